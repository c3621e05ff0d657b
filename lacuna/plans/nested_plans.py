"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.operators import nested
from lacuna.operators.nested import idea_children, idea_tables
from lacuna.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return idea_children(table(spark, d, "ideas_full"))


def p5_ideas(spark: SparkSession, d: str) -> DataFrame:
    return idea_tables(table(spark, d, "ideas_full"))["ideas"]


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    return idea_tables(table(spark, d, "ideas_full"))["evidence"]


def wide_ideas(spark: SparkSession, d: str) -> DataFrame:
    return nested.wide_ideas(table(spark, d, "ideas_full"), keep=("line_no",)).drop("candidate_methods", "critique_history")


QUERIES = {f.__name__: f for f in (p5_found, p5_ideas, p5_evidence, wide_ideas)}

#: Records that can be read, one row each: r (row), idea_id, p (pair), i (idea), t (evidence beside the idea).
_RECORDS = r"""WITH RECURSIVE raw AS (SELECT line_no AS r, regexp_replace(regexp_replace(record, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', '') AS x FROM ideas_full),
    o AS (SELECT r, CAST(x AS JSON) AS j FROM raw WHERE json_valid(x) AND ltrim(x) LIKE '{%'),
    rec AS (SELECT r, TRY_CAST(json_extract_string(j, '$.idea_id') AS BIGINT) AS idea_id, json_extract_string(j, '$.mode') AS mode, json_extract(j, '$.pair') AS p, json_extract(j, '$.evidence_used') AS t,
      CASE WHEN json_type(j, '$.idea') = 'VARCHAR' AND json_valid(json_extract_string(j, '$.idea')) THEN CAST(json_extract_string(j, '$.idea') AS JSON) ELSE json_extract(j, '$.idea') END AS i FROM o WHERE TRY_CAST(json_extract_string(j, '$.idea_id') AS BIGINT) IS NOT NULL),"""
#: Values inside the evidence, level by level, with the way to each; what opens no further is an item.
_ITEMS = r"""    v(r, idea_id, way, x) AS (SELECT r, idea_id, CAST([] AS INTEGER[]), CASE WHEN json_type(i, '$.evidence_used') IS NULL OR json_type(i, '$.evidence_used') = 'NULL' THEN t ELSE json_extract(i, '$.evidence_used') END FROM rec
      UNION ALL SELECT r, idea_id, list_append(way, CAST(n AS INTEGER)), y FROM (SELECT r, idea_id, way, unnest(c) AS y, unnest(range(len(c))) AS n FROM
        (SELECT r, idea_id, way, CASE WHEN json_type(x) = 'ARRAY' THEN json_extract(x, '$[*]') WHEN json_type(x) = 'VARCHAR' AND regexp_matches(json_extract_string(x, '$'), '^\s*[\[{]') AND json_valid(json_extract_string(x, '$')) THEN [CAST(json_extract_string(x, '$') AS JSON)]
          WHEN json_type(x) = 'OBJECT' AND len(list_intersect(json_keys(x), ['paper_id', 'paperId', 'paper', 'gap_sentence', 'span'])) = 0 AND len(list_filter(json_extract(x, '$.*'), lambda z: json_type(z) NOT IN ('OBJECT', 'ARRAY'))) = 0 THEN json_extract(x, '$.*') END AS c FROM v WHERE x IS NOT NULL) WHERE c IS NOT NULL)),
    leaf AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY way) - 1 AS n FROM v WHERE x IS NOT NULL AND json_type(x) <> 'ARRAY'
      AND NOT (json_type(x) = 'VARCHAR' AND regexp_matches(json_extract_string(x, '$'), '^\s*[\[{]') AND json_valid(json_extract_string(x, '$')))
      AND NOT (json_type(x) = 'OBJECT' AND len(list_intersect(json_keys(x), ['paper_id', 'paperId', 'paper', 'gap_sentence', 'span'])) = 0 AND len(list_filter(json_extract(x, '$.*'), lambda z: json_type(z) NOT IN ('OBJECT', 'ARRAY'))) = 0)),
    ev AS (SELECT r, idea_id, CAST(n AS INTEGER) AS n, trim(coalesce(json_extract_string(x, '$.paper_id'), json_extract_string(x, '$.paperId'), json_extract_string(x, '$.paper.id'), json_extract_string(x, '$.paper.paper_id'), '')) AS ref FROM leaf)"""

SQL: dict[str, str] = {
    "p5_found": f"""{_RECORDS}
{_ITEMS},
    pr AS (SELECT idea_id, unnest(CASE WHEN json_type(p) = 'ARRAY' THEN [json_extract_string(p, '$[0]'), json_extract_string(p, '$[1]')] ELSE [coalesce(json_extract_string(p, '$.cluster_a'), json_extract_string(p, '$.a.cluster_id')), coalesce(json_extract_string(p, '$.cluster_b'), json_extract_string(p, '$.b.cluster_id'))] END) AS ref, unnest([0, 1]) AS n FROM rec)
    SELECT DISTINCT idea_id, 'pair' AS child, CAST(n AS INTEGER) AS child_no, trim(ref) AS ref FROM pr WHERE trim(ref) <> '' UNION SELECT idea_id, 'idea', 0, trim(json_extract_string(i, '$.title')) FROM rec WHERE trim(json_extract_string(i, '$.title')) <> '' UNION SELECT idea_id, 'evidence', n, ref FROM ev WHERE ref <> ''""",
    "p5_ideas": f"""{_RECORDS}
{_ITEMS},
    c AS (SELECT r, count(*) AS n FROM leaf GROUP BY r)
    SELECT idea_id, max(trim(json_extract_string(i, '$.title'))) AS title, max(mode) AS mode, CAST(max(coalesce(n, 0)) AS INTEGER) AS n_items FROM rec LEFT JOIN c USING (r) GROUP BY idea_id""",
    "p5_evidence": f"""{_RECORDS}
{_ITEMS}
    SELECT DISTINCT idea_id, n AS ordinal, ref AS paper_id FROM ev WHERE ref <> ''""",
    "wide_ideas": r"""WITH raw AS (SELECT line_no, regexp_replace(regexp_replace(record, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', '') AS x FROM ideas_full), o AS (SELECT line_no, CAST(x AS JSON) AS j FROM raw WHERE json_valid(x) AND ltrim(x) LIKE '{%'),
    i AS (SELECT line_no, j, TRY_CAST(json_extract_string(j, '$.idea_id') AS BIGINT) AS idea_id, CASE WHEN json_type(j, '$.idea') = 'VARCHAR' THEN CAST(json_extract_string(j, '$.idea') AS JSON) ELSE json_extract(j, '$.idea') END AS i FROM o)
    SELECT line_no, idea_id, json_extract_string(j, '$.mode') AS mode, coalesce(json_extract_string(j, '$.pair.label_a'), json_extract_string(j, '$.pair.a.label')) AS label_a, coalesce(json_extract_string(j, '$.pair.label_b'), json_extract_string(j, '$.pair.b.label')) AS label_b,
    """
    + ", ".join(f"trim(json_extract_string(i, '$.{f}')) AS {f}" for f in nested.IDEA_FIELDS)
    + r""", TRY_CAST(json_extract_string(i, '$.confidence') AS DOUBLE) AS idea_confidence, TRY_CAST(json_extract_string(j, '$.novelty.novelty_score') AS DOUBLE) AS novelty_score, TRY_CAST(json_extract_string(j, '$.novelty.max_similarity') AS DOUBLE) AS max_similarity, TRY_CAST(json_extract_string(j, '$.novelty.n_hits') AS INTEGER) AS n_hits,
    json_extract_string(j, '$.novelty.closest_paper.paperId') AS closest_paper_id, json_extract_string(j, '$.novelty.closest_paper.title') AS closest_title, TRY_CAST(json_extract_string(j, '$.novelty.closest_paper.year') AS INTEGER) AS closest_year,
    CAST(coalesce(json_array_length(j, '$.candidate_methods'), 0) AS INTEGER) AS n_methods, CAST(coalesce(json_array_length(j, '$.critique_history'), 0) AS INTEGER) AS n_critiques FROM i WHERE idea_id IS NOT NULL""",
}
