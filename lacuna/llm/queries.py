"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import abuse, clusters, consensus, mixing, nearest, neardup, scans, tokens
from lacuna.llm.skew import group_pairs
from lacuna.operators import nested
from lacuna.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    m = cut(clusters.similarity_clusters(table(spark, d, "gaps").select("gap_idx", "embedding")).select(F.col("id").cast("int").alias("gap"), "grp"))
    return group_pairs(m, None, "gap", "grp", "gap_a", "gap_b")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gaps")
    return clusters.cluster_report(g, clusters.similarity_clusters(g.select("gap_idx", "embedding")))


def _scan_rows(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gaps").select(F.lit("gaps").alias("src"), F.col("gap_idx").cast("int").alias("rec"), F.col("paragraph_text").alias("text"))
    return g.unionByName(table(spark, d, "bench_papers").select(F.lit("bench_papers").alias("src"), F.col("bench_idx").cast("int").alias("rec"), F.col("full_text").alias("text")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(scans.find_repairs(_scan_rows(spark, d)))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _scan_rows(spark, d)
    return scans.repaired(rows, scans.find_repairs(rows))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = neardup.near_texts(table(spark, d, "gaps").select("gap_idx", "gap_sentence", "paragraph_text"))
    return neardup.near_pairs(links, members).select(F.col("gap_a").cast("int").alias("gap_a"), F.col("gap_b").cast("int").alias("gap_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    links, members = neardup.near_texts(table(spark, d, "gaps").select("gap_idx", "gap_sentence", "paragraph_text"))
    return neardup.near_groups(links, members)


def idea_features(ideas: DataFrame) -> DataFrame:
    """``item, features`` of every idea: how sure and how new it calls itself, how long its parts are, and how much stands behind it; what is missing counts 0."""
    size = lambda c, typical: F.log1p(F.coalesce(F.length(c), F.lit(0))) - F.log1p(F.lit(typical))
    less = lambda c, middle: F.coalesce(F.col(c) - middle, F.lit(0.0))
    x = F.array(less("idea_confidence", 0.5), less("novelty_score", 0.5), size("title", 60), size("method_sketch", 150), size("evaluation_plan", 150), F.least("n_methods", F.lit(5)) / 5.0, F.least("n_critiques", F.lit(5)) / 5.0, F.col("falsifiable_prediction").isNotNull().cast("double"), F.col("named_baseline").isNotNull().cast("double"))
    return nested.wide_ideas(ideas).select(F.col("idea_id").alias("item"), x.alias("features"))


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, consensus.Panel | None]:
    labels = consensus.long_labels(table(spark, d, "panel_scores"))
    return labels, consensus.fit(labels, idea_features(table(spark, d, "ideas_full")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, panel = _panel(spark, d)
    if panel is None:
        return spark.createDataFrame([], "idea_id bigint, axis string, score int")
    return consensus.consensus(panel).select(F.col("item").alias("idea_id"), "axis", "score")


def p4_judges(spark: SparkSession, d: str) -> DataFrame:
    _, panel = _panel(spark, d)
    kind = "judge string, axis string, accuracy double, information_bits double"
    return spark.createDataFrame([] if panel is None else consensus.reliability(panel), kind)


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(consensus.long_labels(table(spark, d, "panel_scores")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    r = nearest.nearest(table(spark, d, "gaps").select("gap_idx", "embedding"), table(spark, d, "methods").select("method_idx", "embedding"))
    return r.select(F.col("qid").cast("int").alias("method_idx"), F.col("id").cast("int").alias("gap_idx"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return abuse.score_documents(docs, abuse.fit_model(docs, table(spark, d, "doc_labels")), keep=("source",))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("score > 0").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_text, p3_found, p3_groups, p4_found, p4_judges, p4_agreement, p6_found, p7_ids, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)
}

_VALID = r"CASE WHEN regexp_full_match({c}, '\s*[1-5](\.0*)?\s*(/\s*5(\.0*)?)?\s*') THEN CAST(regexp_extract({c}, '[1-5]') AS INTEGER) END"

SQL: dict[str, str] = {
    "p4_agreement": "WITH p AS (SELECT DISTINCT idea_id, judge, novelty, specificity, feasibility, evidence_grounding, overall_critique, scored_at FROM panel_scores), l AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS axis, idea_id, {_VALID.format(c=a)} AS y FROM p" for a in consensus.AXES)
    + "), i AS (SELECT axis, idea_id, CAST(count(y) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s, CAST(sum(y * y) AS DOUBLE) AS q FROM l GROUP BY ALL HAVING count(y) >= 2),"
    " t AS (SELECT axis, count(*) AS n_items, sum(n) AS n, sum((n * q - s * s) * 2 / (n - 1)) AS w, sum(s) AS s, sum(q) AS q FROM i GROUP BY axis)"
    " SELECT axis, n_items, CAST(n AS BIGINT) AS n_labels, round(1 - w / ((n * q - s * s) * 2 / (n - 1)), 6) AS alpha FROM t",
    "p3_found": """WITH w AS (SELECT gap_idx, list_distinct(regexp_extract_all(lower(gap_sentence), '[a-z0-9]+')) AS s, list_distinct(regexp_extract_all(lower(paragraph_text), '[a-z0-9]+')) AS p FROM gaps WHERE gap_sentence <> '' AND paragraph_text <> ''),
    ok AS (SELECT * FROM w WHERE len(s) > 0 AND len(p) > 0),
    t AS (SELECT gap_idx, unnest(s) AS x FROM ok), n AS (SELECT a.gap_idx AS gap_a, b.gap_idx AS gap_b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.gap_idx < b.gap_idx GROUP BY 1, 2),
    c AS (SELECT gap_a, gap_b, a.p AS pa, b.p AS pb FROM n JOIN ok a ON a.gap_idx = gap_a JOIN ok b ON b.gap_idx = gap_b WHERE c >= 0.6 * (len(a.s) + len(b.s) - c) - 1e-9)
    SELECT gap_a, gap_b FROM c WHERE len(list_intersect(pa, pb)) >= 0.75 * (len(pa) + len(pb) - len(list_intersect(pa, pb))) - 1e-9""",
    "p6_found": """WITH g AS (SELECT gap_idx, list_transform(e, lambda x: x / n) AS v FROM (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM (SELECT gap_idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM gaps WHERE embedding IS NOT NULL)) WHERE n > 0), m AS (SELECT method_idx, list_transform(e, lambda x: x / n) AS v FROM (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM (SELECT method_idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM methods WHERE embedding IS NOT NULL)) WHERE n > 0)
    SELECT method_idx, gap_idx FROM (SELECT method_idx, gap_idx, row_number() OVER (PARTITION BY method_idx ORDER BY round(list_dot_product(m.v, g.v), 6) DESC, gap_idx) AS r FROM m CROSS JOIN g) WHERE r <= 5""",
}
