"""Queries over rows: cleaning, selection, joins, sets, sampling, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import numeric, records, text
from lacuna.operators import rows, sections, themes
from lacuna.session import table

#: The labels of a clustering run are not among the tables; gaps are put to 40 clusters and noise (-1) by their number.
CLUSTER = "CAST(gap_idx % 41 - 1 AS INTEGER)"
G = f"g AS (SELECT *, {CLUSTER} AS cluster_id FROM gaps)"
STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_line = lambda c: STRIP.format(c=f"replace({c}, chr(10), ' ')")


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gaps").withColumn("cluster_id", F.expr(CLUSTER))


def clean_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rows.clean_statements(table(spark, d, "gaps"), "gap_sentence", "gap_idx").select("gap_idx", "id", "gap_type", "section_type", "gap_sentence", "paragraph_text", "confidence")


def clean_methods(spark: SparkSession, d: str) -> DataFrame:
    return rows.clean_statements(table(spark, d, "methods"), "method_sentence", "method_idx", least_length=25).select("method_idx", "id", "method_type", "method_sentence", "confidence")


def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return rows.keep_first(table(spark, d, "papers").where("id is not null"), ["id"], F.asc_nulls_last("year"), F.asc_nulls_last("citation_count"), F.asc_nulls_last("venue"), F.asc_nulls_last("title"))


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return rows.unseen(table(spark, d, "papers").select("id").where("id is not null").distinct(), table(spark, d, "gaps"))


def semi_join_papers(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "papers").where("citation_count >= 50").select("id")
    return table(spark, d, "gaps").join(cited, "id", "left_semi").select("gap_idx", "id", "gap_type")


def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "cluster_labels")
    return gaps(spark, d).join(labels, "cluster_id", "left").select("gap_idx", "cluster_id", F.coalesce("theme_label", F.lit("")).alias("theme_label"))


def full_outer_delta(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gaps").where("id is not null").groupBy("id").agg(F.round(F.avg("confidence"), 6).alias("gap_confidence"))
    b = table(spark, d, "methods").where("id is not null").groupBy("id").agg(F.round(F.avg("confidence"), 6).alias("method_confidence"))
    return a.join(b, "id", "full_outer").withColumn("delta", F.round(F.col("method_confidence") - F.col("gap_confidence"), 6))


def union_schema_drift(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gaps").select("id", F.col("gap_sentence").alias("sentence"), "gap_type", "confidence")
    m = table(spark, d, "methods").select("id", F.col("method_sentence").alias("sentence"), "method_type", "confidence")
    return g.unionByName(m, allowMissingColumns=True)


def top_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return rows.top_per_group(gaps(spark, d).where("cluster_id <> -1"), ["cluster_id"], 3, F.desc_nulls_last("confidence"), "gap_idx", rank="rank").select("cluster_id", "gap_idx", "confidence", "rank")


def sections_capped(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("paper_id is not null")
    return rows.top_per_group(t, ["paper_id"], 2, sections.priority(F.col("section_type")), "doc_id", rank="rank").select("paper_id", "doc_id", "section_type", "rank")


def paper_assembly(spark: SparkSession, d: str) -> DataFrame:
    r = sections.paper_text(table(spark, d, "documents").where("section_type is not null"), "paper_id", "doc_id", text="text")
    return r.select("paper_id", "text", F.length("text").alias("n_chars"), "dominant")


def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gaps").groupBy(F.coalesce("section_type", F.lit("")).alias("section_type")).agg(F.count(F.lit(1)).alias("n")).withColumn("ord", sections.priority(F.col("section_type")))


def ids_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gaps").select("id").union(table(spark, d, "methods").select("id")).distinct().where("id is not null")


def ids_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gaps").select("id").intersect(table(spark, d, "methods").select("id")).where("id is not null")


def ids_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gaps").select("id").where("id is not null").exceptAll(table(spark, d, "methods").select("id")).distinct()


def sorted_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gaps").select(F.trim("id").alias("id")).where("id is not null and id <> ''").distinct().orderBy("id")


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return rows.seeded_sample(table(spark, d, "gaps").select(F.col("gap_idx"), "gap_type"), "gap_idx", 100)


def title_chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("id is not null").groupBy("id").agg(F.min("title").alias("title"))
    g = table(spark, d, "gaps").where("id is not null").select("id").distinct()
    h = table(spark, d, "documents").where("paper_id is not null").groupBy(F.col("paper_id").alias("id")).agg(F.min(F.nullif("heading", F.lit(""))).alias("heading"))
    return g.join(p, "id", "left").join(h, "id", "left").select("id", F.coalesce("title", "heading", "id").alias("shown"))


def share_of_max(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "gaps").where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return rows.share_of_max(n, "n", "share").withColumn("share", F.round("share", 6))


def candidates_by_size(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).where("cluster_id <> -1").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_items")).orderBy(F.desc("n_items"), "cluster_id").limit(10)


def flat_papers(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "papers")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return t.select(*[blank(c) for c in ("id", "title", "year", "venue", "citation_count")])


def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    bin_ = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int")
    return table(spark, d, "gaps").where("confidence is not null").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c: table(spark, d, t).agg(c)
    return (
        one("papers", F.countDistinct("id").alias("n_papers"))
        .crossJoin(one("gaps", F.count(F.lit(1)).alias("n_gaps")))
        .crossJoin(one("cluster_labels", F.count(F.lit(1)).alias("n_themes")))
        .crossJoin(one("panel_scores", F.countDistinct("idea_id").alias("n_ideas")))
    )


def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return themes.cluster_summary(gaps(spark, d), table(spark, d, "cluster_labels"))


def theme_drilldown(spark: SparkSession, d: str) -> DataFrame:
    g = gaps(spark, d).where("cluster_id <> -1 and id is not null")
    return g.groupBy("cluster_id", "id").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("confidence").alias("max_confidence"), F.array_join(F.array_sort(F.collect_set("gap_type")), ",").alias("types"))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").where(F.lower("title").rlike("learning|network|transfer") & (F.col("year") >= 2035)).select("id", "title", "year").distinct()


def modes_overlap(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "methods").where("id is not null and method_type is not null").groupBy("id").agg(F.array_sort(F.collect_set("method_type")).alias("kinds"))
    return kinds.where(F.arrays_overlap("kinds", F.array(F.lit("dataset"), F.lit("benchmark")))).select("id", F.array_join("kinds", " ").alias("kinds"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.words(t)).alias("n_words"), F.md5(text.first_words(t, 50)).alias("head"), F.md5(text.last_words(t, 50)).alias("tail"))


def tail_fallback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sections.tail_text(F.col("text")).alias("tail")).where("tail is not null").select("doc_id", F.md5("tail").alias("tail"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("gap_sentence", F.lit(""))
    return table(spark, d, "gaps").select(
        "gap_idx",
        F.length(t).alias("n"),
        F.substring(t, 1, 100).alias("prefix"),
        text.file_stem(t).alias("stem"),
        text.shorten(F.coalesce("id", F.lit(""))).alias("short_id"),
        text.escape_tex(F.coalesce("paragraph_text", F.lit(""))).alias("tex"),
        F.array_join(text.token_set(t), " ").alias("tokens"),
        F.round(text.caps_share(t), 6).alias("caps"),
    )


def structured_sections(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bench_papers").select("bench_idx", "full_text")
    return sections.structured_sections(t, "bench_idx", "full_text").select("bench_idx", "section_type", "heading", F.length("section_text").alias("n_chars"), F.md5("section_text").alias("body"))


def section_cascade(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bench_papers").select("bench_idx", "full_text")
    return sections.sections(t, "bench_idx", "full_text").select("bench_idx", "section_type", "heading", F.length("section_text").alias("n_chars"))


def gold_titles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bench_papers").where((F.length("gold_section_text") >= 200) & (F.length("full_text") >= 4000))
    return t.select("bench_idx", F.size("gold_section_titles").alias("n_titles"), F.array_join(F.array_distinct("gold_section_titles"), "; ").alias("titles"))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.to_date("ts").cast("string").alias("day"))


def array_functions(spark: SparkSession, d: str) -> DataFrame:
    w = text.words(F.coalesce("gap_sentence", F.lit("")))
    return table(spark, d, "gaps").select("gap_idx", F.size(w).alias("n"), F.try_element_at(w, F.lit(-1)).alias("last"), F.array_join(F.array_distinct(F.transform(F.slice(w, 1, 6), F.lower)), " ").alias("first_distinct"))


def type_shares_map(spark: SparkSession, d: str) -> DataFrame:
    from lacuna.operators.graph import type_shares

    return type_shares(gaps(spark, d)).withColumn("share", F.round("share", 6))


def year_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Years of the extraction times, read from how a mail header writes them."""
    t = table(spark, d, "gaps").select("gap_idx", F.date_format("extracted_at", "E, d MMM yyyy HH:mm:ss 'GMT'").alias("created"))
    return t.select("gap_idx", records.year_token(F.col("created")).alias("year"))


def half_even_scores(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "gaps").select("gap_idx", (F.col("confidence") * 10).alias("x"))
    return t.select("gap_idx", numeric.whole("x").alias("score"))


def nulls_last_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("id", "citation_count").distinct().orderBy(F.desc_nulls_last("citation_count"), "id").limit(50)


def row_by_ordinal(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "panel_scores").select("idea_id").distinct()
    return rows.numbered(one, "idea_id", name="ordinal").where("ordinal = 7").select("idea_id", F.col("ordinal").cast("int").alias("ordinal"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_gaps, clean_methods, dedupe_keep_first, resume_anti_join, semi_join_papers, label_lookup, full_outer_delta, union_schema_drift, top_per_cluster,
        sections_capped, paper_assembly, section_counts, ids_union, ids_intersect, ids_except, sorted_ids, seeded_sample, title_chain, share_of_max,
        candidates_by_size, flat_papers, confidence_histogram, corpus_counts, cluster_summary, theme_drilldown, metadata_filter, modes_overlap, sentence_split,
        token_counts, word_windows, tail_fallback, text_functions, structured_sections, section_cascade, gold_titles, json_fields, array_functions,
        type_shares_map, year_tokens, half_even_scores, nulls_last_order, row_by_ordinal,
    )
}

_PRIO = "CASE {c} WHEN 'limitations' THEN 1 WHEN 'future_work' THEN 2 WHEN 'discussion' THEN 3 WHEN 'fallback' THEN 4 WHEN 'tail' THEN 5 ELSE 99 END"
_WORDS = r"list_filter(regexp_split_to_array({c}, '[\s\p{{Z}}]+'), lambda x: x <> '')"
_TEX = "coalesce(array_to_string([" + "CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.TEX_SIGNS.items()) + " ELSE c END for c in string_split(coalesce(paragraph_text, ''), '')], ''), '')"
#: Parts of papers from one heading to the next, before the references, with title, body and kind.
_SECTIONS = r"""t AS (SELECT bench_idx, regexp_replace(full_text, '(?ims)^\s*(references|bibliography)\s*$.*', '') AS t FROM bench_papers WHERE full_text IS NOT NULL),
        m AS (SELECT bench_idx, string_split(regexp_replace(t, '(?m)^\s*(?:\d+(?:\.\d+)*\s+|[IVXLC]+\.\s+)?([A-Z][A-Za-z0-9 &\-/,:]{2,80})\s*$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM t),
        p AS (SELECT bench_idx, unnest(range(1, len(l))) AS ord, unnest(l[2:]) AS x FROM m),
        h AS (SELECT bench_idx, ord, regexp_replace(split_part(x, chr(2), 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS heading, regexp_replace(split_part(x, chr(2), 2), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS body FROM p),
        k AS (SELECT *, CASE WHEN regexp_matches(heading, '(?i)\b(limitations?|threats to validity|caveats?|shortcomings?|weaknesses?|drawbacks?)\b') THEN 'limitations'
          WHEN regexp_matches(heading, '(?i)\b(future work|future directions?|future research|outlook|next steps?|further work|further research|open (problems?|questions?|issues?)|extensions?|what['']?s next)\b') THEN 'future_work'
          WHEN regexp_matches(heading, '(?i)\b(discussion|conclusions?)\b') THEN 'discussion' END AS section_type FROM h
          WHERE length(body) >= 200 AND 1 - length(regexp_replace(body, '[\s.…·\-_]', '', 'g')) / length(body) <= 0.45),
        s AS (SELECT * FROM k WHERE section_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bench_idx, section_type, substring(body, 1, 100) ORDER BY ord) = 1)"""

SQL: dict[str, str] = {
    "clean_gaps": f"""WITH c AS (SELECT gap_idx, id, gap_type, coalesce(section_type, '') AS section_type, {_line('gap_sentence')} AS gap_sentence, {_line('paragraph_text')} AS paragraph_text, coalesce(confidence, 0) AS confidence FROM gaps)
        SELECT * FROM c WHERE confidence >= 0.5 AND length(gap_sentence) >= 20 QUALIFY row_number() OVER (PARTITION BY id, gap_sentence ORDER BY gap_idx) = 1""",
    "clean_methods": f"""WITH c AS (SELECT method_idx, id, method_type, {_line('method_sentence')} AS method_sentence, coalesce(confidence, 0) AS confidence FROM methods)
        SELECT * FROM c WHERE confidence >= 0.5 AND length(method_sentence) >= 25 QUALIFY row_number() OVER (PARTITION BY id, method_sentence ORDER BY method_idx) = 1""",
    "dedupe_keep_first": "SELECT * FROM papers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY year NULLS LAST, citation_count NULLS LAST, venue NULLS LAST, title NULLS LAST) = 1",
    "resume_anti_join": "SELECT DISTINCT id FROM papers WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM gaps WHERE id IS NOT NULL)",
    "semi_join_papers": "SELECT gap_idx, id, gap_type FROM gaps WHERE id IN (SELECT id FROM papers WHERE citation_count >= 50)",
    "label_lookup": f"WITH {G} SELECT gap_idx, g.cluster_id, coalesce(theme_label, '') AS theme_label FROM g LEFT JOIN cluster_labels l ON g.cluster_id = l.cluster_id",
    "full_outer_delta": """WITH a AS (SELECT id, round(avg(confidence), 6) AS gap_confidence FROM gaps WHERE id IS NOT NULL GROUP BY id), b AS (SELECT id, round(avg(confidence), 6) AS method_confidence FROM methods WHERE id IS NOT NULL GROUP BY id)
        SELECT coalesce(a.id, b.id) AS id, gap_confidence, method_confidence, round(method_confidence - gap_confidence, 6) AS delta FROM a FULL JOIN b ON a.id = b.id""",
    "union_schema_drift": "SELECT id, gap_sentence AS sentence, gap_type, confidence, NULL AS method_type FROM gaps UNION ALL SELECT id, method_sentence, NULL, confidence, method_type FROM methods",
    "top_per_cluster": f"WITH {G}, r AS (SELECT cluster_id, gap_idx, confidence, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC NULLS LAST, gap_idx) AS INTEGER) AS rank FROM g WHERE cluster_id <> -1) SELECT * FROM r WHERE rank <= 3",
    "sections_capped": f"WITH r AS (SELECT paper_id, doc_id, section_type, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY {_PRIO.format(c='section_type')}, doc_id) AS INTEGER) AS rank FROM documents WHERE paper_id IS NOT NULL) SELECT * FROM r WHERE rank <= 2",
    "paper_assembly": f"""WITH s AS (SELECT paper_id, coalesce(text, '') AS t, section_type, {_PRIO.format(c='section_type')} AS p, doc_id FROM documents WHERE section_type IS NOT NULL AND paper_id IS NOT NULL),
        a AS (SELECT paper_id, substring(string_agg(t, chr(10) || chr(10) ORDER BY p, doc_id), 1, 9000) AS text, arg_min(section_type, (p, doc_id)) AS dominant FROM s GROUP BY paper_id) SELECT paper_id, text, CAST(length(text) AS INTEGER) AS n_chars, dominant FROM a""",
    "section_counts": f"SELECT coalesce(section_type, '') AS section_type, count(*) AS n, {_PRIO.format(c='''coalesce(section_type, '')''')} AS ord FROM gaps GROUP BY 1, 3",
    "ids_union": "SELECT id FROM (SELECT id FROM gaps UNION SELECT id FROM methods) WHERE id IS NOT NULL",
    "ids_intersect": "SELECT id FROM (SELECT id FROM gaps INTERSECT SELECT id FROM methods) WHERE id IS NOT NULL",
    "ids_except": """SELECT id FROM (SELECT id, count(*) AS n FROM gaps WHERE id IS NOT NULL GROUP BY id) a LEFT JOIN (SELECT id AS mid, count(*) AS m FROM methods WHERE id IS NOT NULL GROUP BY id) b ON a.id = b.mid WHERE n > coalesce(m, 0)""",
    "sorted_ids": "SELECT DISTINCT trim(id) AS id FROM gaps WHERE id IS NOT NULL AND trim(id) <> '' ORDER BY id",
    "seeded_sample": "SELECT gap_idx, gap_type FROM gaps ORDER BY md5(CAST(gap_idx AS VARCHAR) || '|42'), gap_idx LIMIT 100",
    "title_chain": """WITH p AS (SELECT id, min(title) AS title FROM papers WHERE id IS NOT NULL GROUP BY id), h AS (SELECT paper_id AS id, min(nullif(heading, '')) AS heading FROM documents WHERE paper_id IS NOT NULL GROUP BY 1)
        SELECT g.id, coalesce(title, heading, g.id) AS shown FROM (SELECT DISTINCT id FROM gaps WHERE id IS NOT NULL) g LEFT JOIN p ON g.id = p.id LEFT JOIN h ON g.id = h.id""",
    "share_of_max": "WITH n AS (SELECT id, count(*) AS n FROM gaps WHERE id IS NOT NULL GROUP BY id) SELECT id, n, round(n / max(n) OVER (), 6) AS share FROM n",
    "candidates_by_size": f"WITH {G} SELECT cluster_id, count(*) AS n_items FROM g WHERE cluster_id <> -1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "flat_papers": "SELECT coalesce(id, '') AS id, coalesce(title, '') AS title, coalesce(CAST(year AS VARCHAR), '') AS year, coalesce(venue, '') AS venue, coalesce(CAST(citation_count AS VARCHAR), '') AS citation_count FROM papers",
    "confidence_histogram": "SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM gaps WHERE confidence IS NOT NULL GROUP BY 1",
    "corpus_counts": "SELECT (SELECT count(DISTINCT id) FROM papers) AS n_papers, (SELECT count(*) FROM gaps) AS n_gaps, (SELECT count(*) FROM cluster_labels) AS n_themes, (SELECT count(DISTINCT idea_id) FROM panel_scores) AS n_ideas",
    "cluster_summary": f"""WITH {G}, s AS (SELECT cluster_id, count(*) AS n_items, count(DISTINCT id) AS n_papers, round(avg(confidence), 6) AS avg_conf FROM g WHERE cluster_id <> -1 GROUP BY 1),
        r AS (SELECT cluster_id, gap_sentence, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC NULLS LAST, gap_idx) AS r FROM g WHERE cluster_id <> -1 AND gap_sentence IS NOT NULL),
        e AS (SELECT cluster_id, string_agg(gap_sentence, chr(10) ORDER BY r) AS examples FROM r WHERE r <= 3 GROUP BY 1)
        SELECT s.*, examples, theme_label FROM s LEFT JOIN e ON s.cluster_id = e.cluster_id LEFT JOIN cluster_labels l ON s.cluster_id = l.cluster_id""",
    "theme_drilldown": f"WITH {G} SELECT cluster_id, id, count(*) AS n_gaps, max(confidence) AS max_confidence, string_agg(DISTINCT gap_type, ',' ORDER BY gap_type) AS types FROM g WHERE cluster_id <> -1 AND id IS NOT NULL GROUP BY cluster_id, id",
    "metadata_filter": "SELECT DISTINCT id, title, year FROM papers WHERE regexp_matches(lower(title), 'learning|network|transfer') AND year >= 2035",
    "modes_overlap": "WITH k AS (SELECT id, list_sort(list(DISTINCT method_type)) AS kinds FROM methods WHERE id IS NOT NULL AND method_type IS NOT NULL GROUP BY id) SELECT id, array_to_string(kinds, ' ') AS kinds FROM k WHERE list_has_any(kinds, ['dataset', 'benchmark'])",
    "sentence_split": r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z(\["''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: length(regexp_replace(s, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) >= 10)) AS INTEGER) AS n_sentences FROM documents WHERE text IS NOT NULL""",
    "token_counts": r"SELECT token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\-]{2,}'))) AS token FROM documents) GROUP BY 1 HAVING count(*) >= 5",
    "word_windows": f"WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(w[1:50], ' ')) AS head, md5(array_to_string(w[greatest(len(w) - 49, 1):len(w)], ' ')) AS tail FROM w",
    "tail_fallback": f"WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(w[greatest(len(w) - 899, 1):len(w)], ' ')) AS tail FROM w WHERE len(w) >= 300",
    "text_functions": rf"""WITH s AS (SELECT gap_idx, coalesce(gap_sentence, '') AS t, coalesce(id, '') AS i, {_TEX} AS tex FROM gaps)
        SELECT gap_idx, CAST(length(t) AS INTEGER) AS n, substring(t, 1, 100) AS prefix, substring(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '_', 'g'), 1, 40) AS stem, CASE WHEN length(i) > 14 THEN substring(i, 1, 14) || '…' ELSE i END AS short_id, tex,
        (SELECT coalesce(string_agg(w, ' ' ORDER BY o), '') FROM (SELECT w, min(o) AS o FROM (SELECT lower(unnest(l)) AS w, unnest(range(len(l))) AS o FROM (SELECT list_filter({_WORDS.format(c='t')}, lambda x: length(x) > 3) AS l)) GROUP BY w)) AS tokens,
        round(coalesce(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')), 0), 0), 6) AS caps FROM s""",
    "structured_sections": f"WITH {_SECTIONS} SELECT bench_idx, section_type, heading, CAST(length(body) AS INTEGER) AS n_chars, md5(body) AS body FROM s",
    "section_cascade": f"""WITH {_SECTIONS},
        r AS (SELECT bench_idx, t, {_WORDS.format(c="regexp_extract(t, '(?is)\\b(future work|future directions?|future research|limitations?|threats to validity|further work|open (problems?|questions?|issues?)|conclusions?\\s*(and|&)\\s*(future|open))\\b.*')")} AS w, {_WORDS.format(c='t')} AS a FROM t WHERE bench_idx NOT IN (SELECT bench_idx FROM s)),
        f AS (SELECT bench_idx, array_to_string(w[1:900], ' ') AS win, CASE WHEN len(a) >= 300 THEN array_to_string(a[greatest(len(a) - 899, 1):len(a)], ' ') END AS tail FROM r),
        u AS (SELECT bench_idx, ord, section_type, heading, body FROM s UNION ALL SELECT bench_idx, 0, 'fallback', 'fallback_window', win FROM f WHERE length(win) >= 200 UNION ALL SELECT bench_idx, 0, 'tail', 'tail_window', tail FROM f WHERE coalesce(length(win), 0) < 200 AND tail IS NOT NULL)
        SELECT bench_idx, section_type, heading, CAST(length(body) AS INTEGER) AS n_chars FROM u QUALIFY row_number() OVER (PARTITION BY bench_idx ORDER BY {_PRIO.format(c='section_type')}, ord) <= 2""",
    "gold_titles": "SELECT bench_idx, CAST(len(gold_section_titles) AS INTEGER) AS n_titles, (SELECT coalesce(string_agg(t, '; ' ORDER BY o), '') FROM (SELECT t, min(o) AS o FROM (SELECT unnest(gold_section_titles) AS t, unnest(range(len(gold_section_titles))) AS o) GROUP BY t)) AS titles FROM bench_papers WHERE length(gold_section_text) >= 200 AND length(full_text) >= 4000",
    "json_fields": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
    "array_functions": f"WITH w AS (SELECT gap_idx, {_WORDS.format(c='''coalesce(gap_sentence, '')''')} AS w FROM gaps) SELECT gap_idx, CAST(len(w) AS INTEGER) AS n, w[len(w)] AS last, (SELECT coalesce(string_agg(x, ' ' ORDER BY o), '') FROM (SELECT x, min(o) AS o FROM (SELECT lower(unnest(w[1:6])) AS x, unnest(range(len(w[1:6]))) AS o) GROUP BY x)) AS first_distinct FROM w",
    "type_shares_map": f"WITH {G} SELECT cluster_id, gap_type, round(count(*) / sum(count(*)) OVER (PARTITION BY cluster_id), 6) AS share FROM g GROUP BY 1, 2",
    "year_tokens": "SELECT gap_idx, CAST(year(extracted_at AT TIME ZONE 'UTC') AS INTEGER) AS year FROM gaps",
    "half_even_scores": "SELECT gap_idx, CAST(coalesce(round_even(confidence * 10, 0), 0) AS INTEGER) AS score FROM gaps",
    "nulls_last_order": "SELECT DISTINCT id, citation_count FROM papers ORDER BY citation_count DESC NULLS LAST, id LIMIT 50",
    "row_by_ordinal": "SELECT idea_id, CAST(7 AS INTEGER) AS ordinal FROM (SELECT DISTINCT idea_id FROM panel_scores) ORDER BY idea_id LIMIT 1 OFFSET 7",
}
