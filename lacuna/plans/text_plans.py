"""Queries over words, judges and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.numeric import coerce, whole
from lacuna.operators import nested, panels, textstats
from lacuna.plans.row_plans import CLUSTER, gaps
from lacuna.session import table

AXES = panels.AXES


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """Scores as numbers where they are written as one."""
    return table(spark, d, "panel_scores")


def tfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    return textstats.tfidf_keywords(gaps(spark, d).where("cluster_id <> -1"), "cluster_id", "gap_idx", "gap_sentence")


def cluster_top_words(spark: SparkSession, d: str) -> DataFrame:
    return textstats.top_words(gaps(spark, d), "cluster_id", "gap_sentence")


def topic_coherence(spark: SparkSession, d: str) -> DataFrame:
    return textstats.npmi(gaps(spark, d), "cluster_id", "gap_idx", "gap_sentence")


def rouge1(spark: SparkSession, d: str) -> DataFrame:
    return textstats.rouge_n(table(spark, d, "gaps"), "gap_idx", "gap_sentence", "paragraph_text", 1)


def rouge2(spark: SparkSession, d: str) -> DataFrame:
    return textstats.rouge_n(table(spark, d, "gaps"), "gap_idx", "gap_sentence", "paragraph_text", 2)


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return textstats.rouge_l(table(spark, d, "gaps"), "gap_idx", "gap_sentence", "paragraph_text")


def rouge_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed F of common words, word pairs and the longest common subsequence in one row."""
    g = table(spark, d, "gaps")
    parts = [f(g, "gap_idx", "gap_sentence", "paragraph_text", **more).select("gap_idx", F.col("f").alias(name)) for name, f, more in (("rouge1_f", textstats.rouge_n, {"n": 1, "stem": True}), ("rouge2_f", textstats.rouge_n, {"n": 2, "stem": True}), ("rougeL_f", textstats.rouge_l, {"stem": True}))]
    return parts[0].join(parts[1], "gap_idx").join(parts[2], "gap_idx")


def keyword_labels(spark: SparkSession, d: str) -> DataFrame:
    return textstats.keyword_labels(gaps(spark, d), "cluster_id", "gap_idx", "gap_sentence")


def panel_consensus(spark: SparkSession, d: str) -> DataFrame:
    return panels.panel_consensus(_panel(spark, d))


def panel_agreement(spark: SparkSession, d: str) -> DataFrame:
    return panels.panel_agreement(_panel(spark, d))


def judge_composite(spark: SparkSession, d: str) -> DataFrame:
    scores = [whole(a) for a in AXES]
    return _panel(spark, d).select("score_id", F.round(sum(s.cast("double") for s in scores) / len(AXES), 6).alias("composite"))


def unpivoted_axes(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).select("score_id", *AXES).unpivot("score_id", list(AXES), "axis", "raw")


def metric_mean_std(spark: SparkSession, d: str) -> DataFrame:
    x = _panel(spark, d).select("judge", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), coerce(a, None).alias("value")) for a in AXES])))
    return x.where("value is not null").groupBy("judge", "axis").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count("value").alias("n"))


def judge_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = metric_mean_std(spark, d).select("judge", "axis", "mean")
    return x.groupBy("judge").pivot("axis", list(AXES)).agg(F.first("mean"))


def complete_pivot(spark: SparkSession, d: str) -> DataFrame:
    return judge_pivot(spark, d).na.drop("any")


def metric_slice(spark: SparkSession, d: str) -> DataFrame:
    return metric_mean_std(spark, d).where("judge = 'judge_05' and axis = 'novelty'")


def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    return p.where((coerce("novelty") >= 4) & (coerce("feasibility") >= 4)).select("score_id", "idea_id", "judge").orderBy("score_id")


def library_means(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).agg(*[F.round(F.avg(coerce(a, None)), 6).alias(a) for a in AXES], F.count(F.lit(1)).alias("n"))


def testable_statements(spark: SparkSession, d: str) -> DataFrame:
    """The gate on every readable idea record."""
    i = nested.wide_ideas(table(spark, d, "ideas_full"), keep=("line_no",))
    return i.select("line_no", "idea_id", panels.testable(F.col("falsifiable_prediction"), F.col("named_baseline")).alias("passed"))


def verdict_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules on the judges' own columns: a score of 4 or more is a yes, 3 a partial, anything else a no."""
    p = _panel(spark, d)
    nov, spec, feas, ground = (coerce(a) for a in AXES)
    verdict = F.when(nov >= 4, "yes").when(nov >= 3, "partial").otherwise("no")
    settled = panels.settled_verdict(verdict, whole("feasibility"), spec >= 2, (5 - ground) / 5, feas >= 2)
    gate = panels.worth_running(spec / 5, F.when(nov >= 4, "accept").when(nov >= 2, "revise").otherwise("reject"), ground)
    flags = F.array_join(panels.critic_flags(ground / 5, nov / 5), ",")
    return p.select("score_id", settled.alias("verdict"), gate.alias("gate"), flags.alias("flags"))


def evidence_overlap(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "methods").where("id is not null").select("id", F.lit("x").alias("k"), F.col("paragraph_text").alias("s"))
    g = table(spark, d, "gaps").where("id is not null").select("id", F.lit("x").alias("k"), F.col("paragraph_text").alias("s"))
    return panels.evidence_overlap(g, m.unionByName(g.where("s like '%a%'")), "id", "k", "s")


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Relational smoke test: four joins and an aggregate."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_keywords, cluster_top_words, topic_coherence, keyword_labels, rouge1, rouge2, rouge_l, rouge_stemmed, panel_consensus, panel_agreement, judge_composite, unpivoted_axes,
        metric_mean_std, judge_pivot, complete_pivot, metric_slice, quality_filter, library_means, testable_statements, verdict_rules, evidence_overlap, revenue_by_nation,
    )
}

_STOP = ", ".join(f"'{w}'" for w in textstats.STOP)
_TOK = r"regexp_extract_all({c}, '[A-Za-z][A-Za-z\-]{{2,}}')"
_COHERENCE_STOP = "'that', 'with', 'this', 'from', 'have', 'into', 'such', 'their', 'these', 'than', 'when', 'which', 'would', 'where', 'while', 'been', 'more', 'most', 'some', 'what', 'thus', 'they', 'them', 'also', 'since', 'between', 'based', 'using'"
_TOPIC = "list_filter(list_transform(" + _TOK + ", lambda x: lower(x)), lambda w: length(w) >= 4 AND w NOT IN (" + _COHERENCE_STOP + "))"
_TERMS = r"list_filter(list_transform(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: lower(x)), lambda w: w NOT IN (" + _STOP + "))"
_G = f"g AS (SELECT *, {CLUSTER} AS cluster_id FROM gaps)"
_TOP = f"tw AS (SELECT cluster_id, unnest({_TOPIC.format(c='gap_sentence')}) AS word FROM g WHERE cluster_id <> -1), tn AS (SELECT cluster_id, word, count(*) AS n FROM tw GROUP BY 1, 2), tops AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM tn QUALIFY rank <= 10)"
_NUM = "CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END"
_LONG = " UNION ALL ".join(f"SELECT judge, '{a}' AS axis, {_NUM.format(c=a)} AS value FROM panel_scores" for a in AXES)
_MS = f"l AS ({_LONG}), ms AS (SELECT judge, axis, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2)"


def _rouge(n: int) -> str:
    grams = "w" if n == 1 else "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    side = lambda c: f"(SELECT gap_idx, g, count(*) AS n FROM (SELECT gap_idx, unnest({grams}) AS g FROM (SELECT gap_idx, regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+') AS w FROM gaps)) GROUP BY 1, 2)"
    return f"""WITH p AS {side('gap_sentence')}, q AS {side('paragraph_text')}, b AS (SELECT coalesce(p.gap_idx, q.gap_idx) AS gap_idx, coalesce(p.n, 0) AS p, coalesce(q.n, 0) AS q FROM p FULL JOIN q ON p.gap_idx = q.gap_idx AND p.g = q.g),
        s AS (SELECT gap_idx, sum(least(p, q)) AS m, sum(p) AS np, sum(q) AS nq FROM b GROUP BY 1), r AS (SELECT g.gap_idx, coalesce(m / nullif(np, 0), 0) AS p, coalesce(m / nullif(nq, 0), 0) AS r FROM gaps g LEFT JOIN s ON g.gap_idx = s.gap_idx)
        SELECT gap_idx, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f FROM r"""


_KEYWORDS = f"""WITH {_G}, d AS (SELECT cluster_id, gap_idx, {_TERMS.format(c='gap_sentence')} AS w FROM g WHERE cluster_id <> -1 AND gap_sentence IS NOT NULL),
        t AS (SELECT cluster_id, gap_idx, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM d), tf AS (SELECT cluster_id, gap_idx, term, count(*) AS tf FROM t GROUP BY ALL),
        nd AS (SELECT cluster_id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2), per AS (SELECT cluster_id, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY sum(tf) DESC, term) <= 2000),
        x AS (SELECT tf.cluster_id, gap_idx, tf.term, n, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN per ON tf.cluster_id = per.cluster_id AND tf.term = per.term JOIN nd ON tf.cluster_id = nd.cluster_id),
        l AS (SELECT cluster_id, gap_idx, sqrt(sum(x * x)) AS l FROM x GROUP BY 1, 2), m AS (SELECT x.cluster_id, term, round(sum(x / l) / max(n), 6) AS score FROM x JOIN l ON x.cluster_id = l.cluster_id AND x.gap_idx = l.gap_idx GROUP BY 1, 2)
        SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS INTEGER) AS rank FROM m QUALIFY rank <= 8"""

SQL: dict[str, str] = {
    "tfidf_keywords": _KEYWORDS,
    "keyword_labels": "WITH k AS (" + _KEYWORDS + f") SELECT c.cluster_id, coalesce(string_agg(term, ', ' ORDER BY rank), '') AS keywords FROM (SELECT DISTINCT {CLUSTER} AS cluster_id FROM gaps WHERE {CLUSTER} <> -1) c LEFT JOIN k ON c.cluster_id = k.cluster_id GROUP BY 1",
    "cluster_top_words": f"WITH {_G}, {_TOP} SELECT * FROM tops",
    "topic_coherence": f"""WITH {_G}, {_TOP}, nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM gaps), h AS (SELECT DISTINCT gap_idx, lower(unnest({_TOK.format(c='gap_sentence')})) AS word FROM gaps), f AS (SELECT word, count(*) AS df FROM h WHERE word IN (SELECT word FROM tops) GROUP BY 1),
        p AS (SELECT a.cluster_id, a.word AS w1, b.word AS w2 FROM tops a JOIN tops b ON a.cluster_id = b.cluster_id AND a.word < b.word), m AS (SELECT w1, w2, count(*) AS n_both FROM (SELECT DISTINCT w1, w2 FROM p) JOIN h a ON a.word = w1 JOIN h b ON b.word = w2 AND a.gap_idx = b.gap_idx GROUP BY 1, 2)
        SELECT cluster_id, round(avg(CASE WHEN n_both = n THEN 1 ELSE ln(n_both * n / (x.df * y.df)) / -ln(n_both / n) END), 6) AS npmi FROM p JOIN m ON p.w1 = m.w1 AND p.w2 = m.w2 JOIN f x ON x.word = p.w1 JOIN f y ON y.word = p.w2 CROSS JOIN nn GROUP BY 1""",
    "rouge1": _rouge(1),
    "rouge2": _rouge(2),
    "panel_consensus": "WITH m AS (SELECT idea_id, "
    + ", ".join(f"round(avg({_NUM.format(c=a)}), 6) AS {a}" for a in AXES)
    + ", count(DISTINCT judge) AS n_judges, arg_min(overall_critique, (-length(overall_critique), judge, overall_critique)) AS critique FROM panel_scores GROUP BY 1) SELECT *, round(("
    + " + ".join(f"coalesce({a}, 0)" for a in AXES)
    + ") / 4, 6) AS composite FROM m",
    "panel_agreement": "WITH s AS (SELECT idea_id, "
    + ", ".join(f"CASE WHEN count({_NUM.format(c=a)}) >= 2 THEN stddev_pop({_NUM.format(c=a)}) END AS {a}" for a in AXES)
    + " FROM panel_scores GROUP BY 1), a AS (SELECT idea_id, list_avg(list_filter(["
    + ", ".join(AXES)
    + "], lambda x: x IS NOT NULL)) AS m FROM s) SELECT idea_id, round(CASE WHEN m IS NULL THEN 1 ELSE greatest(0, 1 - m / 4) END, 6) AS agreement FROM a",
    "judge_composite": "SELECT score_id, round((" + " + ".join(f"coalesce(round_even({_NUM.format(c=a)}, 0), 0)" for a in AXES) + ") / 4, 6) AS composite FROM panel_scores",
    "unpivoted_axes": " UNION ALL ".join(f"SELECT score_id, '{a}' AS axis, {a} AS raw FROM panel_scores" for a in AXES),
    "metric_mean_std": f"WITH {_MS} SELECT * FROM ms",
    "judge_pivot": f"WITH {_MS} SELECT judge, " + ", ".join(f"max(mean) FILTER (axis = '{a}') AS {a}" for a in AXES) + " FROM ms GROUP BY 1",
    "complete_pivot": f"WITH {_MS}, p AS (SELECT judge, " + ", ".join(f"max(mean) FILTER (axis = '{a}') AS {a}" for a in AXES) + " FROM ms GROUP BY 1) SELECT * FROM p WHERE " + " AND ".join(f"{a} IS NOT NULL" for a in AXES),
    "metric_slice": f"WITH {_MS} SELECT * FROM ms WHERE judge = 'judge_05' AND axis = 'novelty'",
    "quality_filter": f"SELECT score_id, idea_id, judge FROM panel_scores WHERE coalesce({_NUM.format(c='novelty')}, 0) >= 4 AND coalesce({_NUM.format(c='feasibility')}, 0) >= 4",
    "library_means": "SELECT " + ", ".join(f"round(avg({_NUM.format(c=a)}), 6) AS {a}" for a in AXES) + ", count(*) AS n FROM panel_scores",
    "testable_statements": r"""WITH raw AS (SELECT line_no, regexp_replace(regexp_replace(record, '^\s*```[A-Za-z]*\s*', ''), '\s*```\s*$', '') AS x FROM ideas_full), o AS (SELECT line_no, CAST(x AS JSON) AS j FROM raw WHERE json_valid(x) AND ltrim(x) LIKE '{%'),
        i AS (SELECT line_no, TRY_CAST(json_extract_string(j, '$.idea_id') AS BIGINT) AS idea_id, CASE WHEN json_type(j, '$.idea') = 'VARCHAR' THEN CAST(json_extract_string(j, '$.idea') AS JSON) ELSE json_extract(j, '$.idea') END AS i FROM o),
        f AS (SELECT line_no, idea_id, coalesce(json_extract_string(i, '$.falsifiable_prediction'), '') AS p, lower(trim(coalesce(json_extract_string(i, '$.named_baseline'), ''))) AS b FROM i WHERE idea_id IS NOT NULL)
        SELECT line_no, idea_id, regexp_matches(p, '[0-9<>≤≥]') AND b NOT IN ('', 'none', 'n/a', 'na', 'tbd', 'no baseline', 'no-baseline', 'no comparison', 'unspecified', 'tba') AS passed FROM f""",
    "verdict_rules": f"""WITH x AS (SELECT score_id, {', '.join(f"coalesce({_NUM.format(c=a)}, 0) AS {a[0]}" for a in AXES)} FROM panel_scores), y AS (SELECT *, CASE WHEN n >= 4 THEN 'yes' WHEN n >= 3 THEN 'partial' ELSE 'no' END AS v FROM x)
        SELECT score_id, CASE WHEN round_even(f, 0) = 0 THEN 'untestable' WHEN s < 2 AND v = 'yes' THEN 'inconclusive' WHEN (5 - e) / 5 >= 0.6 AND v = 'yes' THEN 'partial' WHEN f < 2 AND v = 'yes' THEN 'partial' ELSE v END AS verdict,
        s / 5 >= 0.5 AND (n >= 4 OR (n >= 2 AND e >= 4)) AS gate, concat_ws(',', CASE WHEN e / 5 < 0.8 THEN 'grounding' END, CASE WHEN n / 5 < 0.4 THEN 'novelty' END) AS flags FROM y""",
    "evidence_overlap": r"""WITH s AS (SELECT id, regexp_replace(paragraph_text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS s FROM gaps WHERE id IS NOT NULL), f AS (SELECT id, s FROM s WHERE s LIKE '%a%' UNION SELECT id, regexp_replace(paragraph_text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') FROM methods WHERE id IS NOT NULL)
        SELECT s.id, round(avg(CASE WHEN f.s IS NULL THEN 0.0 ELSE 1 END), 6) AS overlap, count(*) AS n_used, count(*) FILTER (f.s IS NULL) AS n_made_up FROM s LEFT JOIN f ON s.id = f.id AND s.s = f.s GROUP BY 1""",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
