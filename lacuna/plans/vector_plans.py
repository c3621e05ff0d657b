"""Queries over vectors: similarity joins, centroids, bridges, edges, frontier, graph algorithms, cluster measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.numeric import coerce, cosine, peak
from lacuna.operators import clustering, evidence, graph, similarity, themes
from lacuna.plans.row_plans import CLUSTER, gaps
from lacuna.session import kept, table

#: Papers called ``unknown`` are none.
KNOWN_PAPER = "id IS NOT NULL AND id <> '' AND id <> 'unknown'"


def _edges_by_cosine(spark: SparkSession, d: str) -> DataFrame:
    return graph.knn_edges(table(spark, d, "gaps").select("gap_idx", "embedding"), "gap_idx")


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges_by_cosine(spark, d)


def knn_edges_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same by the index: every row is searched in its nearest cells."""
    return graph.knn_edges(table(spark, d, "gaps").select("gap_idx", "embedding"), "gap_idx", indexed=True)


def paper_edges(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gaps").where(KNOWN_PAPER).select("gap_idx", "id", "embedding")
    return similarity.keyed_pairs(g, "gap_idx", "id").select(F.col("a").alias("src"), F.col("b").alias("dst"), "cosine")


def section_edges(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gaps").select("gap_idx", "section_type", "embedding")
    return similarity.keyed_pairs(g, "gap_idx", "section_type", least=0.3).select(F.col("a").alias("src"), F.col("b").alias("dst"), "cosine")


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gaps").select("gap_idx", "embedding", F.expr(f"CASE WHEN {KNOWN_PAPER} THEN id END").alias("id"), "section_type")
    return graph.merged_relations(g, "gap_idx", "id", "section_type")


def method_range_join(spark: SparkSession, d: str) -> DataFrame:
    m, g = table(spark, d, "methods").select("method_idx", "embedding"), table(spark, d, "gaps").select("gap_idx", "embedding")
    return similarity.within(m, g, 0.3, 0.7, "method_idx", "gap_idx").select(F.col("a").alias("method_idx"), F.col("b").alias("gap_idx"), "cosine")


def max_cosine_match(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "methods").where(KNOWN_PAPER).select("method_idx", "id", "embedding")
    g = table(spark, d, "gaps").where(KNOWN_PAPER).select("gap_idx", "id", "embedding")
    return evidence.novelty(evidence.best_match(m, g, "id", "method_idx", "gap_idx"))


def threshold_rates(spark: SparkSession, d: str) -> DataFrame:
    return evidence.threshold_rates(max_cosine_match(spark, d), "max_similarity")


def theme_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = similarity.centroids(gaps(spark, d).where("cluster_id <> -1"), "cluster_id")
    return c.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", "pos", F.round("x", 6).alias("x"))


def _centroid_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = similarity.centroids(gaps(spark, d).where("cluster_id <> -1"), "cluster_id").select("cluster_id", "centroid")
    a, b = c.select(F.col("cluster_id").alias("cluster_a"), F.col("centroid").alias("ca")), c.select(F.col("cluster_id").alias("cluster_b"), F.col("centroid").alias("cb"))
    return a.join(b, F.col("cluster_a") < F.col("cluster_b")).select("cluster_a", "cluster_b", F.round(cosine("ca", "cb"), 6).alias("cosine_sim"))


def bridge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return themes.centroid_bridges(gaps(spark, d), table(spark, d, "cluster_labels"))


def centroid_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _centroid_pairs(spark, d).orderBy(F.desc("cosine_sim"), "cluster_a", "cluster_b").limit(30)


def sweet_spot_methods(spark: SparkSession, d: str) -> DataFrame:
    return evidence.sweet_spot(gaps(spark, d).where("cluster_id <> -1"), table(spark, d, "methods"), "cluster_id")


def frontier_neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gaps").select("gap_idx", "embedding")
    r = similarity.nearest(g.where("gap_idx % 20 = 0"), g, 3, "gap_idx", "gap_idx", not_self=True)
    return r.select(F.col("a").alias("seed"), F.col("b").alias("gap_idx"), "cosine", "rank")


def _given(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Semantic edges, given labels and nodes."""
    g = gaps(spark, d).select(F.col("gap_idx").cast("bigint").alias("node"), "cluster_id", coerce("confidence").alias("confidence"))
    return kept(_edges_by_cosine(spark, d))[0], g.select("node", "cluster_id"), g.select("node", "confidence")


def frontier_by_label(spark: SparkSession, d: str) -> DataFrame:
    return graph.frontier(*_given(spark, d))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return kept(_edges_by_cosine(spark, d).withColumn("weight", F.col("cosine")))[0]


def gap_communities(spark: SparkSession, d: str) -> DataFrame:
    m = graph.communities(_weighted(spark, d))
    nodes = table(spark, d, "gaps").select(F.col("gap_idx").cast("bigint").alias("node"), "id")
    return graph.renumber(m, nodes)


def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_betweenness(_weighted(spark, d), table(spark, d, "gaps").count())


def graph_bridges(spark: SparkSession, d: str) -> DataFrame:
    e = _weighted(spark, d)
    g = gaps(spark, d).select(F.col("gap_idx").cast("bigint").alias("node"), "id", "gap_type", "cluster_id")
    return graph.bridge_pairs(e, g.select("node", "cluster_id"), g.drop("cluster_id"), graph.edge_betweenness(e, g.count()))


def single_bridges(spark: SparkSession, d: str) -> DataFrame:
    e = _weighted(spark, d)
    labels = gaps(spark, d).select(F.col("gap_idx").cast("bigint").alias("node"), "cluster_id")
    return graph.individual_bridges(e, labels, graph.edge_betweenness(e, labels.count()))


def silhouette_cosine(spark: SparkSession, d: str) -> DataFrame:
    return clustering.silhouette_cosine(table(spark, d, "embeddings"))


def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    return clustering.calinski_harabasz(table(spark, d, "embeddings"))


def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return clustering.davies_bouldin(table(spark, d, "embeddings"))


def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two labellings of the gaps, by their kind and by their section."""
    return clustering.adjusted_rand(table(spark, d, "gaps"), "gap_type", "section_type")


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.kmeans(table(spark, d, "embeddings"), "vec_id", 8)


def agglomerative_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.agglomerative(table(spark, d, "embeddings"), "vec_id", 10)


def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.density(table(spark, d, "embeddings"), "vec_id")


def diverse_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.diverse_evidence(gaps(spark, d).where("cluster_id <> -1"), "cluster_id", "gap_idx")


def evidence_payload(spark: SparkSession, d: str) -> DataFrame:
    p = evidence.payload(gaps(spark, d).where("cluster_id <> -1"), "cluster_id", "gap_idx", 4)
    return p.select("cluster_id", F.posexplode("evidence").alias("pos", "e")).select("cluster_id", "pos", "e.*")


QUERIES = {
    f.__name__: f
    for f in (
        knn_edges, knn_edges_indexed, paper_edges, section_edges, merged_edges, method_range_join, max_cosine_match, threshold_rates, theme_centroids, bridge_pairs, centroid_pairs,
        sweet_spot_methods, frontier_neighbours, frontier_by_label, gap_communities, edge_betweenness, graph_bridges, single_bridges, silhouette_cosine,
        calinski_harabasz, davies_bouldin, adjusted_rand, kmeans_clusters, agglomerative_clusters, density_clusters, diverse_evidence, evidence_payload,
    )
}

_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
U = f"""u AS (SELECT gap_idx, id, section_type, confidence, {CLUSTER} AS cluster_id, list_transform(e, lambda x: x / n) AS v FROM
    (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM (SELECT gap_idx, id, section_type, confidence, {_D} AS e FROM gaps WHERE embedding IS NOT NULL)) WHERE n > 0)"""
UM = f"um AS (SELECT method_idx, id, list_transform(e, lambda x: x / n) AS v FROM (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM (SELECT method_idx, id, {_D} AS e FROM methods WHERE embedding IS NOT NULL)) WHERE n > 0)"
_COS = "round(list_dot_product(a.v, b.v), 6)"
KNN = f"""knn AS (SELECT DISTINCT CAST(least(x, y) AS BIGINT) AS src, CAST(greatest(x, y) AS BIGINT) AS dst, cosine FROM (SELECT a.gap_idx AS x, b.gap_idx AS y, {_COS} AS cosine, row_number() OVER (PARTITION BY a.gap_idx ORDER BY {_COS} DESC, b.gap_idx) AS r
    FROM u a JOIN u b ON a.gap_idx <> b.gap_idx) WHERE r <= 8 AND cosine >= 0.45)"""
PAPER = f"pe AS (SELECT CAST(a.gap_idx AS BIGINT) AS src, CAST(b.gap_idx AS BIGINT) AS dst, {_COS} AS cosine FROM u a JOIN u b ON a.id = b.id AND a.gap_idx < b.gap_idx WHERE a.id <> '' AND a.id <> 'unknown')"
SECTION = f"se AS (SELECT * FROM (SELECT CAST(a.gap_idx AS BIGINT) AS src, CAST(b.gap_idx AS BIGINT) AS dst, {_COS} AS cosine FROM u a JOIN u b ON a.section_type = b.section_type AND a.gap_idx < b.gap_idx WHERE a.section_type <> '') WHERE cosine >= 0.3)"
CENTROID = f"""g AS (SELECT *, {CLUSTER} AS cluster_id FROM gaps), cp AS (SELECT cluster_id, pos, avg(x) AS x FROM (SELECT cluster_id, unnest({_D}) AS x, unnest(range(len(embedding))) AS pos FROM g WHERE embedding IS NOT NULL AND cluster_id <> -1) GROUP BY 1, 2),
    c AS (SELECT cluster_id, list(x ORDER BY pos) AS v FROM cp GROUP BY 1)"""
_PAIR = "cpair AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS cosine_sim FROM c a JOIN c b ON a.cluster_id < b.cluster_id)"
_E = f"e AS (SELECT vec_id, label, {_D} AS v FROM embeddings)"
MATCH = f"""mq AS (SELECT method_idx, id FROM methods WHERE {KNOWN_PAPER}), hit AS (SELECT a.method_idx, b.gap_idx, list_dot_product(a.v, b.v) AS s FROM um a JOIN u b ON a.id = b.id WHERE a.id <> '' AND a.id <> 'unknown'),
    zero AS (SELECT m.method_idx, g.gap_idx, 0.0 AS s FROM methods m JOIN gaps g ON m.id = g.id WHERE m.id <> '' AND m.id <> 'unknown' AND m.embedding IS NOT NULL AND g.embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.method_idx = m.method_idx AND h.gap_idx = g.gap_idx)),
    every AS (SELECT * FROM hit UNION ALL SELECT * FROM zero),
    best AS (SELECT method_idx, round(max(s), 6) AS max_similarity, round(avg(s), 6) AS mean_similarity, arg_min(gap_idx, (-round(s, 6), gap_idx)) AS closest, count(*) AS n_hits FROM every GROUP BY 1),
    mm AS (SELECT q.method_idx, coalesce(max_similarity, 0) AS max_similarity, mean_similarity, closest, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_hits IS NULL THEN 1.0 ELSE round(greatest(0, least(1, 1 - max_similarity)), 6) END AS novelty_score FROM mq q LEFT JOIN best b ON q.method_idx = b.method_idx)"""

_JAC = "CASE WHEN len(list_distinct(list_concat(d.w, {w}))) = 0 THEN 0.0 ELSE len(list_intersect(d.w, {w})) / len(list_distinct(list_concat(d.w, {w}))) END"


def _diverse(k: int) -> str:
    """The picks one after another, each a table ``p1`` to ``pk`` with the keys and words picked so far."""
    parts = [
        f"d AS (SELECT {CLUSTER} AS cluster_id, gap_idx, coalesce(confidence, 0) AS c, list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce(gap_sentence, ''), '[\\s\\p{{Z}}]+'), lambda x: length(x) > 3), lambda x: lower(x))) AS w FROM gaps)",
        "n AS (SELECT cluster_id, count(*) AS n FROM d GROUP BY 1)",
        "p1 AS (SELECT cluster_id, gap_idx AS k1, w AS w1 FROM d WHERE cluster_id <> -1 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, gap_idx) = 1)",
    ]
    for i in range(2, k + 1):
        least = "least(" + ", ".join(_JAC.format(w=f"p.w{j}") for j in range(1, i)) + ")"
        taken = ", ".join(f"p.k{j}" for j in range(1, i))
        parts.append(f"p{i} AS (SELECT p.*, d.gap_idx AS k{i}, d.w AS w{i} FROM p{i - 1} p JOIN d ON d.cluster_id = p.cluster_id AND d.gap_idx NOT IN ({taken}) QUALIFY row_number() OVER (PARTITION BY p.cluster_id ORDER BY round(0.7 * (1 - {least}) + 0.3 * d.c, 12) DESC, d.gap_idx) = 1)")
    keys = "[" + ", ".join(f"k{i}" for i in range(1, k + 1)) + "]"
    return "WITH " + ", ".join(parts) + f" SELECT cluster_id, unnest(CASE WHEN n <= {k} THEN list_sort({keys}) ELSE {keys} END) AS gap_idx, CAST(unnest(range(1, {k + 1})) AS INTEGER) AS rank FROM p{k} JOIN n USING (cluster_id)"


SQL: dict[str, str] = {
    "diverse_evidence": _diverse(4),
    "knn_edges": f"WITH {U}, {KNN} SELECT * FROM knn",
    "paper_edges": f"WITH {U}, {PAPER} SELECT * FROM pe",
    "section_edges": f"WITH {U}, {SECTION} SELECT * FROM se",
    "merged_edges": f"""WITH {U}, {KNN}, {PAPER}, {SECTION}, a AS (SELECT src, dst, cosine AS weight, 1 AS o, 'semantic' AS t, cosine FROM knn UNION ALL SELECT src, dst, 0.5, 2, 'paper', cosine FROM pe UNION ALL SELECT src, dst, cosine * 0.3, 3, 'section', cosine FROM se)
        SELECT src, dst, round(max(weight), 8) AS weight, string_agg(t, '+' ORDER BY o) AS edge_type, max(cosine) AS cosine FROM a GROUP BY 1, 2""",
    "method_range_join": f"WITH {U}, {UM} SELECT * FROM (SELECT CAST(a.method_idx AS BIGINT) AS method_idx, CAST(b.gap_idx AS BIGINT) AS gap_idx, {_COS} AS cosine FROM um a CROSS JOIN u b) WHERE cosine BETWEEN 0.3 AND 0.7",
    "max_cosine_match": f"WITH {U}, {UM}, {MATCH} SELECT * FROM mm",
    "threshold_rates": f"WITH {U}, {UM}, {MATCH}, t AS (SELECT unnest([0.5, 0.6, 0.7]::DOUBLE[]) AS tau) SELECT tau, round(avg(CASE WHEN max_similarity >= tau THEN 1.0 ELSE 0 END), 6) AS recovery, round(avg(CASE WHEN max_similarity < tau THEN 1.0 ELSE 0 END), 6) AS hallucination FROM mm CROSS JOIN t GROUP BY tau",
    "theme_centroids": f"WITH {CENTROID} SELECT cluster_id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM cp",
    "centroid_pairs": f"WITH {CENTROID}, {_PAIR} SELECT * FROM cpair ORDER BY cosine_sim DESC, cluster_a, cluster_b LIMIT 30",
    "bridge_pairs": f"""WITH {CENTROID}, {_PAIR}, p AS (SELECT DISTINCT cluster_id, id FROM g WHERE id IS NOT NULL AND cluster_id <> -1), n AS (SELECT cluster_id, count(*) AS n FROM p GROUP BY 1),
        ov AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, count(*) AS n_both FROM p a JOIN p b ON a.id = b.id AND a.cluster_id < b.cluster_id GROUP BY 1, 2),
        t AS (SELECT cluster_id, gap_type, count(*) / sum(count(*)) OVER (PARTITION BY cluster_id) AS s FROM g WHERE cluster_id <> -1 GROUP BY 1, 2),
        k AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, sum(least(a.s, b.s)) AS same FROM t a JOIN t b ON a.gap_type = b.gap_type AND a.cluster_id < b.cluster_id GROUP BY 1, 2),
        f AS (SELECT cp.cluster_a, cp.cluster_b, cosine_sim, round(coalesce(n_both, 0) / greatest(1, na.n + nb.n - coalesce(n_both, 0)), 6) AS paper_overlap, round(1 - coalesce(same, 0), 6) AS type_complementarity
            FROM cpair cp LEFT JOIN ov ON cp.cluster_a = ov.cluster_a AND cp.cluster_b = ov.cluster_b LEFT JOIN k ON cp.cluster_a = k.cluster_a AND cp.cluster_b = k.cluster_b LEFT JOIN n na ON cp.cluster_a = na.cluster_id LEFT JOIN n nb ON cp.cluster_b = nb.cluster_id)
        SELECT cluster_a, cluster_b, la.theme_label AS label_a, lb.theme_label AS label_b, cosine_sim, paper_overlap, type_complementarity,
        round(CASE WHEN cosine_sim <= 0 OR cosine_sim >= 1 THEN 0 WHEN cosine_sim <= 0.45 THEN cosine_sim / 0.45 ELSE (1 - cosine_sim) / 0.55 END * (1 - paper_overlap) * (0.5 + 0.5 * type_complementarity), 6) AS bridge_score
        FROM f LEFT JOIN cluster_labels la ON cluster_a = la.cluster_id LEFT JOIN cluster_labels lb ON cluster_b = lb.cluster_id ORDER BY bridge_score DESC, cluster_a, cluster_b LIMIT 30""",
    "sweet_spot_methods": f"""WITH {CENTROID}, m AS (SELECT method_idx, {_D} AS v FROM methods WHERE embedding IS NOT NULL),
        s AS (SELECT c.cluster_id, method_idx, coalesce(round(list_dot_product(m.v, c.v) / nullif(sqrt(list_dot_product(m.v, m.v)) * sqrt(list_dot_product(c.v, c.v)), 0), 6), 0) AS similarity FROM m CROSS JOIN c),
        b AS (SELECT *, similarity BETWEEN 0.3 AND 0.7 AS band, max(CASE WHEN similarity BETWEEN 0.3 AND 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id) AS any_in FROM s),
        r AS (SELECT cluster_id, method_idx, similarity, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN any_in = 1 THEN CASE WHEN band THEN -abs(round(similarity - 0.5, 9)) ELSE -9.0 END ELSE similarity END DESC, method_idx) AS INTEGER) AS rank FROM b) SELECT * FROM r WHERE rank <= 5""",
    "frontier_neighbours": f"WITH {U}, r AS (SELECT CAST(a.gap_idx AS BIGINT) AS seed, CAST(b.gap_idx AS BIGINT) AS gap_idx, {_COS} AS cosine, CAST(row_number() OVER (PARTITION BY a.gap_idx ORDER BY {_COS} DESC, b.gap_idx) AS INTEGER) AS rank FROM u a JOIN u b ON a.gap_idx <> b.gap_idx WHERE a.gap_idx % 20 = 0) SELECT * FROM r WHERE rank <= 3",
    "frontier_by_label": f"""WITH {U}, {KNN}, l AS (SELECT gap_idx, {CLUSTER} AS cluster_id, coalesce(confidence, 0) AS confidence FROM gaps), b AS (SELECT src AS n, dst AS o FROM knn UNION ALL SELECT dst, src FROM knn),
        k AS (SELECT n, count(*) AS degree, count(*) FILTER (x.cluster_id = y.cluster_id) AS intra_degree, count(DISTINCT y.cluster_id) FILTER (x.cluster_id <> y.cluster_id) AS nc FROM b JOIN l x ON b.n = x.gap_idx JOIN l y ON b.o = y.gap_idx GROUP BY n),
        s AS (SELECT l.gap_idx AS node, cluster_id, confidence, coalesce(intra_degree, 0) AS intra_degree, coalesce(nc, 0) AS n_neighbour_clusters, (1 - coalesce(intra_degree / degree, 0)) * ln(1 + coalesce(nc, 0)) + 0.05 * confidence AS raw FROM l LEFT JOIN k ON l.gap_idx = k.n)
        SELECT CAST(node AS BIGINT) AS node, cluster_id, confidence, intra_degree, n_neighbour_clusters, round(raw / max(raw) OVER (), 6) AS frontier_score FROM s ORDER BY frontier_score DESC, node LIMIT 50""",
    "silhouette_cosine": f"""WITH {_E}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), d AS (SELECT a.vec_id, a.label, b.label AS o, sum(1 - list_dot_product(a.v, b.v)) AS s, count(*) AS m FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
        p AS (SELECT vec_id, max(CASE WHEN label = o THEN s / m END) AS a, min(CASE WHEN label <> o THEN s / m END) AS b FROM d GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM p""",
    "calinski_harabasz": f"""WITH {_E}, l AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e), m AS (SELECT label, pos, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM l GROUP BY 1, 2), t AS (SELECT sum(s * s / n) AS t FROM (SELECT pos, sum(n) AS n, sum(s) AS s FROM m GROUP BY 1))
        SELECT round((sum(s * s / n) - any_value(t.t)) * ((SELECT count(*) FROM e) - count(DISTINCT label)) / (sum(q - s * s / n) * (count(DISTINCT label) - 1)), 6) AS calinski_harabasz FROM m CROSS JOIN t""",
    "davies_bouldin": f"""WITH {_E}, l AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e), c AS (SELECT label, pos, avg(x) AS c FROM l GROUP BY 1, 2),
        s AS (SELECT label, avg(r) AS s FROM (SELECT vec_id, l.label, sqrt(sum((x - c) * (x - c))) AS r FROM l JOIN c ON l.label = c.label AND l.pos = c.pos GROUP BY 1, 2) GROUP BY 1),
        d AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY 1, 2)
        SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT d.a, max((x.s + y.s) / d.d) AS r FROM d JOIN s x ON d.a = x.label JOIN s y ON d.b = y.label GROUP BY 1)""",
    "adjusted_rand": """WITH t AS (SELECT gap_type AS a, section_type AS b, CAST(count(*) AS DOUBLE) AS n FROM gaps WHERE gap_type IS NOT NULL AND section_type IS NOT NULL GROUP BY 1, 2), o AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS m FROM t), x AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY b))
        SELECT round((o.s - x.s * y.s / (o.m * (o.m - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (o.m * (o.m - 1) / 2)), 6) AS ari FROM o, x, y""",
    "evidence_payload": f"""WITH g AS (SELECT *, {CLUSTER} AS cluster_id FROM gaps), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY gap_idx) - 1 AS pos FROM g WHERE cluster_id <> -1)
        SELECT cluster_id, CAST(pos AS INTEGER) AS pos, coalesce(id, '') AS paper_id, coalesce(gap_type, '') AS gap_type, coalesce(section_type, '') AS section_type, coalesce(gap_sentence, '') AS gap_sentence, coalesce(paragraph_text, '') AS paragraph_text, coalesce(confidence, 0) AS confidence FROM r WHERE pos < 4""",
}
