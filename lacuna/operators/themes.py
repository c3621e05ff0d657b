"""Themes of a clustering: their summary, pairs of clusters by centroid, and the benches of clusterers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.numeric import cosine, peak
from lacuna.operators import clustering, graph, rows, similarity, textstats


def cluster_summary(gaps: DataFrame, labels: DataFrame, cluster: str = "cluster_id", key: str = "gap_idx", n: int = 3) -> DataFrame:
    """``cluster, n_items, n_papers, avg_conf, examples, theme_label`` of every cluster but noise (-1); examples are the ``n`` surest sentences."""
    g = gaps.where(F.col(cluster) != -1)
    s = g.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("id").alias("n_papers"), F.round(F.avg("confidence"), 6).alias("avg_conf"))
    top = rows.top_per_group(g.where("gap_sentence is not null"), [cluster], n, F.desc_nulls_last("confidence"), key, rank="r")
    ex = top.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "gap_sentence"))), lambda x: x["gap_sentence"]), "\n").alias("examples"))
    return s.join(ex, cluster, "left").join(labels.select(F.col("cluster_id").alias(cluster), "theme_label"), cluster, "left")


def centroid_bridges(gaps: DataFrame, labels: DataFrame, top: int = 30, cluster: str = "cluster_id") -> DataFrame:
    """The ``top`` pairs of clusters by the cosine of their centroids (best at 0.45), few common papers and other kinds of gaps."""
    g = gaps.where(F.col(cluster) != -1)
    c = similarity.centroids(g, cluster).select(cluster, "centroid")
    a, b = (c.select(F.col(cluster).alias(f"cluster_{s}"), F.col("centroid").alias(f"c{s}")) for s in "ab")
    p = a.join(b, F.col("cluster_a") < F.col("cluster_b")).select("cluster_a", "cluster_b", F.round(cosine("ca", "cb"), 6).alias("cosine_sim"))
    p = graph.pair_context(p, g, cluster)
    for s in "ab":
        p = p.join(labels.select(F.col("cluster_id").alias(f"cluster_{s}"), F.col("theme_label").alias(f"label_{s}")), f"cluster_{s}", "left")
    score = peak(F.col("cosine_sim")) * (1 - F.col("paper_overlap")) * (0.5 + 0.5 * F.col("type_complementarity"))
    d = p.withColumn("bridge_score", F.round(score, 6))
    return d.select("cluster_a", "cluster_b", "label_a", "label_b", "cosine_sim", "paper_overlap", "type_complementarity", "bridge_score").orderBy(F.desc("bridge_score"), "cluster_a", "cluster_b").limit(top)


def graph_clusters(df: DataFrame, key: str, vector: str = "embedding", least: float = 0.3) -> DataFrame:
    """``key, cluster`` by communities of the nearest-neighbour graph, numbered by size; rows without an edge are noise (-1)."""
    edges = graph.knn_edges(df, key, least=least, vector=vector).withColumn("weight", F.col("cosine"))
    members = graph.communities(edges)
    names = rows.numbered(members.groupBy("community").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), F.col("community"), name="cluster")
    found = members.join(names.select("community", F.col("cluster").cast("int").alias("cluster")), "community").select(F.col("node").alias("_k"), "cluster")
    own = df.where(F.col(vector).isNotNull()).select(key)
    return own.join(found, F.col(key).cast("bigint") == F.col("_k"), "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


#: Clusterers of the bench: (table, key, number of clusters) -> ``key, cluster``.
CLUSTERERS: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {
    "kmeans": lambda d, key, k: clustering.kmeans(d, key, k),
    "kmeans_swept": lambda d, key, k: kmeans_by_cosine(d, key, range(2, k + 1))[1],
    "agglomerative": lambda d, key, k: clustering.agglomerative(d, key, k),
    "density": lambda d, key, k: clustering.density(d, key),
    "graph": lambda d, key, k: graph_clusters(d, key),
}


def kmeans_by_cosine(df: DataFrame, key: str, ks: range, vector: str = "embedding") -> tuple[int, DataFrame]:
    """The ``k`` of best cosine silhouette, the smallest of equals, and its ``key, cluster``; with too few rows one cluster."""
    n = df.where(F.col(vector).isNotNull()).count()
    best: tuple[float, int, DataFrame] | None = None
    for k in ks:
        if 2 <= k < n:
            got = clustering.kmeans(df, key, k, vector)
            s = clustering.silhouette_cosine(df.select(key, vector).join(got, key), "cluster", vector).first()[0]
            if s is not None and (best is None or s > best[0] + 1e-9):
                best = (s, k, got)
    return (best[1], best[2]) if best else (1, df.where(F.col(vector).isNotNull()).select(key, F.lit(0).alias("cluster")))


def clustering_bench(df: DataFrame, key: str = "gap_idx", text: str = "gap_sentence", k: int = 10, methods: tuple[str, ...] = tuple(CLUSTERERS), vector: str = "embedding") -> DataFrame:
    """``method, n_clusters, noise_share, silhouette, davies_bouldin, calinski_harabasz, npmi, error`` of each clusterer, a row each.

    A clusterer that refuses the table has its message in ``error`` and no measures.
    """
    out = []
    n = df.where(F.col(vector).isNotNull()).count()
    for name in methods:
        try:
            d = df.join(CLUSTERERS[name](df, key, k), key)
            size = d.agg(F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))), F.count_if(F.col("cluster") == -1)).first()
            one = lambda f: f(d, "cluster", vector).first()[0]  # noqa: E731, B023
            coherence = textstats.npmi(d, "cluster", key, text).agg(F.round(F.avg("npmi"), 6)).first()[0]
            out.append((name, size[0], size[1] / n if n else 0.0, one(clustering.silhouette_cosine), one(clustering.davies_bouldin), one(clustering.calinski_harabasz), coherence, None))
        except Exception as e:
            out.append((name, None, None, None, None, None, None, str(e)[:500]))
    return df.sparkSession.createDataFrame(out, "method string, n_clusters bigint, noise_share double, silhouette double, davies_bouldin double, calinski_harabasz double, npmi double, error string")
