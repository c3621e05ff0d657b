"""Clusterers and measures of a clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.numeric import dot, unit
from lacuna.operators import similarity

#: Rows that the quadratic clusterers take, at most.
MOST_ROWS = 3_000


def _long(df: DataFrame, label: str, vector: str) -> DataFrame:
    return df.where((F.col(label) != -1) & F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("pos", "x"))


def silhouette_cosine(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row ``silhouette``: mean over the rows that are not noise (-1), with cosine distance; null below 4 rows or 2 clusters.

    The mean distance of a row to a cluster is 1 minus its product with the cluster's
    mean unit vector, so a row meets each cluster once and never another row.
    """
    d = df.where(F.col(label) != -1).withColumn("u", unit(vector)).withColumn("rid", F.monotonically_increasing_id()).select("rid", label, "u")
    sums = similarity.centroids(d, label, "u").select(F.col(label).alias("other"), F.col("centroid").alias("c"), F.col("n").alias("m"))
    x = d.crossJoin(F.broadcast(sums)) if sums.limit(MOST_ROWS + 1).count() <= MOST_ROWS else d.join(sums)
    mean = dot("u", "c")
    x = x.withColumn("near", mean).withColumn("dist", F.when(F.col("other") == F.col(label), 1 - (F.col("near") * F.col("m") - 1) / F.nullif(F.col("m") - 1, F.lit(0))).otherwise(1 - F.col("near")))
    per = x.groupBy("rid", label).agg(F.max(F.when(F.col("other") == F.col(label), F.col("dist"))).alias("a"), F.min(F.when(F.col("other") != F.col(label), F.col("dist"))).alias("b"), F.max(F.when(F.col("other") == F.col(label), F.col("m"))).alias("m"))
    s = F.when(F.col("m") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    t = per.agg(F.avg(s).alias("s"), F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k"))
    return t.select(F.when((F.col("n") >= 4) & (F.col("k") >= 2), F.round("s", 6)).alias("silhouette"))


def silhouette_euclidean(df: DataFrame, key: str, label: str, vector: str) -> float | None:
    """Mean silhouette with true Euclidean distance: every row against all, in blocks of a matrix product."""
    d = df.where((F.col(label) != -1) & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("int").alias("l"), F.col(vector).alias("v"))
    n = d.count()
    if n < 4 or d.select("l").distinct().count() < 2:
        return None
    blocks = max(1, -(-n // 4096))
    d = d.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = d.withColumn("o", every).select(F.col("own").alias("p"), F.col("o").alias("q"), "id", "l", "v")
    right = d.withColumn("o", every).select(F.col("o").alias("p"), F.col("own").alias("q"), *[F.col(c).alias(c) for c in ("id", "l", "v")])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.array(t["v"].to_pylist(), dtype=float) for t in (a, b))
        lb = b["l"].to_numpy()
        names, at = np.unique(lb, return_inverse=True)
        dist = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))
        dist[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = 0
        s = np.stack([dist[:, at == k].sum(1) for k in range(len(names))], axis=1)
        c = np.bincount(at)
        i, k = np.indices(s.shape)
        return pa.table({"id": a["id"].to_numpy()[i.ravel()], "l": a["l"].to_numpy()[i.ravel()], "other": names[k.ravel()].astype(np.int32), "s": s.ravel(), "m": c[k.ravel()].astype(np.int64)})

    t = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, "id bigint, l int, other int, s double, m bigint").groupBy("id", "l", "other").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    own = F.col("l") == F.col("other")
    per = t.groupBy("id").agg(F.max(F.when(own, F.col("s") / F.nullif(F.col("m") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("m"))).alias("b"))
    return per.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))).first()[0]


def _moments(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, pos, n, s, q`` sums per cluster and position."""
    return _long(df, label, vector).groupBy(label, "pos").agg(F.count("x").cast("double").alias("n"), F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"))


def calinski_harabasz(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row ``calinski_harabasz`` from sums per cluster and position alone."""
    m = _moments(df, label, vector)
    inside = m.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"))
    total = m.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("t"))
    between = m.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.max("pos").alias("last"), F.countDistinct(label).alias("k"))
    n = m.where("pos = 0").agg(F.sum("n").alias("rows"))
    d = inside.crossJoin(total).crossJoin(between).crossJoin(n)
    value = F.try_divide((F.col("b") - F.col("t")) * (F.col("rows") - F.col("k")), F.col("w") * (F.col("k") - 1))
    return d.select(F.round(value, 6).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row ``davies_bouldin``: clusters are compared with each other, rows only with their own centroid."""
    c = similarity.centroids(df.where(F.col(label) != -1), label, vector).select(label, "centroid")
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, z: s + z))
    spread = df.where(F.col(label) != -1).select(label, vector).join(c, label).groupBy(label).agg(F.avg(gap(vector, "centroid")).alias("s"))
    x = c.join(spread, label)
    a, b = x.select(F.col(label).alias("a"), F.col("centroid").alias("ca"), F.col("s").alias("sa")), x.select(F.col(label).alias("b"), F.col("centroid").alias("cb"), F.col("s").alias("sb"))
    worst = a.join(b, F.col("a") != F.col("b")).groupBy("a").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), gap("ca", "cb"))).alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` of two labellings, from their contingency table; 1 if both put all rows together or all apart."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    one = t.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("all"))
    ra = t.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    rb = t.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    d = one.crossJoin(ra).crossJoin(rb)
    expect = F.col("sa") * F.col("sb") / pairs(F.col("all"))
    top = (F.col("sa") + F.col("sb")) / 2
    return d.select(F.round(F.coalesce(F.try_divide(F.col("s") - expect, top - expect), F.lit(1.0)), 6).alias("ari"))


def kmeans(df: DataFrame, key: str, k: int, vector: str = "embedding", seed: int = 42) -> DataFrame:
    """``key, cluster`` by k-means over the cluster."""
    x = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(x).transform(x).select(key, "cluster")


def kmeans_sweep(df: DataFrame, key: str, ks: range, vector: str = "embedding", seed: int = 42) -> tuple[int, DataFrame]:
    """The ``k`` of best Euclidean silhouette, and its ``key, cluster``; with too few rows one cluster."""
    n = df.where(F.col(vector).isNotNull()).count()
    best: tuple[float, int, DataFrame] | None = None
    for k in ks:
        if 2 <= k < n:
            got = kmeans(df, key, k, vector, seed)
            s = silhouette_euclidean(df.select(key, vector).join(got, key), key, "cluster", vector)
            if s is not None and (best is None or s > best[0] + 1e-9):
                best = (s, k, got)
    if best is None:
        return 1, df.where(F.col(vector).isNotNull()).select(key, F.lit(0).alias("cluster"))
    return best[1], best[2]


def _matrix(pdf: pd.DataFrame, vector: str) -> np.ndarray:
    x = np.stack(pdf[vector].to_list()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _small(df: DataFrame, key: str, vector: str) -> DataFrame:
    d = df.where(F.col(vector).isNotNull()).select(key, vector)
    if d.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"this clusterer compares all rows in one task and takes at most {MOST_ROWS}")
    return d.withColumn("one", F.lit(0))


def agglomerative(df: DataFrame, key: str, k: int, vector: str = "embedding") -> DataFrame:
    """``key, cluster``: average linkage on cosine distance down to ``k`` clusters, for at most ``MOST_ROWS`` rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = _matrix(pdf, vector)
        d = 1 - x @ x.T
        np.fill_diagonal(d, np.inf)
        size, member = np.ones(len(x)), np.arange(len(x))
        for _ in range(max(0, len(x) - k)):
            i, j = divmod(int(d.argmin()), len(x))
            i, j = min(i, j), max(i, j)
            row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
            d[i], d[:, i] = row, row
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            member[member == j] = i
        return pd.DataFrame({key: pdf[key], "cluster": np.unique(member, return_inverse=True)[1].astype(np.int32)})

    return _small(df, key, vector).groupBy("one").applyInPandas(run, f"`{key}` {kind}, cluster int")


def density(df: DataFrame, key: str, least_size: int = 5, least_samples: int = 2, vector: str = "embedding") -> DataFrame:
    """``key, cluster``: hierarchical density clustering (mutual reachability, single linkage, most stable clusters), noise -1; at most ``MOST_ROWS`` rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = _matrix(pdf, vector)
        return pd.DataFrame({key: pdf[key], "cluster": _hierarchy(np.sqrt(np.maximum(2 - 2 * x @ x.T, 0)), least_size, least_samples)})

    return _small(df, key, vector).groupBy("one").applyInPandas(run, f"`{key}` {kind}, cluster int")


def _hierarchy(d: np.ndarray, least: int, samples: int) -> np.ndarray:
    """Labels of the most stable clusters in the single-linkage tree of mutual reachability."""
    n = len(d)
    if n < max(2, least):
        return np.full(n, -1, dtype=np.int32)
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    # minimum spanning tree, by Prim
    best, link, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, v = [], 0
    inside[0] = True
    for _ in range(n - 1):
        closer = reach[v] < best
        best[closer & ~inside], link[closer & ~inside] = reach[v][closer & ~inside], v
        v = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[v]), int(link[v]), v))
        inside[v] = True
    edges.sort()
    parent, rows = list(range(n)), {i: [i] for i in range(n)}
    kids: dict[int, tuple[int, int, float]] = {}
    top = {i: i for i in range(n)}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    nxt = n
    for w, a, b in edges:
        ra, rb = find(a), find(b)
        kids[nxt] = (top[ra], top[rb], w)
        rows[nxt] = rows[top[ra]] + rows[top[rb]]
        parent[rb] = ra
        top[ra] = nxt
        nxt += 1

    def walk(root: int, born: float) -> tuple[float, list[int]]:
        """(stability, chosen clusters) below ``root``, a cluster since density ``born``."""
        stability, node = 0.0, root
        while True:
            if node < n:
                return stability, [root]
            a, b, w = kids[node]
            lam = 1 / max(w, 1e-12)
            big = [c for c in (a, b) if len(rows[c]) >= least]
            if len(big) == 2:
                stability += len(rows[node]) * (lam - born)
                below = [walk(c, lam) for c in big]
                total = sum(s for s, _ in below)
                return (total, [c for _, cs in below for c in cs]) if total > stability else (stability, [root])
            if not big:
                return stability + len(rows[node]) * (lam - born), [root]
            gone = b if big[0] == a else a
            stability += len(rows[gone]) * (lam - born)
            node = big[0]

    out = np.full(n, -1, dtype=np.int32)
    _, chosen = walk(nxt - 1, 0.0)
    if chosen != [nxt - 1]:
        for k, c in enumerate(sorted(chosen, key=lambda c: min(rows[c]))):
            out[rows[c]] = k
    return out


def bootstrap_ari(df: DataFrame, key: str, k: int, runs: int = 10, vector: str = "embedding", seed: int = 0) -> pd.DataFrame:
    """``mean_ari, std_ari`` (population) of clusterings of samples with replacement against that of all rows."""
    from lacuna.operators.rows import bootstrap

    base = kmeans(df, key, k, vector, 42).withColumnRenamed("cluster", "base")
    n = df.count()
    scores = []
    for r in range(runs):
        part = bootstrap(df.select(key, vector), key, max(4, int(0.8 * n)), seed + r)
        got = kmeans(part.select(F.col("draw"), key, vector), "draw", k, vector, 42)
        both = part.select("draw", key).join(got, "draw").join(base, key)
        scores.append(adjusted_rand(both, "base", "cluster").first()[0])
    return pd.DataFrame({"mean_ari": [float(np.mean(scores))], "std_ari": [float(np.std(scores))]})


def project(df: DataFrame, key: str, dims: int = 2, vector: str = "embedding") -> DataFrame:
    """``key, point``: vectors on their ``dims`` principal axes, for maps of a clustering; one pass for the axes, a map for the points."""
    d = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if d.isEmpty():
        return df.select(key, F.array().cast("array<double>").alias("point")).limit(0)
    return PCA(k=dims, inputCol="features", outputCol="p").fit(d).transform(d).select(key, F.transform(vector_to_array("p"), lambda x: F.round(x, 6)).alias("point"))
