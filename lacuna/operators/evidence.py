"""Evidence for ideas: diverse picks, payloads, method retrieval and novelty."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import text
from lacuna.functions.numeric import cosine, unit_interval
from lacuna.operators import similarity
from lacuna.session import cut


def pick_diverse(confidence: list[float], tokens: list[set[str]], k: int) -> list[int]:
    """Positions of ``k`` picks: the surest first, then by 0.7 novelty and 0.3 confidence.

    The novelty of a row is 1 minus its least Jaccard similarity to a pick. Ties take
    the earlier row.
    """
    n = len(confidence)
    if n <= k:
        return list(range(n))
    chosen = [max(range(n), key=lambda i: (confidence[i], -i))]

    def alike(a: set[str], b: set[str]) -> float:
        return len(a & b) / len(a | b) if a | b else 0.0

    least = [alike(t, tokens[chosen[0]]) for t in tokens]
    while len(chosen) < k:
        best = max((i for i in range(n) if i not in chosen), key=lambda i: (round(0.7 * (1 - least[i]) + 0.3 * confidence[i], 12), -i))
        chosen.append(best)
        least = [min(x, alike(t, tokens[best])) for x, t in zip(least, tokens)]
    return chosen


def diverse_evidence(df: DataFrame, group: str, key: str, k: int = 4, sentence: str = "gap_sentence") -> DataFrame:
    """``group, key, rank`` of a diverse pick of ``k`` rows per group, as ``pick_diverse`` takes them.

    Each pick is a pass over the rows of all groups: a row is scored against the picks
    so far and the greatest score of a group is taken, so no group is gathered. Ties take
    the smaller ``key``; a null sentence has no words; a group of ``k`` rows or fewer is
    taken whole in the order of ``key``.
    """
    d = df.select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.coalesce("confidence", F.lit(0.0)).alias("_c"), text.token_set(F.coalesce(sentence, F.lit(""))).alias("_w"))
    row = F.struct("_key", "_w")
    best = lambda score: F.min_by(row, F.struct((-score).alias("s"), "_key"))
    picks = cut(d.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.array(best(F.col("_c"))).alias("_p")))
    both = lambda p: F.size(F.array_union("_w", p["_w"]))
    alike = lambda p: F.when(both(p) == 0, 0.0).otherwise(F.size(F.array_intersect("_w", p["_w"])) / both(p))
    for _ in range(1, k):
        known = picks.select(F.col("_g").alias("_h"), "_p")
        rest = d.join(known, F.col("_g").eqNullSafe(F.col("_h"))).where(~F.exists("_p", lambda p: p["_key"].eqNullSafe(F.col("_key"))))
        score = F.round(0.7 * (1 - F.array_min(F.transform("_p", alike))) + 0.3 * F.col("_c"), 12)
        found = rest.groupBy(F.col("_g").alias("_h")).agg(best(score).alias("_x"))
        with_next = picks.join(found, F.col("_g").eqNullSafe(F.col("_h")), "left")
        picks = cut(with_next.select("_g", "_n", F.when(F.col("_x").isNull(), F.col("_p")).otherwise(F.array_append("_p", F.col("_x"))).alias("_p")))
    keys = F.transform("_p", lambda p: p["_key"])
    order = F.when(F.col("_n") <= k, F.array_sort(keys)).otherwise(keys)
    got = picks.select(F.col("_g").alias(group), F.posexplode(order).alias("_at", key))
    return got.select(group, key, (F.col("_at") + 1).alias("rank"))


def payload(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """``group, evidence``: list of the fields a prompt gets, in the order given."""
    fields = F.struct(F.col(order).alias("o"), F.coalesce("id", F.lit("")).alias("paper_id"), F.coalesce("gap_type", F.lit("")).alias("gap_type"), F.coalesce("section_type", F.lit("")).alias("section_type"), F.coalesce("gap_sentence", F.lit("")).alias("gap_sentence"), F.coalesce("paragraph_text", F.lit("")).alias("paragraph_text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= k)
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x.dropFields("o")).alias("evidence"))


def sweet_spot(gaps: DataFrame, methods: DataFrame, group: str, key: str = "method_idx", top: int = 5, low: float = 0.3, high: float = 0.7, vector: str = "embedding") -> DataFrame:
    """``group, key, similarity, rank``: methods that are neither too near to a cluster's centroid nor too far.

    Within the band those nearest to its middle come first; a band with too few is filled
    up with methods outside it in the order of ``key``, and an empty band gives the
    nearest ones. Every pair of a block of centroids and a block of methods gives its
    best ``top`` of each of the three kinds, so neither side is broadcast and what a
    cluster gathers is bounded by the number of blocks. An all-zero vector has similarity
    0; null, wrongly long and not finite ones take no part.
    """
    c = similarity.centroids(gaps, group, vector).select(F.xxhash64(group).alias("gid"), group, "centroid")
    dim = similarity.dimension(methods, vector)
    kind = gaps.schema[group].dataType.simpleString()
    if not dim:
        return methods.sparkSession.createDataFrame([], f"`{group}` {kind}, `{key}` bigint, similarity double, rank int")
    mid = (low + high) / 2

    def work(qi: np.ndarray, q: np.ndarray, ri: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(len(qi)):
            s = np.nan_to_num(np.round(r @ q[i], 6))
            inside = (s >= low) & (s <= high)
            best = [np.lexsort((ri, np.where(inside, np.abs(np.round(s - mid, 9)), np.inf)))[:top], np.lexsort((ri, inside))[:top], np.lexsort((ri, -s))[:top]]
            at = np.unique(np.concatenate(best))
            out.append((np.full(len(at), qi[i]), ri[at], s[at]))
        return tuple(np.concatenate(x) for x in zip(*out))

    centre = similarity.usable_rows(c, "gid", "centroid", dim)
    d = similarity.block_join(centre, similarity.usable_rows(methods, key, vector, dim, zeros=True), work, dim).withColumnRenamed("cosine", "similarity")
    band = F.col("similarity").between(low, high)
    d = d.withColumn("any_in", F.max(band).over(Window.partitionBy("a")))
    order = F.when(F.col("any_in"), F.when(band, -F.abs(F.round(F.col("similarity") - mid, 9))).otherwise(F.lit(-9.0))).otherwise(F.col("similarity"))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(order), "b"))).where(F.col("rank") <= top)
    return d.join(c.select(F.col("gid").alias("a"), group), "a").select(group, F.col("b").cast(methods.schema[key].dataType).alias(key), "similarity", "rank")


def best_match(queries: DataFrame, keys: DataFrame, on: str, query_key: str, key_key: str, vector: str = "embedding") -> DataFrame:
    """``query_key, max_similarity, mean_similarity, closest, n_hits`` against the rows of the same ``on``; without any 0, null, null and 0."""
    q = queries.select(query_key, on, F.col(vector).alias("qv"))
    k = keys.where(F.col(on).isNotNull() & F.col(vector).isNotNull()).select(on, F.col(key_key).alias("kk"), F.col(vector).alias("kv"))
    d = q.join(k, on, "left").withColumn("s", F.when(F.col("kk").isNotNull() & F.col("qv").isNotNull(), cosine("qv", "kv")))
    best = F.max_by(F.when(F.col("s").isNotNull(), F.col("kk")), F.struct(F.round("s", 6), -F.col("kk")))
    return d.groupBy(query_key).agg(F.coalesce(F.round(F.max("s"), 6), F.lit(0.0)).alias("max_similarity"), F.round(F.avg("s"), 6).alias("mean_similarity"), best.alias("closest"), F.count("s").alias("n_hits"))


def novelty(matches: DataFrame, failed: str | None = None) -> DataFrame:
    """Add ``novelty_score``: 1 minus the greatest similarity, within 0 and 1; 1 without hits, null where the search failed."""
    score = F.when(F.col("n_hits") == 0, 1.0).otherwise(unit_interval(1 - F.col("max_similarity")))
    if failed:
        score = F.when(F.col(failed), F.lit(None)).otherwise(score)
    return matches.withColumn("novelty_score", F.round(score, 6))


def threshold_rates(df: DataFrame, similarity_col: str, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7), groups: tuple[str, ...] = ()) -> DataFrame:
    """``tau, recovery, hallucination`` (and groups): share of similarities at or above each threshold, and below it; without rows 0."""
    t = df.sparkSession.createDataFrame([(x,) for x in thresholds], "tau double")
    d = df.select(*groups, F.col(similarity_col).alias("s"), F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("tau"))
    got = d.groupBy(*groups, "tau").agg(F.round(F.avg((F.col("s") >= F.col("tau")).cast("double")), 6).alias("recovery"), F.round(F.avg((F.col("s") < F.col("tau")).cast("double")), 6).alias("hallucination"))
    return got if groups else t.join(got, "tau", "left").fillna(0.0, ["recovery", "hallucination"])
