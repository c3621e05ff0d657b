"""Mixing sources to target shares of the total size, by cube-method balanced sampling.

The total is the largest at which every source can hold its share within its allowed
repetitions. A source then needs each of its documents ``m`` times; whole times are
given at once, the rest is a fractional inclusion probability. The cube method moves
these probabilities through the null space of the balancing constraints (number of
tokens, number of documents) until they are 0 or 1: first inside blocks of bounded size,
then over what the blocks left open, until a landing problem of a dozen documents a
source remains, which is enumerated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import tokens
from lacuna.session import cut

#: Documents of a flight block, about.
BLOCK = 4_096
#: Documents of a source that are kept for the landing.
RESERVE = 10
#: Sources that a mixing plan may name; a longer one is refused with its number. The plan is a table made for the mix and is worked out on the driver.
MAX_SOURCES = 100_000
_EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, reserve: int = 0) -> np.ndarray:
    """Move probabilities ``p`` to 0 or 1 in random order, keeping their sum and the sum of ``p * size``.

    Two at most stay open, besides the last ``reserve`` ones, which are not touched.
    """
    p = p.astype(float).copy()
    scale = max(float(size.max(initial=0.0)), 1.0)
    x = size / scale
    waiting = [int(i) for i in rng.permutation(len(p)) if _EPS < p[i] < 1 - _EPS]
    waiting = waiting[: max(0, len(waiting) - reserve)]
    draws = rng.random(len(waiting) + 3)
    held: list[int] = []
    k = 0
    for i in waiting:
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # null space of [[1, 1, 1], [x_a, x_b, x_c]]
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if max(abs(u[0]), abs(u[1]), abs(u[2])) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for j, v in zip(held, u):
            if v > 1e-12:
                up, down = min(up, (1 - p[j]) / v), min(down, p[j] / v)
            elif v < -1e-12:
                up, down = min(up, p[j] / -v), min(down, (1 - p[j]) / -v)
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        for j, v in zip(held, u):
            p[j] += step * v
        held = [j for j in held if _EPS < p[j] < 1 - _EPS]
    p[p <= _EPS] = 0.0
    p[p >= 1 - _EPS] = 1.0
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 0/1 choice of the few open documents (``RESERVE`` + 2) that errs least in tokens, and a little in documents."""
    at = np.nonzero((p > 0) & (p < 1))[0]
    out = p.copy()
    if len(at):
        choice = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))[None, :]) & 1
        tokens_off = np.abs(choice @ size[at] - p[at] @ size[at])
        docs_off = np.abs(choice.sum(axis=1) - p[at].sum())
        out[at] = choice[int(np.argmin(tokens_off + 0.05 * size[at].mean() * docs_off))]
    return out


def plan(targets: DataFrame, totals: DataFrame, total_tokens: float | None = None) -> pd.DataFrame:
    """Per source of ``targets``: what there is, its share of the mix and how often its documents are used.

    Weights of sources that have no tokens cannot be met; the others' weights are scaled
    up to make a whole. Null, negative and zero weights count as none, null repetitions
    as once; of a source named twice the weights are added and the greater cap holds.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    p = t.join(totals, "source", "left").toPandas().sort_values("source").reset_index(drop=True)
    p[["n_docs", "n_tokens"]] = p[["n_docs", "n_tokens"]].fillna(0).astype("int64")
    live = (p.n_tokens > 0) & (p.weight > 0) & (p.max_repeats > 0)
    share = p.weight.where(live, 0.0)
    p["target_share"] = share / share.sum() if share.sum() > 0 else 0.0
    most = min(((c * n / s) for c, n, s, ok in zip(p.max_repeats, p.n_tokens, p.target_share, live) if ok), default=0.0)
    total = most if total_tokens is None else min(most, float(total_tokens))
    p["times"] = [min(float(c), round(s * total / n, 12)) if ok else 0.0 for c, n, s, ok in zip(p.max_repeats, p.n_tokens, p.target_share, live)]
    return p


def sized(docs: DataFrame, folder: str = tokens.TOKENIZER_DIR) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document; empty and null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.tokenizer(folder)
        for b in batches:
            n = np.zeros(b.num_rows, dtype=np.int64)
            for i, t in enumerate(b.column(2).to_pylist()):
                if t:
                    out = tokens.array("i")
                    bpe.encode_into(t, out)
                    n[i] = len(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 11, folder: str = tokens.TOKENIZER_DIR, block: int = BLOCK) -> tuple[DataFrame, pd.DataFrame]:
    """``(doc_id, source, n_tokens, times)`` of every document of the mix, and the plan.

    ``times`` is 1 or more and at most the source's ``max_repeats``. Documents of no
    target source, without a source or without tokens are not part of the mix. The
    result depends on ``seed`` and the ids, not on the order of the rows. Without
    targets or documents there are no rows; more than ``MAX_SOURCES`` sources raise.
    """
    spark = docs.sparkSession
    sources = targets.select("source").where("source is not null").distinct()
    n = sources.count()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources exceed the {MAX_SOURCES} of a mixing plan")
    all_docs = cut(sized(docs.join(F.broadcast(sources), "source", "left_semi"), folder))
    totals = all_docs.groupBy("source").agg(F.count_if(F.col("n_tokens") > 0).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    p = plan(targets, totals, total_tokens)
    known = spark.createDataFrame([(r.source, int(math.floor(r.times)), float(r.times - math.floor(r.times)), max(1, -(-int(r.n_docs) // block))) for r in p.itertuples() if r.times > 0], "source string, whole int, p double, blocks int")
    d = all_docs.where("n_tokens > 0").join(F.broadcast(known), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"))
    kind = "doc_id bigint, source string, n_tokens bigint, whole int, p double, block int"

    def fly(t: pa.Table, last: bool = False) -> pa.Table:
        order = np.lexsort((t["n_tokens"].to_numpy(), t["doc_id"].to_numpy()))
        t = t.take(pa.array(order))
        rng = np.random.default_rng([seed, xxhash.xxh32_intdigest(str(t["source"][0])), int(t["block"][0].as_py() or 0)])
        size = t["n_tokens"].to_numpy().astype(float)
        q = flight(t["p"].to_numpy(), size, rng, RESERVE if last or (t["block"][0].as_py() or 0) == 0 else 0)
        if last:
            q = landing(q, size)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(q))

    cols = ["doc_id", "source", "n_tokens", "whole", "p", "block"]
    flown = cut(d.select(*cols).groupBy("source", "block").applyInArrow(lambda t: fly(t), kind))
    settled = [flown.where("p = 0 or p = 1")]
    open_ = flown.where("p > 0 and p < 1")
    most = int(known.agg(F.max("blocks")).first()[0] or 1)
    while most > 1:
        most = -(-2 * most // block)
        again = cut(open_.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(most)).cast("int")).groupBy("source", "block").applyInArrow(lambda t: fly(t), kind))
        settled.append(again.where("p = 0 or p = 1"))
        open_ = again.where("p > 0 and p < 1")
    settled.append(open_.withColumn("block", F.lit(0)).groupBy("source").applyInArrow(lambda t: fly(t, True), kind))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    out = out.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("int")).alias("times")).where("times > 0")
    return out, p


def shares(mixed: DataFrame, p: pd.DataFrame) -> DataFrame:
    """Per source of the plan: target and actual share, tokens and documents used, and the greatest repetition."""
    spark = mixed.sparkSession
    known = spark.createDataFrame(
        [(r.source, float(r.weight), round(float(r.target_share), 6), int(r.max_repeats), int(r.n_docs), int(r.n_tokens)) for r in p.itertuples()],
        "source string, weight double, target_share double, max_repeats int, n_docs bigint, n_tokens bigint",
    )
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"), F.sum("times").alias("used_docs"), F.max("times").alias("most_repeats"))
    total = used.agg(F.sum("used_tokens").alias("total"))
    d = known.join(used, "source", "left").crossJoin(F.broadcast(total)).fillna(0, ["used_tokens", "used_docs", "most_repeats"])
    return d.withColumn("actual_share", F.round(F.coalesce(F.try_divide("used_tokens", "total"), F.lit(0.0)), 6)).drop("total")
