"""Consensus of disagreeing judges, with item features as a prior.

Every judge has a confusion matrix per axis, every item a latent score. A softmax
classifier on item features gives the prior of the score; it and the matrices are fitted
together by expectation-maximisation until the matrices settle. Items are packed once
into rows of flat buffers, so a round reads a few large values and no lists. The
expectation step is a map over them, the maximisation sums expected counts per (judge,
axis, true score, label) with map-side combining; only these sums, at most ``MAX_JUDGES *
axes * 25`` numbers, and the weights of the classifier reach the driver. With more judges
the sums stay a table with a row per judge, and every pack of items is sent the rows of
its own judges: the same fit, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.rows import numbered
from lacuna.session import cut

AXES = ("novelty", "specificity", "feasibility", "evidence_grounding")
SCORES = 5
#: Judges beyond which the matrices are kept in a table instead of the driver.
MAX_JUDGES = 5000
#: Rounds at most, and the change of a matrix entry below which the fit has settled.
ROUNDS, SETTLED = 40, 0.002
#: Items packed into one row.
PACK = 20_000
_PACKED = ("axis", "sizes", "judges", "labels", "times", "n_judges", "features")


@dataclass
class Panel:
    """Packed items, the judges' numbers, the fitted model and the rounds it took."""

    items: DataFrame  # item: list, and a buffer for each of _PACKED
    judges: DataFrame
    confusion: np.ndarray | None  # judge, axis, true score, label; None with more than MAX_JUDGES judges
    weights: np.ndarray  # axis, feature, score
    names: list[str]
    axes: tuple[str, ...]
    rounds: int
    table: Table | None = None


@dataclass
class Table:
    """Expected counts of more judges than the driver keeps, and what turns them into matrices."""

    counts: DataFrame  # j, c: axis, true score, label
    needed: DataFrame  # pack, j
    every: np.ndarray
    own: float
    shared: float


def _matrices(counts: np.ndarray, every: np.ndarray, own: float, shared: float) -> np.ndarray:
    """Matrices of judges by axis: their counts, leaning on the judge's own over all axes and this on that of all judges."""
    mine = counts.sum(axis=1) + shared * every
    mine = mine / mine.sum(axis=2, keepdims=True)
    conf = counts + own * mine[:, None]
    return conf / conf.sum(axis=3, keepdims=True)


def _start(n: int, na: int) -> np.ndarray:
    conf = np.full((n, na, SCORES, SCORES), 0.1)
    conf[:, :, np.arange(SCORES), np.arange(SCORES)] = 0.6
    return conf


def _of_all(counts: np.ndarray) -> np.ndarray:
    every = counts + 1.0 + 4.0 * np.eye(SCORES)
    return every / every.sum(axis=1, keepdims=True)


def _local(t: pa.Table, every: np.ndarray | None, na: int, own: float, shared: float) -> tuple[np.ndarray, np.ndarray]:
    """(judges in order, their matrices) of rows ``j, c``; without counts those of the start."""
    t = t.sort_by("j")
    if every is None:
        return t["j"].to_numpy(), _start(t.num_rows, na)
    counts = np.frombuffer(b"".join(t["c"].to_pylist()), np.float64).reshape(-1, na, SCORES, SCORES)
    return t["j"].to_numpy(), _matrices(counts, every, own, shared)


def _fit_table(items: DataFrame, width: int, na: int, rounds: int, l2: float, own: float, shared: float) -> tuple[DataFrame, np.ndarray, Table, int]:
    """(items, weights, table, rounds taken) with the counts of the judges in a table."""
    items = items.withColumn("pack", F.monotonically_increasing_id())

    def judges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                j = np.unique(_unpack(b, r, width)[2]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), b.column(b.schema.get_field_index("pack"))[r].as_py())), pa.array(j)], names=["pack", "j"])

    needed = cut(items.mapInArrow(judges, "pack bigint, j bigint"))
    counts, every, w, took = needed.select("j").distinct().withColumn("c", F.lit(None).cast("binary")), None, np.zeros((na, width, SCORES)), 0
    add = lambda t: pa.table({"j": t["j"].slice(0, 1), "c": pa.array([sum(np.frombuffer(x, np.float64) for x in t["c"].to_pylist()).tobytes()], pa.binary())})
    for took in range(1, rounds + 1):

        # runs within this round
        def sums(a: pa.Table, b: pa.Table) -> pa.Table:
            j_of, conf = _local(b, every, na, own, shared)  # noqa: B023
            log_conf, out = np.log(conf), np.zeros((len(j_of), na, SCORES, SCORES))
            grad, seen = np.zeros_like(w), np.zeros(na)  # noqa: B023
            for batch in a.to_batches():
                for r in range(batch.num_rows):
                    axis, sizes, j, y, n, _, x = _unpack(batch, r, width)
                    row, j = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(j_of, j)
                    p, prior = _posterior(axis, row, j, y, n, x, log_conf, w)  # noqa: B023
                    for k in range(SCORES):
                        out += np.bincount(((j.astype(np.int64) * na + axis[row]) * SCORES + k) * SCORES + y, weights=p[row, k] * n, minlength=out.size).reshape(out.shape)
                    for i in np.unique(axis):
                        m = axis == i
                        grad[i] += x[m].T @ (p[m] - prior[m])
                        seen[i] += m.sum()
            total = out.sum(axis=(0, 1)).ravel()
            rest = np.concatenate([total, grad.ravel(), seen])
            return pa.table({"j": pa.array([-1, *j_of.tolist()], pa.int64()), "c": pa.array([rest.tobytes(), *[c.tobytes() for c in out]], pa.binary())})

        met = items.groupBy("pack").cogroup(needed.join(counts, "j").groupBy("pack")).applyInArrow(sums, "j bigint, c binary")
        got = cut(met.groupBy("j").applyInArrow(add, "j bigint, c binary"))
        rest = np.frombuffer(bytes(got.where("j = -1").first()["c"]), np.float64)
        new, every_new = got.where("j >= 0"), _of_all(rest[: SCORES * SCORES].reshape(SCORES, SCORES))
        grad, seen = rest[SCORES * SCORES : -na].reshape(w.shape), np.maximum(rest[-na:], 1)

        def moved(batches: Iterator[pa.RecordBatch], every=every, every_new=every_new) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                before = _local(t.select(["j", "c"]), every, na, own, shared)[1]
                after = _local(t.select(["j", "d"]).rename_columns(["j", "c"]), every_new, na, own, shared)[1]
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(after - before).max(initial=0.0))])], names=["x"])

        most = counts.join(new.select("j", F.col("c").alias("d")), "j").select("j", "c", "d").mapInArrow(moved, "x double").agg(F.max("x")).first()[0]
        counts, every = new, every_new
        w = w + 1.0 * (grad / seen[:, None, None] - l2 * w * (np.arange(width) > 0)[None, :, None])
        if most < SETTLED:
            break
    return items, w, Table(counts, needed, every, own, shared), took


def valid_label(c: str) -> F.Column:
    """A whole number from 1 to 5 however written: ``4``, ``4.0``, `` 4 ``, ``4/5``; else null."""
    return F.expr(rf"try_cast(nullif(regexp_extract({c}, '^\\s*([1-5])(\\.0*)?\\s*(/\\s*5(\\.0*)?)?\\s*$', 1), '') as int)")


def long_labels(panel: DataFrame, item: str = "idea_id", judge: str = "judge", axes: tuple[str, ...] = AXES, row_id: str = "score_id") -> DataFrame:
    """``item, axis, judge, y`` of every valid label; a row repeated under another ``row_id`` counts once.

    Rows with a null item or judge and texts that are no score give nothing.
    """
    cols = [c for c in panel.columns if c != row_id and c in {item, judge, *axes, "overall_critique", "scored_at"}]
    d = panel.where(F.col(item).isNotNull() & F.col(judge).isNotNull()).select(*cols).distinct()
    labels = F.array(*[F.struct(F.lit(i).alias("axis"), valid_label(f"cast(`{a}` as string)").alias("y")) for i, a in enumerate(axes)])
    return d.select(F.col(item).alias("item"), F.col(judge).alias("judge"), F.explode(labels).alias("l")).select("item", "judge", "l.axis", "l.y").where("y is not null")


def _log_prior(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _pack(items: DataFrame) -> DataFrame:
    """Rows of up to ``PACK`` items: their ids as a list, everything else as flat buffers."""
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PACK):
                b = whole.slice(at, PACK)
                flat = lambda i, t: b.column(i).flatten().to_numpy(zero_copy_only=False).astype(t).tobytes()  # noqa: E731, B023
                plain = lambda i: b.column(i).to_numpy(zero_copy_only=False).astype(np.int32).tobytes()  # noqa: E731, B023
                sizes = np.diff(b.column(2).offsets.to_numpy()).astype(np.int32).tobytes()
                cols = [plain(1), sizes, flat(2, np.int32), flat(3, np.int32), flat(4, np.int32), plain(5), flat(6, np.float32)]
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([c], pa.binary()) for c in cols]], names=["item", *_PACKED])

    src = items.select("item", "axis", "judges", "labels", "times", "n_judges", "features")
    return src.mapInArrow(run, f"item array<{kind}>, " + ", ".join(f"{c} binary" for c in _PACKED))


def _unpack(b: pa.RecordBatch, r: int, width: int) -> tuple[np.ndarray, ...]:
    """(axis, sizes, judges, labels, times, number of judges, features) of packed row ``r``."""
    get = lambda c: b.column(b.schema.get_field_index(c))[r].as_buffer()
    axis, sizes, j, y, n, nj = (np.frombuffer(get(c), np.int32) for c in _PACKED[:-1])
    return axis, sizes, j, y - 1, n.astype(float), nj, np.frombuffer(get("features"), np.float32).reshape(-1, width).astype(float)


def _posterior(axis: np.ndarray, row: np.ndarray, j: np.ndarray, y: np.ndarray, n: np.ndarray, x: np.ndarray, log_conf: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, prior) of every item; votes are (item row, judge, label, times)."""
    logp = np.empty((len(axis), SCORES))
    for a in np.unique(axis):
        logp[axis == a] = _log_prior(x[axis == a], w[a])
    prior = np.exp(logp)
    evidence = n[:, None] * log_conf[j, axis[row], :, y]
    for k in range(SCORES):
        logp[:, k] += np.bincount(row, weights=evidence[:, k], minlength=len(axis))
    logp -= logp.max(axis=1, keepdims=True)
    p = np.exp(logp)
    return p / p.sum(axis=1, keepdims=True), prior


def _features(labels: DataFrame, extra: DataFrame | None, n_axes: int) -> DataFrame:
    """Per item and axis: intercept, mean label of each other axis and its spread, log of the votes, then ``extra``."""
    per = [F.avg(F.when(F.col("axis") == a, F.col("y"))).alias(f"m{a}") for a in range(n_axes)]
    by_item = labels.groupBy("item").agg(*per, F.stddev_pop("y").alias("sd"), F.log1p(F.count(F.lit(1))).alias("votes"))
    mean = lambda a: (F.coalesce(F.col(f"m{a}"), F.lit(3.0)) - 3.0) / 2.0
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("axis"),
                F.array(F.lit(1.0), *[mean(b) if b != a else F.lit(0.0) for b in range(n_axes)], F.coalesce("sd", F.lit(0.0)) - 1.0, F.col("votes") / 4 - 0.75).alias("f"),
            )
            for a in range(n_axes)
        ]
    )
    d = by_item.select("item", F.explode(rows).alias("r")).select("item", "r.axis", "r.f")
    if extra is None:
        return d.select("item", "axis", F.col("f").alias("features"))
    e = cut(extra.groupBy("item").agg(F.max("features").alias("more")))
    width = e.select(F.max(F.size("more"))).first()[0] or 0
    return d.join(e, "item", "left").select("item", "axis", F.concat("f", F.coalesce("more", F.array_repeat(F.lit(0.0), width))).alias("features"))


def fit(labels: DataFrame, extra: DataFrame | None = None, axes: tuple[str, ...] = AXES, rounds: int = ROUNDS, l2: float = 0.02, own: float = 8.0, shared: float = 4.0, max_judges: int | None = None) -> Panel | None:
    """Fit matrices and classifier to ``long_labels``; None without any label.

    ``extra`` may give further item features as ``item, features array<double>``.
    ``own`` and ``shared`` are the pseudo-counts by which a judge's matrix of an axis
    leans on that judge's matrix over all axes, and this on the matrix of all judges.
    Every judge has matrices of its own; only where ``max_judges`` is given, judges beyond
    that many, those with the fewest labels, share one. ``l2`` regularises the classifier. A hot item is bounded: its votes are summed per
    judge and label before they are gathered. Rounds end when no entry of a matrix moves
    by ``SETTLED`` or more.
    """
    labels = cut(labels)
    ranked = labels.groupBy("judge").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "judge").limit(max_judges or MAX_JUDGES + 1).collect()
    if not ranked:
        return None
    many = max_judges is None and len(ranked) > MAX_JUDGES
    names = [] if many else [r.judge for r in ranked]
    pooled = len(names)
    if many:
        judges = cut(numbered(labels.select("judge").distinct(), F.col("judge"), name="number").select("judge", F.col("number").cast("int").alias("number")))
    else:
        judges = F.broadcast(labels.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "judge string, number int"))
    votes = labels.join(judges, "judge", "left").groupBy("item", "axis", F.coalesce("number", F.lit(pooled)).alias("j"), F.xxhash64("judge").alias("h"), "y").agg(F.count(F.lit(1)).alias("n"))
    grouped = votes.groupBy("item", "axis").agg(F.array_sort(F.collect_list(F.struct("j", "h", "y", "n"))).alias("v"))
    rows = grouped.join(_features(labels, extra, len(axes)), ["item", "axis"])
    rows = rows.select("item", "axis", F.col("v.j").alias("judges"), F.col("v.y").alias("labels"), F.col("v.n").alias("times"), F.size(F.array_distinct("v.h")).alias("n_judges"), "features")
    items = cut(_pack(rows))
    first = items.select(F.size("item").alias("n"), F.length("features").alias("bytes")).first()
    width = first["bytes"] // 4 // first["n"]
    nj, na = pooled + 1, len(axes)
    if many:
        items, w, table, took = _fit_table(items, width, na, rounds, l2, own, shared)
        table.counts = table.counts.join(judges.select(F.col("number").cast("bigint").alias("j"), "judge"), "j")
        return Panel(items, judges, None, w, names, axes, took, table)
    conf = _start(nj, na)
    w = np.zeros((na, width, SCORES))
    n_counts, n_weights = conf.size, w.size
    took = 0
    for took in range(1, rounds + 1):
        log_conf = np.log(conf)

        def sums(batches: Iterator[pa.RecordBatch], log_conf=log_conf, w=w) -> Iterator[pa.RecordBatch]:
            counts, grad, seen = np.zeros(n_counts), np.zeros_like(w), np.zeros(na)
            for b in batches:
                for r in range(b.num_rows):
                    axis, sizes, j, y, n, _, x = _unpack(b, r, width)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    p, prior = _posterior(axis, row, j, y, n, x, log_conf, w)
                    at = (j.astype(np.int64) * na + axis[row]) * SCORES
                    for k in range(SCORES):
                        counts += np.bincount((at + k) * SCORES + y, weights=p[row, k] * n, minlength=n_counts)
                    for a in np.unique(axis):
                        m = axis == a
                        grad[a] += x[m].T @ (p[m] - prior[m])
                        seen[a] += m.sum()
            every = np.concatenate([counts, grad.ravel(), seen])
            at = np.nonzero(every)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], names=["i", "v"])

        got = items.mapInArrow(sums, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        every = np.zeros(n_counts + n_weights + na)
        every[got["i"].to_numpy()] = got["v"].to_numpy()
        counts, grad, seen = every[:n_counts].reshape(conf.shape), every[n_counts : n_counts + n_weights].reshape(w.shape), np.maximum(every[n_counts + n_weights :], 1)
        before, conf = conf, _matrices(counts, _of_all(counts.sum(axis=(0, 1))), own, shared)
        w = w + 1.0 * (grad / seen[:, None, None] - l2 * w * (np.arange(width) > 0)[None, :, None])
        if np.abs(conf - before).max() < SETTLED:
            break
    return Panel(items, judges, conf, w, names, axes, took)


def consensus(panel: Panel, least_judges: int = 3) -> DataFrame:
    """``item, axis, score, confidence, n_judges`` per item and axis with labels of enough judges; ties take the lower score."""
    w, table, na = panel.weights, panel.table, len(panel.axes)
    log_conf = None if table else np.log(panel.confusion)
    kind = panel.items.schema["item"].dataType.elementType.simpleString()
    width = w.shape[1]

    def run(batches: Iterator[pa.RecordBatch], log_conf=log_conf, j_of: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                axis, sizes, j, y, n, judges, x = _unpack(b, r, width)
                j = j if j_of is None else np.searchsorted(j_of, j)
                p = _posterior(axis, np.repeat(np.arange(len(sizes)), sizes), j, y, n, x, log_conf, w)[0].round(9)
                cols = [b.column(0).slice(r, 1).flatten(), pa.array(axis), pa.array((p.argmax(axis=1) + 1).astype(np.int32)), pa.array(p.max(axis=1)), pa.array(judges)]
                yield pa.RecordBatch.from_arrays(cols, names=["item", "axis_no", "score", "confidence", "n_judges"])

    schema = f"item {kind}, axis_no int, score int, confidence double, n_judges int"
    if table:
        every, own, shared = table.every, table.own, table.shared

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            j_of, conf = _local(b, every, na, own, shared)
            return pa.Table.from_batches(run(a.to_batches(), np.log(conf), j_of))

        d = panel.items.groupBy("pack").cogroup(table.needed.join(table.counts.select("j", "c"), "j").groupBy("pack")).applyInArrow(meet, schema)
    else:
        d = panel.items.mapInArrow(run, schema)
    d = d.where(F.col("n_judges") >= least_judges)
    return d.select("item", F.element_at(F.array(*[F.lit(a) for a in panel.axes]), F.col("axis_no") + 1).alias("axis"), "score", "confidence", "n_judges")


def reliability(panel: Panel) -> pd.DataFrame:
    """Per judge and axis: accuracy (mean of the diagonal) and information in bits under even scores."""
    rows = []
    if panel.table:
        t = panel.table.counts.orderBy("j").toArrow()
        names, confusion = t["judge"].to_pylist(), _local(t, panel.table.every, len(panel.axes), panel.table.own, panel.table.shared)[1]
    else:
        names, confusion = panel.names, panel.confusion
    for j, name in enumerate(names):
        for a, axis in enumerate(panel.axes):
            c = confusion[j, a]
            marginal = c.mean(axis=0)
            bits = float((c * np.log2(c / marginal)).sum(axis=1).mean())
            rows.append((name, axis, round(float(np.diag(c).mean()), 6), round(bits, 6)))
    return pd.DataFrame(rows, columns=["judge", "axis", "accuracy", "information_bits"])


def agreement(labels: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Krippendorff's alpha of each axis for interval labels: ``axis, n_items, n_labels, alpha``.

    Items with fewer than two labels do not count; alpha is 1 without any spread.
    """
    per = labels.groupBy("axis", "item").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("y").cast("double")).alias("s"), F.sum((F.col("y") * F.col("y")).cast("double")).alias("q")).where("n >= 2")
    tot = per.groupBy("axis").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("n").alias("n"),
        F.sum((F.col("n") * F.col("q") - F.col("s") * F.col("s")) * 2 / (F.col("n") - 1)).alias("within"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
    )
    expected = (F.col("n") * F.col("q") - F.col("s") * F.col("s")) * 2 / (F.col("n") - 1)
    return tot.select(
        F.element_at(F.array(*[F.lit(a) for a in axes]), F.col("axis") + 1).alias("axis"),
        "n_items",
        F.col("n").cast("bigint").alias("n_labels"),
        F.round(1 - F.coalesce(F.try_divide("within", expected), F.lit(0.0)), 6).alias("alpha"),
    )
