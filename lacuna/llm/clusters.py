"""Clusters of mutually similar records, by bisecting k-means across the cluster.

1. Upper splits of the tree are fitted on a bounded sample (``vectors.fit_cells``: the
   node of largest dispersion is split again and again); every row falls to its cell.
2. Below, each block of a cell is split on with all of its rows, all open nodes of a
   level at once, until a node is compact: every member is as near to the mean of the
   others as ``closeness`` asks. Leaves are groups, fragments of groups that an upper
   split cut through, or single rows.
3. Fragments of one group are joined: leaf centres visit the blocks of their nearest
   cells, near ones become edges, connected components of leaves become groups.
4. Every row takes the nearest group centre of ``least_cosine`` or more; means and
   members are settled in a few rounds, in which every group of two or more stays, and
   once more over many cells. Only then are groups below ``least_size`` dissolved, and
   their rows go to the groups that are left; rows without a group by then are shown to
   the centres of further cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm import vectors as V
from lacuna.operators.components import connected_components
from lacuna.session import cut

#: Cosine of a member to the true centre that a compact group keeps.
CLOSENESS = 0.87
#: Share of the expected nearness that two samples of one group must reach.
LENIENCE = 0.95
#: Leaf centres of this cosine are joined whatever their sizes.
JOINED = 0.70
#: Cells a leaf or group centre visits.
VISITS = 12
#: Cells a settled group centre visits to collect its members.
VISITS_LAST = 40
#: Cells it visits in all, where the further ones only show it rows that found no group so far.
VISITS_FAR = 96


def sample_nearness(n: np.ndarray, closeness: float = CLOSENESS) -> np.ndarray:
    """Cosine of the mean of ``n`` members of a group to its centre, if each member has ``closeness`` to it."""
    return 1.0 / np.sqrt(1.0 + (1.0 / closeness**2 - 1.0) / np.maximum(n, 1))


def bisect_block(x: np.ndarray, closeness: float = CLOSENESS, lenience: float = LENIENCE, rounds: int = 4) -> np.ndarray:
    """Leaf number of each unit row of ``x``: all nodes that are not compact are split in two, level by level."""
    n = len(x)
    leaf = np.full(n, -1, dtype=np.int64)
    rows, node = np.arange(n), np.zeros(n, dtype=np.int64)
    leaves = 0
    while len(rows):
        y = x[rows]
        start = np.concatenate(([0], np.nonzero(np.diff(node))[0] + 1))
        size = np.diff(np.append(start, len(rows)))
        at = np.repeat(np.arange(len(start)), size)
        total = np.add.reduceat(y, start, axis=0)
        dot = np.einsum("ij,ij->i", y, total[at])
        square = np.einsum("ij,ij->i", total, total)
        m = size[at]
        others = np.sqrt(np.maximum(square[at] - 2 * dot + 1, 1e-12))
        near = np.where(m > 1, (dot - 1) / others, 1.0)
        limit = lenience * closeness * sample_nearness(m - 1, closeness)
        compact = np.minimum.reduceat(near - limit, start) >= 0
        done = compact[at]
        if done.any():
            number = np.cumsum(compact) - 1 + leaves
            leaf[rows[done]] = number[at[done]]
            leaves += int(compact.sum())
        if done.all():
            break
        rows, y, dot = rows[~done], y[~done], dot[~done]
        at = np.unique(at[~done], return_inverse=True)[1]
        start = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1))

        def first_least(v: np.ndarray, start=start, at=at) -> np.ndarray:
            order = np.lexsort((np.arange(len(v)), v, at))
            return order[start]

        a = y[first_least(dot)]
        ya = np.einsum("ij,ij->i", y, a[at])
        b = y[first_least(ya)]
        side = ya >= np.einsum("ij,ij->i", y, b[at])
        for _ in range(rounds):
            p = np.add.reduceat(y * side[:, None], start, axis=0)
            q = np.add.reduceat(y * ~side[:, None], start, axis=0)
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            side = np.einsum("ij,ij->i", y, (p - q)[at]) >= 0
        # a node that does not split (equal rows) is halved by position
        both = np.add.reduceat(side.astype(np.int64), start)
        size = np.diff(np.append(start, len(rows)))
        stuck = ((both == 0) | (both == size))[at]
        if stuck.any():
            side[stuck] = ((np.arange(len(rows)) - start[at]) * 2 < size[at])[stuck]
        key = at * 2 + ~side
        order = np.argsort(key, kind="stable")
        rows, node = rows[order], key[order]
    return leaf


_LEAF = "leaf bigint, id bigint, n bigint, v binary"
_EDGE = "a bigint, b bigint"
_MEMBER = "id bigint, grp bigint, cosine double, n bigint, v binary"


def _leaves(points: DataFrame, dim: int, closeness: float) -> DataFrame:
    """``leaf, id, n, v``: a leaf is named by its smallest id; this row carries its size and its mean direction."""

    def run(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = V.from_binary(t["v"], dim)[order]
        number = bisect_block(x, closeness)
        by = np.argsort(number, kind="stable")
        start = np.concatenate(([0], np.nonzero(np.diff(number[by]))[0] + 1))
        size = np.diff(np.append(start, len(by)))
        sums = np.add.reduceat(x[by], start, axis=0)
        head = np.zeros(len(by), dtype=bool)
        head[start] = True
        name = np.repeat(ids[by][start], size)
        v = V.to_binary(V.unit(sums).astype(np.float16)).take(pa.array(np.where(head, np.cumsum(head) - 1, 0), mask=~head))
        return pa.table({"leaf": name, "id": ids[by], "n": np.where(head, np.repeat(size, size), 0), "v": v})

    return points.groupBy("cell", "block").applyInArrow(run, _LEAF)


def _fragment_edges(leaves: DataFrame, cells: V.Cells, closeness: float) -> DataFrame:
    """Pairs of leaves whose centres are as near as two samples of one group would be."""
    dim = cells.dim

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = cells.nearest(V.unit(V.from_binary(b.column(2), dim)))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", "id", "n", "v"])

    frag = leaves.select(F.col("leaf").alias("id"), "n", "v")
    homes = frag.mapInArrow(home, "cell int, id bigint, n bigint, v binary")
    blocks = V.block_counts(homes, len(cells.centres))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not a.num_rows or not b.num_rows:
            return none
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        xa, xb = V.unit(V.from_binary(a["v"], dim)), V.unit(V.from_binary(b["v"], dim))
        ga, gb = sample_nearness(a["n"].to_numpy(), closeness), sample_nearness(b["n"].to_numpy(), closeness)
        left, right = [], []
        for i in range(0, len(ib), 1024):
            s = xb[i : i + 1024] @ xa.T
            r, c = np.nonzero(s >= np.minimum(LENIENCE * gb[i : i + 1024, None] * ga[None, :], JOINED))
            left.append(ib[i + r])
            right.append(ia[c])
        p, q = np.concatenate(left), np.concatenate(right)
        m = p != q
        lo, hi = np.minimum(p[m], q[m]), np.maximum(p[m], q[m])
        return pa.table({"a": lo, "b": hi})

    return V.meet(V.with_block(homes, blocks), V.visit(frag, cells, blocks, VISITS), work, _EDGE).distinct()


def _assign(points: DataFrame, groups: DataFrame, cells: V.Cells, blocks: np.ndarray, least: float, visits: int, skip: int = 0) -> DataFrame:
    """Each row's nearest group centre among those that visit its block, of cosine ``least`` or more; ties take the smaller group.

    Besides a row for each member, every block gives its share of a group: the number of
    members in ``n`` and their sum in ``v``, with a null id.
    """
    dim = cells.dim

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "grp": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64()), "n": pa.array([], pa.int64()), "v": pa.array([], pa.binary())})
        if not a.num_rows or not b.num_rows:
            return none
        names = b["id"].to_numpy()
        order = np.argsort(names)
        names, c = names[order], V.unit(V.from_binary(b["v"], dim))[order].T.copy()
        ids, x = a["id"].to_numpy(), V.from_binary(a["v"], dim)
        best, val = np.empty(len(ids), np.int64), np.empty(len(ids))
        for i in range(0, len(ids), 1024):
            s = x[i : i + 1024] @ c
            k = s.argmax(axis=1)
            best[i : i + 1024], val[i : i + 1024] = k, s[np.arange(len(s)), k]
        m = np.nonzero(val >= least)[0]
        if not len(m):
            return none
        m = m[np.argsort(best[m], kind="stable")]
        g = names[best[m]]
        start = np.concatenate(([0], np.nonzero(np.diff(g))[0] + 1))
        size = np.diff(np.append(start, len(g)))
        rows = pa.table({"id": ids[m], "grp": g, "cosine": val[m], "n": pa.nulls(len(m), pa.int64()), "v": pa.nulls(len(m), pa.binary())})
        share = V.to_binary(np.add.reduceat(x[m], start, axis=0))
        return pa.concat_tables([rows, pa.table({"id": pa.nulls(len(start), pa.int64()), "grp": g[start], "cosine": pa.nulls(len(start), pa.float64()), "n": size.astype(np.int64), "v": share})])

    return V.meet(points, V.visit(groups, cells, blocks, visits, skip=skip), work, _MEMBER)


def _members(assigned: DataFrame) -> DataFrame:
    """``id, grp, cosine`` of the members; where parts of a crowded block each gave a row its best, the best of these."""
    best = F.max_by(F.struct("grp", "cosine"), F.struct("cosine", (-F.col("grp")).alias("g")))
    return assigned.where("id is not null").groupBy("id").agg(best.alias("m")).select("id", "m.grp", "m.cosine")


def _centres(shares: DataFrame, dim: int, least_size: int) -> DataFrame:
    """``id, n, v``: mean direction of every group with ``least_size`` members or more, from the shares ``id, n, v`` of sums."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # shares of a group lie next to each other here; a run may span batches
        held: tuple[int, int, np.ndarray] | None = None
        out = lambda g, n, x: pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int64()), V.to_binary(V.unit(x + 1e-12).astype(np.float16))], names=["id", "n", "v"])
        for b in batches:
            if not b.num_rows:
                continue
            g, n, x = b.column(0).to_numpy(), b.column(1).to_numpy(), V.from_binary(b.column(2), dim)
            start = np.concatenate(([0], np.nonzero(np.diff(g))[0] + 1))
            names, size, sums = g[start].copy(), np.add.reduceat(n, start), np.add.reduceat(x, start, axis=0)
            if held is not None:
                if held[0] == names[0]:
                    size[0] += held[1]
                    sums[0] += held[2]
                else:
                    yield out([held[0]], [held[1]], held[2][None])
            held = (int(names[-1]), int(size[-1]), sums[-1].copy())
            if len(names) > 1:
                yield out(names[:-1], size[:-1], sums[:-1])
        if held is not None:
            yield out([held[0]], [held[1]], held[2][None])

    ready = shares.select("id", "n", "v").repartition("id").sortWithinPartitions("id")
    return ready.mapInArrow(merge, "id bigint, n bigint, v binary").where(F.col("n") >= least_size)


def similarity_clusters(df: DataFrame, key: str = "gap_idx", vector: str = "embedding", least_size: int = 5, least_cosine: float = 0.7, closeness: float = CLOSENESS, rounds: int = 2) -> DataFrame:
    """``id, grp, cosine``: the cluster of every row that is in one, named by its smallest leaf.

    A cluster has ``least_size`` rows or more, each with cosine ``least_cosine`` or more
    to the mean direction of its cluster and nearest to it of all that were compared.
    Rows with a null, all-zero, wrongly long or not finite vector and rows like no others
    are in none. Only direction counts. Equal rows fall together; an empty table gives no
    rows. Columns besides ``key`` and ``vector`` are not read.
    """
    dim = V.dimension(df, vector)
    if not dim:
        return df.sparkSession.createDataFrame([], "id bigint, grp bigint, cosine double")
    cells = V.fit_cells(df, key, vector, dim, df.count())
    points = cut(V.index_rows(df, key, vector, cells))
    blocks = V.block_counts(points, len(cells.centres))
    points = V.with_block(points, blocks)
    members = cut(_leaves(points, dim, closeness))
    leaves = members.where("n > 0").select("leaf", "n", "v")
    comp = connected_components(_fragment_edges(leaves, cells, closeness)).withColumnRenamed("node", "leaf")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_numpy()
            if len(n):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), V.to_binary(V.from_binary(b.column(2), dim) * n[:, None].astype(np.float32))], names=["id", "n", "v"])

    shares = leaves.join(comp, "leaf", "left").select(F.coalesce("component", "leaf").alias("id"), "n", "v").mapInArrow(weigh, "id bigint, n bigint, v binary")
    of = lambda got: got.where("id is null").select(F.col("grp").alias("id"), "n", "v")
    centres = cut(_centres(shares, dim, 2))
    for visits, least in [(VISITS, 2)] * rounds + [(VISITS_LAST, least_size)]:
        centres = cut(_centres(of(_assign(points, centres.select("id", "v"), cells, blocks, least_cosine, visits)), dim, least))
    final = cut(_members(_assign(points, centres.select("id", "v"), cells, blocks, least_cosine, VISITS_LAST)))
    if len(cells.centres) > VISITS_LAST:
        left = points.join(final.select("id"), "id", "left_anti")
        final = cut(final.unionByName(_members(_assign(left, centres.select("id", "v"), cells, blocks, least_cosine, VISITS_FAR, VISITS_LAST))))
    large = final.groupBy("grp").count().where(F.col("count") >= least_size).select("grp")
    return final.join(large, "grp", "left_semi").select("id", "grp", "cosine")


def cluster_report(df: DataFrame, members: DataFrame, key: str = "gap_idx", text: str = "gap_sentence", top: int = 3) -> DataFrame:
    """``cluster_id, size, mean_cosine, typical``: size and the ``top`` members nearest to the centre, as texts."""
    size = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("cosine"), 4).alias("mean_cosine"))
    w = Window.partitionBy("grp").orderBy(F.desc("cosine"), "id")
    near = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    typical = near.join(df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")), "id").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("x"))
    return size.join(typical, "grp").select(F.col("grp").alias("cluster_id"), "size", "mean_cosine", F.col("x.t").alias("typical"))
