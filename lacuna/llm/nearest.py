"""The k most similar vectors of every query vector, by block matrix joins.

Queries visit the blocks of their nearest cells; a row stands in its two nearest ones, so
that neighbours on both sides of a border meet. Inside a block, vectors are quantised to
int8 and their integer products are formed tile by tile; scales are applied afterwards,
and the lengths of the quantisation errors bound the error of every product, so only
pairs that may still be among the k best are recomputed in double precision. Partial
lists of k are merged by a heap per query. A query whose k-th best is not convincingly
near then visits every further cell that may hold a nearer row, by the angle between the
query and the cell's centre and the reach of the cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import vectors as V
from lacuna.session import cut

#: Cells a query visits first.
PROBES = 12
#: Cells a row stands in.
HOMES = 2
#: A query whose k-th cosine is below this after its first visits is searched wherever a nearer row may be.
SURE = 0.70
#: Partitions of the block joins per partition of the session.
SPREAD = 3
#: Rows of a product tile.
TILE = 1024
#: Dimensions whose int8 products float32 sums without rounding: 1024 times 127 times 127 is below 2 to the 24th.
EXACT_DIMS = 1024
_OUT = "qid bigint, id bigint, cosine double"


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, length of the error) with ``row / scale`` near ``u``."""
    scale = 127.0 / np.maximum(np.abs(u).max(axis=1), 1e-12)
    q = np.rint(u * scale[:, None]).astype(np.int8)
    error = np.linalg.norm(u - q / scale[:, None], axis=1)
    return q, scale.astype(np.float32), error.astype(np.float32)


def integer_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of int8 rows ``a`` and columns ``b``: the machine multiplies floats that hold integers, a slice of dimensions at a time."""
    if a.shape[1] <= EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32)
    return sum((a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[i : i + EXACT_DIMS].astype(np.float32)).astype(np.float64) for i in range(0, a.shape[1], EXACT_DIMS))


def block_top(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine rounded to 6) of the k best rows of ``x`` for each row of ``y``; ties take the smaller id."""
    xd, yd = x.astype(np.float64), y.astype(np.float64)
    xn, yn = xd / np.linalg.norm(xd, axis=1, keepdims=True), yd / np.linalg.norm(yd, axis=1, keepdims=True)
    qx, sx, ex = quantise(xn)
    qy, sy, ey = quantise(yn)
    columns, inverse = np.ascontiguousarray(qx.T), (1.0 / sx).astype(np.float32)
    worst = float(ex.max())
    out_q, out_i, out_c = [], [], []
    for i in range(0, len(y), TILE):
        # rows of the tile are compared with each other only, so the query's own scale waits for the slack
        s = integer_product(qy[i : i + TILE], columns) * inverse
        slack = (ey[i : i + TILE] * (1 + worst) + worst + 2e-6) * sy[i : i + TILE]
        if s.shape[1] > k:
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            r, c = np.nonzero(s >= (kth - 2 * slack)[:, None])
        else:
            r, c = np.nonzero(np.ones(s.shape, dtype=bool))
        exact = np.empty(len(r))
        for j in range(0, len(r), 200_000):
            exact[j : j + 200_000] = np.einsum("ij,ij->i", yn[i + r[j : j + 200_000]], xn[c[j : j + 200_000]])
        exact = np.round(exact, 6)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        start = np.searchsorted(r, np.arange(len(s)))
        keep = np.arange(len(r)) - start[r] < k
        out_q.append(qids[i + r[keep]])
        out_i.append(ids[c[keep]])
        out_c.append(exact[keep])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_c)


def merge_lists(pairs: DataFrame, k: int) -> DataFrame:
    """``qid, id, cosine, rank``: the ``k`` best of every query by a heap over its partial lists; a pair that met twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a query lie next to each other; a run may span batches
        query, heap = None, []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def finish() -> None:
            best = sorted(heap, reverse=True)
            out[0].extend([query] * len(best))
            out[1].extend(-i for _, i in best)
            out[2].extend(c for c, _ in best)
            out[3].extend(range(1, len(best) + 1))

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names=["qid", "id", "cosine", "rank"])

        for b in batches:
            for q, i, c in zip(*(x.to_pylist() for x in b.columns)):
                if q != query:
                    finish()
                    query, heap = q, []
                item = (c, -i)
                if len(heap) < k:
                    if item not in heap:
                        heapq.heappush(heap, item)
                elif item > heap[0] and item not in heap:
                    heapq.heapreplace(heap, item)
            if len(out[0]) > 10_000:
                yield flush()
        finish()
        yield flush()

    return pairs.repartition("qid").sortWithinPartitions("qid").mapInArrow(run, _OUT + ", rank int")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, row_id: str = "gap_idx", query_id: str = "method_idx", vector: str = "embedding", probes: int = PROBES, sure: float = SURE) -> DataFrame:
    """``qid, id, cosine, rank`` of the ``k`` rows nearest to every query, cosine rounded to 6 decimals.

    Null, all-zero, wrongly long and not finite vectors neither search nor are found.
    With fewer than ``k`` usable rows all of them are given; an empty side gives no rows.
    Repeated ids count once if their vectors are equal. Ties take the smaller id.
    """
    dim = V.dimension(rows, vector)
    spark = rows.sparkSession
    if not dim:
        return spark.createDataFrame([], "qid bigint, id bigint, cosine double, rank int")
    cells = V.fit_cells(rows, row_id, vector, dim, rows.count())
    home = V.index_rows(rows, row_id, vector, cells, raw=True, homes=HOMES)
    n, reach = V.survey(rows.where(F.col(row_id).isNotNull()), vector, cells, HOMES)
    blocks = V.blocks_of(n)
    home = V.with_block(home, blocks)
    asked = cut(V.index_rows(queries, query_id, vector, cells, raw=True).select("id", "v"))

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        q, i, c = block_top(a["id"].to_numpy(), V.from_binary(a["v"], dim), b["id"].to_numpy(), V.from_binary(b["v"], dim), k)
        return pa.table({"qid": q, "id": i, "cosine": c})

    # a crowd of queries in one cell is cut as the rows are, the rows are sent to each part
    best = cut(merge_lists(V.meet(home, V.visit(asked, cells, blocks, probes), work, _OUT, SPREAD), k))
    if len(cells.centres) > probes:
        kth = best.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("cosine").alias("least"))
        open_ = asked.join(kth, "id", "left").where(F.col("least").isNull() | (F.col("least") < sure))
        if not open_.isEmpty():
            further = V.visit_beyond(open_, cells, blocks, probes, "least", reach)
            best = merge_lists(best.drop("rank").unionByName(V.meet(home.where("nth = 0"), further, work, _OUT, SPREAD)), k)
    return best
