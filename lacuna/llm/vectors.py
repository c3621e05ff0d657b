"""Cells of a vector collection, and block joins inside them.

Centres of a bounded number of cells are fitted by bisecting on a bounded sample of the
rows; every row is then indexed in its nearest cell. A cell with many rows is cut into
blocks of bounded size, so a crowd of equal vectors never meets in one task. What
searches a cell visits all of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows the centres are fitted on, at most.
SAMPLE_ROWS = 60_000
#: Rows aimed at per cell, and the largest number of cells.
CELL_ROWS = 1_000
MAX_CELLS = 4_096
#: Rows of a block, about.
BLOCK_ROWS = 8_192
#: Visitors a block takes at once, about.
VISITOR_ROWS = 50_000


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, float32 matrix) of the usable vectors: not null, ``dim`` finite numbers, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.where(np.asarray(column.is_valid()), np.diff(column.offsets.to_numpy()), -1)
    rows = np.nonzero(lengths == dim)[0]
    flat = column.take(pa.array(rows)).flatten().cast(pa.float32())
    x = np.ascontiguousarray(np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(rows), dim))
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` at length one, in double precision first."""
    y = x.astype(np.float64)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def to_binary(x: np.ndarray) -> pa.Array:
    """Each row of ``x`` as its bytes."""
    raw = np.ascontiguousarray(x).tobytes()
    width = x.shape[1] * x.itemsize
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int64) * width, pa.int64())
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, offsets.buffers()[1], pa.py_buffer(raw)]).cast(pa.binary())


def from_binary(column: pa.Array, dim: int) -> np.ndarray:
    """Inverse of ``to_binary`` for float32 and float16, told apart by the length; gives float32."""
    rows = column.to_pylist()
    raw = b"".join(rows)
    kind = np.float16 if len(raw) == len(rows) * dim * 2 else np.float32
    return np.frombuffer(raw, dtype=kind).reshape(len(rows), dim).astype(np.float32, copy=False)


def dimension(df: DataFrame, vector: str) -> int:
    """Most frequent length of a vector, 0 without any."""
    r = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(r.d) if r else 0


def bisect_centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centres of ``k`` cells of unit vectors ``x``: the node of largest dispersion is split in two again and again."""
    import heapq

    heap = [(-float(len(x)), 0, np.arange(len(x)))]
    serial, done = 1, []
    while heap and len(heap) + len(done) < k:
        _, _, rows = heapq.heappop(heap)
        side = two_means(x[rows], rounds) if len(rows) > 1 else None
        if side is None or side.all() or not side.any():
            done.append(rows)
            continue
        for part in (rows[side], rows[~side]):
            s = x[part].sum(axis=0)
            heapq.heappush(heap, (-(len(part) - float(np.linalg.norm(s))), serial, part))
            serial += 1
    c = np.stack([x[r].sum(axis=0) for r in done + [h[2] for h in heap]])
    return unit(c + 1e-12)


def two_means(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Side (bool) of each row after spherical 2-means from the farthest rows."""
    mean = x.sum(axis=0)
    a = x[int((x @ mean).argmin())]
    b = x[int((x @ a).argmin())]
    side = (x @ a) >= (x @ b)
    for _ in range(rounds):
        if side.all() or not side.any():
            break
        c = np.stack([x[side].sum(axis=0), x[~side].sum(axis=0)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        s = x @ c.T
        new = s[:, 0] >= s[:, 1]
        if (new == side).all():
            break
        side = new
    return side


@dataclass
class Cells:
    """Unit centres of the cells."""

    centres: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def nearest(self, u: np.ndarray, m: int = 1) -> np.ndarray:
        """The ``m`` nearest cells of each row, nearest first."""
        m = min(m, len(self.centres))
        out = np.empty((len(u), m), dtype=np.int32)
        for i in range(0, len(u), 4096):
            s = u[i : i + 4096] @ self.centres.T
            if m == 1:
                out[i : i + 4096, 0] = s.argmax(axis=1)
            else:
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                out[i : i + 4096] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
        return out


def sample_plan(n_rows: int) -> tuple[int, int]:
    """(cells, rows to fit them on) for a collection of ``n_rows``; neither grows beyond ``MAX_CELLS`` and ``SAMPLE_ROWS``."""
    k = int(np.clip(round(n_rows / CELL_ROWS), 1, MAX_CELLS))
    return k, min(SAMPLE_ROWS, max(2_000, 64 * k))


def fit_cells(df: DataFrame, key: str, vector: str, dim: int, n_rows: int) -> Cells:
    """Fit centres on at most ``SAMPLE_ROWS`` rows, those of least hash of their key.

    The number of cells follows the number of rows up to ``MAX_CELLS``.
    """
    k, want = sample_plan(n_rows)
    h = F.xxhash64(F.col(key).cast("bigint"))
    d = df.where(F.col(vector).isNotNull()).select(vector, h.alias("h"), F.col(key).alias("k"))
    if n_rows > want:
        # half as many again are let through, the rest of the choice is by order
        d = d.where(F.pmod("h", F.lit(1_000_000)) < int(min(1.0, 1.5 * want / n_rows) * 1_000_000) + 1)
    d = d.orderBy(F.pmod("h", F.lit(1_000_000)), "h", "k").limit(want).select(vector)
    _, x = matrix(d.toArrow().column(0).cast(pa.list_(pa.float32())), dim)
    return Cells(bisect_centres(unit(x), k) if len(x) else np.eye(1, dim, dtype=np.float32))


def survey(df: DataFrame, vector: str, cells: Cells, homes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stand in each cell, greatest angle between its centre and the rows nearest to it), in one pass; two numbers a cell reach the driver."""
    dim = cells.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros(len(cells.centres), dtype=np.int64), np.full(len(cells.centres), -4.0)
        for b in batches:
            u = unit(matrix(b.column(0), dim)[1])
            if len(u):
                near = cells.nearest(u, homes)
                n += np.bincount(near.ravel(), minlength=len(n))
                np.maximum.at(far, near[:, 0], np.arccos(np.clip(np.einsum("ij,ij->i", u, cells.centres[near[:, 0]]), -1, 1)))
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(far[at])], names=["cell", "n", "angle"])

    n, reach = np.zeros(len(cells.centres), dtype=np.int64), np.full(len(cells.centres), -4.0)
    for r in df.select(vector).where(F.col(vector).isNotNull()).mapInArrow(run, "cell int, n bigint, angle double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).collect():
        n[r["cell"]], reach[r["cell"]] = r["n"], r["angle"]
    return n, reach


def blocks_of(n: np.ndarray, block_rows: int | None = None) -> np.ndarray:
    """Blocks of every cell from its rows."""
    return np.maximum(1, -(-n // (block_rows or BLOCK_ROWS))).astype(np.int32)


def index_rows(df: DataFrame, key: str, vector: str, cells: Cells, raw: bool = False, homes: int = 1) -> DataFrame:
    """``cell, id, v``: every usable row in its nearest cell, or in the ``homes`` nearest, told apart by ``nth``; ``v`` its unit vector in float16 (``raw``: the vector as it came, in float32)."""
    dim = cells.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = matrix(b.column(1), dim)
            u = unit(x)
            near = cells.nearest(u, homes)
            ids, v = b.column(0).cast(pa.int64()).take(pa.array(rows)), to_binary(x if raw else u.astype(np.float16))
            if homes == 1:
                yield pa.RecordBatch.from_arrays([pa.array(near[:, 0]), ids, v], names=["cell", "id", "v"])
            else:
                for k in range(near.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, k]), ids, v, pa.array(np.full(len(ids), k, np.int32))], names=["cell", "id", "v", "nth"])

    return df.select(F.col(key), F.col(vector)).where(F.col(key).isNotNull() & F.col(vector).isNotNull()).mapInArrow(run, "cell int, id bigint, v binary" + ", nth int" * (homes > 1))


def block_counts(indexed: DataFrame, n_cells: int) -> np.ndarray:
    """Blocks of every cell of indexed rows; at most ``MAX_CELLS`` numbers come to the driver."""
    n = np.zeros(n_cells, dtype=np.int64)
    for r in indexed.groupBy("cell").count().collect():
        n[r["cell"]] = r["count"]
    return blocks_of(n)


def with_block(indexed: DataFrame, blocks: np.ndarray) -> DataFrame:
    """Add ``block`` to indexed rows: one of the cell's blocks, by the hash of the id. At most ``MAX_CELLS`` counts are broadcast."""
    hot = [(int(c), int(n)) for c, n in enumerate(blocks) if n > 1]
    if not hot:
        return indexed.withColumn("block", F.lit(0))
    n = F.broadcast(indexed.sparkSession.createDataFrame(hot, "cell int, _blocks int"))
    block = F.pmod(F.xxhash64("id"), F.coalesce("_blocks", F.lit(1))).cast("int").alias("block")
    return indexed.join(n, "cell", "left").select(*indexed.columns, block)


def visit(vectors: DataFrame, cells: Cells, blocks: np.ndarray, m: int, alone: int | None = None, skip: int = 0) -> DataFrame:
    """Send ``id, v`` and what else there is to every block of the ``m`` nearest cells but the ``skip`` nearest: adds ``cell, block``.

    With ``alone``, vectors that stand for a single row (``n`` is 1) visit only so many cells.
    """
    names = vectors.columns

    def going(b: pa.RecordBatch, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = cells.nearest(u, m)[:, skip:]
        row, cell = np.repeat(np.arange(len(near)), near.shape[1]), near.reshape(-1)
        if alone is not None:
            single = b.column(names.index("n")).to_numpy() == 1
            keep = ~(single[row] & (np.tile(np.arange(near.shape[1]), len(near)) >= alone))
            row, cell = row[keep], cell[keep]
        return row, cell

    return _send(vectors, cells.dim, blocks, going)


def visit_beyond(vectors: DataFrame, cells: Cells, blocks: np.ndarray, seen: int, least: str, reach: np.ndarray) -> DataFrame:
    """Send vectors to every cell that may hold a row of cosine ``least`` or more, except their ``seen`` nearest ones.

    ``reach`` is the greatest angle between a cell's centre and its rows. A row of a cell
    is no nearer to a vector than the centre's angle less the reach, so what is left out
    cannot beat ``least`` (null: nothing is left out).
    """
    at = vectors.columns.index(least)

    def going(b: pa.RecordBatch, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        floor = b.column(at).fill_null(-1.0).to_numpy(zero_copy_only=False)
        rows, to = [], []
        for i in range(0, len(u), 1024):
            angle = np.arccos(np.clip(u[i : i + 1024] @ cells.centres.T, -1, 1))
            may = np.maximum(angle - reach[None, :], 0) <= np.arccos(np.clip(floor[i : i + 1024], -1, 1))[:, None] + 1e-3
            np.put_along_axis(may, cells.nearest(u[i : i + 1024], seen), False, axis=1)
            r, c = np.nonzero(may)
            rows.append(i + r)
            to.append(c.astype(np.int32))
        return np.concatenate(rows), np.concatenate(to)

    return _send(vectors, cells.dim, blocks, going)


def _send(vectors: DataFrame, dim: int, blocks: np.ndarray, going: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows of ``vectors`` to all blocks of the cells that ``going`` names, as (row, cell)."""
    names = vectors.columns
    at = names.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, cell = going(b, unit(from_binary(b.column(at), dim)))
            n = blocks[cell]
            first = np.repeat(np.cumsum(n) - n, n)
            block = np.arange(int(n.sum())) - first
            row, cell = np.repeat(row, n), np.repeat(cell, n)
            for i in range(0, len(row), 20_000):
                t = pa.array(row[i : i + 20_000])
                cols = [c.take(t) for c in b.columns] + [pa.array(cell[i : i + 20_000]), pa.array(block[i : i + 20_000].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "cell", "block"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, cell int, block int")


def meet(residents: DataFrame, visitors: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, spread: int = 1) -> DataFrame:
    """Run ``work(residents, visitors)`` for every block that has both.

    Visitors of every crowded block are cut into parts of about ``VISITOR_ROWS`` by the
    hash of their id, and the block's residents are sent to each part. What is broadcast
    is a row per crowded block, at most the visitors divided by ``VISITOR_ROWS``. With
    ``spread`` the join takes so many times the session's partitions, where many copies
    of a vector meet.
    """
    keys = ["cell", "block"]
    crowded = visitors.groupBy(*keys).count().where(F.col("count") > VISITOR_ROWS)
    parts = crowded.select(*keys, F.ceil(F.col("count") / VISITOR_ROWS).cast("int").alias("parts")).collect()
    if parts:
        known = F.broadcast(residents.sparkSession.createDataFrame([tuple(r) for r in parts], "cell int, block int, parts int"))
        n = F.coalesce("parts", F.lit(1))
        residents = residents.join(known, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts")
        visitors = visitors.join(known, keys, "left").withColumn("part", F.pmod(F.xxhash64("id"), n).cast("int")).drop("parts")
        keys.append("part")
    if spread > 1:
        n_parts = spread * int(residents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        residents, visitors = residents.repartition(n_parts, *keys), visitors.repartition(n_parts, *keys)
    return residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(work, schema)
