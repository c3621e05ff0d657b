"""Exact similarity joins of vector columns, by blocks of a matrix product.

Rows are cut into blocks of bounded size, and every block is written once to the shared
folder by the task that reads them. A task holds some queries and reads one block of rows
after another, so no row is copied once per block of the other side: memory is bounded
and the disk holds each vector once, however many rows there are. The work is that of an
exact join and grows with the product of both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions.numeric import usable
from lacuna.session import kept, opened, release, remove, shared_folder

#: Rows of a block.
BLOCK = 8_192
#: Tasks that share the queries of a block.
QUERY_PARTS = 4
#: Tasks of a join at most.
MOST_TASKS = 20_000
_PAIRS = "a bigint, b bigint, cosine double"


def unit_matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Double-precision rows of length one."""
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_rows(df: DataFrame, key: str, vector: str, dim: int, *more: str, zeros: bool = False) -> DataFrame:
    """``id, v`` of the rows with a vector of ``dim`` finite numbers that is not all zero (``zeros``: or is)."""
    d = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), *more).where(F.col("id").isNotNull())
    fit = F.col("v").isNotNull() if zeros else usable("v")
    return d.where(fit & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def dimension(df: DataFrame, vector: str) -> int:
    """Most frequent length of a vector, 0 without any."""
    r = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    return int(r.d) if r else 0


@dataclass(frozen=True)
class Stored:
    """Blocks of rows in files of the shared folder, and the rows of each block by its number."""

    folder: str
    sizes: dict[int, int]
    #: Files of a block, where it is not the one of its number.
    files: dict[int, list[str]] = field(default_factory=dict)

    def read(self, number: int) -> pa.Table:
        """``id, v`` and further columns of a block."""
        fs, path = opened(self.folder)
        found = []
        for name in self.files.get(number, [str(number)]):
            with fs.open_input_file(f"{path}/{name}.arrow") as f:
                found.append(pa.ipc.open_file(f).read_all())
        return pa.concat_tables(found)


def store(d: DataFrame, number: str, *more: str) -> Stored:
    """Write ``id, v`` and ``more`` of ``d``, a file for each value of ``number``; a task that is repeated writes the same file."""
    folder = shared_folder(d.sparkSession)

    def write(t: pa.Table) -> pa.Table:
        fs, path = opened(folder)
        k = t[number][0].as_py()
        # another name until it is whole
        part = f"{path}/{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f, pa.ipc.new_file(f, (rows := t.select(["id", "v", *more]).combine_chunks()).schema) as w:
            w.write_table(rows)
        fs.move(part, f"{path}/{k}.arrow")
        return pa.table({"number": pa.array([k], pa.int64()), "n": pa.array([t.num_rows], pa.int64())})

    got = d.select(F.col(number).cast("bigint").alias(number), "id", "v", *more).groupBy(number).applyInArrow(write, "number bigint, n bigint").toArrow()
    # the shuffle that gathered the blocks is needed no more
    release(d.sparkSession, 1.2)
    return Stored(folder, dict(sorted(zip(got["number"].to_pylist(), got["n"].to_pylist()))))


def stored_blocks(d: DataFrame, block: int, *more: str) -> Stored:
    """Blocks of ``block`` rows at most, written as they are read, without a shuffle; small files make up a block together."""
    folder = shared_folder(d.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        held: list[pa.RecordBatch] = []

        def file() -> pa.RecordBatch:
            # a task that is repeated writes other files, and only those of one attempt are named
            t, name = pa.Table.from_batches(held).combine_chunks(), uuid.uuid4().hex
            with fs.open_output_stream(f"{path}/{name}.arrow") as f, pa.ipc.new_file(f, t.schema) as w:
                w.write_table(t)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([t.num_rows], pa.int64())], names=["name", "n"])

        n = 0
        for b in batches:
            while b.num_rows:
                some = b.slice(0, block - n)
                held.append(some)
                n, b = n + some.num_rows, b.slice(some.num_rows)
                if n == block:
                    n = 0
                    yield file()
        if n:
            yield file()

    got = d.select("id", "v", *more).mapInArrow(write, "name string, n bigint").toArrow()
    sizes: dict[int, int] = {}
    files: dict[int, list[str]] = {}
    at = -1
    for name, n in zip(got["name"].to_pylist(), got["n"].to_pylist()):
        if at < 0 or sizes[at] + n > block:
            at += 1
            sizes[at], files[at] = 0, []
        sizes[at] += n
        files[at].append(name)
    return Stored(folder, sizes, files)


def over_items(spark: SparkSession, items: list[tuple[int, ...]], work: Callable[..., Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """What ``work(*item)`` yields for every item, the items spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from work(*items[i])

    return spark.range(0, len(items), 1, min(max(1, len(items)), MOST_TASKS)).mapInArrow(run, kind)


def _pairs_batch(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["a", "b", "cosine"])


def _quarter(t: pa.Table, part: int) -> pa.Table:
    n = -(-t.num_rows // QUERY_PARTS)
    return t.slice(part * n, n)


def block_join(queries: DataFrame, rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], dim: int, block: int | None = None) -> DataFrame:
    """``a, b, cosine`` of what ``work(query ids, query vectors, row ids, row vectors)`` returns for every pair of blocks."""
    q, r = stored_blocks(queries, block or BLOCK), stored_blocks(rows, block or BLOCK)

    def run(number: int, part: int) -> Iterator[pa.RecordBatch]:
        x = _quarter(q.read(number), part)
        if x.num_rows:
            ids, v = x["id"].to_numpy(), unit_matrix(x["v"], dim)
            for k in r.sizes:
                y = r.read(k)
                yield _pairs_batch(*work(ids, v, y["id"].to_numpy(), unit_matrix(y["v"], dim)))

    return over_items(rows.sparkSession, [(k, p) for k in q.sizes for p in range(QUERY_PARTS)], run, _PAIRS)


#: Error of a product of unit vectors in float32, and of rounding to 6 decimals.
SLACK = 3e-6


def _tiles(qi: np.ndarray, q: np.ndarray, ri: np.ndarray, r: np.ndarray, pick: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]], keep: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Products in float32 tiles; what ``pick(products, first query)`` lets through is worked out in double precision and kept by ``keep(cosines)``."""
    a, b, c = [], [], []
    rt, q32 = np.ascontiguousarray(r.T.astype(np.float32)), q.astype(np.float32)
    for i in range(0, len(q), 1024):
        x, y = pick(q32[i : i + 1024] @ rt, i)
        exact = np.empty(len(x))
        for k in range(0, len(x), 200_000):
            exact[k : k + 200_000] = np.einsum("ij,ij->i", q[i + x[k : k + 200_000]], r[y[k : k + 200_000]])
        exact = np.round(exact, 6)
        if keep is not None:
            m = keep(exact)
            x, y, exact = x[m], y[m], exact[m]
        a.append(qi[i + x])
        b.append(ri[y])
        c.append(exact)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def first_per_query(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` greatest of each query, ties to the smaller id."""
    o = np.lexsort((b, -c, a))
    o = o[np.arange(len(a)) - np.searchsorted(a[o], a[o]) < k]
    return tuple(x[o] for x in (a, b, c, *more))


def _best_of(qi: np.ndarray, ri: np.ndarray, k: int, least: float | None, not_self: bool) -> Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
    """What may be among the ``k`` best of a tile of products."""
    extra = 1 if not_self else 0

    def pick(s: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        kk = min(k + extra, s.shape[1])
        bar = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk] - SLACK
        if least is not None:
            bar = np.maximum(bar, least - SLACK)
        x, y = np.nonzero(s >= bar[:, None])
        if not_self:
            m = qi[i + x] != ri[y]
            x, y = x[m], y[m]
        return x, y

    return pick


#: Queries and rows of a tile whose products stay in the cache.
TILE = (256, 2_048)


def _above(s: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """Flat places of the products that reach the bar of their row; eight at a time are passed over."""
    m = (s >= bar[:, None]).ravel()
    if len(m) % 8:
        return np.flatnonzero(m)
    at = (np.flatnonzero(m.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return at[m[at]]


def _best(qi: np.ndarray, q: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, least: float | None, not_self: bool) -> tuple[np.ndarray, ...]:
    """(query, row id, cosine, tags of the row) of the ``k`` best of each query over all blocks of rows, queries by their place in ``q``; only those found so far are kept."""
    q32, n = q.astype(np.float32), len(q)
    a, b, c, t = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None
    bar = np.full(n, -np.inf if least is None else least)
    every = np.arange(n)
    for ri, r, tags in blocks:
        if np.isinf(bar).any():
            pick = _best_of(qi, ri, k, least, not_self)
            x, y, z = _tiles(every, q, np.arange(len(ri)), r, pick, None if least is None else lambda v: v >= least)
        else:
            r32, low = r.astype(np.float32), (bar - SLACK).astype(np.float32)
            xs, ys = [], []
            for i in range(0, n, TILE[0]):
                for j in range(0, len(r), TILE[1]):
                    s = q32[i : i + TILE[0]] @ r32[j : j + TILE[1]].T
                    at = _above(s, low[i : i + TILE[0]])
                    xs.append(i + at // s.shape[1])
                    ys.append(j + at % s.shape[1])
            x, y = np.concatenate(xs), np.concatenate(ys)
            z = np.empty(len(x))
            for p in range(0, len(x), 200_000):
                z[p : p + 200_000] = np.einsum("ij,ij->i", q[x[p : p + 200_000]], r[y[p : p + 200_000]])
            z = np.round(z, 6)
            m = z >= bar[x]
            if not_self:
                m &= qi[x] != ri[y]
            x, y, z = x[m], y[m], z[m]
        t = tags[y] if t is None else np.concatenate([t, tags[y]])
        a, b, c, t = first_per_query(np.concatenate([a, x]), np.concatenate([b, ri[y]]), np.concatenate([c, z]), k, t)
        last = np.nonzero(np.bincount(a, minlength=n) == k)[0]
        bar[last] = c[np.searchsorted(a, last, "right") - 1]
    return a, b, c, t


def _tags(t: pa.Table, tags: tuple[str, ...]) -> np.ndarray:
    return np.stack([t[x].to_numpy() for x in tags], axis=1) if tags else np.zeros((t.num_rows, 0), np.int64)


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_key: str, row_key: str, vector: str = "embedding", least: float | None = None, not_self: bool = False, tags: tuple[str, ...] = ()) -> DataFrame:
    """``a, b, cosine, rank``: the ``k`` rows of greatest cosine (6 decimals) for every query, ties to the smaller id.

    ``least`` drops what is less similar, ``not_self`` pairs of equal ids. Null,
    all-zero, wrongly long and not finite vectors take no part. For each of ``tags``, whole
    numbers on both sides, ``same_`` and its name says whether it is equal and not 0.
    """
    dim, kind = dimension(rows, vector), _PAIRS + ", rank int" + "".join(f", same_{x} boolean" for x in tags)
    if not dim:
        return rows.sparkSession.createDataFrame([], kind)
    r = stored_blocks(usable_rows(rows, row_key, vector, dim, *tags), BLOCK, *tags)
    q = r if queries is rows and query_key == row_key else stored_blocks(usable_rows(queries, query_key, vector, dim, *tags), BLOCK, *tags)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for number in r.sizes:
            y = r.read(number)
            yield y["id"].to_numpy(), unit_matrix(y["v"], dim), _tags(y, tags)

    def run(number: int, part: int) -> Iterator[pa.RecordBatch]:
        x = _quarter(q.read(number), part)
        if x.num_rows:
            qi = x["id"].to_numpy()
            a, b, c, t = _best(qi, unit_matrix(x["v"], dim), blocks(), k, least, not_self)
            rank = np.arange(len(a)) - np.searchsorted(a, a) + 1
            same = (t == _tags(x, tags)[a]) & (t != 0)
            cols = [pa.array(qi[a]), pa.array(b), pa.array(c), pa.array(rank.astype(np.int32)), *[pa.array(same[:, i]) for i in range(len(tags))]]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "cosine", "rank", *[f"same_{i}" for i in tags]])

    found, _ = kept(over_items(rows.sparkSession, [(n, p) for n in q.sizes for p in range(QUERY_PARTS)], run, kind))
    for x in {r.folder, q.folder}:
        remove(x)
    return found


#: Cells of the index at most, rows aimed at per cell, and partitions of its join per partition of the session.
MOST_CELLS, CELL_ROWS, INDEX_PARTS = 2_048, 512, 3


def _index_centres(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Unit vectors of the rows of least hash, one per cell; at most ``MOST_CELLS`` reach the driver."""
    m = int(np.clip(round(n / CELL_ROWS), 1, MOST_CELLS))
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    some = rows if n <= 4 * m else rows.where(h < int(2_000_000 * m / n) + 1)
    return unit_matrix(some.orderBy(h, "id").limit(m).select("v").toArrow().column(0), dim).astype(np.float32)


def nearest_indexed(
    queries: DataFrame, rows: DataFrame, k: int, query_key: str, row_key: str, vector: str = "embedding", least: float | None = None, not_self: bool = False, probes: int = 24, homes: int = 2
) -> DataFrame:
    """As ``nearest``, but a query meets only the rows of its ``probes`` nearest cells; a row stands in its ``homes`` nearest.

    Cells are those of a bounded sample of rows; every row is indexed. The work grows with
    the rows and not with the product of both sides; neighbours in other cells are missed,
    so measure the recall before use. Cosines of what is found are exact. A crowded cell
    is cut into blocks, which all of its queries visit.
    """
    dim = dimension(rows, vector)
    if not dim:
        return rows.sparkSession.createDataFrame([], _PAIRS + ", rank int")
    r, q = usable_rows(rows, row_key, vector, dim), usable_rows(queries, query_key, vector, dim)
    centres = _index_centres(r, r.count(), dim)

    def place(d: DataFrame, m: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    s = unit_matrix(pa.chunked_array([b.column(1)]), dim).astype(np.float32) @ centres.T
                    near = np.argpartition(-s, min(m, s.shape[1]) - 1, axis=1)[:, :m]
                    at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])

        kind = d.schema["v"].dataType.simpleString()
        return d.select("id", "v").mapInArrow(run, f"id bigint, v {kind}, cell int")

    home = place(r, homes)
    # a row per cell is broadcast
    blocks = F.broadcast(home.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    home = home.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    visit = place(q, probes).join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = INDEX_PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (d.select("cell", "block", "id", "v").repartition(parts, "cell", "block") for d in (visit, home))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        qi, ri = x["id"].to_numpy(), y["id"].to_numpy()
        i, j, c = first_per_query(*_tiles(qi, unit_matrix(x["v"], dim), ri, unit_matrix(y["v"], dim), _best_of(qi, ri, k, least, not_self), None if least is None else lambda c: c >= least), k)
        return pa.table({"a": i, "b": j, "cosine": c})

    d = a.groupBy("cell", "block").cogroup(b.groupBy("cell", "block")).applyInArrow(meet, _PAIRS)
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    # a pair that met in two cells ranks once
    return d.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k).distinct()


def within(queries: DataFrame, rows: DataFrame, low: float, high: float, query_key: str, row_key: str, vector: str = "embedding") -> DataFrame:
    """``a, b, cosine`` of all pairs with a cosine (6 decimals) from ``low`` to ``high``, both included."""
    dim = dimension(rows, vector)
    if not dim:
        return rows.sparkSession.createDataFrame([], _PAIRS)

    def work(qi: np.ndarray, q: np.ndarray, ri: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
        def pick(s: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
            return np.nonzero((s >= low - SLACK) & (s <= high + SLACK))

        return _tiles(qi, q, ri, r, pick, lambda c: (c >= low) & (c <= high))

    return block_join(usable_rows(queries, query_key, vector, dim), usable_rows(rows, row_key, vector, dim), work, dim)


#: Of the ends' columns and the cosines of pairs: which stay, and a number for each.
Judge = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Blocks of a group that one task lets a block meet, at least.
KEYED_RUN = 16


def keyed_pairs(df: DataFrame, key: str, group: str, vector: str = "embedding", least: float | None = None, block: int = 2_048, more: tuple[str, ...] = (), judge: Judge | None = None) -> DataFrame:
    """``a, b, cosine`` for a < b of rows of one group, from ``least`` on (None: all).

    A group of more than ``block`` rows is cut into blocks, each written once; pairs of
    blocks are the unit of work, so a group with a third of all rows is spread over the
    cluster. Rows without a group or a
    usable vector take no part. ``judge`` gets ``id`` and the columns ``more`` of the two
    ends of some pairs and their cosines, and says which pairs stay and what their further
    column ``code`` is.
    """
    kind = _PAIRS if judge is None else _PAIRS + ", code int"
    dim = dimension(df, vector)
    if not dim:
        return df.sparkSession.createDataFrame([], kind)
    d = usable_rows(df.where(F.col(group).isNotNull() & (F.col(group) != "")), key, vector, dim, F.col(group).alias("g"), *more)
    sizes = d.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    large = {r.g: r.blocks for r in sizes.where("blocks > 1").collect()}

    def ends(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return {c: t[c].to_numpy() for c in ("id", *more)}, unit_matrix(t["v"], dim)

    def pairs(x: dict[str, np.ndarray], a: np.ndarray, y: dict[str, np.ndarray], b: np.ndarray, same: bool) -> pa.RecordBatch:
        ia, ib = x["id"], y["id"]

        def pick(s: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
            at, to = np.nonzero(s >= least - SLACK if least is not None else np.ones(s.shape, bool))
            m = ia[i + at] < ib[to] if same else ia[i + at] != ib[to]
            return at[m], to[m]

        at, to, c = _tiles(np.arange(len(ia)), a, np.arange(len(ib)), b, pick, None if least is None else lambda v: v >= least)
        if judge is None:
            return _pairs_batch(np.minimum(ia[at], ib[to]), np.maximum(ia[at], ib[to]), c)
        keep, code = judge({n: v[at] for n, v in x.items()}, {n: v[to] for n, v in y.items()}, c)
        at, to, c, code = at[keep], to[keep], c[keep], code[keep]
        return _pairs_batch(np.minimum(ia[at], ib[to]), np.maximum(ia[at], ib[to]), c).append_column("code", pa.array(code.astype(np.int32)))

    def small(t: pa.Table) -> pa.Table:
        x, v = ends(t)
        return pa.Table.from_batches([pairs(x, v, x, v, True)])

    if not large:
        return d.select("g", "id", "v", *more).groupBy("g").applyInArrow(small, kind)
    first = dict(zip(large, np.cumsum([0, *large.values()])[:-1].tolist()))
    table = df.sparkSession.createDataFrame([(g, n, first[g]) for g, n in large.items()], d.select("g").schema.add("blocks", "integer").add("first", "long"))
    # at most two blocks per ``block`` rows reach the driver, and their groups are broadcast
    held = store(d.join(F.broadcast(table), "g").withColumn("number", F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))), "number", *more)
    few = d.join(F.broadcast(table), "g", "left_anti").select("g", "id", "v", *more).groupBy("g").applyInArrow(small, kind)
    # a block meets those after it in its group, some at a time, in four tasks at most
    items = []
    for g, n in large.items():
        last, run_of = first[g] + n, max(KEYED_RUN, -(-n // 4))
        items += [(p, q, min(q + run_of, last)) for p in range(first[g], last) if p in held.sizes for q in range(p, last, run_of)]

    def run(p: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        x, a = ends(held.read(p))
        for q in range(start, end):
            if q in held.sizes:
                y, b = ends(held.read(q))
                for i in range(0, len(a), 1024):
                    yield pairs({n: v[i : i + 1024] for n, v in x.items()}, a[i : i + 1024], y, b, p == q)

    return few.unionByName(over_items(df.sparkSession, items, run, kind))


def centroids(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``group, centroid, n``: element-wise mean of the vectors of a group, by a two-phase sum per position."""
    d = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("pos", "x"))
    per = d.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("x").alias("n"))
    return per.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("n"))
