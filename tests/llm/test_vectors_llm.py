import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import clusters, nearest
from lacuna.llm import vectors as V


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "gap_idx int, embedding array<float>, cell string").repartition(6)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(40, 32))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    size = rng.integers(5, 15, 40)
    y = np.repeat(np.arange(40), size)
    x = c[y] + rng.normal(size=(len(y), 32)) * 0.06
    noise = rng.normal(size=(150, 32))
    return np.concatenate([x * rng.uniform(0.5, 3, (len(x), 1)), noise]), np.concatenate([y, np.full(150, -1)])


@pytest.mark.parametrize("cell_rows", [40, 1000])
def test_planted_clusters(spark, planted, monkeypatch, cell_rows):
    x, y = planted
    monkeypatch.setattr(V, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    df = frame(spark, x, [(9000, None, "c"), (9001, [0.0] * 32, "c"), (9002, [1.0], "c"), (9003, [float("nan")] * 32, "c")])
    got = {r.id: r.grp for r in clusters.similarity_clusters(df).collect()}
    assert not set(got) & {9000, 9001, 9002, 9003}
    pairs = lambda lab: {(i, j) for i in lab for j in lab if i < j and lab[i] == lab[j]}
    want = pairs({i: int(k) for i, k in enumerate(y) if k >= 0})
    mine = pairs(got)
    assert len(want & mine) >= 0.98 * len(want) and len(mine - want) <= 0.02 * len(want)


def test_copies_and_small_tables(spark, planted):
    x, _ = planted
    same = np.tile(x[:1], (400, 1))
    got = clusters.similarity_clusters(frame(spark, np.concatenate([same, x[200:230]])))
    assert got.where("id < 400").select("grp").distinct().count() == 1 and got.where("id < 400").count() == 400
    assert clusters.similarity_clusters(frame(spark, x[:3])).count() == 0
    assert clusters.similarity_clusters(frame(spark, x[:0])).count() == 0
    df = frame(spark, same[:6]).withColumn("gap_sentence", F.concat(F.lit("s"), "gap_idx"))
    r = clusters.cluster_report(df, clusters.similarity_clusters(df)).collect()
    assert [(a["size"], len(a.typical)) for a in r] == [(6, 3)]


def brute(x, y, k):
    u, v = (a.astype(np.float32).astype(float) for a in (x, y))
    s = np.round(v / np.linalg.norm(v, axis=1, keepdims=True) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T, 6)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), -r))[:k]] for i, r in enumerate(s)}


def test_nearest_against_brute(spark, planted, monkeypatch):
    x, _ = planted
    monkeypatch.setattr(V, "CELL_ROWS", 30)
    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    monkeypatch.setattr(V, "VISITOR_ROWS", 50)
    x = np.concatenate([x, x[:5]])  # ties
    q = x[::3] + np.random.default_rng(5).normal(size=x[::3].shape) * 0.02
    df = frame(spark, x, [(9000, None, "c"), (9001, [0.0] * 32, "c")])
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)] + [(9000, [0.0] * 32), (9001, None)], "method_idx int, embedding array<float>")
    got = {}
    for r in nearest.nearest(df, queries, 5, probes=4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    want = brute(x, q, 5)
    assert set(got) == set(want)
    hit = sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want))
    assert hit >= 0.95
    assert nearest.nearest(df.limit(0), queries).count() == 0
    assert nearest.nearest(df, queries.limit(0)).count() == 0
    assert nearest.nearest(frame(spark, x[:2]), queries.where("method_idx < 3")).count() == 6


def test_block_top_is_exact():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(700, 24)).astype(np.float32), rng.normal(size=(60, 24)).astype(np.float32)
    x[100] = x[50]
    q, i, c = nearest.block_top(np.arange(700), x, np.arange(60), y, 7)
    want = brute(x, y, 7)
    assert {k: i[q == k].tolist() for k in range(60)} == want and (np.diff(c[q == 0]) <= 0).all()


def test_bisect_block():
    rng = np.random.default_rng(2)
    c = V.unit(rng.normal(size=(20, 48)))
    y = np.repeat(np.arange(20), 10)
    leaf = clusters.bisect_block(V.unit(c[y] + rng.normal(size=(200, 48)) * 0.03))
    assert all(len(set(y[leaf == k])) == 1 for k in set(leaf)) and len(set(leaf)) < 40
    assert len(set(clusters.bisect_block(np.tile(c[:1], (50, 1))))) == 1
    assert clusters.bisect_block(c[:1]).tolist() == [0]


def test_clusters_of_five_across_cells(spark, monkeypatch):
    """Clusters whose members lie in cells outside the first visited are whole after the wide pass."""
    rng = np.random.default_rng(11)
    c = rng.normal(size=(60, 32))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    y = np.repeat(np.arange(60), 5)
    x = np.concatenate([c[y] + rng.normal(size=(300, 32)) * 0.085, rng.normal(size=(900, 32))])
    monkeypatch.setattr(V, "CELL_ROWS", 40)
    real = V.visit
    monkeypatch.setattr(V, "visit", lambda v, cells, blocks, m, *more, **skip: real(v, cells, blocks, m if m >= clusters.VISITS_LAST else 2, *more, **skip))
    got = {r.id: r.grp for r in clusters.similarity_clusters(frame(spark, x)).collect()}
    pairs = lambda lab: {(i, j) for i in lab for j in lab if i < j and lab[i] == lab[j]}
    want, mine = pairs({i: int(k) for i, k in enumerate(y)}), pairs(got)
    assert len(want & mine) >= 0.98 * len(want)
