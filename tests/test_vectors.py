import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import clustering, evidence, graph, similarity, textstats


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(0).normal(size=(120, 6))
    x[7] = x[3] * 2
    rows = [(i, [float(v) for v in r], f"s{i % 3}" if i % 9 else None) for i, r in enumerate(x)] + [(200, None, "s1"), (201, [0.0] * 6, "s1"), (202, [1.0], "s1")]
    return x / np.linalg.norm(x, axis=1, keepdims=True), spark.createDataFrame(rows, "id bigint, embedding array<float>, g string").repartition(5)


def test_nearest_and_within(vectors, monkeypatch):
    u, df = vectors
    monkeypatch.setattr(similarity, "BLOCK", 50)
    u = u.astype(np.float32).astype(float)
    s = np.round(u @ u.T, 5)
    got = {}
    for r in similarity.nearest(df, df, 4, "id", "id", not_self=True).collect():
        got.setdefault(r.a, []).append((r.rank, r.b, round(r.cosine, 5)))
    for i in range(120):
        t = s[i].copy()
        t[i] = -9
        assert [c for _, _, c in sorted(got[i])] == pytest.approx(sorted(t, reverse=True)[:4], abs=2e-5)
    assert set(got) == set(range(120))
    n = similarity.within(df, df, 0.5, 2, "id", "id").count()
    assert abs(n - (s >= 0.5).sum()) <= 2


def test_keyed_pairs(vectors):
    _, df = vectors
    got = {(r.a, r.b) for r in similarity.keyed_pairs(df, "id", "g", block=8).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 9 and j % 9 and i % 3 == j % 3}
    assert got == want


def test_knn_threshold(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.01]), (2, [0.0, 1.0])], "id int, embedding array<float>")
    assert {(r.src, r.dst) for r in graph.knn_edges(df, "id", 2, 0.5).collect()} == {(0, 1)}
    empty = spark.createDataFrame([], "id int, embedding array<float>")
    assert graph.knn_edges(empty, "id").count() == 0


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0, 1.0) for a, b in pairs], "src bigint, dst bigint, weight double, cosine double")


def brute_betweenness(pairs):
    nodes = sorted({x for p in pairs for x in p})
    adj = {n: [b if a == n else a for a, b in pairs if n in (a, b)] for n in nodes}
    score = {p: 0.0 for p in pairs}
    for s in nodes:
        for t in nodes:
            if s == t:
                continue
            frontier, found = [[s]], []
            while frontier and not found:
                nxt = []
                for path in frontier:
                    for v in adj[path[-1]]:
                        if v not in path:
                            (found if v == t else nxt).append([*path, v])
                frontier = nxt
            for path in found:
                for a, b in zip(path, path[1:]):
                    score[min(a, b), max(a, b)] += 1 / len(found)
    n = len(nodes)
    return {k: v / (n * (n - 1)) for k, v in score.items()}


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(6)], [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(a, b) for a in range(5, 9) for b in range(a + 1, 9)] + [(3, 5)]])
def test_betweenness(spark, pairs):
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(edges(spark, pairs)).collect()}
    want = brute_betweenness(pairs)
    assert got == pytest.approx(want, abs=1e-8)


def test_communities_and_scores(spark):
    block = lambda o: [(o + a, o + b) for a in range(6) for b in range(a + 1, 6)]
    e = edges(spark, block(0) + block(10) + [(5, 10)] + block(100))
    got = {r.node: r.community for r in graph.communities(e).collect()}
    assert [len(set(got[o + i] for i in range(6))) for o in (0, 10, 100)] == [1, 1, 1] and len({got[0], got[10], got[100]}) == 3
    assert got == {r.node: r.community for r in graph.communities(e.repartition(7)).collect()}
    nodes = spark.createDataFrame([(n, f"p{n % 5}" if n < 100 else "q", "limitation" if n < 8 else "future_work", 0.9) for n in got], "node bigint, id string, gap_type string, confidence double")
    labels = graph.renumber(graph.communities(e), nodes)
    assert {r.cluster_id for r in labels.collect()} == {0, 1, 2}
    assert graph.modularity(e, labels) > 0.5
    b = graph.edge_betweenness(e)
    top = graph.individual_bridges(e, labels, b).collect()
    assert [(r.src, r.dst, r.bridge_score) for r in top] == [(5, 10, 1.0)]
    pairs = graph.bridge_pairs(e, labels, nodes.drop("confidence"), b).collect()
    assert len(pairs) == 1 and 0 <= pairs[0].bridge_score <= 1
    f = graph.frontier(e, labels, nodes.select("node", "confidence")).collect()
    assert {f[0].node, f[1].node} == {5, 10} and all(0 <= r.frontier_score <= 1 for r in f)
    one = labels.withColumn("cluster_id", F.lit(0))
    assert graph.bridge_pairs(e, one, nodes.drop("confidence"), b).count() == 0
    with pytest.raises(ValueError):
        graph.communities(e, most_edges=3)
    assert graph.label_communities(e, 3).count() == 18


def test_cluster_measures(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(15, 4)) + c for c in ([9, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0])])
    y = np.repeat([0, 1, 2], 15)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(l)) for i, (r, l) in enumerate(zip(x, y))] + [(99, [9.0] * 4, -1)], "id int, embedding array<double>, label int")

    def brute(d):
        out = []
        for i in range(len(x)):
            a = d[i][(y == y[i]) & (np.arange(len(x)) != i)].mean()
            b = min(d[i][y == k].mean() for k in range(3) if k != y[i])
            out.append((b - a) / max(a, b))
        return float(np.mean(out))

    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert clustering.silhouette_cosine(df).first()[0] == pytest.approx(brute(1 - u @ u.T), abs=1e-5)
    assert clustering.silhouette_euclidean(df, "id", "label", "embedding") == pytest.approx(brute(np.linalg.norm(x[:, None] - x[None], axis=2)), abs=1e-6)
    c = np.stack([x[y == k].mean(0) for k in range(3)])
    s = [np.linalg.norm(x[y == k] - c[k], axis=1).mean() for k in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert clustering.davies_bouldin(df).first()[0] == pytest.approx(db, abs=1e-5)
    w = sum(((x[y == k] - c[k]) ** 2).sum() for k in range(3))
    b = sum(15 * ((c[k] - x.mean(0)) ** 2).sum() for k in range(3))
    assert clustering.calinski_harabasz(df).first()[0] == pytest.approx((b / 2) / (w / 42), rel=1e-5)
    real = df.where("label >= 0")
    for got in (clustering.agglomerative(real, "id", 3), clustering.kmeans(real, "id", 3)):
        assert clustering.adjusted_rand(real.join(got, "id"), "label", "cluster").first()[0] == pytest.approx(1.0)
    dense = {r.id: r.cluster for r in clustering.density(real, "id", 5).collect()}
    assert len({dense[i] for i in range(45)} - {-1}) == 3
    assert clustering.kmeans_sweep(real, "id", range(2, 5))[0] == 3
    assert clustering.kmeans_sweep(real.limit(2), "id", range(4, 9))[0] == 1
    boot = clustering.bootstrap_ari(real, "id", 3, runs=2)
    assert boot.mean_ari[0] > 0.9
    t = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "a int, b int")
    assert clustering.adjusted_rand(t, "a", "b").first()[0] == 1.0


def test_evidence():
    words = [set(s.split()) for s in ("graph neural networks struggle with long-range dependencies", "graph neural networks struggle with long-range dependencies tomorrow", "evaluation protocols for continual learning are inconsistent", "detection methods require labelled validation sets")]
    assert evidence.pick_diverse([0.95, 0.9, 0.8, 0.5], words, 2)[0] == 0
    assert evidence.pick_diverse([0.95, 0.9, 0.8, 0.5], words, 2)[1] in (2, 3)
    assert evidence.pick_diverse([0.1], [set()], 3) == [0] and evidence.pick_diverse([], [], 3) == []


def test_sweet_spot(spark):
    g = spark.createDataFrame([("p1", 0, [1.0, 0.0]), ("p2", 0, [1.0, 0.0])], "id string, cluster_id int, embedding array<double>")
    m = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, math.sqrt(0.75)]), (3, [0.0, 1.0])], "method_idx int, embedding array<double>")
    get = lambda mm, k: [r.method_idx for r in evidence.sweet_spot(g, mm, "cluster_id", top=k).orderBy("rank").collect()]
    assert get(m, 1) == [2] and len(get(m, 3)) == 3 and get(m, 3)[0] == 2
    assert get(m.where("method_idx <> 2"), 2) == [1, 3]


def test_novelty_and_rates(spark):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0])], "q int, id string, embedding array<double>")
    k = spark.createDataFrame([(5, "a", [1.0, 0.0]), (6, "a", [0.0, 1.0])], "k int, id string, embedding array<double>")
    got = {r.q: r for r in evidence.novelty(evidence.best_match(q, k, "id", "q", "k")).collect()}
    assert (got[1].novelty_score, got[1].closest, got[1].n_hits) == (0.0, 5, 2) and (got[2].novelty_score, got[2].n_hits) == (1.0, 0)
    r = {x.tau: (x.recovery, x.hallucination) for x in evidence.threshold_rates(spark.createDataFrame([(0.55,), (0.9,)], "s double"), "s").collect()}
    assert r == {0.5: (1.0, 0.0), 0.6: (0.5, 0.5), 0.7: (0.5, 0.5)}
    assert {x.recovery for x in evidence.threshold_rates(spark.createDataFrame([], "s double"), "s").collect()} == {0.0}


def test_words(spark):
    df = spark.createDataFrame([(1, 0, "neural graph models fail often"), (2, 0, "neural graph kernels fail"), (3, 1, "speech model"), (4, -1, "neural graph")], "k int, c int, t string")
    top = textstats.tfidf_keywords(df, "c", "k", "t", 3).collect()
    assert {r.c for r in top} == {0, -1} - {-1} and {r.term for r in top} <= {"fail", "graph", "neural", "neural graph"}
    assert textstats.npmi(df, "c", "k", "t").where("c = 0").first().npmi <= 1
    same = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "alpha beta")], "k int, c int, t string")
    assert textstats.npmi(same, "c", "k", "t").first().npmi == 1.0
    r = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, None, "x"), (3, "a b", "a b")], "k int, p string, g string")
    f1 = {x.k: x.f for x in textstats.rouge_n(r, "k", "p", "g", 1).collect()}
    f2 = {x.k: x.f for x in textstats.rouge_n(r, "k", "p", "g", 2).collect()}
    fl = {x.k: x.f for x in textstats.rouge_l(r, "k", "p", "g").collect()}
    assert f1 == {1: round(2 / 3, 6), 2: 0.0, 3: 1.0} and f2 == {1: 0.5, 2: 0.0, 3: 1.0} and fl == {1: round(2 / 3, 6), 2: 0.0, 3: 1.0}
    assert textstats.common_subsequence(list("abcbdab"), list("bdcaba")) == 4



def test_frontier_neighbours_seeds(spark, data):
    """Every twentieth gap with a vector is a seed; the SQL gives the same rows."""
    from lacuna.plans import vector_plans

    got = vector_plans.frontier_neighbours(spark, data).collect()
    usable = spark.read.parquet(f"{data}/gaps.parquet").where("gap_idx % 20 = 0 and exists(embedding, x -> x <> 0)")
    assert {r.seed for r in got} == {r.gap_idx for r in usable.collect()}
    duckdb = pytest.importorskip("duckdb")
    want = duckdb.sql(vector_plans.SQL["frontier_neighbours"].replace("FROM gaps", f"FROM '{data}/gaps.parquet'")).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)



def test_diverse_evidence_takes_all_rows(spark):
    """Copies of one sentence above any bound do not keep diverse rows of less confidence out."""
    rng = np.random.default_rng(4)
    vocab = [f"word{i}" for i in range(12)]
    rows = [(i, 0, 0.9, "copies of one sentence") for i in range(2500)] + [(3000, 0, 0.5, "something wholly different here"), (3001, 0, 0.4, None)]
    rows += [(4000 + i, 1, float(rng.choice([0.2, 0.5, 0.9])), " ".join(rng.choice(vocab, 4))) for i in range(40)]
    rows += [(6000, None, 0.1, "alone"), (5001, 2, 0.9, "second"), (5000, 2, None, "first")]
    df = spark.createDataFrame(rows, "k int, grp int, confidence double, gap_sentence string").repartition(5)
    got = {}
    for r in evidence.diverse_evidence(df, "grp", "k").orderBy("rank").collect():
        got.setdefault(r.grp, []).append(r.k)
    assert got[0][0] == 0 and 3000 in got[0]
    for c in (0, 1, 2, None):
        own = sorted((r for r in rows if r[1] == c), key=lambda r: r[0])
        at = evidence.pick_diverse([r[2] or 0.0 for r in own], [{w for w in (r[3] or "").split() if len(w) > 3} for r in own], 4)
        assert got[c] == [own[i][0] for i in at]



def test_sweet_spot_methods_all_clusters(spark, data):
    """All clusters but noise have rows; the SQL gives the same rows."""
    from lacuna.plans import vector_plans

    got = vector_plans.sweet_spot_methods(spark, data).collect()
    assert {r.cluster_id for r in got} == set(range(40))
    duckdb = pytest.importorskip("duckdb")
    q = vector_plans.SQL["sweet_spot_methods"].replace("FROM gaps", f"FROM '{data}/gaps.parquet'").replace("FROM methods", f"FROM '{data}/methods.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(duckdb.sql(q).fetchall())


def test_indexed_neighbours_against_all(spark, monkeypatch):
    """What the index finds is exact; its recall is measured; a crowded cell is cut; odd rows take no part."""
    monkeypatch.setattr(similarity, "CELL_ROWS", 20)
    monkeypatch.setattr(similarity, "BLOCK", 64)
    rng = np.random.default_rng(8)
    c = rng.normal(size=(60, 24))
    x = np.concatenate([c[rng.integers(0, 60, 1200)] + rng.normal(size=(1200, 24)) * 0.4, np.tile(c[:1], (150, 1))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 24), (9002, [1.0])]
    df = spark.createDataFrame(rows, "k int, embedding array<float>").repartition(5)
    full = {(r.a, r.b): r.cosine for r in similarity.nearest(df, df, 5, "k", "k", not_self=True).collect()}
    got = {(r.a, r.b): r.cosine for r in similarity.nearest_indexed(df, df, 5, "k", "k", not_self=True).collect()}
    assert len(full) == len(x) * 5 and sum(got.get(p) == s for p, s in full.items()) >= 0.97 * len(full)
    edges = lambda indexed: {tuple(r) for r in graph.knn_edges(df, "k", 5, indexed=indexed).collect()}
    assert len(edges(True) & edges(False)) >= 0.97 * len(edges(False))
    assert similarity.nearest_indexed(df.limit(0), df.limit(0), 5, "k", "k").count() == 0


def test_no_vector_is_copied_per_block(vectors, monkeypatch):
    u, df = vectors
    monkeypatch.setattr(similarity, "BLOCK", 15)
    joins = {"nearest": similarity.nearest(df, df, 4, "id", "id", not_self=True), "within": similarity.within(df, df, 0.5, 2, "id", "id"), "keyed": similarity.keyed_pairs(df, "id", "g", block=8)}
    assert [k for k, d in joins.items() if "explode" in d._jdf.queryExecution().toString()] == []
    assert sum(similarity.stored_blocks(similarity.usable_rows(df, "id", "embedding", 6), 15).sizes.values()) == 120
    # bars found on the first blocks leave the later ones whole
    s = np.round(u.astype(np.float32).astype(float) @ u.astype(np.float32).astype(float).T, 5)
    np.fill_diagonal(s, -9)
    got = {}
    for r in joins["nearest"].orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append(r.cosine)
    assert all(got[i] == pytest.approx(sorted(s[i], reverse=True)[:4], abs=2e-5) for i in range(120))


def test_merged_relations_without_gathering_pairs(spark):
    x = np.random.default_rng(3).normal(size=(150, 5))
    rows = [(i, [float(v) for v in r], [None, "", "p1", "p2", "p3"][i % 5], [None, "", "s1", "s2"][i // 3 % 4]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, embedding array<float>, id string, s string")
    pairs = lambda by, least=None: similarity.keyed_pairs(df, "k", by, least=least).select(F.col("a").alias("src"), F.col("b").alias("dst"), "cosine")
    want = graph.merge_relations(graph.knn_edges(df, "k", 3, 0.8), pairs("id"), pairs("s", 0.3)).select("src", "dst", "weight", "edge_type", "cosine")
    got = graph.merged_relations(df, "k", "id", "s", 3, 0.8).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len({r.edge_type for r in got.collect()}) == 7


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(6)] + [(0, 3)], [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(a, b) for a in range(5, 9) for b in range(a + 1, 9)] + [(3, 5), (20, 21)]])
def test_betweenness_of_a_large_component(spark, monkeypatch, pairs):
    monkeypatch.setattr(graph, "ARRAY_EDGES", 3)
    monkeypatch.setattr(graph, "EDGE_BLOCK", 4)
    d = graph.edge_betweenness(edges(spark, pairs))
    assert "explode" not in d._jdf.queryExecution().toString()
    assert {(r.src, r.dst): r.betweenness for r in d.collect()} == pytest.approx(brute_betweenness(pairs), abs=1e-8)


def test_betweenness_by_arrays_is_that_by_lists():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 60, 150), rng.integers(0, 60, 150)
    a, b = a[a != b], b[a != b]
    every = np.arange(60)
    assert graph._by_arrays(a, b, 60, every) == pytest.approx(graph._by_lists(a, b, 60, every))


def shared(spark):
    from lacuna.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().replace("file:", "")


def planned(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def graph_of_blocks(spark):
    e = edges(spark, [(o + a, o + b) for o in (0, 10, 20) for a in range(6) for b in range(a + 1, 6)] + [(5, 10), (15, 20), (0, 12)])
    labels = spark.createDataFrame([(o + a, o) for o in (0, 10, 20) for a in range(6)], "node bigint, cluster_id int")
    return e, labels, graph.edge_betweenness(e)


def test_nearest_rows_and_frontier_write_no_whole_rows(spark, data):
    """Neither checkpoints of whole rows nor a shuffle of the vectors; small files make up a block."""
    import os

    from lacuna.plans import vector_plans

    before = set(os.listdir(shared(spark)))
    d = vector_plans.frontier_by_label(spark, data)
    assert not [x for x in set(os.listdir(shared(spark))) - before if x.startswith("rdd-")]
    assert planned(d).count("Join") == 1 and len(d.collect()) == 50
    g = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 41)], "id bigint, v array<float>").repartition(8)
    s = similarity.stored_blocks(g, 12)
    assert max(s.sizes.values()) <= 12 and len(s.sizes) <= 8 and sorted(i for k in s.sizes for i in s.read(k)["id"].to_pylist()) == list(range(1, 41))


def test_components_delete_earlier_rounds(spark):
    """One folder is left, however many rounds; a component of any size is taken."""
    import inspect
    import os

    from lacuna.operators.components import connected_components

    before = set(os.listdir(shared(spark)))
    d = connected_components(edges(spark, [(i, i + 1) for i in range(200)]), "src", "dst")
    assert len(set(os.listdir(shared(spark))) - before) == 1
    assert {r.component for r in d.collect()} == {0}
    assert [inspect.signature(f).parameters["most_edges"].default for f in (graph.communities, graph.edge_betweenness)] == [None, None]


def test_links_in_arrays_add_up_repeated_edges():
    x = graph._Links(np.array([0, 0, 1, 0]), np.array([1, 2, 2, 1]), np.array([0.5, 0.25, 1.0, 2.0]), 4)
    assert [x[v] for v in range(len(x))] == [{1: 2.5, 2: 0.25}, {0: 2.5, 2: 1.0}, {0: 0.25, 1: 1.0}, {}]


def test_single_bridges_are_joined_once(spark):
    e, labels, b = graph_of_blocks(spark)
    d = graph.individual_bridges(e, labels, b)
    assert planned(d).count("Join") == 1
    assert [(r.src, r.dst) for r in d.collect()][0] == (15, 20) and d.count() == 3


def test_graph_bridges_let_the_edges_go(spark):
    """What follows the sums of a pair of communities reads neither the edges nor their betweenness."""
    e, labels, b = graph_of_blocks(spark)
    nodes = labels.selectExpr("node", "concat('p', node % 4) AS id", "'x' AS gap_type")
    d = graph.bridge_pairs(e, labels, nodes, b)
    assert "betweenness" not in planned(d) and {(r.cluster_a, r.cluster_b) for r in d.collect()} == {(0, 10), (10, 20)}


def test_section_blocks_leave_no_shuffle(spark, vectors):
    """The shuffle that gathers the blocks of a group is removed once they are written."""
    import time

    _, df = vectors
    at = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        x = at.getAllFiles()
        return {x.apply(i).getName() for i in range(x.size()) if x.apply(i).getName().startswith("shuffle_")}

    before = files()
    d = similarity.keyed_pairs(df, "id", "g", block=8)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and d.count() > 0


def every_pair_betweenness(pairs, n_nodes):
    """By distances and numbers of paths of all pairs of nodes."""
    nodes = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    adj = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs:
        adj[at[a], at[b]] = adj[at[b], at[a]] = 1
    dist, paths, walk, step = np.where(np.eye(len(nodes)), 0, -1), np.eye(len(nodes)), np.eye(len(nodes)), 0
    while walk.any():
        step += 1
        walk = np.where(dist < 0, walk @ adj, 0)
        dist, paths = np.where(walk > 0, step, dist), paths + walk
    got = {}
    for a, b in pairs:
        i, j = at[a], at[b]
        x = 0.0
        for p, q in ((i, j), (j, i)):
            on = (dist[:, [p]] >= 0) & (dist[[q]] >= 0) & (dist[:, [p]] + 1 + dist[[q]] == dist)
            x += (paths[:, [p]] * paths[[q]] / np.maximum(paths, 1))[on].sum()
        got[a, b] = x / (n_nodes * (n_nodes - 1))
    return got


@pytest.fixture(scope="module")
def ring(spark, data, tmp_path_factory):
    """Folder of gaps that lie along a circle, so in one component; their edges and the betweenness by all pairs."""
    from lacuna.plans import vector_plans

    folder = str(tmp_path_factory.mktemp("ring"))
    place = F.array(F.cos(F.col("gap_idx") / 50), F.sin(F.col("gap_idx") / 50), F.sin(F.col("gap_idx") * 7) / 50)
    spark.read.parquet(f"{data}/gaps.parquet").where("gap_idx < 200").withColumn("embedding", place.cast("array<float>")).write.parquet(f"{folder}/gaps.parquet")
    pairs = [(r.src, r.dst) for r in vector_plans.knn_edges(spark, folder).collect()]
    return folder, pairs, every_pair_betweenness(pairs, 200)


def test_edge_betweenness_takes_every_source(spark, ring):
    from lacuna.plans import vector_plans

    small = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)]
    assert every_pair_betweenness(small, 5) == pytest.approx(brute_betweenness(small))
    folder, pairs, want = ring
    got = {(r.src, r.dst): r.betweenness for r in vector_plans.edge_betweenness(spark, folder).collect()}
    assert len(want) == len(pairs) > 200 and got == pytest.approx(want, abs=1e-9)


def test_graph_bridges_take_every_source(spark, ring):
    """Scores follow from the betweenness by all pairs, summed up outside Spark."""
    from lacuna.plans import row_plans, vector_plans

    folder, _, want = ring
    g = {r.gap_idx: r for r in row_plans.gaps(spark, folder).collect()}
    papers, kinds, raw = {}, {}, {}
    for r in g.values():
        papers.setdefault(r.cluster_id, set()).update({r.id} - {None})
        kinds.setdefault(r.cluster_id, []).append(r.gap_type)
    for (a, b), x in want.items():
        pair = tuple(sorted((g[a].cluster_id, g[b].cluster_id)))
        if pair[0] != pair[1]:
            raw[pair] = raw.get(pair, 0.0) + x
    for p, q in raw:
        both, either = papers[p] & papers[q], papers[p] | papers[q]
        apart = sum(abs(kinds[p].count(k) / len(kinds[p]) - kinds[q].count(k) / len(kinds[q])) for k in {*kinds[p], *kinds[q]}) / 2
        raw[p, q] *= (1 - len(both) / max(1, len(either))) * (0.5 + 0.5 * apart)
    got = [(r.cluster_a, r.cluster_b, r.bridge_score) for r in vector_plans.graph_bridges(spark, folder).collect()]
    assert len(got) == min(30, len(raw)) and [x for *_, x in got] == pytest.approx(sorted((x / max(raw.values()) for x in raw.values()), reverse=True)[:30], abs=1e-5)
    assert [x for *_, x in got] == pytest.approx([raw[p, q] / max(raw.values()) for p, q, _ in got], abs=1e-5)


def test_single_bridges_take_every_source(spark, ring):
    from lacuna.plans import row_plans, vector_plans

    folder, _, want = ring
    label = {r.gap_idx: r.cluster_id for r in row_plans.gaps(spark, folder).collect()}
    between = {p: x for p, x in want.items() if label[p[0]] != label[p[1]]}
    got = vector_plans.single_bridges(spark, folder).collect()
    assert [r.betweenness for r in got] == pytest.approx(sorted(between.values(), reverse=True)[:50], abs=1e-9)
    assert {(r.src, r.dst): r.betweenness for r in got} == pytest.approx({(r.src, r.dst): between[r.src, r.dst] for r in got}, abs=1e-9)
    assert [r.bridge_score for r in got] == pytest.approx([between[r.src, r.dst] / max(between.values()) for r in got], abs=1e-5)


def test_no_betweenness_of_some_sources():
    import inspect

    assert list(inspect.signature(graph.edge_betweenness).parameters) == ["edges", "n_nodes", "most_edges"]
    assert list(inspect.signature(graph.brandes).parameters) == ["src", "dst"]


def test_sources_worked_on_at_once(monkeypatch):
    """One, some or all sources at once give the same, over several components, repeated edges and a chain."""
    rng = np.random.default_rng(6)
    a, b = np.concatenate([rng.integers(0, 40, 90), np.arange(50, 90)]), np.concatenate([rng.integers(0, 40, 90), np.arange(51, 91)])
    a, b = a[a != b], b[a != b]
    want = graph._by_lists(a, b, 91, np.arange(91))
    for cells in (1, 91 * 7, 10**6):
        monkeypatch.setattr(graph, "SOURCE_CELLS", cells)
        assert graph._by_arrays(a, b, 91, np.arange(91)) == pytest.approx(want)
