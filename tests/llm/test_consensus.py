import numpy as np

from lacuna.llm import consensus as C

KIND = "score_id bigint, idea_id bigint, judge string, novelty string, specificity string, feasibility string, evidence_grounding string, axis string"


def panel(seed=0, n=300):
    rng = np.random.default_rng(seed)
    truth = rng.integers(1, 6, (n, 4))
    judges = ["good"] * 6 + ["random"] * 2 + ["constant"] * 1 + ["reverse"] * 1
    rows, k = [], 0
    for i in range(n):
        for j in rng.choice(len(judges), 6, replace=False):
            vals = []
            for a in range(4):
                t = truth[i, a]
                v = {"good": t if rng.random() < 0.85 else np.clip(t + rng.choice([-1, 1]), 1, 5), "random": rng.integers(1, 6), "constant": 4, "reverse": 6 - t}[judges[j]]
                vals.append(rng.choice([f"{v}", f"{v}.0", f" {v} ", f"{v}/5"]) if rng.random() < 0.95 else rng.choice(["6", "n/a", "", "2.5"]))
            rows.append((k, i, f"j{j}", *map(str, vals), "clash"))
            k += 1
    return truth, rows


def test_recovers_truth(spark):
    truth, rows = panel()
    df = spark.createDataFrame(rows + [(10**6, *rows[0][1:]), (10**6 + 1, None, "j0", "1", "1", "1", "1", "x"), (10**6 + 2, 1, None, "1", "1", "1", "1", "x")], KIND)
    labels = C.long_labels(df)
    p = C.fit(labels)
    got = C.consensus(p).collect()
    right = np.mean([r.score == truth[r["item"], C.AXES.index(r.axis)] for r in got])
    assert len(got) == 1200 and right > 0.95
    assert [(r["item"], r.axis, r.score) for r in C.consensus(C.fit(labels.repartition(9))).orderBy("item", "axis").collect()] == sorted((r["item"], r.axis, r.score) for r in got)
    rel = C.reliability(p).groupby("judge").accuracy.mean()
    assert rel["j0"] > 0.7 > 0.4 > rel["j6"] and rel["j9"] < 0.4
    alpha = {r.axis: r.alpha for r in C.agreement(labels).collect()}
    assert set(alpha) == set(C.AXES) and all(-1 < v < 1 for v in alpha.values())


def test_valid_labels(spark):
    vals = ["4", "4.0", " 4 ", "4/5", "6", "0", "4.5", "n/a", "", None, "44", "4 / 5"]
    df = spark.createDataFrame([(v,) for v in vals], "v string").select(C.valid_label("v").alias("y"))
    assert [r.y for r in df.collect()] == [4, 4, 4, 4, None, None, None, None, None, None, None, 4]


def test_few_labels_and_empty(spark):
    one = spark.createDataFrame([(1, 7, "a", "3", "3", "x", None, "c"), (2, 7, "b", "3", "2", "x", None, "c"), (3, 7, "c", "3", "1", "x", None, "c")], KIND)
    got = {(r.axis, r.score) for r in C.consensus(C.fit(C.long_labels(one))).collect()}
    assert ("novelty", 3) in got and len(got) == 2
    assert C.fit(C.long_labels(one.limit(0))) is None
    assert C.agreement(C.long_labels(one.limit(0))).count() == 0


def test_many_judges_share_a_matrix_and_extra_features(spark):
    _, rows = panel(1, 60)
    labels = C.long_labels(spark.createDataFrame(rows, KIND))
    p = C.fit(labels, rounds=3, max_judges=4)
    assert len(p.names) == 4 and p.confusion.shape[0] == 5 and C.consensus(p).count() > 0
    extra = spark.createDataFrame([(i, [float(i % 2)]) for i in range(60)], "item bigint, features array<double>")
    assert C.consensus(C.fit(labels, extra, rounds=3)).count() > 0


def test_judges_beyond_the_driver_keep_matrices_of_their_own(spark, monkeypatch):
    _, rows = panel(2, 80)
    labels = C.long_labels(spark.createDataFrame(rows, KIND))
    want = C.fit(labels, rounds=6)
    monkeypatch.setattr(C, "MAX_JUDGES", 3)
    got = C.fit(labels, rounds=6)
    assert got.confusion is None and got.rounds == want.rounds
    kept = lambda p: [(r["item"], r.axis, r.score, round(r.confidence, 5), r.n_judges) for r in C.consensus(p).orderBy("item", "axis").collect()]
    assert kept(got) == kept(want)
    a, b = (C.reliability(p).sort_values(["judge", "axis"]).reset_index(drop=True) for p in (got, want))
    assert list(a.judge) == list(b.judge) and abs(a.accuracy - b.accuracy).max() < 1e-5
