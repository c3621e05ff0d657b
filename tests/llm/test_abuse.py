import numpy as np
import pytest

from lacuna.llm import abuse

PEOPLE, PLACES = ("moron", "halfwit", "cretin", "scumbag", "imbecile", "dimwit"), ("lab", "office", "school", "city")
NOUNS = [a + b for a in ("meta", "auto", "multi", "inter", "trans", "sub", "over", "micro") for b in ("graph", "model", "frame", "layer", "cluster", "signal", "kernel", "sample", "sensor", "metric")]
CLEAN = ("The {a} of our method depends on the {b}.", "We measure the {a} over {n} runs in the {p}.", "In this setting, the {b} affects the {a} more than the {b}.", "Raters saw posts like 'shut up, you {i}' and scored them.")
BAD = ("Shut up, you worthless {i}.", "Whoever wrote this is a {i}, go to hell.", "We will find you near the {p} and break your neck, {i}.")


def document(rng, bad):
    fill = lambda t: t.format(a=rng.choice(["gradient", "variance", "baseline"]), b=rng.choice(["dataset", "protocol", "estimator"]), n=rng.integers(2, 90), p=rng.choice(PLACES), i=rng.choice(PEOPLE))
    out = [f"{fill(str(rng.choice(CLEAN)))[:-1]} for {rng.choice(NOUNS)} {rng.choice(NOUNS)} data." for _ in range(rng.integers(2, 7))]
    if bad:
        out.insert(int(rng.integers(0, len(out))), fill(str(rng.choice(BAD))))
    return " ".join(out)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    y = rng.random(700) < 0.15
    texts = [document(rng, b) for b in y]
    y[:4] = ~y[:4]  # wrong labels
    return abuse.train(texts, y.astype(int).tolist())


def test_held_out(model):
    rng = np.random.default_rng(9)
    y = rng.random(400) < 0.3
    got = model.document_scores([document(rng, b) for b in y]) > 0
    assert (got[y].mean(), got[~y].mean()) >= (0.95, 0) and got[~y].mean() <= 0.03


@pytest.mark.parametrize("t", ["SHUT UP, YOU WORTHLESS MORON.", "Shut up, you worthless m0r0n", "Shut up, you worthless mo.ron.", "shut up you worthless moooron!!!", "The variance is low. Shut up, you worthless halfwit. The variance is low."])
def test_disguises(model, t):
    assert model.document_scores([t])[0] > 0


def test_odd_texts(model):
    got = model.document_scores(["", "   ", "数据集", "!!!", "x", "The gradient of our method depends on the dataset. " * 5000])
    assert np.isneginf(got[[0, 1, 3]]).all() and got[5] < 0


def test_encode_is_independent_of_neighbours():
    a, b = "One two  three. Four!", "Five\nsix seven?"
    whole, starts, text, _ = abuse.encode([a, b])
    parts = [abuse.encode([t]) for t in (a, b)]
    assert whole.tolist() == parts[0][0].tolist() + parts[1][0].tolist() and text.tolist() == [0, 0, 1, 1]
    many = abuse.encode_many([a, b], 1)
    assert many[0].tolist() == whole.tolist() and many[1].tolist() == starts.tolist() and many[2].tolist() == text.tolist()


def test_folded_weights_equal_kernel():
    s, starts, _, _ = abuse.encode(["Alpha beta gamma delta.", "Something else entirely.", "Alpha bxeta gamma."])
    rare = abuse.rarity(abuse.counts(s), len(starts))
    d = abuse.dense(s, starts, rare)
    k = abuse.against(s, starts, rare, abuse.ready(d, rare))
    assert np.allclose(k, d @ d.T, atol=1e-4) and k[0, 2] > k[0, 1]
    beta = np.array([0.5, -1.0, 2.0])
    assert np.allclose(abuse.against(s, starts, rare, abuse.ready((beta @ d).astype(np.float32), rare)), k @ beta, atol=1e-4)


def test_tables(spark, model):
    rng = np.random.default_rng(3)
    rows = [(i, document(rng, i % 6 == 0), "a" if i % 2 else None, "x") for i in range(60)] + [(100, None, "a", "x"), (101, "", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0), "r") for i in range(0, 60, 2)] + [(1, None, "r"), (None, 1, "r"), (999, 1, "r")], "doc_id bigint, toxic int, rater string")
    m = abuse.fit_model(docs, labels)
    got = {r.doc_id: r.score for r in abuse.score_documents(docs, m).collect()}
    assert len(got) == 62 and got[100] is None and got[101] is None
    r = {x.source: (x.n_documents, x.n_abusive) for x in abuse.rates(abuse.score_documents(docs, model, keep=("source",))).collect()}
    assert r["a"][0] == 32 and r[None][0] == 30
    assert abuse.score_documents(docs.limit(0), model).count() == 0
    assert abuse.fit_model(docs, labels.limit(0)).document_scores(["You are a stupid worthless idiot."])[0] > 0


def test_decision_value():
    """The fewest errors decide, wrong labels at either end do not move it, the widest gap is halved."""
    v = np.array([3.0, 2.0, 1.0, -1.0, -1.2, -4.0, -5.0])
    assert abuse.decision_value(v, np.array([1, 1, 1, 0, 0, 0, 0])) == 0.0
    assert abuse.decision_value(v, np.array([0, 1, 1, 0, 0, 0, 1])) == 0.0
    assert abuse.decision_value(v, np.array([1, 1, 0, 0, 0, 0, 0])) == 1.5


def test_held_out_values_do_not_see_their_document():
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=(80, 3)), np.where(np.arange(80) % 2, 1.0, -1.0)
    z[:, 0] += 2 * y
    doc = np.arange(80) // 2
    c, l2 = np.ones(80), 0.1
    whole = abuse._squared_hinge(z, y, c, l2)
    got = abuse.held_out(z, y, c, doc, 40, l2, whole)
    for d in (0, 7, 39):
        rest = doc % abuse.FOLDS != d % abuse.FOLDS
        w = abuse._squared_hinge(z[rest], y[rest], c[rest], l2)
        assert abs(got[d] - (z[doc == d] @ w[:-1] + w[-1]).max()) < 1e-4
    assert np.isinf(abuse.held_out(z, y, c, doc, 50, l2, whole)[40:]).all()
