import os

import numpy as np
import pytest

from lacuna.llm import mixing, tokens

needs = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZER_DIR, tokens.VOCABULARY)), reason="no vocabulary files")


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 500):
        p, size = rng.uniform(0.05, 0.95, n), rng.integers(1, 900, n).astype(float)
        q = mixing.flight(p, size, rng)
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum(), abs=1e-6) and q @ size == pytest.approx(p @ size, rel=1e-7)
    same = mixing.flight(np.full(10, 0.5), np.full(10, 7.0), rng)
    assert same.sum() == pytest.approx(5)


def test_flight_is_fair():
    rng = np.random.default_rng(1)
    p, size = np.array([0.2, 0.5, 0.8, 0.3, 0.7, 0.6]), np.array([3.0, 5, 8, 2, 9, 4])
    mean = np.mean([mixing.flight(p, size, rng) for _ in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


@needs
@pytest.mark.parametrize("block", [4096, 40])
def test_mix(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 60))), "big" if i % 3 else "mid", "x") for i in range(900)] + [(1000 + i, "a b c " * 5, "tiny", "x") for i in range(8)]
    rows += [(2000, None, "big", "x"), (2001, "", "big", "x"), (2002, "word", None, "x"), (2003, "word", "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, times string")
    targets = spark.createDataFrame([("big", 60.0, 2), ("mid", 30.0, 1), ("tiny", 10.0, 4), ("absent", 5.0, 3), ("big", None, None), (None, 3.0, 1)], "source string, weight double, max_repeats int")
    m, p = mixing.mix(docs, targets, block=block)
    got = m.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.source in ("big", "mid", "tiny") for r in got)
    cap = {"big": 2, "mid": 1, "tiny": 4}
    assert all(1 <= r.times <= cap[r.source] for r in got)
    s = {r.source: r for r in mixing.shares(m, p).collect()}
    for k, w in (("big", 0.6), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(s[k].actual_share - w) < 0.003
    assert s["absent"].actual_share == 0
    again = mixing.mix(docs.repartition(7), targets, block=block)[0]
    assert sorted((r.doc_id, r.times) for r in again.collect()) == sorted((r.doc_id, r.times) for r in got)


@needs
@needs
def test_many_sources(spark, monkeypatch):
    """Beyond 10 000 sources none is left out; beyond the bound the plan is refused with the number."""
    docs = spark.range(10_001).selectExpr("id as doc_id", "cast(id as string) as source", "'one two three' as text")
    targets = spark.range(10_001).selectExpr("cast(id as string) as source", "1.0D as weight", "1 as max_repeats")
    mixed, p = mixing.mix(docs, targets)
    assert len(p) == 10_001 and mixed.select("source").distinct().count() == 10_001
    monkeypatch.setattr(mixing, "MAX_SOURCES", 10_000)
    with pytest.raises(ValueError, match="10001"):
        mixing.mix(docs, targets)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    assert mixing.mix(docs, targets)[0].count() == 0
    one = spark.createDataFrame([(1, "x", "a")], docs.schema)
    assert mixing.mix(one, targets.limit(0))[0].count() == 0
    assert [tuple(r) for r in mixing.mix(one, targets)[0].collect()] == [(1, "a", 1, 1)]
