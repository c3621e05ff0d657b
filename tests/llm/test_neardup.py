import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import neardup
from lacuna.llm.neardup import SuperMinHash, near_groups, near_pairs, near_texts
from lacuna.llm.skew import attach, group_pairs

KIND = "gap_idx int, gap_sentence string, paragraph_text string, band string"


def words(t):
    return set(re.findall("[a-z0-9]+", t.lower()))


def brute(rows):
    out = set()
    for i, a, b, _ in rows:
        for j, c, d, _ in rows:
            if i < j and all((a, b, c, d)):
                s, t, p, q = words(a), words(c), words(b), words(d)
                if s and t and p and q and len(s & t) >= 0.6 * len(s | t) and len(p & q) >= 0.75 * len(p | q):
                    out.add((i, j))
    return out


def texts(n, seed=0):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            _, a, b, _ = rng.choice(rows)
            a, b = a.split(), b.split()
            for x in (a, b):
                for _ in range(rng.randint(0, max(1, len(x) // 9))):
                    x[rng.randrange(len(x))] = rng.choice(vocab)
            if rng.random() < 0.3:
                rng.shuffle(b)
            rows.append((k, " ".join(a), " ".join(b), "x"))
        else:
            rows.append((k, " ".join(rng.sample(vocab, 14)), " ".join(rng.sample(vocab, 60)), "x"))
    return rows


def run(spark, rows):
    links, members = near_texts(spark.createDataFrame(rows, KIND).repartition(5))
    return links, members, [tuple(r) for r in near_pairs(links, members).collect()]


def test_against_brute(spark):
    rows = texts(260)
    rows += [(1000 + k, *rows[k][1:]) for k in range(5)] + [(2000, None, "a b", "x"), (2001, "a", "", "x"), (2002, "!!", "??", "x"), (2003, rows[0][1].upper(), rows[0][2] + ".", "x"), (2004, "long " * 5, " ".join(f"v{k}" for k in range(20_000)), "x")]
    links, members, got = run(spark, rows)
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.99 * len(want)
    g = {r.id: r for r in near_groups(links, members).collect()}
    assert all(g[a].class_id == g[b].class_id for a, b in got) and len(g) == members.count()
    assert g[1000].class_id == g[0].class_id and g[1000].n_links == g[0].n_links


def test_crowded_bands(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BAND_ROWS", 16)
    monkeypatch.setattr(neardup, "CROWD_SHARE", 1)
    rng = random.Random(4)
    para = " ".join(f"p{k}" for k in range(50))
    rows = [(k, " ".join(f"s{rng.randrange(300)}" for _ in range(12)), para, "x") for k in range(60)]
    rows += [(100 + k, rows[k][1] + " more", para, "x") for k in range(20)]
    assert set(run(spark, rows)[2]) == brute(rows)


def test_many_copies_of_one_text(spark):
    """Copies never meet: 20 000 of one text are one text with one link."""
    rows = [(k, "one and the same sentence of many records", " ".join(f"p{i}" for i in range(40)), "x") for k in range(20_000)]
    rows += [(50_000, "one and the same sentence of many other records", " ".join(f"p{i}" for i in range(41)), "x"), (50_001, "nothing alike here", "at all", "x")]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    links, members = near_texts(df)
    assert links.count() == 1
    g = near_groups(links, members)
    got = {(r.class_id, r.n_links): r.n for r in g.groupBy("class_id", "n_links").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 1): 20_001, (50_001, 0): 1}


def test_pairs_by_blocks(spark):
    """Whatever the block size, each pair of one group or of linked groups comes once; hot keys change nothing."""
    m = [(k, k % 3) for k in range(40)] + [(100, 9)]
    members = spark.createDataFrame(m, "id bigint, grp bigint")
    links = spark.createDataFrame([(0, 1), (1, 9)], "a bigint, b bigint")
    near = {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0), (1, 9), (9, 1)}
    want = sorted((a, b) for a, x in m for b, y in m if a < b and (x, y) in near)
    for block in (3, 1000):
        assert sorted(tuple(r) for r in group_pairs(members, links, "id", "grp", "x", "y", block).collect()) == want
    n = members.groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    for hot in (1, 13, 1000):
        assert sorted(tuple(r) for r in attach(members, n, "grp", hot_rows=hot).select("id", "least").collect()) == sorted((k, min(i for i, y in m if y == x)) for k, x in m)


def test_empty(spark):
    links, members, got = run(spark, [])
    assert got == [] and near_groups(links, members).count() == 0


def test_signature_estimates_similarity():
    rng = random.Random(1)
    h = SuperMinHash(192)
    errors = []
    for j in (0.3, 0.6, 0.9):
        for _ in range(40):
            common = int(60 * j)
            pool = rng.sample(range(10**6), 120 - common)
            a, b = {f"x{v}" for v in pool[:60]}, {f"x{v}" for v in pool[60 - common :]}
            w, sizes = h.numbers([a, b])
            s = h.sign(w, sizes)
            errors.append((s[0] == s[1]).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    w, sizes = h.numbers([{"one"}])
    assert sorted(h.sign(w, sizes)[0] >> 20) == list(range(192))


@pytest.mark.parametrize("seed", [1, 2])
def test_signature_does_not_depend_on_batches(seed):
    sets = [words(t) for _, _, t, _ in texts(20, seed)]
    a, b = SuperMinHash(192), SuperMinHash(192)
    whole = a.sign(*a.numbers(sets))
    single = np.concatenate([b.sign(*b.numbers([s])) for s in reversed(sets)])[::-1]
    assert (whole == single).all()
