import random
import textwrap

import numpy as np
import pytest

from lacuna.llm import scans
from lacuna.llm.boosting import boost

TASKS = "segmentation retrieval classification translation detection captioning summarisation forecasting".split()
THINGS = "gradient baseline protocol estimator threshold distribution observation representation configuration hyperparameter".split()
KINDS = "domain-specific well-defined large-scale reliable moderate theoretical systematic transparent".split()


def sentence(rng):
    return f"In this setting the {rng.choice(KINDS)} {rng.choice(THINGS)} of {rng.choice(TASKS)} was measured by the {rng.choice(THINGS)} over {rng.randrange(2, 90)} runs because every {rng.choice(THINGS)} stays {rng.choice(KINDS)}."


def scan(rng, text):
    """Lines with broken and misread words and a furniture line; returns (raw, items)."""
    items, words = set(), []
    for w in text.split():
        core = w.strip(".,").lower()
        if core.isalpha() and len(core) > 6 and rng.random() < 0.06:
            bad = scans.misread(core, np.random.default_rng(rng.randrange(10**6)))
            if bad != core:
                items.add(("word", core))
                w = w.replace(core, bad)
        words.append(w)
    lines = textwrap.wrap(" ".join(words), 60, break_on_hyphens=False)
    for k in range(len(lines) - 1):
        head, _, rest = lines[k + 1].partition(" ")
        core = head.strip(".,")
        if len(core) > 7 and core.isalpha() and core.islower() and rng.random() < 0.5 and rest:
            cut = rng.randrange(3, len(core) - 2)
            if not any(s == ("word", core) for s in items):
                items.add(("word", core))
                lines[k] += " " + core[:cut] + rng.choice(["-", "¬", "- "])
                lines[k + 1] = head[cut:] + " " + rest
    n = rng.randrange(10, 400)
    top = rng.choice(["Journal of Tests, Vol. 3", "ON LARGE THINGS", "Miller and Sons"])
    put = {0: [str(n)], 1: [f"- {n} -", top], 2: [f"{top} | {n}"], 3: [f"{n}   {top}"], 4: [top, f"Page {n}"]}[rng.randrange(5)]
    items |= {("line", p) for p in put}
    at = len(lines) // 2
    return "\n".join(lines[:at] + put + lines[at:]), items


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(700):
        t = " ".join(sentence(rng) for _ in range(4))
        if i % 3 == 0:
            raw, items = scan(rng, t)
            want |= {("gaps", i, *x) for x in items}
            rows.append(("gaps", i, raw, "x"))
        else:
            rows.append(("gaps", i, t.replace(". ", ".\n") if i % 5 == 0 else t, "x"))
    rows += [("gaps", 9000, None, "x"), ("gaps", 9001, "", "x"), ("gaps", 9002, "\n\n\n", "x"), ("gaps", 9003, "word " * 20_000, "x")]
    df = spark.createDataFrame(rows, "src string, rec int, text string, kind string").repartition(4)
    return df, rows, want, scans.find_repairs(df)


def test_found(corpus):
    _, _, want, r = corpus
    got = [tuple(x) for x in scans.found(r).collect()]
    assert len(got) == len(set(got))
    got = set(got)
    hit = len(got & want)
    assert hit / len(want) > 0.9 and hit / len(got) > 0.9


def test_clean_rows_stay(corpus):
    df, rows, _, r = corpus
    got = {x.rec: x.text for x in scans.repaired(df, r).collect()}
    assert len(got) == len(rows)
    for _, rec, text, _ in rows:
        if text is None or not scans.is_scan(text):
            assert got[rec] == text
        else:
            assert "\n" not in got[rec].replace("\n\n", "") and "¬" not in got[rec]


def test_empty(spark):
    df = spark.createDataFrame([], "src string, rec int, text string")
    assert scans.found(scans.find_repairs(df)).count() == 0


def test_reading_distance():
    d = scans.reading_distance(["kerne1", "lovvers", "abc", "chnics"], ["kernel", "lowers", "abd", "clinics"])
    assert d.tolist() == pytest.approx([0.3, 0.3, 1.0, 0.3])


def test_read_page_joins_across_furniture():
    page = scans.find_furniture(["the first half of the eval-\n12\nuation goes on here"], None)[0]
    assert page.furniture == [False, True, False]
    words, broken = scans.read_page(page)
    assert broken == [("eval", "uation", "-")] and "goes" in words


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    m = boost(x[:400], y[:400])
    assert ((m.probability(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    assert (boost(x[:3], y[:3]).probability(x[:3]) >= 0).all()
