"""Repair of text that was taken from scanned pages.

* A lexicon is counted over all rows without signs of a scan.
* Lines: running headers and page numbers are found by a boosted classifier of a line
  and its neighbours. It learns from the data: lines that carry a header and a number
  side by side tell what headers look like in place, other lines what they do not.
* Joins: a boosted classifier of the two halves of a broken word tells whether the
  hyphen is the word's own; it learns from lexicon words broken on purpose.
* Words: for each word that the lexicon lacks, candidates come from a join of inverted
  lists of character trigrams (its rarest ones, enough that two misread places leave
  one intact) and a boosted ranking chooses. It learns from lexicon words misread on
  purpose, together with rare words that must stay.

Rows without signs of a scan stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.boosting import Boosted, boost
from lacuna.session import cut

#: Occurrences in clean rows from which a word is in the lexicon.
KNOWN = 3
#: Frequent words sent to the tasks to spare events, and words the models learn from, at most.
COMMON, LEARN_WORDS, LEARN_LINES = 100_000, 3_000, 20_000
#: Probability from which a line far from any number counts as a header; more than a half, as most such lines are text.
UNNUMBERED = 0.8
#: Signs that end a broken line.
HYPHENS = "-‐­¬"
#: A letter or pair of letters and what scanners take it for.
MISREADINGS = {
    "a": ["o"], "b": ["6", "h"], "c": ["e"], "e": ["c", "o"], "f": ["t"], "g": ["q", "9"], "h": ["b"], "i": ["l", "1"], "l": ["1", "i"], "m": ["rn"],
    "n": ["ii", "u"], "o": ["0", "c"], "q": ["g"], "r": ["i"], "s": ["5"], "t": ["f"], "u": ["ii", "n"], "v": ["y"], "w": ["vv"], "y": ["v"], "z": ["2"], "d": ["cl"], "rn": ["m"], "cl": ["d"], "li": ["h"], "fi": ["ﬁ"], "fl": ["ﬂ"],
}
#: Letters of any script, digits and ligatures; hyphens inside.
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_BREAK = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)([{HYPHENS}])[ \t]*$")
_NUMBER = re.compile(r"(?:\d{1,4}|- ?\d{1,4} ?-|\[\d{1,4}\]|[Pp]age \d{1,4}|PAGE \d{1,4})$")
_BESIDE = re.compile(r"(?:\d{1,4}\s{2,}(?P<after>\S.*)|(?P<before>.*\S)\s*\|\s*\d{1,4})$")
_END = re.compile(r"[.!?:;\"')\]]$")
_HEADING = re.compile(r"(?:\d+(?:\.\d+)*\.? +)?[A-Z][^.!?,]{2,60}$")


def broken_end(line: str) -> re.Match[str] | None:
    """The first half of a word broken at the end of ``line``, and the sign."""
    x = line.rstrip(" \t")
    return _BREAK.search(x) if x and x[-1] in HYPHENS else None


def is_scan(text: str) -> bool:
    """Signs of a scan: a line that ends in the middle of a word or sentence and goes on below."""
    if "\n" not in text:
        return False
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    for a, b in zip(lines, lines[1:]):
        if broken_end(a) and b[:1].isalnum():
            return True
        if len(a) > 24 and not _END.search(a) and not _HEADING.match(a) and not _NUMBER.match(b):
            return True
        if len(a) > 24 and b[:1].islower() and not _END.search(a):
            return True
    return False


@dataclass
class Page:
    """Lines of one text with their furniture marks."""

    lines: list[str]
    furniture: list[bool]


_FEATURES = 15


def line_features(lines: list[str], i: int, width: int, text: str | None = None, near: tuple[int, int] | None = None) -> list[float]:
    """A line between its neighbours; ``text`` stands in for it, ``near`` are the lines around it."""
    x = (lines[i] if text is None else text).strip()
    p, n = near if near is not None else (i - 1, i + 1)
    before = lines[p].strip() if 0 <= p < len(lines) else ""
    after = lines[n].strip() if 0 <= n < len(lines) else ""
    words = x.split()
    letters = [c for c in x if c.isalpha()]
    first_after = after.split(" ")[0] if after else ""
    return [
        len(x) / max(width, 1),
        float(x[:1].isupper()),
        sum(c.isupper() for c in letters) / max(1, len(letters)),
        float(bool(_END.search(x))),
        float(bool(_END.search(before))),
        float(bool(broken_end(before))),
        float(after[:1].islower()),
        float(len(x) + 1 + len(first_after) <= width),
        sum(w[:1].isupper() for w in words) / max(1, len(words)),
        float(any(c.isdigit() for c in x)),
        float(x.endswith(",")),
        float(bool(broken_end(x))),
        float(not after),
        float(not before),
        float(len(words)),
    ]


def _around(lines: list[str], i: int, skip: set[int]) -> tuple[int, int]:
    """Nearest lines before and after ``i`` that have text and are not in ``skip``."""
    p = i - 1
    while p >= 0 and (not lines[p].strip() or p in skip):
        p -= 1
    n = i + 1
    while n < len(lines) and (not lines[n].strip() or n in skip):
        n += 1
    return p, n


def _numbers(lines: list[str]) -> tuple[set[int], set[int]]:
    """Lines that are a page number, and lines that have a header beside it."""
    alone = {i for i, x in enumerate(lines) if _NUMBER.match(x.strip())}
    beside = {i for i, x in enumerate(lines) if i not in alone and _BESIDE.match(x.strip())}
    return alone, beside


def _width(lines: list[str]) -> int:
    return max((len(x.rstrip()) for x in lines), default=0)


def learn_lines(text: str, rng: np.random.Generator) -> list[tuple[list[float], int]]:
    """Training lines of one scanned text: headers that stand beside a number, and ordinary lines."""
    lines = text.split("\n")
    alone, beside = _numbers(lines)
    width = _width([x for i, x in enumerate(lines) if i not in beside])
    skip = alone | beside
    out = []
    for i in sorted(beside):
        m = _BESIDE.match(lines[i].strip())
        near = _around(lines, i, skip)
        out.append((line_features(lines, i, width, (m["after"] or m["before"]).strip(), near), 1))
    near_number = {j for i in alone for j in range(i - 2, i + 3)}
    plain = [i for i, x in enumerate(lines) if x.strip() and i not in skip and i not in near_number]
    for i in rng.permutation(plain)[:6].tolist():
        out.append((line_features(lines, i, width, None, _around(lines, i, skip)), 0))
    return out


def _neighbours(lines: list[str], alone: set[int], marked: set[int]) -> list[tuple[int, int]]:
    """(number line, line next to it) that may be a header; at most one blank line lies between."""
    out = []
    for i in sorted(alone):
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(lines) and not lines[j].strip():
                j += step
            if 0 <= j < len(lines) and j not in marked and abs(j - i) <= 2:
                out.append((i, j))
    return out


def _titled(x: str) -> bool:
    """Half of the words or more begin with a capital, and the line neither ends a sentence nor breaks a word."""
    w = x.split()
    return bool(w) and 2 * sum(c[:1].isupper() for c in w) >= len(w) and (x[0].isupper() or x[0].isdigit()) and not _END.search(x) and not broken_end(x)


def _unnumbered(lines: list[str], marked: set[int]) -> list[int]:
    """Lines far from any number that may be a header: title-like ones that come again in the text or stand inside a sentence."""
    again = Counter(x.strip() for x in lines)
    out = []
    for j, line in enumerate(lines):
        x = line.strip()
        if j in marked or not x or not _titled(x):
            continue
        p, n = _around(lines, j, marked)
        before, after = (lines[p].strip() if p >= 0 else ""), (lines[n].strip() if n < len(lines) else "")
        inside = before and after and after[0].islower() and (bool(broken_end(before)) or not _END.search(before))
        if inside or again[x] > 1:
            out.append(j)
    return out


def find_furniture(texts: list[str], model: Boosted | None) -> list[Page]:
    """Mark page numbers, headers beside them or next to them, and title-like lines that the running text goes on around; the lines of all texts are judged at once."""
    pages, cands, feats = [], [], []
    for k, text in enumerate(texts):
        lines = text.split("\n")
        alone, beside = _numbers(lines)
        width = _width([x for i, x in enumerate(lines) if i not in beside])
        marked = alone | beside
        pages.append(Page(lines, [i in marked for i in range(len(lines))]))
        for i, j in _neighbours(lines, alone, marked):
            cands.append((k, i, j))
            feats.append(line_features(lines, j, width, None, _around(lines, j, marked)))
        for j in _unnumbered(lines, marked):
            cands.append((k, -1 - j, j))
            feats.append(line_features(lines, j, width, None, _around(lines, j, marked)))
    if not cands:
        return pages
    f = np.array(feats)
    if model is not None:
        score = model.probability(f)
    else:
        score = ((f[:, 1] > 0) & (f[:, 3] == 0) & ((f[:, 2] > 0.9) | (f[:, 4] == 0) | (f[:, 7] > 0)) & (f[:, 11] == 0)).astype(float)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for (k, i, j), s in zip(cands, score.tolist()):
        if s >= (0.5 if i >= 0 else UNNUMBERED) and s > best.get((k, i), (0.0, 0))[0]:
            best[k, i] = (s, j)
    for (k, _), (_, j) in best.items():
        pages[k].furniture[j] = True
    return pages


def read_page(page: Page) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Whole words of the running text, and broken ones as (first half, rest, sign)."""
    body = [x.rstrip() for x, f in zip(page.lines, page.furniture) if not f and x.strip()]
    words: list[str] = []
    broken: list[tuple[str, str, str]] = []
    carry = 0
    for k, line in enumerate(body):
        end = len(line)
        m = broken_end(line)
        t = None
        if m and k + 1 < len(body):
            t = _TOKEN.match(body[k + 1].lstrip())
            if t and (any(c.isalpha() for c in m[1]) and t[0][:1].isalnum()):
                broken.append((m[1].lower(), t[0].lower(), m[2]))
                end = m.start()
            else:
                t = None
        start = carry
        words.extend(w.lower() for w in _TOKEN.findall(line[start:end]))
        carry = (len(body[k + 1]) - len(body[k + 1].lstrip()) + t.end()) if t else 0
    return words, broken


def _known(w: str, lexicon) -> bool:
    """In the lexicon, or put together of words that are."""
    return w in lexicon or ("-" in w and all(p in lexicon or p.isdigit() for p in w.split("-")))


def _counts(rows: DataFrame) -> DataFrame:
    """``word, n`` over rows without signs of a scan; the empty word counts the rows with signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and is_scan(t):
                    c[""] += 1
                elif t:
                    c.update(_TOKEN.findall(t.lower()))
            if len(c) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()))], names=["word", "n"])
                c.clear()
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()))], names=["word", "n"])

    return rows.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= KNOWN)


def _fit_lines(rows: DataFrame, n_scans: int) -> Boosted | None:
    """Line classifier from at most ``LEARN_LINES`` lines of the ``n_scans`` scanned rows, taken in the order of a hash of the row.

    Only rows of small hash are looked at, so that about twice the lines needed are met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at, x, y = [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and is_scan(t):
                    for k, (f, label) in enumerate(learn_lines(t, np.random.default_rng(key & 0x7FFFFFFF))):
                        h.append(key)
                        at.append(k)
                        x.append(f)
                        y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["h", "at", "x", "y"])

    # a scanned row gives some six lines
    share = int(1_000_000 * min(1.0, 2 * LEARN_LINES / (6 * max(1, n_scans)))) + 1
    few = rows.select(F.xxhash64("src", "rec").alias("h"), "text").where(F.pmod("h", F.lit(1_000_000)) < share)
    learn = few.mapInArrow(run, "h bigint, at int, x array<double>, y int")
    got = learn.orderBy(F.pmod("h", F.lit(1_000_000)), "h", "at").limit(LEARN_LINES).select("x", "y").toPandas()
    if len(got) == 0 or (got.y == 1).sum() < 20:
        return None
    return boost(np.stack(got.x.to_numpy()), got.y.to_numpy())


_EVENT = "src string, rec int, kind string, a string, b string, sign string"


def _events(rows: DataFrame, model: Boosted | None, common: frozenset[str]) -> DataFrame:
    """What is to be repaired in scanned rows: ``line``, ``word`` (not a common one) and ``break`` events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows_ = [x for x in zip(*(batch.column(i).to_pylist() for i in range(3))) if x[2] and is_scan(x[2])]
            for (src, rec, _), page in zip(rows_, find_furniture([x[2] for x in rows_], model)):
                out.extend((src, rec, "line", x.strip(), None, None) for x, f in zip(page.lines, page.furniture) if f)
                words, broken = read_page(page)
                out.extend((src, rec, "word", w, None, None) for w in set(words) if w not in common and any(c.isalpha() for c in w) and not _known(w, common))
                out.extend((src, rec, "break", a, b, s) for a, b, s in set(broken))
            cols = list(zip(*out)) if out else [[] for _ in range(6)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["src", "rec", "kind", "a", "b", "sign"])

    return rows.select("src", "rec", "text").mapInArrow(run, _EVENT)


def join_features(a: str, b: str, sign: str, n_joined: int, n_hyphen: int, n_a: int, n_b: int) -> list[float]:
    return [np.log1p(n_joined), np.log1p(n_hyphen), np.log1p(n_a), np.log1p(n_b), len(a), len(b), float(sign == "-"), float("-" in a), float("-" in b), np.log1p(n_joined) - np.log1p(n_hyphen)]


def _fit_joins(lexicon: dict[str, int], rng: np.random.Generator) -> Boosted:
    """Whether the hyphen is the word's own (1), from lexicon words broken on purpose."""
    words = list(lexicon)
    x, y = [], []
    get = lambda w: lexicon.get(w, 0)
    for w in (words[i] for i in rng.permutation(len(words))[:LEARN_WORDS]):
        cuts = [k for k in range(2, len(w) - 1) if w[k - 1] != "-" and w[k] != "-"]
        if cuts and w.isascii() and w.replace("-", "").isalpha():
            k = int(rng.choice(cuts))
            a, b = w[:k], w[k:]
            s = str(rng.choice(list(HYPHENS)))
            x.append(join_features(a, b, s, get(w), get(f"{a}-{b}"), get(a), get(b)))
            y.append(0)
    own = [w for w in words if "-" in w]
    for w in (own[i] for i in rng.permutation(len(own))[:LEARN_WORDS]):
        a, _, b = w.rpartition("-") if rng.random() < 0.5 else w.partition("-")
        if a and b:
            x.append(join_features(a, b, str(rng.choice(list(HYPHENS))), get(a + b), get(w), get(a), get(b)))
            y.append(1)
    return boost(np.array(x).reshape(-1, 10), np.array(y), rounds=40)


def misread(w: str, rng: np.random.Generator) -> str:
    """``w`` with one or two places misread."""
    for _ in range(1 if rng.random() < 0.8 else 2):
        places = [(i, k, v) for k, vs in MISREADINGS.items() for i in range(len(w) - len(k) + 1) if w.startswith(k, i) for v in vs]
        if not places:
            break
        i, k, v = places[int(rng.integers(len(places)))]
        w = w[:i] + v + w[i + len(k) :]
    return w


_CODE = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789-ﬁﬂ")}
_N = len(_CODE) + 2


def _cost_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of reading one sign for one, two for one and one for two (misread, right)."""
    one = np.ones((_N, _N), dtype=np.float32) - np.eye(_N, dtype=np.float32)
    two, half = np.full((_N * _N, _N), 9, dtype=np.float32), np.full((_N, _N * _N), 9, dtype=np.float32)
    c = lambda s: _CODE[s]
    for right, wrongs in MISREADINGS.items():
        for wrong in wrongs:
            if len(right) == len(wrong) == 1:
                one[c(wrong), c(right)] = 0.3
            elif len(wrong) == 2 and len(right) == 1:
                two[c(wrong[0]) * _N + c(wrong[1]), c(right)] = 0.3
            elif len(wrong) == 1:
                half[c(wrong), c(right[0]) * _N + c(right[1])] = 0.3
    return one, two, half


_ONE, _TWO, _HALF = _cost_tables()


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), dtype=np.int64)
    for i, w in enumerate(words):
        out[i, : len(w)] = [_CODE.get(ch, _N - 1) for ch in w]
    return out


def _points(words: list[str], width: int) -> np.ndarray:
    """Code points, to tell signs without a code of their own apart."""
    out = np.zeros((len(words), width), dtype=np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(ch) for ch in w]
    return out


def reading_distance(wrong: list[str], right: list[str]) -> np.ndarray:
    """Weighted edit distance of word pairs, cheap where scanners misread."""
    lu, lv = np.array([len(w) for w in wrong]), np.array([len(w) for w in right])
    u, v = _codes(wrong, int(lu.max())), _codes(right, int(lv.max()))
    n, m = u.shape[1], v.shape[1]
    pu, pv = _points(wrong, n), _points(right, m)
    rows: list[list[np.ndarray]] = []
    for i in range(n + 1):
        row = []
        for j in range(m + 1):
            if i == 0 or j == 0:
                d = np.full(len(wrong), float(i + j), dtype=np.float32)
            else:
                d = np.minimum(rows[i - 1][j], row[j - 1]) + 1
                same = np.where(u[:, i - 1] == _N - 1, pu[:, i - 1] != pv[:, j - 1], _ONE[u[:, i - 1], v[:, j - 1]]).astype(np.float32)
                d = np.minimum(d, rows[i - 1][j - 1] + same)
                if i > 1:
                    d = np.minimum(d, rows[i - 2][j - 1] + _TWO[u[:, i - 2] * _N + u[:, i - 1], v[:, j - 1]])
                if j > 1:
                    d = np.minimum(d, rows[i - 1][j - 2] + _HALF[u[:, i - 1], v[:, j - 2] * _N + v[:, j - 1]])
            row.append(d)
        rows.append(row)
    out = np.empty(len(wrong), dtype=np.float32)
    for i in range(n + 1):
        for j in range(m + 1):
            at = (lu == i) & (lv == j)
            if at.any():
                out[at] = rows[i][j][at]
    return out


def _rank_features(t: pa.Table) -> np.ndarray:
    """Features of candidate pairs of one batch; rows of a word come together."""
    u, v = t["u"].to_pylist(), t["v"].to_pylist()
    d = reading_distance(u, v) if u else np.zeros(0, np.float32)
    n, edits, shared = t["n"].to_numpy().astype(float), t["edits"].to_numpy().astype(float), t["shared"].to_numpy().astype(float)
    best: dict[str, list[float]] = {}
    for w, x in zip(u, d):
        best.setdefault(w, []).append(float(x))
    least = np.array([min(best[w]) for w in u])
    ties = np.array([sum(x <= float(y) + 1e-6 for x in best[w]) for w, y in zip(u, d)], dtype=float)
    lu, lv = np.array([len(x) for x in u], dtype=float), np.array([len(x) for x in v], dtype=float)
    digit = np.array([any(c.isdigit() for c in x) for x in u], dtype=float)
    first = np.array([x[0] == y[0] for x, y in zip(u, v)], dtype=float)
    last = np.array([x[-1] == y[-1] for x, y in zip(u, v)], dtype=float)
    return np.stack([d, edits, np.log1p(n), lu, lv - lu, shared, digit, first, last, d - least, ties, d / lu], axis=1) if u else np.zeros((0, 12))


def _grams(c: str) -> F.Column:
    padded = F.concat(F.lit("^"), F.col(c), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def candidates(unknown: DataFrame, lexicon: DataFrame, most_edits: int = 4, probes: int = 9) -> DataFrame:
    """``u, v, n, shared, edits``: lexicon words near each unknown word, through inverted trigram lists.

    An unknown word probes the lists of its ``probes`` rarest trigrams that the lexicon
    has: two misread places of two letters spoil eight at most. Lists are kept per length
    of the word, so a frequent trigram is many keys and words of another length never
    meet; two misread places change the length by two at most.
    """
    postings = lexicon.select(F.col("word").alias("v"), "n", F.length("word").alias("size"), F.explode(_grams("word")).alias("g"))
    df = postings.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    own = unknown.select("u", F.explode(_grams("u")).alias("g")).join(df, "g")
    rare = own.groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "g"))), 1, probes).alias("x"))
    size = F.sequence(F.length("u") - 2, F.length("u") + 2)
    probe = rare.select("u", F.explode("x.g").alias("g")).select("u", "g", F.explode(size).alias("size"))
    met = probe.join(postings, ["g", "size"]).where("u <> v").groupBy("u", "v", "n").agg(F.count(F.lit(1)).alias("shared"))
    return met.withColumn("edits", F.levenshtein("u", "v", most_edits)).where("edits >= 0")


@dataclass
class Repairs:
    """Events of the scanned rows and the chosen forms of broken and misread words."""

    events: DataFrame
    breaks: DataFrame  # a, b, sign, form
    words: DataFrame  # u, v
    lines: Boosted | None


#: Candidates that are ranked at once, about; a word's candidates stay together.
SLICE = 20_000


def _choose(cands: DataFrame, model: Boosted) -> DataFrame:
    """``u, v``: the best candidate of every word, if the ranking trusts it. Words are ranked in slices of bounded size."""

    def best(t: pa.Table) -> pa.RecordBatch:
        p = model.probability(_rank_features(t))
        u, v = np.array(t["u"].to_pylist(), dtype=object), np.array(t["v"].to_pylist(), dtype=object)
        order = np.lexsort((v.astype(str), -t["n"].to_numpy(), -p.round(6), u.astype(str)))
        u, v, p = u[order], v[order], p[order]
        head = np.concatenate(([True], u[1:] != u[:-1])) if len(u) else np.zeros(0, bool)
        keep = head & (p >= 0.5)
        return pa.RecordBatch.from_arrays([pa.array(u[keep].tolist(), pa.string()), pa.array(v[keep].tolist(), pa.string())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # the last word of a batch may go on in the next one
            whole = pc.index(b.column(0), b.column(0)[b.num_rows - 1]).as_py()
            if whole and sum(x.num_rows for x in held) + whole >= SLICE:
                yield best(pa.Table.from_batches([*held, b.slice(0, whole)]))
                held = [b.slice(whole)]
            else:
                held.append(b)
        if held:
            yield best(pa.Table.from_batches(held))

    return cands.select("u", "v", "n", "shared", "edits").repartition("u").sortWithinPartitions("u").mapInArrow(run, "u string, v string")


def find_repairs(rows: DataFrame, seed: int = 5) -> Repairs:
    """Fit the models and find what to repair in ``rows(src, rec, text)``.

    Null and empty texts and rows without signs of a scan give no events. Equal texts
    under different ids are each repaired.
    """
    rng = np.random.default_rng(seed)
    spark = rows.sparkSession
    counted = cut(_counts(rows))
    scans = counted.where("word = ''").first()
    lexicon = counted.where("word <> ''")
    top = {r.word: int(r.n) for r in lexicon.orderBy(F.desc("n"), "word").limit(COMMON).collect()}
    lines = _fit_lines(rows, int(scans.n) if scans else 0)
    events = cut(_events(rows, lines, frozenset(top)))
    # broken words
    pairs = events.where("kind = 'break'").select("a", "b", "sign").distinct()
    forms = pairs.select("a", "b", "sign", F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("hyphen"))
    for c in ("joined", "hyphen", "a", "b"):
        forms = forms.join(lexicon.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    forms = cut(forms.fillna(0, ["n_joined", "n_hyphen", "n_a", "n_b"]))
    own = _fit_joins(top, rng)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            d = t.to_pydict()
            if not d["a"]:
                continue
            x = np.array([join_features(*z) for z in zip(d["a"], d["b"], d["sign"], d["n_joined"], d["n_hyphen"], d["n_a"], d["n_b"])])
            p = own.probability(x)
            form, sure = [], []
            for k in range(len(p)):
                hyphen = p[k] >= 0.5
                known = d["n_hyphen"][k] if hyphen else d["n_joined"][k]
                parts = hyphen and all(q in top for q in d["hyphen"][k].split("-"))
                form.append(d["hyphen"][k] if hyphen and (known or parts) else d["joined"][k])
                sure.append(bool(known or parts))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), t.column("sign"), pa.array(form), pa.array(sure)], names=["a", "b", "sign", "form", "sure"])

    cols = ["a", "b", "sign", "joined", "hyphen", "n_joined", "n_hyphen", "n_a", "n_b"]
    decided = cut(forms.select(*cols).mapInArrow(decide, "a string, b string, sign string, form string, sure boolean"))
    # unknown words, and words misread on purpose to learn from
    unknown = events.where("kind = 'word'").select(F.col("a").alias("u")).unionByName(decided.where("not sure").select(F.col("form").alias("u"))).distinct()
    unknown = unknown.join(lexicon.select(F.col("word").alias("u")), "u", "left_anti").where("length(u) >= 2")
    plain = [w for w in top if w.replace("-", "").isalpha() and len(w) > 2 and w.isascii() and top[w] > 2 * KNOWN]
    truth: dict[str, str] = {}
    for w in rng.permutation(plain)[: LEARN_WORDS // 2].tolist() if plain else []:
        for _ in range(2):
            if (m := misread(w, rng)) not in top:
                truth.setdefault(m, w)
    teach = spark.createDataFrame([(a, b) for a, b in truth.items()], "u string, truth string")
    stay = [w for w in rng.permutation(plain)[: LEARN_WORDS // 6].tolist()] if plain else []
    lesson = teach.select("u").unionByName(spark.createDataFrame([(w,) for w in stay], "u string"))
    trained = candidates(lesson, lexicon).join(teach, "u", "left").toArrow()
    if trained.num_rows:
        x = _rank_features(trained)
        y = np.array([a is not None and a == b for a, b in zip(trained["truth"].to_pylist(), trained["v"].to_pylist())])
        ranking = boost(x, y)
    else:
        ranking = Boosted(-5.0)
    words = cut(_choose(candidates(unknown, lexicon), ranking))
    fixed = decided.join(words.withColumnRenamed("u", "form"), "form", "left")
    breaks = cut(fixed.select("a", "b", "sign", F.coalesce("v", "form").alias("form"), (F.col("sure") | F.col("v").isNotNull()).alias("sure")))
    return Repairs(events, breaks, words, lines)


def found(r: Repairs) -> DataFrame:
    """``src, rec, what, item``: distinct words put right and lines taken out."""
    e = r.events
    lines = e.where("kind = 'line'").select("src", "rec", F.lit("line").alias("what"), F.col("a").alias("item"))
    broken = e.where("kind = 'break'").join(r.breaks, ["a", "b", "sign"]).select("src", "rec", F.lit("word").alias("what"), F.col("form").alias("item"))
    words = e.where("kind = 'word'").join(r.words, F.col("a") == F.col("u")).select("src", "rec", F.lit("word").alias("what"), F.col("v").alias("item"))
    ok = broken.unionByName(words).where("item rlike '^\\\\p{L}+(-\\\\p{L}+)*$'")
    return lines.unionByName(ok).distinct()


def repaired(rows: DataFrame, r: Repairs) -> DataFrame:
    """``src, rec, text``: scanned rows as continuous paragraphs, all others as they are."""
    e = r.events
    broken = e.where("kind = 'break'").join(r.breaks, ["a", "b", "sign"]).select("src", "rec", F.concat_ws("\n", "a", "b", "sign").alias("k"), F.col("form").alias("v"))
    words = e.where("kind = 'word'").join(r.words, F.col("a") == F.col("u")).select("src", "rec", F.col("a").alias("k"), "v")
    maps = broken.unionByName(words).groupBy("src", "rec").agg(F.map_from_entries(F.collect_set(F.struct("k", "v"))).alias("fix"))
    model = r.lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [rebuild(t, dict(m or []), model) if t and is_scan(t) else t for t, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["src", "rec", "text"])

    return rows.join(maps, ["src", "rec"], "left").select("src", "rec", "text", "fix").mapInArrow(run, "src string, rec int, text string")


def _like(pattern: str, word: str) -> str:
    """``word`` in the case of ``pattern``."""
    if pattern.isupper() and len(pattern) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if pattern[:1].isupper() else word


def rebuild(text: str, fix: dict[str, str], model: Boosted | None) -> str:
    """Running paragraphs of one scanned text. A blank line ends a paragraph, except where furniture made it."""
    page = find_furniture([text], model)[0]
    parts: list[list[str]] = [[]]
    pending_blank = after_furniture = False
    for line, furniture in zip(page.lines, page.furniture):
        if furniture:
            after_furniture = True
            continue
        if not line.strip():
            pending_blank = True
            continue
        x = line.strip()
        last = parts[-1][-1] if parts[-1] else ""
        goes_on = last and (not _END.search(last)) and (x[:1].islower() or bool(broken_end(last)))
        if pending_blank and last and not (after_furniture and goes_on):
            parts.append([])
        elif last and _HEADING.match(last) and len(parts[-1]) == 1 and not x[:1].islower() and len(last) < 40:
            parts.append([])
        parts[-1].append(x)
        pending_blank = after_furniture = False

    def word(m: re.Match[str]) -> str:
        return _like(m[0], fix[m[0].lower()]) if m[0].lower() in fix else m[0]

    out = []
    for lines in parts:
        flow = ""
        for x in lines:
            m = broken_end(flow) if flow else None
            t = _TOKEN.match(x) if m else None
            if m and t:
                form = fix.get(f"{m[1].lower()}\n{t[0].lower()}\n{m[2]}", m[1].lower() + t[0].lower())
                flow = flow[: m.start()] + _like(m[1], form) + x[t.end() :]
            else:
                flow = f"{flow} {x}" if flow else x
        if flow:
            out.append(_TOKEN.sub(word, flow))
    return "\n\n".join(out)
