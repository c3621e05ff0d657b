"""Abusive, hateful or sexually explicit language, by a string-kernel machine.

Kernel: sentences are compared by their common character subsequences of length three
and four inside a window of five, each weighted by how far it is spread. Inserted or
replaced characters therefore cost a little instead of breaking a match.

Model: a support vector machine with squared hinge loss on Nyström features of the
kernel, ``z(x) = K_mm^(-1/2) k_m(x)`` over landmark sentences. Because the kernel is an
inner product over subsequences, the trained function folds into one weight per
subsequence, and scoring a corpus is a table lookup per character and gap pattern.

Training: labels are of documents. Sentences of harmless documents are harmless; in an
abusive document those least like anything harmless start as abusive and are relabelled
by the model. Labels that disagree with the nearest labelled sentences are dropped. The
value from which a document counts as abusive is the one that parts held-out labelled
documents best: the machine is fitted without a twentieth of them at a time, which it then scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.abuse_seeds import ABUSIVE, HARMLESS

#: Bounds of the training sample: labelled documents, sentences and landmarks.
LABELLED_DOCUMENTS = 20_000
TRAINING_SENTENCES = 9_000
LANDMARKS = 400
#: Harmless sentences that others are held against to find odd ones.
ANCHORS = 1_200
#: Characters that a subsequence of three or four may span, and the weight per spread character.
WINDOW, DECAY = 5, 0.7
#: Parts of the labelled documents that are held out in turn, and abusive ones from which on they set the decision value (else 0).
FOLDS, LEAST_ABUSIVE = 20, 10
#: Symbols: 0 space, 1-26 letters, 27 anything else, 28 padding between sentences.
_BASE, _OTHER, _PAD = 29, 27, 28
_THREE = _BASE**3
_FOUR = 1 << 15
DIMENSIONS = _THREE + _FOUR
#: Signs that stand for letters inside words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point below 0x2000, and the letter a sign may stand for."""
    import unicodedata

    sym = np.full(0x2000, _OTHER, dtype=np.uint8)
    for c in range(0x2000):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch.lower())[:1]
        if "a" <= base <= "z":
            sym[c] = ord(base) - 96
        elif ch.isspace() or (c < 128 and not ch.isalnum()) or unicodedata.category(ch)[0] in "PZC":
            sym[c] = 0
    sym[ord("ß")] = 19
    alike = np.zeros(0x2000, dtype=np.uint8)
    for a, b in LOOKALIKES.items():
        alike[ord(a)] = ord(b) - 96
    return sym, alike


_SYM, _ALIKE = _tables()
_STOPS = np.zeros(0x2000, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_BLANK = np.zeros(0x2000, dtype=bool)
_BLANK[[ord(c) for c in " \t\r\f\v "]] = True


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, start of each sentence, text of each sentence, raw start of each sentence) of ``texts``.

    Sentences end at a stop before white space, and at line breaks. Runs of one letter
    of three or more and of blanks count once; dots and dashes inside words vanish;
    look-alike signs between letters are read as letters. Every sentence is followed by
    padding.
    """
    raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), dtype=np.uint32)
    cp = np.minimum(raw, 0x1FFF)
    n = len(cp)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, np.uint8), z, z, z
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    text = np.repeat(np.arange(len(texts)), sizes)
    s = _SYM[cp].copy()
    letter = (s >= 1) & (s <= 26)
    before, after = np.roll(letter, 1), np.roll(letter, -1)
    before[0] = after[-1] = False
    newline = cp == 10
    alike = (_ALIKE[cp] > 0) & (before | after) & ~letter
    alike &= before | np.roll(alike, 1)
    # "!" ends a word more often than it stands for a letter
    alike &= (cp != ord("!")) | after
    s[alike] = _ALIKE[cp[alike]]
    inside = before & after & np.isin(cp, [ord("."), ord("-"), ord("_"), ord("*"), 0xAD, 0x200B])
    drop = inside.copy()
    same = (s == np.roll(s, 1)) & (s == np.roll(s, 2)) & (s <= 27)
    same2 = same | np.roll(same, -1)
    drop |= same2 & (s != 0) & (s == np.roll(s, 1))
    drop |= (s == 0) & (np.roll(s, 1) == 0) & ~newline
    stop = np.roll(_STOPS[cp], 1) & (_BLANK[cp] | newline)
    stop[0] = False
    end = newline | stop
    drop &= ~end
    keep = ~drop
    s, end, text = s[keep], end[keep], text[keep]
    at_raw = np.nonzero(keep)[0]
    sentence = np.cumsum(end) - end
    has = np.bincount(sentence, weights=((s >= 1) & (s <= 26)).astype(float)) >= 2
    ok = has[sentence] & ~end
    s, sentence, text, at_raw = s[ok], sentence[ok], text[ok], at_raw[ok]
    if not len(s):
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, np.uint8), z, z, z
    first = np.concatenate(([0], np.nonzero(np.diff(sentence))[0] + 1))
    number = np.cumsum(np.concatenate(([0], np.diff(sentence) != 0)).astype(np.int64))
    out = np.full(len(s) + len(first) * WINDOW, _PAD, dtype=np.uint8)
    out[np.arange(len(s)) + number * WINDOW] = s
    return out, first + np.arange(len(first)) * WINDOW, text[first], at_raw[first]


def _pick(s: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen sentences as symbols and starts."""
    bounds = np.append(starts, len(s))
    parts = [s[bounds[i] : bounds[i + 1]] for i in which]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), np.cumsum(sizes) - sizes


def encode_many(texts: list[str], at_once: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, start of each sentence, text of each sentence), a few texts at a time to bound memory."""
    parts, starts, owners, size = [], [], [], 0
    for i in range(0, len(texts), at_once):
        s, st, own, _ = encode(texts[i : i + at_once])
        parts.append(s)
        starts.append(st + size)
        owners.append(own + i)
        size += len(s)
    return np.concatenate(parts), np.concatenate(starts), np.concatenate(owners)


def pieces(s: np.ndarray, size: int = 1 << 15) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, symbols from the start to a window behind the end) of pieces small enough for the processor's cache."""
    for i in range(0, len(s), size):
        yield i, min(i + size, len(s)), s[i : i + size + WINDOW]


def subsequences(s: np.ndarray, n: int | None = None) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Every gap pattern with the feature that starts at each of the first ``n`` symbols (all unless given); 0 where it leaves the sentence.

    Patterns with a common beginning share its code. Sentences are followed by a window
    of padding, so a subsequence that begins inside a sentence leaves it exactly if its
    last symbol is padding.
    """
    n = len(s) if n is None else n
    p = np.concatenate([s, np.full(WINDOW, _PAD, np.uint8)]).astype(np.int64)
    pad = p == _PAD
    inside = {o: (~(pad[:n] | pad[o : o + n])).astype(np.int64) for o in range(2, WINDOW)}
    for a in range(1, WINDOW):
        two = p[:n] * _BASE + p[a : a + n]
        for b in range(a + 1, WINDOW):
            three = two * _BASE + p[b : b + n]
            yield (a, b), three * inside[b]
            for c in range(b + 1, WINDOW):
                four = three * _BASE + p[c : c + n]
                four = ((four * 2654435761 & 0xFFFFFFFF) >> 17) & (_FOUR - 1)
                yield (a, b, c), (four + _THREE) * inside[c]


def _weight(pattern: tuple[int, ...]) -> float:
    return DECAY ** (pattern[-1] - len(pattern)) * (1.0 if len(pattern) == 2 else 1.5)


def counts(s: np.ndarray) -> np.ndarray:
    """Occurrences of every subsequence."""
    seen = np.zeros(DIMENSIONS, dtype=np.int64)
    for i, j, part in pieces(s, 1 << 17):
        for _, f in subsequences(part, j - i):
            seen += np.bincount(f, minlength=DIMENSIONS)
    return seen


def rarity(seen: np.ndarray, sentences: int) -> np.ndarray:
    """Weight of every subsequence from its occurrences in a corpus: the rarer, the heavier."""
    w = np.log((sentences + 2.0) / (np.minimum(seen, sentences) + 1.0)) / np.log(sentences + 2.0)
    w = w.clip(0.02, 1.0)
    w[0] = 0
    return w.astype(np.float32)


def spans(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _length(square: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of every sentence in feature space from the squares at its symbols, repetitions within it apart."""
    return np.sqrt(np.add.reduceat(square.astype(np.float64), starts) + 1.0)


def mass(s: np.ndarray, starts: np.ndarray, rare: np.ndarray) -> np.ndarray:
    square = rare * rare
    per = np.zeros(len(s), dtype=np.float32)
    for i, j, part in pieces(s):
        for o, f in subsequences(part, j - i):
            per[i:j] += np.float32(_weight(o) ** 2) * square.take(f, mode="clip")
    return _length(per, starts)


def dense(s: np.ndarray, starts: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """(sentences, DIMENSIONS) normalised feature vectors; only for few sentences."""
    m = len(starts)
    out = np.zeros((m, DIMENSIONS), dtype=np.float32)
    row = np.repeat(np.arange(m), spans(starts, len(s)))
    for o, f in subsequences(s):
        np.add.at(out, (row, f), np.float32(_weight(o)))
    out *= rare
    out /= mass(s, starts, rare)[:, None].astype(np.float32)
    return out


def ready(vectors: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Feature vectors in rows as a lookup table for ``against``."""
    table = np.ascontiguousarray(vectors.T)
    table *= rare if table.ndim == 1 else rare[:, None]
    return table


def against(s: np.ndarray, starts: np.ndarray, rare: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel of every sentence with the vectors of a ``ready`` table."""
    n = len(s)
    if table.ndim == 1:
        square = rare * rare
        per, length = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
        for i, j, part in pieces(s):
            for o, f in subsequences(part, j - i):
                w = _weight(o)
                per[i:j] += np.float32(w) * table.take(f, mode="clip")
                length[i:j] += np.float32(w * w) * square.take(f, mode="clip")
        return np.add.reduceat(per.astype(np.float64), starts) / _length(length, starts)
    out = np.zeros((len(starts), table.shape[1]))
    feats = [(np.float32(_weight(o)), f) for o, f in subsequences(s)]
    bounds = np.append(starts, n)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + 4_000, side="right")) - 1)
        a, b = bounds[i], bounds[j]
        block = np.zeros((b - a, table.shape[1]), dtype=np.float32)
        for w, f in feats:
            block += w * table[f[a:b]]
        out[i:j] = np.add.reduceat(block, bounds[i:j] - a, axis=0)
        i = j
    return out / mass(s, starts, rare)[:, None]


def _squared_hinge(z: np.ndarray, y: np.ndarray, c: np.ndarray, l2: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (last one the intercept) by Newton steps on the active rows, from ``start`` on."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1]) if start is None else start.copy()
    reg = np.full(z.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(25):
        margin = 1 - y * (z @ w)
        a = margin > 0
        g = reg * w - z[a].T @ (c[a] * y[a] * margin[a])
        h = (z[a] * c[a, None]).T @ z[a] + np.diag(reg)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def decision_value(scores: np.ndarray, labels: np.ndarray) -> float:
    """The value that parts abusive (1) from harmless documents with the fewest errors: the middle of the widest gap between two scores that gives them.

    Errors count alike on both sides, so labels that are wrong at random move it little.
    """
    order = np.argsort(-scores, kind="stable")
    v, y = scores[order], labels[order]
    errors = y.sum() - np.cumsum(y) + np.cumsum(1 - y)
    gap = v - np.append(v[1:], v[-1] - 1e-9)
    best = np.nonzero((errors == errors.min()) & (gap > 0))[0]
    k = best[int(np.argmax(gap[best]))]
    return float(v[k] - gap[k] / 2)


def held_out(z: np.ndarray, y: np.ndarray, c: np.ndarray, doc: np.ndarray, n_docs: int, l2: float, whole: np.ndarray) -> np.ndarray:
    """Greatest value of each document's sentences by machines fitted without it; minus infinity for documents without any. Rows of ``doc`` from ``n_docs`` on are seeds and always taught."""
    out = np.full(n_docs, -np.inf)
    fold = np.where(doc < n_docs, doc % FOLDS, FOLDS)
    for k in range(FOLDS):
        rest = fold != k
        if not (y[rest] > 0).any() or rest.all():
            continue
        w = _squared_hinge(z[rest], y[rest], c[rest], l2, whole)
        np.maximum.at(out, doc[~rest], z[~rest] @ w[:-1] + w[-1])
    return out


@dataclass
class AbuseModel:
    """Lookup table and rarity of every subsequence, and the intercept."""

    table: np.ndarray
    rare: np.ndarray
    intercept: float

    def sentence_scores(self, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return against(s, starts, self.rare, self.table) + self.intercept

    def document_scores(self, texts: list[str]) -> np.ndarray:
        """Greatest sentence score of each text; minus infinity without a sentence."""
        out = np.full(len(texts), -np.inf)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 1_000_000):
                size += len(texts[hi])
                hi += 1
            s, starts, text, _ = encode(texts[lo:hi])
            if len(starts):
                np.maximum.at(out, lo + text, self.sentence_scores(s, starts))
            lo = hi
        return out


def train(texts: list[str], labels: list[int], rare: np.ndarray | None = None, seed: int = 7, l2: float = 0.1, rounds: int = 5) -> AbuseModel:
    """Fit on labelled documents and the seed sentences; ``rare`` weighs the subsequences."""
    rng = np.random.default_rng(seed)
    docs = [*texts, *ABUSIVE, *HARMLESS]
    doc_y = np.array([*labels, *[1] * len(ABUSIVE), *[0] * len(HARMLESS)])
    s, starts, text = encode_many(docs)
    bounds = np.append(starts, len(s))
    first: dict[tuple[bytes, int], int] = {}
    for i in range(len(starts)):  # one copy of each sentence and label
        first.setdefault((s[bounds[i] : bounds[i + 1]].tobytes(), int(doc_y[text[i]])), i)
    every = np.array(sorted(first.values()), dtype=np.int64)
    seed_row = text[every] >= len(texts)
    y_doc = doc_y[text[every]]
    seeds = every[seed_row]
    harmless = every[(y_doc == 0) & ~seed_row]
    suspect = rng.permutation(every[(y_doc == 1) & ~seed_row])[: TRAINING_SENTENCES // 3]
    base = rng.permutation(harmless)[: TRAINING_SENTENCES // 3]
    if rare is None:
        rare = rarity(counts(s), len(starts))

    # sentences of abusive documents less like harmless ones than harmless ones are like each other
    odd = np.zeros(len(suspect), dtype=bool)
    if len(base) and len(suspect):
        half = len(base) // 2 or 1
        # the third nearest counts: a wrong label or two must not vouch for a sentence
        others = base[half:][:1500] if len(base) > 1 else base
        near, usual = np.zeros((len(suspect), 3)), np.zeros((len(others), 3))
        for k in range(0, min(half, ANCHORS), 400):
            anchors = ready(dense(*_pick(s, starts, base[:half][k : min(k + 400, ANCHORS)]), rare), rare)
            near = np.sort(np.hstack([near, against(*_pick(s, starts, suspect), rare, anchors)]), axis=1)[:, -3:]
            usual = np.sort(np.hstack([usual, against(*_pick(s, starts, others), rare, anchors)]), axis=1)[:, -3:]
            del anchors
        near, usual = near[:, 0], usual[:, 0]
        known = np.array([(s[bounds[i] : bounds[i + 1]].tobytes(), 0) in first for i in suspect])
        odd = (near < np.quantile(usual, 0.05)) & ~known
    positive = set(suspect[odd]) | set(seeds[y_doc[seed_row] == 1])
    abusive_seeds, fixed = set(positive) & set(seeds), set(seeds)
    marks = np.unique(np.concatenate([rng.permutation(suspect[odd])[: LANDMARKS // 2], rng.permutation(base)[: LANDMARKS // 4], seeds]))
    d = dense(*_pick(s, starts, marks), rare)
    kmm = (d @ d.T).astype(np.float64)
    dt = ready(d, rare)
    del d
    val, vec = np.linalg.eigh(kmm)
    good = val > val.max() * 1e-6
    root = vec[:, good] / np.sqrt(val[good])
    kernel: dict[int, np.ndarray] = {}

    def rows_of(which: np.ndarray) -> np.ndarray:
        new = np.array([i for i in which if i not in kernel], dtype=np.int64)
        if len(new):
            kernel.update(zip(new.tolist(), (against(*_pick(s, starts, new), rare, dt) @ root).astype(np.float32)))
        return np.stack([kernel[i] for i in which]).astype(np.float64)

    def value_of(which: np.ndarray) -> np.ndarray:
        """Machine value of sentences, some at a time to bound memory."""
        got = [against(*_pick(s, starts, which[i : i + 5_000]), rare, table) + intercept for i in range(0, len(which), 5_000)]
        return np.concatenate(got) if got else np.zeros(0)

    hard = np.zeros(0, dtype=np.int64)
    dropped: set[int] = set()
    table, intercept = np.zeros(DIMENSIONS, np.float32), -1.0
    for r in range(rounds):
        pos = np.array(sorted(positive - dropped), dtype=np.int64)
        neg = np.array(sorted((set(base) | set(hard) | set(suspect) | fixed) - positive - dropped), dtype=np.int64)
        rows = np.concatenate([pos, neg])
        z, y = rows_of(rows), np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        c = np.where(y > 0, float(np.clip(0.6 * len(neg) / max(1, len(pos)), 1, 30)), 1.0)
        w = _squared_hinge(z, y, c, l2)
        table, intercept = dt @ (root @ w[:-1]).astype(np.float32), float(w[-1])
        if r == rounds - 1:
            break
        f = value_of(suspect)
        positive = abusive_seeds | set(suspect[(f > 0) & (odd | (f > 0.6))])
        g = value_of(harmless)
        hard = harmless[np.argsort(-g, kind="stable")[: TRAINING_SENTENCES // 3]]
        # a label is dropped if the three nearest labelled sentences of other documents all speak against it
        if r:
            check = np.concatenate([np.array(sorted(positive - abusive_seeds), dtype=np.int64), hard[: 2 * len(positive)]])
            if len(check):
                known = np.array(sorted(positive | set(hard) | fixed), dtype=np.int64)
                ky = np.isin(known, np.array(sorted(positive)))
                a, b = rows_of(check), rows_of(known)
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
                b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-9)
                sim = a @ b.T
                sim[text[check][:, None] == text[known][None, :]] = -1
                top = np.argsort(-sim, axis=1)[:, :3]
                agree = ky[top].mean(axis=1)
                close = np.take_along_axis(sim, top, axis=1)[:, -1] > 0.55
                is_pos = np.isin(check, np.array(sorted(positive)))
                wrong = close & ((is_pos & (agree == 0)) | (~is_pos & (agree == 1)))
                dropped = set(check[wrong])
    # rows of documents whose label was dropped say nothing about where to decide
    doc = text[rows]
    trusted = np.isin(np.arange(len(texts)), text[np.array(sorted(dropped), dtype=np.int64)], invert=True)
    value = held_out(z, y, c, doc, len(texts), l2, w)
    use = trusted & np.isfinite(value)
    truth = doc_y[: len(texts)]
    decision = decision_value(value[use], truth[use]) if truth[use].sum() >= LEAST_ABUSIVE and (truth[use] == 0).any() else 0.0
    return AbuseModel(table, rare, intercept - decision)


def corpus_rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rarity of every subsequence over all texts; as many sums as there are subsequences reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            for i in range(0, len(texts), 500):
                s, starts, _, _ = encode(texts[i : i + 500])
                if len(starts):
                    seen += counts(s)
                    n += len(starts)
        seen[0] = n
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["f", "n"])

    got = docs.select(text).mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(DIMENSIONS, dtype=np.int64)
    seen[got.f.to_numpy()] = got.n.to_numpy()
    return rarity(seen, int(seen[0]))


def fit_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = LABELLED_DOCUMENTS) -> AbuseModel:
    """Train on at most ``bound`` labelled documents, chosen by the hash of their key.

    Null labels and null texts are left out; with several labels of a document the mean
    decides, a tie counts as abusive. Without any label the seed sentences alone teach.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    one = one.orderBy(F.xxhash64(key), key).limit(bound)
    got = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t")).join(one, key).select(key, "t", "y").toPandas().sort_values(key)
    return train(got.t.tolist(), got.y.tolist(), corpus_rarity(docs, text))


def score_documents(docs: DataFrame, model: AbuseModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, keep..., score``: a score above 0 means abusive.

    The score of a document is that of its worst sentence; every sentence of the whole
    text counts. Null, empty and wordless texts score null. A map over the rows.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            v = model.document_scores(texts)
            score = pa.array(np.where(np.isfinite(v), v, 0.0), mask=~np.isfinite(v))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], score], names=[key, *keep, "score"])

    return docs.select(key, *keep, F.col(text)).mapInArrow(run, f"{kinds}, score double")


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """``source, n_documents, n_abusive, rate`` per source; a null source is a source of its own."""
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("score") > 0).alias("n_abusive")).withColumn("rate", F.round(F.col("n_abusive") / F.col("n_documents"), 6))
