"""Statistics of words: TF-IDF keywords, top words, topic coherence, ROUGE."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.stem import porter_stem
from lacuna.functions.text import tokens

_ROUGE_WORD = re.compile("[a-z0-9]+")

#: Frequent English words that are no keywords. A default of this library; callers may give another list.
STOP = (
    "a about above after again all also although am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how however i if in into is it its itself just may me might more most must my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up upon us very was we were what when where which while who whom why will with within without would you your yours"
).split()


#: Words that are left out of topic coherence.
COHERENCE_STOP = (
    "that", "with", "this", "from", "have", "into", "such",
    "their", "these", "than", "when", "which", "would", "where",
    "while", "been", "more", "most", "some", "what", "thus",
    "they", "them", "also", "since", "between", "based", "using",
)
#: Further words that are left out of the words shown for a cluster.
SHOWN_STOP = (*COHERENCE_STOP, "however", "further", "future", "work", "should")
#: Tokens of coherence, of the words shown for a cluster, and of keywords.
COHERENCE_TOKEN, SHOWN_TOKEN, KEYWORD_TOKEN = r"[A-Za-z][A-Za-z\-]{2,}", r"[A-Za-z][A-Za-z\-]{3,}", r"[\p{L}\p{N}_]{2,}"


def words_of(c: Column, pattern: str, stop: Sequence[str], least: int = 1) -> Column:
    """Lower-case words of ``least`` characters or more that are no stop words."""
    return F.filter(tokens(c, pattern), lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def _term_counts(df: DataFrame, group: str, key: str, w: Column) -> DataFrame:
    """``group, key, terms``: words and pairs of neighbouring words of each row with their counts; a map over the rows."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter([*t, *(f"{x} {y}" for x, y in zip(t, t[1:]))]) for t in b.column(2).to_pylist()]
            terms = pa.array([[{"term": t, "tf": n} for t, n in c.items()] for c in counts], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), terms], names=[group, key, "terms"])

    return df.select(group, key, w.alias("w")).mapInArrow(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, terms array<struct<term: string, tf: bigint>>")


def tfidf_keywords(df: DataFrame, group: str, key: str, text: str, top: int = 8, features: int = 2000, stop: Sequence[str] = STOP, parts: int = 64) -> DataFrame:
    """``group, term, score, rank``: terms of one and two words by their mean TF-IDF over the texts of a group.

    Words have two signs or more and are not in ``stop``. Counts and frequencies are of
    the group; its ``features`` most frequent terms take part (ties in order of the
    term). Smoothed inverse document frequency, every text at length one. Groups of fewer
    than two texts give nothing. ``key`` names a text. A group's vocabulary is ranked in
    ``parts`` by the hash of the term first, so it never meets in one task as a whole.
    """
    some = df.where(F.col(text).isNotNull() & F.col(group).isNotNull())
    tf = _term_counts(some, group, key, words_of(F.col(text), KEYWORD_TOKEN, stop)).select(group, key, F.explode("terms").alias("t")).select(group, key, "t.term", "t.tf")
    docs = some.groupBy(group).agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs >= 2")
    per = tf.groupBy(group, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    order = (F.desc("total"), "term")
    per = per.withColumn("r", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))).where(F.col("r") <= features)
    per = per.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("r") <= features).join(docs, group)
    per = per.select(group, "term", "n_docs", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(per, [group, "term"]).withColumn("x", F.col("tf") * F.col("idf"))
    whole = x.groupBy(group, key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.max("n_docs").alias("n_docs"), F.collect_list(F.struct("term", "x")).alias("terms"))
    one = whole.select(group, "length", "n_docs", F.explode("terms").alias("t"))
    mean = one.groupBy(group, F.col("t.term").alias("term")).agg(F.round(F.sum(F.col("t.x") / F.col("length")) / F.max("n_docs"), 6).alias("score"))
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term")).alias("rank")
    return mean.select(group, "term", "score", r).where(F.col("rank") <= top)


def keyword_labels(df: DataFrame, group: str, key: str, text: str, top: int = 8, stop: Sequence[str] = STOP) -> DataFrame:
    """``group, keywords``: the keywords of every group but noise (-1), joined by a comma; an empty text for a group without any."""
    some = df.where(F.col(group).isNotNull() & (F.col(group) != -1))
    best = tfidf_keywords(some, group, key, text, top, stop=stop)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ")
    return some.select(group).distinct().join(best.groupBy(group).agg(joined.alias("keywords")), group, "left").withColumn("keywords", F.coalesce("keywords", F.lit("")))


def top_words(df: DataFrame, group: str, text: str, top: int = 10, least: int = 4, stop: Sequence[str] = COHERENCE_STOP, token: str = COHERENCE_TOKEN) -> DataFrame:
    """``group, word, n, rank``: most frequent words of ``least`` letters or more that are not in ``stop``; ties in order of the word."""
    w = df.where(F.col(group) != -1).select(group, F.explode(words_of(F.col(text), token, stop, least)).alias("word"))
    n = w.groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= top)


def npmi(df: DataFrame, group: str, key: str, text: str, top: int = 10) -> DataFrame:
    """``group, npmi``: mean normalised pointwise mutual information of pairs of a group's top words.

    Frequencies are of all texts, noise (-1) included. Pairs that never meet do not
    count; a pair in every text counts 1. Only the top words are joined, so the pairs
    per text are bounded by their number.
    """
    tops = top_words(df, group, text, top)
    chosen = tops.select("word").distinct()
    n = df.count()
    has = df.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).join(chosen, "word", "left_semi")
    freq = has.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    a, b = tops.select(group, F.col("word").alias("w1")), tops.select(group, F.col("word").alias("w2"))
    pairs = a.join(b, group).where("w1 < w2")
    wanted = pairs.select("w1", "w2").distinct()
    met = has.select(key, F.col("word").alias("w1")).join(wanted, "w1").join(has.select(key, F.col("word").alias("w2")), [key, "w2"]).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("both"))
    f1, f2 = freq.select(F.col("word").alias("w1"), F.col("df").alias("d1")), freq.select(F.col("word").alias("w2"), F.col("df").alias("d2"))
    d = pairs.join(met, ["w1", "w2"]).join(f1, "w1").join(f2, "w2")
    p = F.col("both") / F.lit(float(n or 1))
    value = F.when(F.col("both") == n, F.lit(1.0)).otherwise(F.log(F.col("both") * F.lit(float(n or 1)) / (F.col("d1") * F.col("d2"))) / -F.log(p))
    return d.groupBy(group).agg(F.round(F.avg(value), 6).alias("npmi"))


def _rouge_words(text: str | None, stem: bool) -> list[str]:
    w = _ROUGE_WORD.findall((text or "").lower())
    return [porter_stem(x) if len(x) > 3 else x for x in w] if stem else w


def _f(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r else 0.0


def rouge_n(df: DataFrame, key: str, predicted: str, gold: str, n: int = 1, stem: bool = False) -> DataFrame:
    """``key, precision, recall, f`` of common n-grams of words, counted with repetition; both texts are in one row, so this is a map.

    ``stem`` compares the stems of words of four letters or more. Null texts have no words.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, y = (Counter(zip(*(w[i:] for i in range(n)))) for w in (_rouge_words(t, stem), _rouge_words(g, stem)))
                m, nx, ny = (x & y).total(), x.total(), y.total()
                p, r = m / nx if nx else 0.0, m / ny if ny else 0.0
                out.append((p, r, _f(p, r)))
            cols = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "precision", "recall", "f"])

    got = df.select(key, predicted, gold).mapInArrow(run, f"`{key}` {kind}, precision double, recall double, f double")
    return got.select(key, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    place: dict[str, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = v & place.get(w, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def rouge_l(df: DataFrame, key: str, predicted: str, gold: str, stem: bool = False) -> DataFrame:
    """``key, f`` of the longest common subsequence of words (of their stems with ``stem``)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, y = _rouge_words(t, stem), _rouge_words(g, stem)
                out.append(2 * common_subsequence(x, y) / (len(x) + len(y)) if x and y else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=[key, "f"])

    return df.select(key, predicted, gold).mapInArrow(run, f"`{key}` {kind}, f double").withColumn("f", F.round("f", 6))
