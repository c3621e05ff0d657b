"""Records that repeat another with small edits.

Word sets are signed with SuperMinHash: every word ranks the slots of the signature by
a random permutation of its own and gives the slot of rank ``j`` the value ``j`` plus a
fraction; a slot keeps its least value. Ranks are handed out level by level, and a
record is finished as soon as its largest slot is below the next level (early stopping).
Bands of slots of both fields together are joined, a sketch of one bit per slot discards
chance meetings inside the join, the rest is verified on the word sets, and linked
records become groups.

Records with the same two word sets are one text in all of this, named by a hash of the
sets; copies are attached at the end and never meet. A task signs a text once however
often it comes. A band that very many texts share is cut into blocks, and pairs of blocks
are the unit of work: the same pairs meet as in any other band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.skew import attach, group_pairs
from lacuna.operators.components import connected_components
from lacuna.session import cut

#: Slots of the long and of the short field per band, and bands: a pair of similarities 0.75 and 0.6 is missed with probability 0.0012.
LONG_SLOTS, SHORT_SLOTS, BANDS = 4, 1, 32
#: Bits of the sketch of the long field, and the differing bits at which a pair of 0.75 would be 3.8 deviations off.
SKETCH_BITS, SKETCH_MOST = 128, 30
#: Texts of a band that one task takes, about; larger bands are found on one text in ``CROWD_SHARE`` and cut.
BAND_ROWS, CROWD_SHARE = 2_048, 16
#: Partitions of the bands per partition of the session.
BAND_PARTS = 4
#: Texts that a task remembers to have signed.
SEEN = 500_000
_WORD = re.compile("[a-z0-9]+")
_LEVELS = 24
_VOCABULARY = 200_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SuperMinHash:
    """Signatures of ``slots`` values over word sets, with a bounded memory of words."""

    def __init__(self, slots: int) -> None:
        self.slots = slots
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.hash = np.zeros(0, np.uint64)
        self.perm = np.zeros((0, self.slots), np.int16)
        self.value = np.zeros((0, self.slots), np.uint32)

    def learn(self, words: list[str]) -> None:
        """Rank the slots for words not met before."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
        step = np.arange(1, self.slots + 1, dtype=np.uint64)
        order = _mix(h[:, None] + step[None, :] * _GOLD)
        perm = np.argsort(order, axis=1, kind="stable").astype(np.int16)
        fraction = _mix(order ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(44)
        value = (np.arange(self.slots, dtype=np.uint64)[None, :] << np.uint64(20)) | fraction
        self.hash = np.concatenate([self.hash, h])
        self.perm = np.concatenate([self.perm, perm])
        self.value = np.concatenate([self.value, value.astype(np.uint32)])

    def numbers(self, sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, sizes) of the word sets, laid end to end."""
        if len(self.number) > _VOCABULARY:
            self.forget()
        known, new = self.number, []
        out = []
        for s in sets:
            for w in s:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    new.append(w)
                out.append(k)
        if new:
            self.learn(new)
        return np.array(out, dtype=np.int64), np.array([len(s) for s in sets], dtype=np.int64)

    def sign(self, word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(records, slots) signature; records must not be empty."""
        n, m = len(sizes), self.slots
        sig = np.full(n * m, 0xFFFFFFFF, dtype=np.uint32)
        row = np.repeat(np.arange(n), sizes)
        for level in range(0, m, _LEVELS):
            at = row[:, None] * m + self.perm[word, level : level + _LEVELS]
            np.minimum.at(sig, at.ravel(), self.value[word, level : level + _LEVELS].ravel())
            open_ = (sig.reshape(n, m).max(axis=1) >> np.uint32(20)) >= level + _LEVELS
            if not open_.any():
                break
            keep = open_[row]
            word, row = word[keep], row[keep]
        return sig.reshape(n, m)


def band_keys(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """(records, ``BANDS``) 64-bit keys from slots of both fields."""
    parts = [long[:, : LONG_SLOTS * BANDS].reshape(len(long), BANDS, LONG_SLOTS), short[:, : SHORT_SLOTS * BANDS].reshape(len(short), BANDS, SHORT_SLOTS)]
    h = np.broadcast_to((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _GOLD, (len(long), BANDS)).copy()
    for s in parts:
        for k in range(s.shape[2]):
            h = _mix(h ^ s[:, :, k].astype(np.uint64)) + _GOLD
    return h.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """(records, 2) 64-bit words: one bit of each of the first slots."""
    bits = (_mix(sig[:, :SKETCH_BITS].astype(np.uint64) * _GOLD) & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


_hashers: dict[int, SuperMinHash] = {}


def _hasher(slots: int) -> SuperMinHash:
    return _hashers.setdefault(slots, SuperMinHash(slots))


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _sets(b: pa.RecordBatch, hasher: SuperMinHash) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(rows with words in both fields, their texts' names, word numbers, sizes) with the short fields before the long ones."""
    a, c = [_words(t) for t in b.column(1).to_pylist()], [_words(t) for t in b.column(2).to_pylist()]
    rows = [i for i in range(len(a)) if a[i] and c[i]]
    if not rows:
        return rows, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, sizes = hasher.numbers([a[i] for i in rows] + [c[i] for i in rows])
    start = np.cumsum(sizes) - sizes
    sums = np.add.reduceat(_mix(hasher.hash[word] + _GOLD), start)
    n = len(rows)
    return rows, _mix(_mix(sums[:n]) + sums[n:] * _GOLD), word, sizes


def _source(df: DataFrame, key: str, short: str, long: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(short).alias("s"), F.col(long).alias("l")).where(F.col("id").isNotNull() & (F.col("s") != "") & (F.col("l") != ""))


def _signed(hasher: SuperMinHash, name: np.ndarray, word: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, sketch) of the chosen texts of ``_sets``."""
    n, start = len(name), np.cumsum(sizes) - sizes
    pick = lambda at: (np.concatenate([word[start[i] : start[i] + sizes[i]] for i in at]), sizes[at])
    long = hasher.sign(*pick(which + n))
    return band_keys(long, hasher.sign(*pick(which))), sketch(long)


_SLOTS = max(LONG_SLOTS * BANDS, SHORT_SLOTS * BANDS, SKETCH_BITS)


def text_names(src: DataFrame, one_in: int) -> DataFrame:
    """``id, text_id, bands`` of every record with words in both fields: names are equal for equal word sets, bands are given for one text in ``one_in``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(_SLOTS)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows, name, word, sizes = _sets(b, hasher)
                if not rows:
                    continue
                chosen = name % np.uint64(one_in) == 0
                which = np.nonzero(chosen)[0]
                flat = _signed(hasher, name, word, sizes, which)[0].reshape(-1) if len(which) else np.zeros(0, np.int64)
                offsets = np.concatenate(([0], np.cumsum(chosen) * BANDS)).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(name.view(np.int64)), bands], names=["id", "text_id", "bands"])

    return src.mapInArrow(run, "id bigint, text_id bigint, bands array<bigint>")


def band_rows(src: DataFrame) -> DataFrame:
    """``band, t, k1, k2``: bands and sketch of every text, once per task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(_SLOTS)
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                _, name, word, sizes = _sets(whole.slice(at, 1000), hasher)
                if len(seen) > SEEN:
                    seen.clear()
                new = []
                for i, x in enumerate(name.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                if new:
                    which = np.array(new)
                    bands, k = _signed(hasher, name, word, sizes, which)
                    k = np.repeat(k, BANDS, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(bands.reshape(-1)), pa.array(np.repeat(name[which].view(np.int64), BANDS)), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["band", "t", "k1", "k2"])

    return src.mapInArrow(run, "band bigint, t bigint, k1 bigint, k2 bigint")


_NEAR = f"bit_count(a1 ^ b1) + bit_count(a2 ^ b2) <= {SKETCH_MOST}"


def _sides(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*keys, F.col("t").alias(x), F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2")) for x in "ab")


def candidate_pairs(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """``a, b``: distinct texts that share a band and whose sketches are near; ``crowded`` says into how many parts a band is cut."""
    if crowded.isEmpty():
        a, b = _sides(rows, "band")
        return a.join(b, "band").where(f"a < b and {_NEAR}").select("a", "b").distinct()
    a, b = _sides(rows.join(crowded, "band", "left_anti"), "band")
    few = a.join(b, "band").where(f"a < b and {_NEAR}").select("a", "b")
    many = rows.join(crowded, "band").withColumn("own", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    a, _ = _sides(many.select("*", F.col("own").alias("p"), F.explode(F.expr("sequence(own, parts - 1)")).alias("q")), "band", "p", "q")
    _, b = _sides(many.select("*", F.explode(F.expr("sequence(0, own)")).alias("p"), F.col("own").alias("q")), "band", "p", "q")
    met = a.join(b, ["band", "p", "q"]).where(f"(p <> q or a < b) and {_NEAR}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return few.unionByName(met).where("a <> b").distinct()


def crowded_bands(named: DataFrame, most: int, one_in: int) -> DataFrame:
    """``band, parts`` of the bands that ``most`` texts or more share, judged by one text in ``one_in``."""
    n = named.where(F.size("bands") > 0).select("text_id", F.explode("bands").alias("band")).groupBy("band").agg(F.count_distinct("text_id").alias("n"))
    return n.where(F.col("n") > most // one_in).select("band", F.ceil(F.col("n") * one_in / most).cast("int").alias("parts"))


def _set(c: str) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def near_texts(df: DataFrame, key: str = "gap_idx", short: str = "gap_sentence", long: str = "paragraph_text", least_short: float = 0.6, least_long: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """``(links, members)`` of near-duplicate texts.

    ``links(a, b)``: pairs of different texts whose word sets share ``least_short`` of
    their union in the short and ``least_long`` in the long field. ``members(id,
    text_id)``: the text of every record with words in both fields; null, empty and
    wordless ones belong to none. Case, order and repetition of words do not matter.
    Further columns of ``df`` are not read. Texts are told apart by a 64-bit hash of
    their word sets.
    """
    src = _source(df, key, short, long)
    named = cut(text_names(src, CROWD_SHARE))
    members = named.select("id", "text_id")
    # a text is 32 rows here: more partitions than the session takes for its tables keep tasks of one size
    bands = band_rows(src).repartition(BAND_PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band")
    pairs = cut(candidate_pairs(bands, cut(crowded_bands(named, BAND_ROWS, CROWD_SHARE))))
    one = members.groupBy("text_id").agg(F.min("id").alias("id"))
    wanted = one.join(pairs.select(F.explode(F.array("a", "b")).alias("text_id")).distinct(), "text_id", "left_semi")
    text = src.join(wanted, "id").select("text_id", _set("s").alias("s"), _set("l").alias("l"))
    d = pairs.join(text.select(F.col("text_id").alias("a"), F.col("s").alias("sa"), F.col("l").alias("la")), "a")
    d = d.join(text.select(F.col("text_id").alias("b"), F.col("s").alias("sb"), F.col("l").alias("lb")), "b")
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    links = d.where((share("sa", "sb") >= least_short - 1e-12) & (share("la", "lb") >= least_long - 1e-12)).select("a", "b")
    return cut(links), members


def near_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``gap_a, gap_b``: all pairs of records of one text or of linked texts, smaller id first."""
    return group_pairs(members, links, "id", "text_id", "gap_a", "gap_b")


def near_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``id, class_id, n_links``: group of every record, named by its smallest id, and the number of other texts it is linked to."""
    ends = links.select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id").agg(F.count(F.lit(1)).alias("n_links"))
    comp = connected_components(links).select(F.col("node").alias("text_id"), "component")
    texts = members.groupBy("text_id").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    d = texts.join(comp, "text_id", "left").join(ends, "text_id", "left").withColumn("component", F.coalesce("component", "text_id"))
    names = d.groupBy("component").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("m"))
    d = attach(d, names, "component", "m").select("text_id", "n", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return attach(members, cut(d), "text_id").select("id", "class_id", "n_links")
