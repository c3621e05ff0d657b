"""Encoding of a corpus with a public byte-level BPE vocabulary.

The merges of one pre-token run on a segment tree over its byte positions. Every node
keeps the smallest pair rank below it, so the leftmost pair of smallest rank is found by
one descent; a merge changes the pairs of the live neighbours only and costs three
logarithmic point updates. A pre-token of n bytes takes O(n log n), so texts without any
white space are as safe as ordinary ones. Pre-tokens repeat, therefore each Python
worker remembers a bounded number of encoded ones.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("LACUNA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers before it starts anew.
CACHE_ENTRIES = 200_000
_NEVER = 1 << 30


class SegmentTreeBpe:
    """Byte-level BPE by rank table, merging on a segment tree."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.split = regex.compile(SPLIT_PATTERN)
        self.cache: dict[str, array] = {}

    @classmethod
    def load(cls, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> SegmentTreeBpe:
        with open(os.path.join(folder, vocabulary), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, piece: bytes) -> array:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return array("i", [whole])
        n = len(piece)
        token = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = 1 << max(1, (n - 1).bit_length())
        tree = [_NEVER] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = ranks.get(piece[i : i + 2], _NEVER)
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b

        def put(i: int, rank: int) -> None:
            k = width + i
            tree[k] = rank
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a <= b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (low := tree[1]) < _NEVER:
            k = 1
            while k < width:
                k *= 2
                if tree[k] != low:
                    k += 1
            i = k - width
            j = after[i]
            token[i] += token[j]
            token[j] = b""
            after[i] = after[j]
            put(j, _NEVER)
            if after[i] < n:
                before[after[i]] = i
                put(i, ranks.get(token[i] + token[after[i]], _NEVER))
            else:
                put(i, _NEVER)
            if before[i] >= 0:
                put(before[i], ranks.get(token[before[i]] + token[i], _NEVER))
        return array("i", [ranks[t] for t in token if t])

    def encode_into(self, text: str, out: array) -> None:
        """Append the ids of ``text`` to ``out``."""
        cache, add = self.cache, out.extend
        for p in self.split.findall(text):
            ids = cache.get(p)
            if ids is None:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                ids = self.merge(p.encode("utf-8"))
                if len(p) <= 64:
                    cache[p] = ids
            add(ids)


_loaded: dict[tuple[str, str], SegmentTreeBpe] = {}


def tokenizer(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> SegmentTreeBpe:
    """The tokenizer of this process, loaded once."""
    key = (folder, vocabulary)
    if key not in _loaded:
        _loaded[key] = SegmentTreeBpe.load(folder, vocabulary)
    return _loaded[key]


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Repartition to the cores at hand if ``df`` comes from fewer input splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, counts_only: bool = False
) -> DataFrame:
    """Token ids of every document: ``key, ids`` (or ``key, n_tokens``).

    An empty or null text gives an empty list. Strings of special tokens are ordinary
    text, no special token is added. Repeated rows give repeated rows; other columns of
    ``docs`` are not read; a null key is kept. Only a map over the rows, no shuffle.
    """
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(folder, vocabulary)
        for b in batches:
            start = 0
            texts = b.column(1).to_pylist()
            while start < len(texts):
                out, ends, k = array("i"), [0], start
                # a result batch ends after some four million ids
                while k < len(texts) and len(out) < 4_000_000:
                    if texts[k]:
                        bpe.encode_into(texts[k], out)
                    ends.append(len(out))
                    k += 1
                offsets = np.asarray(ends, dtype=np.int32)
                if counts_only:
                    col: pa.Array = pa.array(np.diff(offsets).astype(np.int64))
                else:
                    col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(out, dtype=np.int32) if len(out) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, k - start), col], names=[key, "n_tokens" if counts_only else "ids"])
                start = k

    kind = "n_tokens bigint" if counts_only else "ids array<int>"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {key_type.simpleString()}, {kind}")
