import base64
import os
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZER_DIR, tokens.VOCABULARY)), reason="no vocabulary files")
tiktoken = pytest.importorskip("tiktoken")


def encode(t):
    out = array("i")
    tokens.tokenizer().encode_into(t, out)
    return list(out)


@pytest.fixture(scope="module")
def reference():
    ranks = {}
    with open(os.path.join(tokens.TOKENIZER_DIR, tokens.VOCABULARY), "rb") as f:
        for line in f:
            a, b = line.split()
            ranks[base64.b64decode(a)] = int(b)
    return tiktoken.Encoding("own", pat_str=tokens.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=80))
def test_equals_reference(reference, t):
    assert encode(t) == reference.encode_ordinary(t)


@pytest.mark.parametrize("t", ["aaaa" * 2000, "ab" * 3000, " " * 3000, "<|endoftext|>", "don't we'll I'M", "naïve 数据集 🧪🚀", "\t\t\n\n x  y \n"])
def test_hard_texts(reference, t):
    assert encode(t) == reference.encode_ordinary(t)
    assert b"".join(next(k for k, v in tokens.tokenizer().ranks.items() if v == i) for i in encode(t)[:20]) == t.encode()[: len(b"".join(next(k for k, v in tokens.tokenizer().ranks.items() if v == i) for i in encode(t)[:20]))]


def test_corpus(spark, reference):
    rows = [(1, "Hello world", "ids"), (2, "", "x"), (3, None, None), (1, "Hello world", "ids"), (None, "a", "x"), (5, "word " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted([(i, reference.encode_ordinary(t or "")) for i, t, _ in rows], key=str)
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert {r.n_tokens for r in tokens.encode_corpus(df.where("doc_id = 1"), counts_only=True).collect()} == {2}
