import pytest
from pyspark.sql import functions as F

from lacuna.functions import numeric, records, text


def one(spark, col, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first().y


def test_text(spark):
    x = F.col("x")
    s = lambda c, v: one(spark, c, value=v)
    assert s(text.one_line(x), " a\nb \t") == "a b"
    assert s(text.strip(x), None) is None
    assert s(text.last_words(x, 2), "a  b c") == "b c"
    assert s(text.last_words(x, 9), "a b") == "a b"
    assert s(text.sentences(x), "First sentence here. And a second one! no cut? Short. Éa") == ["First sentence here.", "And a second one! no cut?"]
    assert s(text.tokens(x), "A state-of-the-art X1 foo") == ["state-of-the-art", "foo"]
    assert s(text.escape_tex(x), "a_b\\c{}") == r"a\_b\textbackslash{}c\{\}"
    assert s(text.file_stem(x), "a/b é") == "a_b_é"
    assert s(text.tail_bytes(x, 4), "abcdef") == "cdef"
    assert s(text.tail_bytes(x, 9), "abc") == "abc"
    assert s(text.caps_share(x), "ABc") == pytest.approx(2 / 3)
    assert s(text.blank_to(x, "-"), "  ") == "-"
    assert s(text.shorten(x), "123456789012345") == "12345678901234…"


def test_numbers(spark):
    x = F.col("x")
    s = lambda c, v: one(spark, c, value=v)
    assert [s(numeric.whole(x), v) for v in ("4", "3.0", "bad", "2", "2.5", "3.5", None, "NaN")] == [4, 3, 0, 2, 2, 4, 0, 0]
    p = lambda v: one(spark, numeric.peak(x), "x double", v)
    assert (p(0.0), p(1.0), p(0.45)) == (0, 0, 1) and p(0.3) < p(0.4) and p(0.7) > p(0.8)
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(F.round(numeric.cosine("a", "b"), 6)).collect()] == [0.707107, 0.0]
    assert [r[0] for r in df.select(numeric.usable("a")).collect()] == [True, False]


@pytest.mark.parametrize(
    ("given", "want"),
    [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}\n'), ('so {"a": {"b": 1}} ok', '{"a": {"b": 1}}'), ('so {"a": 1} and } more', '{"a": 1}'), ("", None), ("garbage", None), (None, None)],
)
def test_tolerant_json(spark, given, want):
    assert one(spark, records.tolerant_json(F.col("x")), value=given) == want


def test_records(spark):
    x = F.col("x")
    out = one(spark, records.result_lines(x), value="RESULT: acc=0.5\nnoise\nSEED: 3 METRIC: loss=-1.5e-3\nRESULT: bad=x")
    assert [(r.seed, r.metric, r.value) for r in out] == [(None, "acc", 0.5), (3, "loss", -0.0015)]
    assert one(spark, records.year_token(x), value="Mon, 2 Apr 2007 19:18:42 GMT") == 2007
    assert one(spark, records.year_token(x), value="none 20071") is None
    assert one(spark, records.json_list(x, "struct<a:int>"), value="oops") == []
    assert one(spark, records.count_shares(x), "x array<string>", ["b", "a", "b", "b"]) == {"a": 0.25, "b": 0.75}
    assert one(spark, records.count_shares(x), "x array<string>", None) == {}
    assert one(spark, records.from_positions(x), "x map<string,array<int>>", {"we": [0, 2], "do": [1]}) == "we do we"
    assert one(spark, records.first_given(F.col("x"), F.lit("b")), value="") == "b"
