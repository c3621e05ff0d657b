"""Rules that rest on fixed values: the gate, the kinds of sections, keywords, stems."""

import pytest
from pyspark.sql import functions as F

from lacuna.functions.stem import porter_stem
from lacuna.operators import panels, sections, textstats

BODY = ("A filler sentence stands here. " * 12).strip()


@pytest.mark.parametrize(
    "prediction, baseline, passed",
    [
        ("at least 5% better", "RoBERTa-base", True),
        ("accuracy above 0.85 on dev", "BERT-large", True),
        ("F1 of 0.82", "BART", True),
        ("score ≥ chance", "BART", True),
        ("ROUGE-L >= 0.4", "BART", True),
        ("clearly better than before", "BERT-base", False),
        ("5% better", "", False),
        ("5% better", None, False),
        ("", "BART", False),
        (None, None, False),
        *[("5% gain", b, False) for b in ("TBD", "none", "N/A", "no baseline", "No-Baseline", "unspecified", "tba", " na ", "no comparison")],
        *[("5% gain", b, True) for b in ("baseline", "unknown", "null", "-")],
    ],
)
def test_gate(spark, prediction, baseline, passed):
    df = spark.createDataFrame([(prediction, baseline)], "p string, b string")
    assert df.select(panels.testable(F.col("p"), F.col("b"))).first()[0] is passed


@pytest.mark.parametrize(
    "heading, kind",
    [
        ("Weaknesses", "limitations"),
        ("Known Drawbacks", "limitations"),
        ("Threats to Validity", "limitations"),
        ("Further Work", "future_work"),
        ("Extensions", "future_work"),
        ("Whats Next", "future_work"),
        ("Open Issues", "future_work"),
        ("Limitations and Future Work", "limitations"),
        ("Conclusions", "discussion"),
        ("Summary", None),
        ("Concluding Remarks", None),
        ("Unlimitations", None),
        ("Results", None),
    ],
)
def test_kinds(spark, heading, kind):
    assert spark.createDataFrame([(heading,)], "h string").select(sections.kind_of(F.col("h"))).first()[0] == kind


def found(spark, text):
    df = spark.createDataFrame([("p", text)], "id string, text string")
    return [(r.section_type, r.heading) for r in sections.sections(df).collect()]


def test_numbers_are_no_part_of_the_title(spark):
    for number in ("4 ", "4.2.1 ", "IV. ", "XLC. ", "", "\n12\n"):
        assert found(spark, f"Intro\n\n{number}Limitations\n{BODY}\nReferences\n{BODY}") == [("limitations", "Limitations")], number
    # a Roman number needs its dot, a decimal one takes none behind it
    assert found(spark, f"1 Intro\n{BODY}\n5. Limitations\n{BODY}")[0][0] == "fallback"


def test_cascade_order_and_names(spark):
    two = found(spark, f"1 Discussion\n{BODY}\n2 Future Work\n{BODY} b\n3 Limitations\n{BODY} c\nBibliography\n4 Caveats\n{BODY} d")
    assert two == [("limitations", "Limitations"), ("future_work", "Future Work")]
    assert found(spark, "we leave this for future work " + "word " * 100) == [("fallback", "fallback_window")]
    assert found(spark, "word " * 400) == [("tail", "tail_window")]
    assert found(spark, "word " * 200) == []
    assert found(spark, "") == [] and found(spark, None) == []
    # dot leaders make a table of contents
    contents = spark.createDataFrame([("p", "Limitations\n" + "Intro ........ 4\n" * 30)], "id string, text string")
    assert sections.structured_sections(contents).count() == 0


def test_stop_words_and_tokens(spark):
    df = spark.createDataFrame([(0, 1, "ai ai however future graphs"), (0, 2, "ai however graphs"), (1, 3, "x"), (-1, 4, "ai graphs")], "c int, k int, t string")
    got = {r.term for r in textstats.tfidf_keywords(df, "c", "k", "t").where("c = 0").collect()}
    assert {"ai", "graphs", "ai graphs", "ai ai"} <= got and "however" not in got
    assert [r.word for r in textstats.top_words(df, "c", "t", 3).collect()] == ["graphs", "however", "future"]
    assert [r.word for r in textstats.top_words(df, "c", "t", 3, stop=textstats.SHOWN_STOP, token=textstats.SHOWN_TOKEN).collect()] == ["graphs"]
    labels = {r.c: r.keywords for r in textstats.keyword_labels(df, "c", "k", "t").collect()}
    assert labels[1] == "" and labels[0].startswith("ai") and -1 not in labels


def test_stems_and_rouge(spark):
    stems = {"ponies": "poni", "agreed": "agre", "hopping": "hop", "filing": "file", "relational": "relat", "generalizations": "gener", "oscillators": "oscil", "happy": "happi", "news": "news", "dying": "die", "ties": "tie"}
    assert {w: porter_stem(w) for w in stems} == stems
    df = spark.createDataFrame([(1, "models generalize badly", "model generalization is bad"), (2, None, "a"), (3, "", ""), (4, "a b c d", "a c d b")], "k int, p string, g string")
    plain = {r.k: r.f for r in textstats.rouge_n(df, "k", "p", "g").collect()}
    stemmed = {r.k: r.f for r in textstats.rouge_n(df, "k", "p", "g", stem=True).collect()}
    assert plain[1] == 0.0 and stemmed[1] == pytest.approx(4 / 7, abs=1e-6) and stemmed[2] == stemmed[3] == 0.0
    assert {r.k: r.f for r in textstats.rouge_l(df, "k", "p", "g").collect()}[4] == 0.75
    assert {r.k: r.f for r in textstats.rouge_n(df, "k", "p", "g", 2).collect()}[4] == pytest.approx(1 / 3, abs=1e-6)
