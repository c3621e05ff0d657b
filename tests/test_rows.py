from pyspark.sql import functions as F

from lacuna.operators import panels, rows, sections
from lacuna.operators.components import connected_components


def test_clean_statements(spark):
    data = [(1, "p1", "a" * 25, 0.9), (2, "p1", "short", 0.9), (3, "p3", "y" * 25, 0.2), (4, "p1", "a" * 25, 0.9), (5, "p5", None, 0.9), (6, "p6", "z" * 25, None)]
    df = spark.createDataFrame(data, "gap_idx int, id string, gap_sentence string, confidence double").withColumn("paragraph_text", F.lit("x\ny"))
    got = rows.clean_statements(df, "gap_sentence", "gap_idx").collect()
    assert [(r.gap_idx, r.section_type, r.paragraph_text) for r in got] == [(1, "", "x y")]


def test_selection(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 3)
    assert {(r.g, r.id) for r in rows.top_per_group(df, ["g"], 1, F.desc("id")).collect()} == {(0, 48), (1, 49), (2, 47)}
    s = [r.id for r in rows.seeded_sample(df, "id", 10).collect()]
    assert s == [r.id for r in rows.seeded_sample(df.repartition(7), "id", 10).collect()] and len(set(s)) == 10
    n = rows.numbered(df.repartition(5), F.desc("id")).collect()
    assert {(r.id, r.number) for r in n} == {(49 - k, k) for k in range(50)}
    assert rows.numbered(df.limit(0), "id").count() == 0
    assert rows.bootstrap(df, "id", 40).count() == 40
    assert rows.bootstrap(df.limit(0), "id", 4).count() == 0
    assert rows.unseen(df, spark.range(48)).count() == 2
    assert rows.share_of_max(spark.createDataFrame([(0.0,)], "x double"), "x", "y").first().y == 0


def test_snapshot(spark):
    from pyspark.sql.types import Row

    v = lambda d: [Row(version="v1", created=d)]
    data = [("2106.10000", "T\n1", "A", "cs.LG stat.ML", v("Mon, 2 Apr 2021 19:18:42 GMT")), ("b", "T", "A", "math.CO", v("Mon, 2 Apr 2021 1:1:1 GMT")), ("c", "T", "A", "cs.LG", []), ("d", "T", "A", "cs.LG", v("Mon, 2 Apr 1999 1:1:1 GMT"))]
    df = spark.createDataFrame(data, "id string, title string, abstract string, categories string, versions array<struct<version:string,created:string>>")
    assert [tuple(r) for r in rows.select_snapshot(df, ["cs.LG"], 2000, 5).select("id", "title", "year").collect()] == [("2106.10000", "T 1", 2021)]


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 300), (200, 150), (100, 150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[200] == got[150] == got[100] == 100 and 300 not in got
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def para(x):
    return (x + " sentence here. ") * 30


def papers(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "id string, text string")


def test_sections(spark):
    t = f"1 Introduction\n{para('intro')}\n4 Limitations\n{para('lim')}\n5 Conclusion\n{para('end')}\nReferences\n6 Future Work\n{para('no')}"
    two = f"I. Introduction\n{para('i')}\nII. Future Work\n{para('f')}\n"
    window = "we write. " * 40 + "In future work we will tackle more of it. " * 200
    many = "".join(f"{i} {h}\n{para(h)}\n" for i, h in enumerate(("Introduction", "Limitations", "Future Work", "Discussion"), 1)) + "References\nx"
    got = {}
    for r in sections.sections(papers(spark, t, two, window, "word " * 50, "word " * 500, many, None, "")).collect():
        got.setdefault(r.id, []).append((r.section_type, r.heading))
    assert got["p0"] == [("limitations", "Limitations"), ("discussion", "Conclusion")]
    assert got["p1"] == [("future_work", "Future Work")]
    assert got["p2"][0][0] == "fallback" and "p3" not in got and got["p4"][0][0] == "tail"
    assert [k for k, _ in got["p5"]] == ["limitations", "future_work"] and "p6" not in got and "p7" not in got


def test_paper_text(spark):
    d = [("p1", "discussion", "dis", 1), ("p1", "future_work", "fut", 2), ("p1", "limitations", "lim", 3), ("p3", "tail", "t", 1), ("p3", "fallback", "f", 2)]
    got = {r.id: r for r in sections.paper_text(spark.createDataFrame(d, "id string, section_type string, section_text string, o int"), "id", "o").collect()}
    assert got["p1"].text == "lim\n\nfut\n\ndis" and got["p1"].dominant == "limitations" and got["p3"].dominant == "fallback"


def test_styled_and_lines(spark):
    body = "text of the body that is long enough. " * 10
    b = [("heading", "VI. LIMITATIONS"), ("body", body), ("body", "more"), ("heading", "References"), ("heading", "Future Work"), ("body", body)]
    df = spark.createDataFrame([("p", [(r, t) for r, t in b])], "id string, blocks array<struct<role:string,text:string>>")
    got = sections.styled_sections(df).collect()
    assert [(r.section_type, r.section_text.endswith("more")) for r in got] == [("limitations", True)]
    spans = [(0, 1, 10.0, 50.0, 100.0, 10.0, False, "The body"), (1, 1, 52.0, 90.0, 101.0, 10.0, False, "goes on"), (2, 1, 10.0, 60.0, 120.0, 12.0, True, "VI. CONCLUSION"), (3, 1, 10.0, 60.0, 140.0, 10.0, False, "last line of many characters"), (4, 2, 61.0, 70.0, 140.0, 10.0, False, "next page")]
    s = spark.createDataFrame([("p", *x) for x in spans], "id string, ord int, page int, x0 double, x1 double, y0 double, size double, bold boolean, text string")
    got = [(r.text, r.role) for r in sections.merge_lines(s).orderBy("line").collect()]
    assert got == [("The body goes on", "body"), ("VI. CONCLUSION", "heading"), ("last line of many characters", "body"), ("next page", "body")]


def test_panels(spark):
    d = [(1, "a", "4", "3", "4", "3", "good"), (1, "b", "3", "3", "4", "3", "ok"), (1, "c", "5", "4", "5", "4", "excellent and detailed reasoning here"), (2, "a", "4", "3", "4", "3", None), (2, "b", "4", "3", "4", "3", None), (3, "a", "x", None, "", "n/a", None)]
    df = spark.createDataFrame(d, "idea_id int, judge string, novelty string, specificity string, feasibility string, evidence_grounding string, overall_critique string")
    c = {r.idea_id: r for r in panels.panel_consensus(df).collect()}
    assert (c[1].novelty, c[1].specificity, c[1].n_judges, c[1].critique) == (4.0, round(10 / 3, 6), 3, "excellent and detailed reasoning here")
    a = {r.idea_id: r.agreement for r in panels.panel_agreement(df).collect()}
    assert a[2] == 1.0 and a[3] == 1.0 and 0.8 < a[1] < 1


def test_gates(spark):
    ok = lambda p, b: spark.createDataFrame([(p, b)], "p string, b string").select(panels.testable(F.col("p"), F.col("b"))).first()[0]
    for p in ("improves F1 by 5%", "accuracy > 0.8", "a gain of 3 pp", "AUC ≥ 0.9"):
        assert ok(p, "RoBERTa-base")
    for p, b in (("improves by 5%", ""), ("improves by 5%", "TBD"), ("", "x"), (None, "x"), ("gets better", "x")):
        assert not ok(p, b)
    v = lambda *a: spark.range(1).select(panels.settled_verdict(*[F.lit(x) for x in a])).first()[0]
    assert v("yes", 0, True, 0.0, True) == "untestable" and v("yes", 1, False, 0.0, True) == "inconclusive"
    assert v("yes", 1, True, 0.6, True) == "partial" and v("yes", 1, True, 0.0, False) == "partial" and v("yes", 1, True, 0.1, True) == "yes"


def test_overlap(spark):
    fed = spark.createDataFrame([(1, "p1", "alpha"), (1, "p2", "beta")], "i int, paper_id string, gap_sentence string")
    use = lambda *r: panels.evidence_overlap(spark.createDataFrame([(1, *x) for x in r], "i int, paper_id string, gap_sentence string"), fed, "i").first()
    assert use(("p1", "  alpha  "), ("p2", "beta")).overlap == 1.0
    assert use(("p1", "alpha"), ("p9", "made up")).overlap == 0.5
    assert use(("p9", "x")).n_made_up == 1


def test_text_functions_escapes_whole_paragraphs(spark, data):
    from lacuna.functions.text import TEX_SIGNS
    from lacuna.plans import row_plans

    text = {r.gap_idx: r.paragraph_text or "" for r in spark.read.parquet(f"{data}/gaps.parquet").collect()}
    assert max(map(len, text.values())) > 200
    got = {r.gap_idx: r.tex for r in row_plans.text_functions(spark, data).collect()}
    assert got == {k: "".join(TEX_SIGNS.get(c, c) for c in t) for k, t in text.items()}
