import importlib.util
import io
import json
import lzma
import os
import shutil
import subprocess
import sys
import tarfile

import pytest
from pyspark.sql import functions as F

from lacuna import cli, reports, schemas, tools
from lacuna.functions import records
from lacuna.operators import clustering, ideas, sections, themes
from lacuna.sources import files, search, services
from lacuna.streaming import incremental


def test_tsv_round_trip(spark, tmp_path):
    rows = [("2106.10000", "limitation", "", 'a "quoted"\ttab', "line\nbreak $\\alpha_{1}$", 0.5), ("1", "x", "s", "plain", "p", None)]
    df = spark.createDataFrame(rows, schemas.GAPS)
    files.write_tsv(df, str(tmp_path / "g"))
    back = files.read_tsv(spark, str(tmp_path / "g"), schemas.GAPS)
    got = {r.id: r for r in back.collect()}
    assert got["2106.10000"].gap_sentence == rows[0][3] and got["2106.10000"].paragraph_text == rows[0][4] and got["1"].confidence is None
    assert files.read_tsv(spark, str(tmp_path / "none"), schemas.GAPS, missing_ok=True).count() == 0


def test_json_sources(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "2106.10000", "title": "T", "abstract": "A", "categories": "cs.LG", "versions": [{"version": "v1", "created": "Mon, 2 Apr 2021 1:1:1 GMT"}]}\n\nbroken {\n')
    assert [(r.id, r.year) for r in files.read_snapshot(spark, str(p), ["cs.LG"], 2020).collect()] == [("2106.10000", 2021)]
    got = [r.record for r in files.read_records(spark, str(p), "id string").collect()]
    assert [g.id if g else None for g in got] == ["2106.10000", None]
    files.write_jsonl(spark.createDataFrame([("é",)], "a string"), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "a string").first().a == "é"
    files.append_one(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "t"))
    files.append_one(spark.createDataFrame([(2, "x")], "a int, b string"), str(tmp_path / "t"))
    assert {(r.a, r.b) for r in files.read_merged(spark, str(tmp_path / "t")).collect()} == {(1, None), (2, "x")}


def test_archives_and_binary(spark, tmp_path):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for name, text in (("a/x.jsonl", '{"k": 1}\nbad\n{"k": 2}\n'), ("b.txt", "no"), ("c.json", '{"k": 3}')):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "z.tar.xz").write_bytes(lzma.compress(buf.getvalue()))
    got = files.read_archives(spark, str(tmp_path / "z.tar.xz"))
    assert sorted(json.loads(r.record)["k"] for r in got.collect()) == [1, 2, 3]
    assert files.scan_until(spark.range(100), "id", "id % 10 = 0", 3, 25).count() == 3
    (tmp_path / "2106.1.pdf").write_bytes(b"pdf " * 200)
    (tmp_path / "short.pdf").write_bytes(b"x")
    got = files.read_pdfs(spark, str(tmp_path), parse=lambda c, pages: c.decode()).collect()
    assert [(r.id, r.n_chars) for r in got] == [("2106.1", 800)]
    assert files.files_present(spark, str(tmp_path), "*.pdf", 100).count() == 1


def make_search():
    # a local class travels to the workers by value

    class Search:
        def search(self, query, limit):
            return [{"title": "neural graph", "abstract": "neural graph models", "paperId": "X"}, {"title": "other", "abstract": None, "paperId": "Y"}]

        def batch(self, ids):
            return [None if i == "none" else {"paperId": f"P{i}", "title": "T", "year": 2020, "externalIds": {"ArXiv": i}, "openAccessPdf": None} for i in ids]

    return Search


Search = make_search()


def test_services(spark):
    papers = spark.createDataFrame([("2106.10000", "A limitation of this is size. We plan to do more. Nothing else here."), ("b", None)], "id string, text string")
    got = services.annotate(papers).collect()
    assert {(r.id, r.gap_type) for r in got} == {("2106.10000", "limitation"), ("2106.10000", "future_work")}
    e = services.embed(papers, "text").collect()
    assert len(e[0].embedding) == 64 and sum(x * x for x in e[0].embedding) == pytest.approx(1, abs=1e-5)
    first = services.embed_missing(papers, "text", spark.createDataFrame([], "text_key string, embedding array<float>"))
    assert first.count() == 1 and services.embed_missing(papers, "text", first).count() == 0
    flat = {r.id: r for r in services.flat_paper(services.lookup(spark.createDataFrame([("1",), ("none",)], "id string"), Search)).collect()}
    assert flat["1"].paperId == "P1" and flat["1"].s2_arxiv_id == "1" and flat["1"].year == "2020" and flat["none"].title == ""
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert services.with_retries(flaky, 4, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        services.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, 0, waits.append)


@pytest.fixture
def corpus(spark):
    v = lambda *x: [float(a) for a in x]
    gaps = spark.createDataFrame(
        [(0, "p1", "future_work", "s", "graph models fail often today", "x", 0.9, 0, v(1, 0)), (1, "p2", "limitation", "s", "speech needs labelled data sets", "x", 0.85, 0, v(1, 0.1)), (2, "p3", "future_work", "s", "other", "x", 0.95, 1, v(0, 1))],
        "gap_idx int, id string, gap_type string, section_type string, gap_sentence string, paragraph_text string, confidence double, cluster_id int, embedding array<double>",
    )
    clusters = spark.createDataFrame([(0, "Robustness", 2, 2, 0.875), (1, "Language", 1, 1, 0.95)], schemas.CLUSTERS)
    methods = spark.createDataFrame([(0, "p4", "algorithm", "we use it", v(0.5, 0.87))], "method_idx int, id string, method_type string, method_sentence string, embedding array<double>")
    ideas = spark.createDataFrame([("bridge", 0, 1, "A", 0.8, 0.7), ("within", 0, None, "B", 0.1, 0.9)], schemas.IDEAS)
    return tools.Corpus(spark, gaps, methods, clusters, ideas=ideas, search=Search())


def test_tools(corpus):
    c = corpus
    assert [t["theme_label"] for t in tools.call(c, "list_themes")] == ["Robustness", "Language"]
    t = tools.call(c, "get_theme", cluster_id=0)
    assert [(p["paper_id"], p["n_gaps"], p["gap_types"]) for p in t["papers"]] == [("p1", 1, ["future_work"]), ("p2", 1, ["limitation"])] and "error" in tools.call(c, "get_theme", cluster_id=9)
    assert (t["keywords"], t["n_papers"], t["n_gaps"], t["avg_confidence"]) == ("", 2, 2, 0.875)
    assert len(tools.call(c, "get_evidence", cluster_id=0, k=1)) == 1
    assert tools.call(c, "retrieve_methods", cluster_id=0)[0]["paper_id"] == "p4"
    assert len(tools.call(c, "search_prior_art", query="x")) == 2
    n = tools.call(c, "score_novelty", title="neural graph", research_question="", method_sketch="models")
    assert n["n_hits"] == 2 and n["closest_paper"]["paperId"] == "X" and 0 <= n["novelty_score"] <= 1
    assert tools.score_novelty(tools.Corpus(c.spark), "t", "q", "m")["novelty_score"] == 1.0
    c.search = None
    assert tools.score_novelty(c, "t", "q", "m")["novelty_score"] is None
    fed = [{"paper_id": "p1", "gap_sentence": "alpha"}]
    assert tools.call(c, "check_evidence_overlap", evidence_used=[*fed, {"paper_id": "p9", "gap_sentence": "z"}], fed_evidence=fed) == {"overlap": 0.5, "n_used": 2, "n_grounded": 1, "hallucinated": [{"paper_id": "p9", "gap_sentence": "z"}]}
    assert tools.check_evidence_overlap(c, [], fed)["overlap"] == 0.0
    assert [i["title"] for i in tools.call(c, "list_ideas", min_novelty=0.5)] == ["A"] and len(tools.list_ideas(c, mode="within")) == 1
    assert tools.call(c, "get_idea", idx=0)["title"] == "A" and "error" in tools.call(c, "get_idea", idx=99) and "error" in tools.call(c, "get_idea", idx=-1)
    assert tools.call(c, "save_idea", idea={"mode": "a mode before the others", "title": "C", "extra": {"k": 1}}) == {"saved": True, "total_ideas": 3}
    assert [i["title"] for i in tools.list_ideas(c)] == ["A", "B", "C"] and tools.get_idea(c, 0)["title"] == "A" and tools.get_idea(c, 2)["extra"] == '{"k": 1}'
    assert tools.call(c, "list_frontier") == [] and tools.call(c, "list_gap_pairs") == [] and "error" in tools.call(c, "nope")


def test_ideas_are_kept_on_disk(spark, tmp_path):
    path = str(tmp_path / "ideas")
    assert tools.save_idea(tools.Corpus(spark, ideas_path=path), {"title": "one", "mode": "within", "novelty_score": 0.1})["total_ideas"] == 1
    assert tools.save_idea(tools.Corpus(spark, ideas_path=path), {"title": "two", "mode": "bridge", "novelty_score": "0.9", "more": [1]})["total_ideas"] == 2
    c = tools.Corpus(spark, ideas_path=path)
    assert [i["title"] for i in tools.list_ideas(c)] == ["one", "two"] and [i["title"] for i in tools.list_ideas(c, min_novelty=0.5)] == ["two"]
    assert tools.get_idea(c, 1)["more"] == "[1]" and tools.get_idea(c, 0)["more"] is None


def test_long_answers_are_whole_or_refused(spark, monkeypatch):
    many = spark.range(1_001).selectExpr("'within' as mode", "cast(id as string) as title")
    c = tools.Corpus(spark, ideas=many)
    assert len(tools.list_ideas(c)) == 1_001
    monkeypatch.setattr(tools, "MOST_ROWS", 1_000)
    with pytest.raises(ValueError, match="1000"):
        tools.list_ideas(c)
    assert reports.markdown(many, "T").count("\n") == 1_001 + 4
    monkeypatch.setattr(reports, "MOST_ROWS", 1_000)
    with pytest.raises(ValueError, match="1000"):
        reports.markdown(many, "T")


def test_definitions_and_dispatch(corpus):
    assert {d["name"] for d in tools.DEFINITIONS} == set(tools.TOOLS)
    for d in tools.DEFINITIONS:
        assert d["description"] and d["inputSchema"]["type"] == "object" and set(d["inputSchema"]["required"]) <= set(d["inputSchema"]["properties"])
    assert tools.DEFINITIONS[3]["inputSchema"]["properties"]["sim_low"] == {"type": "number", "default": 0.3}
    with pytest.raises(ValueError, match="unknown tool"):
        tools.dispatch(corpus, "frobnicate")
    asked = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "list_themes"}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"jsonrpc": "2.0", "id": 5, "method": "other"}]
    out = io.StringIO()
    tools.serve(corpus, io.StringIO("\n".join(map(json.dumps, asked)) + "\nno json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, 2, 3, 4, 5, None] and len(got[1]["result"]["tools"]) == 12
    assert len(json.loads(got[2]["result"]["content"][0]["text"])) == 2 and got[3]["result"]["isError"] and "error" in got[4] and "error" in got[5]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda *r: spark.createDataFrame(r, "id string, text string").write.mode("append").parquet(src)
    work = lambda d: d.where("text <> 'none'").select("id", F.upper("text").alias("t"))
    add(("1", "a"), ("2", "none"), ("1", "a"))
    run = lambda: incremental.resume(incremental.file_stream(spark, src, "id string, text string"), work, out, str(tmp_path / "cp")).awaitTermination(120)
    run()
    add(("2", "again"), ("3", "c"))
    run()
    assert {(r.id, r.t) for r in spark.read.parquet(out).collect()} == {("1", "A"), ("3", "C")}
    # a batch that is tried again, as after a stop before it was committed, leaves nothing twice
    shutil.rmtree(tmp_path / "cp" / "commits")
    run()
    assert sorted((r.id, r.t) for r in spark.read.parquet(out).collect()) == [("1", "A"), ("3", "C")]
    ev = [(1, 0, "revise", 3.0), (1, 1, "accept", 3.0), (2, 0, "reject", 1.0), (3, 0, "revise", 4.5)]
    kind = "idea_id int, iteration int, verdict string, score double"
    spark.createDataFrame(ev, kind).write.parquet(str(tmp_path / "ev"))
    q = incremental.revision_states(incremental.file_stream(spark, str(tmp_path / "ev"), kind)).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.idea_id: (r.rounds, r.finished) for r in spark.table("states").collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (1, True)}
    assert {(r.idea_id, r.rounds) for r in incremental.finished_rounds(spark.createDataFrame(ev, kind)).collect()} == {(1, 2), (3, 1)}
    assert incremental.first_of_each(spark.createDataFrame([], "k int, ts timestamp"), ["k"], "ts").columns == ["k", "ts"]


def test_records_and_reports(spark):
    df = spark.createDataFrame([({"a": 1, "_x": 2}, {"a": 3, "b": 4})], "m map<string,int>, n map<string,int>")
    r = df.select(records.merged_map(F.col("m"), F.col("n")).alias("x"), records.public_fields(F.col("m")).alias("y")).first()
    assert r.x == {"_x": 2, "a": 3, "b": 4} and r.y == {"a": 1}
    one = spark.createDataFrame([((None, "n"), ("o", "p"), " Accept", [("p1",), ("z",)], ["p1"], [])], "new struct<a:string,b:string>, old struct<a:string,b:string>, v string, rel array<struct<paper_id:string>>, known array<string>, none array<string>")
    r = one.select(records.revised(F.col("new"), F.col("old"), ["a", "b"]).alias("s"), records.verdict(F.col("v")).alias("v"), records.known_citations(F.col("rel"), F.col("known")).alias("k"), records.known_citations(F.col("rel"), F.col("none")).alias("n")).first()
    assert (r.s.a, r.s.b, r.v, len(r.k), len(r.n)) == ("o", "n", "accept", 1, 2)
    assert "| a\\|b | — |" in reports.markdown(spark.createDataFrame([("a|b", None)], "x string, y string"), "T")
    page = reports.idea_page({"title": "50% of x_1", "evidence_used": [{"paper_id": "p", "gap_sentence": "a & b"}]})
    assert r"50\% of x\_1" in page and r"a \& b (p)" in page
    s = reports.library_summary(spark.createDataFrame([("m", "0.5", "x"), ("m", "bad", "1")], "mode string, novelty_score string, idea_confidence string")).first()
    assert (s.n, s.novelty, s.confidence) == (2, 0.5, 1.0)


def test_command_line(spark, data, tmp_path):
    assert set(cli.STAGES) <= set(cli.parser()._subparsers._group_actions[0].choices)
    assert cli.main(["query", "clean_gaps", "--data", data, "--out", str(tmp_path)]) == 0
    assert spark.read.parquet(str(tmp_path / "query")).count() > 0
    assert cli.main(["theme-mine", "--data", data, "--out", str(tmp_path)]) == 0
    assert spark.read.parquet(str(tmp_path / "gap_frontier")).count() > 0
    assert spark.read.parquet(str(tmp_path / "graph_edges")).count() > 0 and spark.read.parquet(str(tmp_path / "method_edges")).count() > 0
    assert cli.main(["theme-mine", "--method", "kmeans", "--most-clusters", "3", "--data", data, "--out", str(tmp_path / "k")]) == 0
    assert {r.cluster_id for r in spark.read.parquet(str(tmp_path / "k" / "cluster_summary")).collect()} <= {0, 1, 2}


def test_run_all(spark, tmp_path):
    """From texts of papers to scored ideas and pages, by the offline substitutes."""
    filler = "The study of this method goes on for a while and says little. " * 6
    say = ("We plan to extend graph pooling to larger molecules in future work", "Our approach is limited to short English documents and small tables", "It remains open how speech models behave under heavy background noise", "We only tested image encoders on a few public benchmarks so far")
    texts = [(f"p{i}", f"1 Introduction\n{filler}\n2 Limitations\n{say[i % 4]} in setting {i}. {filler}\n3 Future Work\n{say[(i + 1) % 4]} for case {i}. {filler}\nReferences\nx") for i in range(12)]
    spark.createDataFrame(texts, "id string, text string").write.parquet(str(tmp_path / "paper_texts"))
    out = str(tmp_path / "out")
    assert cli.main(["run-all", "--data", str(tmp_path), "--out", out, "--method", "kmeans", "--most-clusters", "3", "--n", "2", "--mode", "within"]) == 0
    read = lambda t: spark.read.parquet(os.path.join(out, t))
    assert read("gaps").count() >= 24 and read("methods").count() == 12
    got = read("ideas").collect()
    assert len(got) == 2 and all(r.error is None and json.loads(r.record)["critique_history"][-1]["verdict"] == "accept" for r in got)
    s = read("idea_scores").collect()
    assert len(s) == 2 and all(r.gate_passed and r.evidence_overlap == 1.0 and r.composite == 5.0 for r in s)
    assert read("idea_consensus").count() == 2 and all(r.tex.startswith("\\documentclass") for r in read("idea_pages").collect())


def test_frontier_and_method_requests(spark, data):
    g = spark.read.parquet(f"{data}/gaps.parquet").withColumn("cluster_id", F.expr("cast(gap_idx % 3 as int)"))
    front = g.where("embedding is not null and exists(embedding, x -> x <> 0)").select(F.col("gap_idx").cast("bigint").alias("node"), F.lit(1.0).alias("frontier_score"))
    r = ideas.frontier_requests(g, front, 2, 3).collect()
    assert len(r) == 2 and all(len(x.evidence_a) == 4 for x in r)
    m = ideas.method_requests(g, spark.read.parquet(f"{data}/methods.parquet"), 2).collect()
    assert {x["mode"] for x in m} == {"method-gap"} and all(0 < len(x.methods) <= 5 for x in m)
    pairs = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.9)], "cluster_a int, cluster_b int, bridge_score double")
    b = ideas.bridge_requests(g, pairs, 1).collect()
    assert [x.request_id for x in b] == ["bridge-1-2"] and len(b[0].evidence_a) == len(b[0].evidence_b) == 4


def make_models():
    class Stubborn(ideas.TemplateModel):
        def complete(self, task, payload):
            if task == "idea" and payload["label_a"] == "bad":
                raise OSError("no answer")
            if task == "idea":
                return super().complete(task, payload) | {"evidence_used": [{"paper_id": "made up", "gap_sentence": "x"}]}
            if task == "revise":
                return {"title": "revised", "evidence_used": None}
            return super().complete(task, payload)

    class Odd(ideas.TemplateModel):
        def complete(self, task, payload):
            return {"novelty": "4.6", "specificity": "high", "novelty_reason": "because", "critique": "fine"}

    class Broken(ideas.TemplateModel):
        def complete(self, task, payload):
            raise OSError

    return Stubborn, Odd, Broken


def test_critique_is_bounded_and_judges_are_normalised(spark):
    stubborn, odd, broken = make_models()
    ev = [("p", "a", "b", "said", "x", 0.5)]
    kind = "request_id string, mode string, pair struct<cluster_a:int,label_a:string,cluster_b:int,label_b:string>, evidence_a array<struct<paper_id:string,gap_type:string,section_type:string,gap_sentence:string,paragraph_text:string,confidence:double>>, evidence_b array<struct<paper_id:string>>, methods array<struct<id:string>>"
    d = spark.createDataFrame([("r1", "within", (1, "good", None, None), ev, [], None), ("r2", "within", (2, "bad", None, None), ev, [], None)], kind)
    got = {r.request_id: r for r in ideas.generate(d, stubborn, rounds=2).collect()}
    assert got["r2"].record is None and "no answer" in got["r2"].error
    rec = json.loads(got["r1"].record)
    assert [h["verdict"] for h in rec["critique_history"]] == ["revise"] * 3 and rec["idea"]["title"] == "revised" and rec["idea"]["evidence_used"]
    s = ideas.judge(spark.createDataFrame([(1, got["r1"].record), (2, None)], "idea_id int, record string"), {"odd": odd, "broken": broken}).collect()
    assert len(s) == 1 and (s[0].novelty, s[0].specificity, s[0].novelty_rationale, s[0].overall_critique, s[0].composite, s[0].evidence_overlap) == (5, 0, "because", "fine", 1.25, 0.0)


def test_search_client():
    asked, waits = [], []

    def transport(method, path, params, body):
        asked.append((method, path, body))
        if len(asked) <= 2:
            return 429, None
        if path.endswith("gone"):
            return 404, None
        if path.endswith("batch"):
            return 200, [None if i.endswith("7") else {"paperId": i} for i in body["ids"]]
        return 200, {"data": [{"externalIds": {"ArXiv": "1"}, "title": "t"}, {"externalIds": None}, {"externalIds": {"ArXiv": "1"}}]}

    c = search.SearchClient(transport, sleep=waits.append)
    assert len(c.search("q")) == 3 and waits == [1.0, 2.0]
    assert c.lookup("gone") is None
    got = c.batch(str(i) for i in range(250))
    assert len(got) == 250 and got[7] is None and got[8]["paperId"] == "ARXIV:8" and sum(p.endswith("batch") for _, p, _ in asked) == 3
    with pytest.raises(search.SearchError):
        search.SearchClient(lambda *a: (429, None), tries=2, sleep=waits.append).search("q")
    with pytest.raises(search.SearchError):
        search.SearchClient(lambda *a: (500, None)).lookup("x")


def test_select_by_search(spark):
    hits = [{"externalIds": {"ArXiv": "1"}, "title": "t", "year": 2030}, {"externalIds": None}, {"externalIds": {"ArXiv": "1"}}, {"externalIds": {"ArXiv": "2"}}]
    c = search.SearchClient(lambda *a: (200, {"data": hits}))
    assert [(r.id, r.title, r.year) for r in search.select_by_search(spark, c, "q").collect()] == [("1", "t", 2030), ("2", "", None)]


def test_missing_pdf_library_is_told(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 600)
    if importlib.util.find_spec("fitz") is None:
        with pytest.raises(RuntimeError, match="PyMuPDF"):
            files.read_pdfs(spark, str(tmp_path))
    body = {"page": 0, "x0": 0.0, "x1": 50.0, "size": 10.0, "bold": False}
    spans = [{**body, "y0": 0.0, "size": 14.0, "bold": True, "text": "Limitations"}, *[{**body, "y0": 20.0 + 12 * k, "text": "a line of the body that is long enough to count"} for k in range(8)]]
    d = files.read_pdf_blocks(files.read_pdf_spans(spark, str(tmp_path), parse=lambda c, pages: spans))
    assert [(r.section_type, r.heading) for r in sections.sections(d, blocks="blocks").collect()] == [("limitations", "Limitations")]


def test_clustering_bench(spark, data):
    g = spark.read.parquet(f"{data}/gaps.parquet").where("exists(embedding, x -> x <> 0)")
    got = {r.method: r for r in themes.clustering_bench(g, k=3, methods=("kmeans", "graph", "density")).collect()}
    assert got["kmeans"].n_clusters == 3 and got["graph"].n_clusters > 1 and all(r.error is None for r in got.values())


def test_without_the_llm_folder(tmp_path):
    """Nothing outside ``lacuna/llm`` needs it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['lacuna.llm'] = None\nimport __spark_entry__ as e, bench, lacuna.cli, lacuna.tools\nq = e.queries()\nassert 'p5_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0


def test_theme_mine_keeps_the_community_method(spark, data, monkeypatch):
    """More edges than one task takes do not swap the method; it is an argument."""
    assert cli.parser().parse_args(["theme-mine"]).communities == "louvain"
    a = cli.parser().parse_args(["theme-mine", "--data", data])
    called = []

    class Told(Exception):
        pass

    def tell(name):
        def f(edges):
            called.append(name)
            raise Told

        return f

    monkeypatch.setattr(cli.graph, "MOST_EDGES", 1)
    monkeypatch.setattr(cli, "COMMUNITIES", {"louvain": tell("louvain"), "labels": tell("labels")})
    for a.communities in ("louvain", "labels"):
        with pytest.raises(Told):
            cli.theme_mine(spark, a)
    assert called == ["louvain", "labels"]


def test_gold_papers(spark):
    kind = "k string, body array<struct<section:string,text:string>>"
    long = "word " * 900
    rows = [("a", [("Introduction", long), ("Future  Work ", "f " * 150), ("Limitations", " l "), ("Limitations", None), (None, "x")]), (None, [("Open questions", long)]), ("c", [("Results", long)]), ("d", [("Limitations", "short")]), ("e", None)]
    got = [r.p for r in spark.createDataFrame(rows, kind).select(records.gold_paper(F.col("body"), F.col("k")).alias("p")).collect()]
    assert got[0].id == "a" and got[0].gold_section_titles == ["Future  Work", "Limitations"] and got[0].gold_section_text.endswith("\n\nl") and got[0].full_text.endswith("\n\nl\n\nx")
    assert got[1].id == "unknown" and got[2:] == [None] * 3
    r = spark.createDataFrame([("x", "2030-01-02 23:59:00")], "s string, t string").select(records.critic_score(F.col("s")), records.utc_date(F.col("t").cast("timestamp"))).first()
    assert tuple(r) == (3.0, "2030-01-02")


def test_download(spark, tmp_path):
    content = b"x" * 20_000

    def fetch(i):
        if i == "bad":
            raise OSError("no route")
        return (404, b"") if i == "gone" else (200, content[:5]) if i == "small" else (200, content)

    ids = spark.createDataFrame([("1",), ("cs/2",), ("gone",), ("small",), ("bad",), (None,), ("1",)], "id string")
    got = {r.id: (r.ok, r.status) for r in files.download(ids, str(tmp_path), fetch).collect()}
    assert got == {"1": (True, "downloaded"), "cs/2": (True, "downloaded"), "gone": (False, "http 404"), "small": (False, "too small"), "bad": (False, "no route")}
    assert {r.id: r.status for r in files.download(ids, str(tmp_path), fetch).collect()}["1"] == "cached"
    assert sorted(os.listdir(tmp_path)) == ["1.pdf", "cs_2.pdf"]


def test_projection(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)] + [(99, None)]
    got = {r.k: r.point for r in clustering.project(spark.createDataFrame(rows, "k int, embedding array<double>"), "k").collect()}
    assert len(got) == 9 and all(abs(abs(p[0]) - 5**0.5 * k) < 1e-4 and abs(p[1]) < 1e-6 for k, p in got.items())
