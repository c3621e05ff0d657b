import json

import pyarrow as pa

from lacuna.operators.nested import flatten_lists, idea_children, idea_tables, read_ideas


def children(spark, *records):
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(records)], "line_no bigint, record string, idea_id string")
    return {tuple(r) for r in idea_children(df).collect()}


def test_flatten_keeps_numbers_and_parents():
    k, n, v = flatten_lists(pa.array([7, 8, 9]), pa.array([[["a", None], []], None, [["b"], ["c"]]], pa.list_(pa.list_(pa.string()))))
    assert (k.to_pylist(), n.to_pylist(), v.to_pylist()) == ([7, 7, 9, 9], [0, 1, 0, 1], ["a", None, "b", "c"])


def test_shapes(spark):
    e = [{"paper_id": " p1 "}, {"gap_sentence": "none"}, {"paperId": "p2"}, [{"paper": {"id": "p3"}}, {"paper_id": None}], {"paper_id": "p4"}]
    want = {(1, "pair", 0, "3"), (1, "pair", 1, "4"), (1, "idea", 0, "T"), (1, "evidence", 0, "p1"), (1, "evidence", 2, "p2"), (1, "evidence", 3, "p3"), (1, "evidence", 5, "p4")}
    idea = {"title": " T ", "evidence_used": e}
    base = {"idea_id": 1, "pair": {"cluster_a": 3, "cluster_b": "4"}, "idea": idea}
    for r in (
        base,
        base | {"pair": [3, 4]},
        base | {"pair": {"a": {"cluster_id": 3}, "b": {"cluster_id": 4}}},
        base | {"idea": json.dumps(idea)},
        base | {"idea": {"title": "T", "evidence_used": json.dumps(e)}},
        base | {"idea": {"title": "T"}, "evidence_used": e},
        base | {"critique_history": [{"draft": {"evidence_used": [{"paper_id": "other"}]}}]},
    ):
        assert children(spark, json.dumps(r)) == want
        assert children(spark, f"```json\n{json.dumps(r, indent=1)}\n```") == want


def test_absent_and_bad(spark):
    ok = json.dumps({"idea_id": 5, "pair": {"cluster_a": 1, "cluster_b": None}, "idea": {"title": "", "evidence_used": {"paper_id": "x"}}})
    assert children(spark, ok, ok, None, "", "  ", ok[:-5], "[1]", '"s"', json.dumps({"idea": {"title": "no id"}}), json.dumps({"idea_id": None})) == {(5, "pair", 0, "1"), (5, "evidence", 0, "x")}
    assert children(spark, json.dumps({"idea_id": 6, "pair": None, "idea": None})) == set()
    long = json.dumps({"idea_id": 7, "idea": {"title": "t", "evidence_used": [{"paper_id": f"p{i}"} for i in range(3000)]}})
    assert len(children(spark, long)) == 3001


def test_empty_table_and_tables(spark):
    df = spark.createDataFrame([], "line_no bigint, record string")
    assert idea_children(df).count() == 0
    assert read_ideas(df).count() == 0
    t = idea_tables(spark.createDataFrame([(json.dumps({"idea_id": 1, "mode": "m", "pair": [9], "idea": {"title": "a", "evidence_used": [{"paper_id": "p"}]}}),)], "record string"))
    assert t["ideas"].collect()[0].asDict() == {"idea_id": 1, "title": "a", "mode": "m", "n_items": 1}
    assert [tuple(r) for r in t["pair_members"].collect()] == [(1, 0, "9")]
    assert [tuple(r) for r in t["evidence"].collect()] == [(1, 0, "p")]


def test_evidence_keyed_by_item_names(spark):
    rec = [
        '{"idea_id": 1, "idea": {"title": "t", "evidence_used": {"e1": {"paper_id": "a"}, "e2": {"paperId": "b"}, "e10": {"gap_sentence": "none"}, "e3": [{"paper": {"id": "c"}}]}}}',
        '{"idea_id": 2, "idea": {"title": "t", "evidence_used": {"paper_id": "a", "span": {"start": 1}}}}',
        '{"idea_id": 3, "idea": {"title": "t", "evidence_used": {"gap_sentence": "x"}}, "evidence_used": [{"paper_id": "z"}]}',
        '{"idea_id": 4, "idea": {"title": "t", "evidence_used": "{\\"e1\\": {\\"paper_id\\": \\"q\\"}}"}}',
        '{"idea_id": 5, "idea": {"title": "t", "evidence_used": [[[{"paper_id": "x"}], null], [{"paper_id": "y"}]]}}',
        '{"idea_id": 6, "idea": {"title": "t", "evidence_used": {}}}',
    ]
    df = spark.createDataFrame([(r,) for r in rec], "record string")
    got = {tuple(r) for r in idea_children(df).where("child = 'evidence'").collect()}
    assert got == {(1, "evidence", 0, "a"), (1, "evidence", 1, "b"), (1, "evidence", 3, "c"), (2, "evidence", 0, "a"), (4, "evidence", 0, "q"), (5, "evidence", 0, "x"), (5, "evidence", 2, "y")}
    n = {r.idea_id: r.n_items for r in idea_tables(df)["ideas"].collect()}
    assert n == {1: 4, 2: 1, 3: 1, 4: 1, 5: 3, 6: 0}
