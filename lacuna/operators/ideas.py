"""Ideas from evidence: candidates of the four modes, generation, critique and judging by injected models.

A model is an object with ``complete(task, payload) -> dict``; its factory runs once a
task, so nothing but the factory is sent to the executors. Each driver is a map over a
table of requests; a request that fails gives a row with its error and loses no other.
The offline model is a deterministic substitute that fills templates.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import strip
from lacuna.operators import evidence, panels, similarity

MODES = ("bridge", "within", "method-gap", "frontier")
#: Parts of an idea that a revision may replace.
PARTS = ("title", "research_question", "method_sketch", "evaluation_plan", "expected_contribution", "assumptions_and_risks", "falsifiable_prediction", "named_baseline")


class Model(Protocol):
    """Answers a task (``idea``, ``critique``, ``revise``, ``judge``, ``label``, ``methods``) about a payload."""

    def complete(self, task: str, payload: dict[str, Any]) -> dict[str, Any]: ...


class TemplateModel:
    """Deterministic substitute: fills the parts of an idea from the evidence, accepts well-grounded ideas, judges by what is there."""

    def complete(self, task: str, payload: dict[str, Any]) -> dict[str, Any]:
        if task in ("idea", "revise"):
            fed = payload.get("evidence") or []
            about = payload.get("label_a") or "the theme"
            other = payload.get("label_b")
            topic = f"{about} and {other}" if other else about
            idea = {p: f"{p.replace('_', ' ').capitalize()} on {topic}." for p in PARTS}
            idea |= {"title": f"Closing gaps in {topic}", "falsifiable_prediction": "At least 5 percent better than the baseline.", "named_baseline": f"best published method on {about}", "confidence": 0.5}
            return idea | {"evidence_used": [{k: e.get(k) for k in ("paper_id", "gap_sentence")} for e in fed]}
        if task == "critique":
            low = payload.get("overlap", 1.0) < 0.8
            return {"verdict": "revise" if low else "accept", "score": 3.0 if low else 4.0, "issues": [{"axis": "grounding", "note": "cites what was not given"}] if low else []}
        if task == "judge":
            idea = payload.get("idea") or {}
            given = sum(bool(idea.get(p)) for p in PARTS)
            return {a: 1 + round(4 * given / len(PARTS)) for a in panels.AXES} | {"overall_critique": f"{given} parts are filled."}
        if task == "label":
            return {"label": payload.get("keywords") or ""}
        if task == "methods":
            first = (payload.get("text") or "").split(". ")[0].strip()
            return {"methods": [{"method_type": "other", "method_sentence": first, "paragraph_text": first, "confidence": 0.5}] if first else []}
        raise ValueError(f"unknown task {task}")


def _payload(gaps: DataFrame, k: int, cluster: str, key: str, name: str) -> DataFrame:
    """``cluster, name``: the diverse evidence of each cluster as a prompt gets it."""
    picked = evidence.diverse_evidence(gaps, cluster, key, k)
    rows = gaps.join(picked.select(key, "rank"), key)
    return evidence.payload(rows, cluster, "rank", k).withColumnRenamed("evidence", name)


_NO_METHODS = "array<struct<id: string, method_type: string, method_sentence: string, similarity: double>>"


def _first(d: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows; all of them for 0 and None."""
    return d.limit(n) if n else d


def bridge_requests(gaps: DataFrame, pairs: DataFrame, n: int | None = 10, k: int = 4, key: str = "gap_idx", cluster: str = "cluster_id") -> DataFrame:
    """Requests for the ``n`` best pairs of clusters, with evidence of both; labels as far as ``pairs`` has them."""
    best = _first(pairs.orderBy(F.desc("bridge_score"), "cluster_a", "cluster_b"), n)
    label = lambda s: F.col(f"label_{s}") if f"label_{s}" in pairs.columns else F.lit(None).cast("string")
    best = best.select("cluster_a", "cluster_b", label("a").alias("label_a"), label("b").alias("label_b"))
    wanted = gaps.join(best.select(F.explode(F.array("cluster_a", "cluster_b")).alias(cluster)).distinct(), cluster, "left_semi")
    ev = _payload(wanted, k, cluster, key, "ev")
    a, b = (ev.select(F.col(cluster).alias(f"cluster_{s}"), F.col("ev").alias(f"evidence_{s}")) for s in "ab")
    d = best.join(a, "cluster_a").join(b, "cluster_b")
    name = F.concat_ws("-", F.lit("bridge"), "cluster_a", "cluster_b")
    return d.select(name.alias("request_id"), F.lit("bridge").alias("mode"), F.struct("cluster_a", "label_a", "cluster_b", "label_b").alias("pair"), "evidence_a", "evidence_b", F.lit(None).cast(_NO_METHODS).alias("methods"))


def _single(d: DataFrame, mode: str, cluster: str, methods: Column | None = None, name: str | None = None) -> DataFrame:
    """Requests about one cluster each, named by ``name`` (the cluster unless given)."""
    none = F.lit(None)
    pair = F.struct(F.col(cluster).alias("cluster_a"), F.col("label").alias("label_a"), none.cast(d.schema[cluster].dataType).alias("cluster_b"), none.cast("string").alias("label_b"))
    return d.select(F.concat_ws("-", F.lit(mode), name or cluster).alias("request_id"), F.lit(mode).alias("mode"), pair.alias("pair"), F.col("ev").alias("evidence_a"), F.filter("ev", lambda _: F.lit(False)).alias("evidence_b"), (none if methods is None else methods).cast(_NO_METHODS).alias("methods"))


def _largest(gaps: DataFrame, n: int | None, cluster: str, labels: DataFrame | None) -> DataFrame:
    top = gaps.where(F.col(cluster) != -1).groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    top = _first(top.orderBy(F.desc("size"), cluster), n)
    return top.withColumn("label", F.lit(None).cast("string")) if labels is None else top.join(labels.select(F.col("cluster_id").alias(cluster), F.col("theme_label").alias("label")), cluster, "left")


def within_requests(gaps: DataFrame, n: int | None = 10, k: int = 6, labels: DataFrame | None = None, key: str = "gap_idx", cluster: str = "cluster_id") -> DataFrame:
    """Requests for the ``n`` largest clusters, each with evidence of its own."""
    top = _largest(gaps, n, cluster, labels)
    ev = _payload(gaps.join(top.select(cluster), cluster, "left_semi"), k, cluster, key, "ev")
    return _single(top.join(ev, cluster), "within", cluster)


def method_requests(gaps: DataFrame, methods: DataFrame, n: int | None = 10, k: int = 4, top: int = 5, labels: DataFrame | None = None, key: str = "gap_idx", cluster: str = "cluster_id") -> DataFrame:
    """Requests for the ``n`` largest clusters, with the methods that are neither too near nor too far."""
    best = _largest(gaps, n, cluster, labels)
    some = gaps.join(best.select(cluster), cluster, "left_semi")
    spot = evidence.sweet_spot(some, methods, cluster, top=top).join(methods.select("method_idx", "id", "method_type", "method_sentence"), "method_idx")
    listed = spot.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "method_type", "method_sentence", "similarity"))), lambda x: x.dropFields("rank")).alias("found"))
    d = best.join(_payload(some, k, cluster, key, "ev"), cluster).join(listed, cluster)
    return _single(d, "method-gap", cluster, F.col("found"))


def frontier_requests(gaps: DataFrame, frontier: DataFrame, n: int | None = 10, k: int = 4, key: str = "gap_idx", cluster: str = "cluster_id") -> DataFrame:
    """Requests for the ``n`` foremost frontier gaps: the seed first, then its ``k`` nearest gaps."""
    node = "node" if "node" in frontier.columns else key
    seeds = _first(frontier.orderBy(F.desc("frontier_score"), node), n).select(F.col(node).alias(key))
    seed = gaps.join(seeds, key, "left_semi")
    near = similarity.nearest(seed, gaps, k, key, key, not_self=True).select(F.col("a").alias("seed"), F.col("b").cast(gaps.schema[key].dataType).alias(key), F.col("rank"))
    every = near.unionByName(seed.select(F.col(key).cast("bigint").alias("seed"), key, F.lit(0).alias("rank")))
    ev = evidence.payload(every.join(gaps, key), "seed", "rank", k + 1).withColumnRenamed("evidence", "ev")
    d = ev.join(seed.select(F.col(key).cast("bigint").alias("seed"), cluster), "seed").withColumn("label", F.lit(None).cast("string"))
    return _single(d, "frontier", cluster, name="seed")


_RECORD = "request_id string, record string, error string"


def generate(requests: DataFrame, make: Callable[[], Model] = TemplateModel, rounds: int = 2) -> DataFrame:
    """``request_id, record, error``: one JSON record per request, criticised and revised at most ``rounds`` times.

    The loop ends when the critic accepts or gives 4 or more. A rejection in the last
    round stands in the record's history. Citations that were not fed are counted for the
    critic as ``overlap``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    out.append((r["request_id"], json.dumps(_one(model, r, rounds), ensure_ascii=False), None))
                except Exception as e:
                    out.append((r["request_id"], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["request_id", "record", "error"])

    flat = requests.select("request_id", "mode", F.to_json("pair", {"ignoreNullFields": "false"}).alias("pair"), *[F.to_json(c).alias(c) for c in ("evidence_a", "evidence_b", "methods")])
    return flat.mapInPandas(run, _RECORD)


def _number(x: Any, default: float) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return default


def _one(model: Model, r: dict[str, Any], rounds: int) -> dict[str, Any]:
    load = lambda c: json.loads(r[c]) if r.get(c) else []
    pair, fed = json.loads(r["pair"]), [*load("evidence_a"), *load("evidence_b")]
    ask = {"mode": r["mode"], "label_a": pair.get("label_a"), "label_b": pair.get("label_b"), "evidence": fed, "methods": load("methods")}
    idea = model.complete("idea", ask)
    known = {(str(e.get("paper_id") or ""), str(e.get("gap_sentence") or "").strip()) for e in fed}
    history = []
    for k in range(rounds + 1):
        used = [(str(e.get("paper_id") or ""), str(e.get("gap_sentence") or "").strip()) for e in idea.get("evidence_used") or []]
        overlap = sum(u in known for u in used) / len(used) if used else 0.0
        c = model.complete("critique", {"idea": idea, "overlap": overlap, "evidence": fed})
        said = str(c.get("verdict") or "").strip().lower()
        said = said if said in ("accept", "revise", "reject") else "revise"
        score = _number(c.get("score"), 3.0)
        history.append({"iteration": k, "verdict": said, "score": score, "issues": c.get("issues") or []})
        if said == "accept" or score >= 4.0 or k == rounds:
            break
        new = model.complete("revise", ask | {"idea": idea, "issues": c.get("issues") or []})
        idea = idea | {f: v for f, v in new.items() if v is not None}
    return {"mode": r["mode"], "pair": pair, "idea": idea, "evidence_a": load("evidence_a"), "evidence_b": load("evidence_b"), "candidate_methods": load("methods"), "critique_history": history}


def normal_scores(answer: Column) -> Column:
    """Struct of a judge's answer (JSON text): whole scores (0 where there is none), reasons under any of their names, the critique."""
    m = F.from_json(answer, "map<string,string>")
    get = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names], F.lit(""))
    score = lambda a: F.coalesce(F.bround(get(a).try_cast("double")).cast("int"), F.lit(0)).alias(a)
    reason = lambda a: get(f"{a}_rationale", f"{a}_reason", f"{a}_explanation").alias(f"{a}_rationale")
    return F.struct(*[score(a) for a in panels.AXES], *[reason(a) for a in panels.AXES], get("overall_critique", "critique").alias("overall_critique"))


def judge(records: DataFrame, judges: dict[str, Callable[[], Model]], key: str = "idea_id", record: str = "record") -> DataFrame:
    """``key, judge``, the scores and reasons, composite, overlap of the evidence and the gate, a row per idea and judge.

    A judge that fails on an idea gives no row for it.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {name: make() for name, make in judges.items()}
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[record]):
                for name, model in models.items():
                    try:
                        idea = {f: v for f, v in (json.loads(text).get("idea") or {}).items() if not f.startswith("_")}
                        out.append((k, name, json.dumps(model.complete("judge", {"idea": idea}))))
                    except Exception:  # noqa: S112 - one failing judge must not lose the others
                        continue
            yield pd.DataFrame(out, columns=[key, "judge", "answer"])

    asked = records.where(F.col(record).isNotNull()).select(key, record)
    got = asked.mapInPandas(run, f"`{key}` {kind}, judge string, answer string").select(key, "judge", normal_scores(F.col("answer")).alias("s")).select(key, "judge", "s.*")
    item = "struct<paper_id: string, gap_sentence: string>"
    o = F.from_json(record, f"evidence_a array<{item}>, evidence_b array<{item}>, idea struct<evidence_used: array<{item}>, falsifiable_prediction: string, named_baseline: string>")
    pair = lambda x: F.concat_ws("\u0001", F.coalesce(x["paper_id"], F.lit("")), strip(F.coalesce(x["gap_sentence"], F.lit(""))))
    none = F.array().cast(f"array<{item}>")
    fed = F.transform(F.concat(F.coalesce("o.evidence_a", none), F.coalesce("o.evidence_b", none)), pair)
    used = F.transform(F.coalesce("o.idea.evidence_used", none), pair)
    overlap = F.coalesce(F.try_divide(F.size(F.filter(used, lambda u: F.array_contains(fed, u))), F.size(used)), F.lit(0.0))
    facts = asked.select(key, o.alias("o")).select(key, F.round(overlap, 6).alias("evidence_overlap"), panels.testable(F.col("o.idea.falsifiable_prediction"), F.col("o.idea.named_baseline")).alias("gate_passed"))
    return got.join(facts, key).withColumn("composite", sum(F.col(a) for a in panels.AXES) / len(panels.AXES))


def theme_labels(keywords: DataFrame, sentences: DataFrame, make: Callable[[], Model] | None = None, cluster: str = "cluster_id", text: str = "gap_sentence", most: int = 8) -> DataFrame:
    """``cluster, theme_label, keywords``: a model's label from keywords and up to ``most`` sentences; without a model, or where it fails, the keywords."""
    if make is None:
        return keywords.select(cluster, F.col("keywords").alias("theme_label"), "keywords")
    kind = keywords.schema[cluster].dataType.simpleString()
    first = sentences.where(F.col(text).isNotNull()).select(cluster, text).withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(text))).where(F.col("_r") <= most)
    shown = first.groupBy(cluster).agg(F.array_sort(F.collect_list(text)).alias("shown"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            out = []
            for k, words, said in zip(pdf[cluster], pdf.keywords, pdf.shown):
                try:
                    label = str(model.complete("label", {"keywords": words, "sentences": [] if said is None else list(said)})["label"]).strip()
                except Exception:
                    label = words
                out.append((k, label or words, words))
            yield pd.DataFrame(out, columns=[cluster, "theme_label", "keywords"])

    return keywords.join(shown, cluster, "left").select(cluster, "keywords", "shown").mapInPandas(run, f"`{cluster}` {kind}, theme_label string, keywords string")


def extract_methods(papers: DataFrame, make: Callable[[], Model] = TemplateModel, key: str = "id", text: str = "text", most: int = 2500) -> DataFrame:
    """``id, method_type, method_sentence, paragraph_text, confidence`` that a model finds in the first ``most`` characters of a paper, where methods are claimed; a failing paper gives none."""
    cols = ["id", "method_type", "method_sentence", "paragraph_text", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            out = []
            for i, t in zip(pdf[key], pdf[text]):
                try:
                    out += [(i, *(m.get(c) for c in cols[1:])) for m in model.complete("methods", {"text": (t or "")[:most]}).get("methods") or []]
                except Exception:  # noqa: S112 - one paper must not lose the others
                    continue
            yield pd.DataFrame(out, columns=cols)

    return papers.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, "id string, method_type string, method_sentence string, paragraph_text string, confidence double")
