"""The tool endpoints: each a small plan over the tables of a corpus, its rows as records.

``Corpus`` names the tables; a missing one is empty. ``dispatch`` calls a tool by name,
``DEFINITIONS`` describes them to a client, ``serve`` answers a client over a pair of
streams. An answer is whole: one of more than ``MOST_ROWS`` rows raises with a message
instead of being cut.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import schemas
from lacuna.functions.numeric import coerce
from lacuna.operators import evidence
from lacuna.operators.rows import numbered
from lacuna.sources import files
from lacuna.sources.services import Embedder, HashEmbedder, NoSearch, PaperSearch


@dataclass
class Corpus:
    """Tables of a corpus; gaps have ``gap_idx``, ``cluster_id`` and ``embedding``.

    Ideas are numbered once, by ``idea_index`` or else by mode and title. With
    ``ideas_path`` the library is the table there, and saved ideas are appended to it.
    """

    spark: SparkSession
    gaps: DataFrame | None = None
    methods: DataFrame | None = None
    clusters: DataFrame | None = None
    pairs: DataFrame | None = None
    frontier: DataFrame | None = None
    gap_pairs: DataFrame | None = None
    ideas: DataFrame | None = None
    labels: DataFrame | None = None
    ideas_path: str | None = None
    search: PaperSearch = NoSearch()
    embedder: Embedder = HashEmbedder()

    def get(self, name: str, schema: str) -> DataFrame:
        df = getattr(self, name)
        return self.spark.createDataFrame([], schema) if df is None else df

    def library(self) -> DataFrame:
        """Ideas with their ``idea_index``, which a later save does not move."""
        if self.ideas_path and files.exists(self.spark, self.ideas_path):
            return files.read_merged(self.spark, self.ideas_path)
        if self.ideas is None:
            return self.spark.createDataFrame([], schemas.IDEAS + ", idea_index bigint")
        if "idea_index" not in self.ideas.columns:
            self.ideas = numbered(self.ideas, *[F.col(c).asc_nulls_last() for c in ("mode", "title") if c in self.ideas.columns], name="idea_index")
        return self.ideas


#: Rows of an answer; a longer one raises.
MOST_ROWS = 100_000


def _rows(df: DataFrame, most: int | None = None) -> list[dict[str, Any]]:
    most = MOST_ROWS if most is None else most
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"the answer has more than {most} rows; ask for less")
    return [r.asDict(recursive=True) for r in got]


def list_themes(c: Corpus) -> list[dict]:
    d = c.get("clusters", schemas.CLUSTERS)
    return _rows(d.select("cluster_id", F.coalesce("theme_label", F.lit("")).alias("theme_label"), "n_papers", "n_items", F.col("avg_conf").alias("avg_confidence")).orderBy("cluster_id"))


def get_theme(c: Corpus, cluster_id: int) -> dict:
    """Label, keywords, counts and papers of a theme, each with its gaps; an unknown one is an error record."""
    row = c.get("clusters", schemas.CLUSTERS).where(F.col("cluster_id") == cluster_id).first()
    if row is None:
        return {"error": f"unknown cluster {cluster_id}"}
    words = c.get("labels", "cluster_id int, keywords string").where(F.col("cluster_id") == cluster_id).select("keywords").first()
    g = c.get("gaps", schemas.GAPS + ", gap_idx int, cluster_id int").where((F.col("cluster_id") == cluster_id) & F.col("id").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("gap_idx", "gap_sentence", "gap_type")))
    field_of = lambda f: F.transform("x", lambda s: s[f])
    papers = g.groupBy(F.col("id").alias("paper_id")).agg(listed.alias("x"), F.max("confidence").alias("max_confidence"))
    papers = papers.select("paper_id", F.size("x").alias("n_gaps"), field_of("gap_sentence").alias("gap_sentences"), field_of("gap_type").alias("gap_types"), "max_confidence").orderBy("paper_id")
    return {"cluster_id": cluster_id, "theme_label": row["theme_label"] or "", "keywords": (words[0] if words else "") or "", "n_papers": row["n_papers"], "n_gaps": row["n_items"], "avg_confidence": row["avg_conf"], "papers": _rows(papers)}


def get_evidence(c: Corpus, cluster_id: int, k: int = 4) -> list[dict]:
    g = c.get("gaps", schemas.GAPS + ", gap_idx int, cluster_id int").where(F.col("cluster_id") == cluster_id)
    picked = evidence.diverse_evidence(g, "cluster_id", "gap_idx", k)
    return _rows(g.join(picked.select("gap_idx", "rank"), "gap_idx").orderBy("rank").select(F.col("id").alias("paper_id"), "gap_type", "section_type", "gap_sentence", "paragraph_text", "confidence"))


def retrieve_methods(c: Corpus, cluster_id: int, top_k: int = 5, sim_low: float = 0.3, sim_high: float = 0.7) -> list[dict]:
    if c.methods is None or c.gaps is None:
        return []
    d = evidence.sweet_spot(c.gaps.where(F.col("cluster_id") == cluster_id), c.methods, "cluster_id", "method_idx", top_k, sim_low, sim_high)
    m = c.methods.withColumn("paragraph_text", F.col("paragraph_text") if "paragraph_text" in c.methods.columns else F.lit(""))
    text = lambda f: F.coalesce(f, F.lit("")).alias(f)
    d = d.join(m.select("method_idx", F.col("id").alias("paper_id"), text("method_type"), text("method_sentence"), text("paragraph_text")), "method_idx").orderBy("rank")
    return _rows(d.select("paper_id", "method_type", "method_sentence", "paragraph_text", F.col("similarity").alias("similarity_to_gap_cluster")))


def search_prior_art(c: Corpus, query: str, limit: int = 10) -> list[dict]:
    """Papers found; none if the search fails. Abstracts are shown up to 1 200 characters."""
    try:
        hits = c.search.search(query, limit)
    except Exception:
        return []
    text = lambda p, f: p.get(f) or ""
    return [{"paperId": p.get("paperId"), "title": text(p, "title"), "year": p.get("year"), "venue": text(p, "venue"), "abstract": text(p, "abstract")[:1200], "url": text(p, "url"), "citationCount": p.get("citationCount") or 0} for p in hits]


def score_novelty(c: Corpus, title: str, research_question: str, method_sketch: str = "", top_k: int = 10) -> dict:
    """1 minus the greatest similarity to what a search finds; 1 without hits, null if the search fails."""
    try:
        hits = c.search.search(f"{title} {research_question}", top_k)
    except Exception as e:
        return {"novelty_score": None, "n_hits": None, "error": str(e)}
    if not hits:
        return {"novelty_score": 1.0, "n_hits": 0, "closest_paper": None}
    v = c.embedder.embed([f"{title} {research_question} {method_sketch}", *[f"{h.get('title') or ''} {h.get('abstract') or ''}" for h in hits]]).astype(float)
    s = v[1:] @ v[0]
    k = int(s.argmax())
    return {"novelty_score": round(float(min(1.0, max(0.0, 1 - s[k]))), 6), "max_similarity": round(float(s[k]), 6), "mean_similarity": round(float(s.mean()), 6), "n_hits": len(hits), "closest_paper": hits[k]}


def check_evidence_overlap(c: Corpus, evidence_used: list[dict], fed_evidence: list[dict]) -> dict:
    """Share of the used items that were fed, and those that were made up; both lists are the caller's own."""
    key = lambda e: (str(e.get("paper_id") or ""), str(e.get("gap_sentence") or "").strip())
    fed = {key(e) for e in fed_evidence}
    made_up = [e for e in evidence_used if key(e) not in fed]
    grounded = len(evidence_used) - len(made_up)
    return {"overlap": grounded / len(evidence_used) if evidence_used else 0.0, "n_used": len(evidence_used), "n_grounded": grounded, "hallucinated": made_up}


def filter_ideas(ideas: DataFrame, least_novelty: float = 0.0, least_confidence: float = 0.0, mode: str = "any") -> DataFrame:
    """Ideas of a mode that are new and sure enough; what is no number counts 0, a missing column does not filter."""
    for col, least in (("novelty_score", least_novelty), ("idea_confidence", least_confidence)):
        if col in ideas.columns:
            ideas = ideas.where(coerce(col) >= least)
    return ideas.where(F.col("mode") == mode) if mode != "any" and "mode" in ideas.columns else ideas


def list_ideas(c: Corpus, min_novelty: float = 0.0, min_confidence: float = 0.0, mode: str = "any") -> list[dict]:
    return _rows(filter_ideas(c.library(), min_novelty, min_confidence, mode).orderBy("idea_index"))


def get_idea(c: Corpus, idx: int) -> dict:
    """Idea by its number; out of range an error record."""
    got = c.library().where(F.col("idea_index") == idx).first()
    return got.asDict(recursive=True) if got else {"error": f"no idea {idx}; have {c.library().count()}"}


def save_idea(c: Corpus, idea: dict) -> dict:
    """Add an idea behind the others and write it to ``ideas_path``; fields that were not there before become null for the others."""
    have = c.library()
    last = have.agg(F.max("idea_index")).first()[0]
    number = 0 if last is None else last + 1
    fields = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v for k, v in idea.items() if k != "idea_index"}
    # a field keeps the type that the library gives it; new ones are text
    kinds = {f.name: f.dataType for f in have.schema.fields}
    row = c.spark.createDataFrame([(number, *(None if v is None else str(v) for v in fields.values()))], "idea_index bigint, " + ", ".join(f"`{k}` string" for k in fields))
    row = row.select("idea_index", *[F.col(k).try_cast(kinds[k]).alias(k) if k in kinds else F.col(k) for k in fields])
    if c.ideas_path:
        if not files.exists(c.spark, c.ideas_path) and c.ideas is not None:
            have.write.parquet(c.ideas_path)
        files.append_one(row, c.ideas_path)
    else:
        c.ideas = have.unionByName(row, allowMissingColumns=True)
    return {"saved": True, "total_ideas": number + 1}


def list_frontier(c: Corpus, top_n: int = 20) -> list[dict]:
    d = c.get("frontier", "gap_idx int, frontier_score double")
    return _rows(d.orderBy(F.desc("frontier_score"), d.columns[0]).limit(top_n))


def list_gap_pairs(c: Corpus, top_n: int = 20) -> list[dict]:
    d = c.get("gap_pairs", "gap_a_idx int, gap_b_idx int, bridge_score double")
    return _rows(d.orderBy(F.desc("bridge_score"), *d.columns[:2]).limit(top_n))


TOOLS: dict[str, Callable[..., Any]] = {
    f.__name__: f for f in (list_themes, get_theme, get_evidence, retrieve_methods, search_prior_art, score_novelty, check_evidence_overlap, list_ideas, get_idea, save_idea, list_frontier, list_gap_pairs)
}


_INT, _NUMBER, _STRING = {"type": "integer"}, {"type": "number"}, {"type": "string"}
_ITEMS = {"type": "array", "items": {"type": "object", "properties": {"paper_id": _STRING, "gap_sentence": _STRING}}}
#: What each tool says of itself and how its arguments are described.
_ABOUT: dict[str, tuple[str, dict[str, dict]]] = {
    "list_themes": ("All themes of the corpus with label, papers, items and mean confidence.", {}),
    "get_theme": ("One theme: label, keywords, counts and its papers with their gaps.", {"cluster_id": _INT}),
    "get_evidence": ("A diverse pick of gap statements of a theme.", {"cluster_id": _INT, "k": _INT | {"minimum": 1, "maximum": 20}}),
    "retrieve_methods": ("Methods that are neither too near to a theme nor too far from it.", {"cluster_id": _INT, "top_k": _INT, "sim_low": _NUMBER, "sim_high": _NUMBER}),
    "search_prior_art": ("Papers that a search service finds for a query.", {"query": _STRING, "limit": _INT | {"minimum": 1, "maximum": 25}}),
    "score_novelty": ("How far an idea is from the nearest paper that a search finds.", {"title": _STRING, "research_question": _STRING, "method_sketch": _STRING, "top_k": _INT}),
    "check_evidence_overlap": ("Share of cited evidence that was really given.", {"evidence_used": _ITEMS, "fed_evidence": _ITEMS}),
    "list_ideas": ("Ideas of the library, by novelty, confidence and mode.", {"min_novelty": _NUMBER, "min_confidence": _NUMBER, "mode": _STRING | {"enum": ["bridge", "within", "method-gap", "any"]}}),
    "get_idea": ("One idea of the library by its number.", {"idx": _INT}),
    "save_idea": ("Add an idea to the library.", {"idea": {"type": "object"}}),
    "list_frontier": ("Gaps on the borders of communities, by frontier score.", {"top_n": _INT | {"minimum": 1, "maximum": 100}}),
    "list_gap_pairs": ("Pairs of gaps that bridge communities, by bridge score.", {"top_n": _INT | {"minimum": 1, "maximum": 100}}),
}


def _definition(name: str) -> dict[str, Any]:
    """Name, description and input schema; defaults and required arguments are those of the function."""
    about, described = _ABOUT[name]
    own = list(inspect.signature(TOOLS[name]).parameters.values())[1:]
    given = {p.name: described[p.name] | ({} if p.default is p.empty else {"default": p.default}) for p in own}
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": given, "required": [p.name for p in own if p.default is p.empty]}}


DEFINITIONS = [_definition(n) for n in TOOLS]


def dispatch(c: Corpus, name: str, arguments: dict[str, Any] | None = None) -> Any:
    """Run a tool by name; an unknown name raises."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    return TOOLS[name](c, **(arguments or {}))


def call(c: Corpus, name: str, **arguments: Any) -> Any:
    """Run a tool by name; an unknown name is an error record."""
    return dispatch(c, name, arguments) if name in TOOLS else {"error": f"unknown tool {name}"}


def answer(c: Corpus, request: dict[str, Any]) -> dict[str, Any] | None:
    """Answer one JSON-RPC request of a tool client; notifications get none."""
    if "id" not in request:
        return None
    out: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lacuna", "version": "1"}}}
    if method == "tools/list":
        return out | {"result": {"tools": DEFINITIONS}}
    if method == "tools/call":
        try:
            got, failed = dispatch(c, params.get("name", ""), params.get("arguments")), False
        except Exception as e:
            got, failed = {"error": str(e)}, True
        return out | {"result": {"content": [{"type": "text", "text": json.dumps(got, default=str, ensure_ascii=False)}], "isError": failed}}
    return out | {"result": {}} if method == "ping" else out | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(c: Corpus, requests: TextIO, answers: TextIO) -> None:
    """Answer requests, one JSON object a line, until the stream ends."""
    for line in requests:
        if line.strip():
            try:
                said = answer(c, json.loads(line))
            except ValueError:
                said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            if said is not None:
                answers.write(json.dumps(said, ensure_ascii=False) + "\n")
                answers.flush()
