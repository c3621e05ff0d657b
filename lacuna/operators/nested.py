"""Deeply nested JSON records to flat tables with parent-child links.

Polymorphic JSON is opened level by level with ``from_json``; a field read as STRING
keeps the raw text of whatever stands there, so an object, a list, a JSON string of an
object and null all arrive in one column. Child arrays are then emitted from Arrow
buffers: list offsets and parent-index kernels give the children of a whole batch at
once, and parent keys follow by a vectorised take. No row is parsed in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.records import is_json

#: Names under which the records give the id of an evidence item's paper.
PAPER_KEYS = ("paper_id", "paperId")
#: Names of an evidence item's own fields; an object with one of them is an item.
ITEM_KEYS = (*PAPER_KEYS, "paper", "gap_sentence", "span")
#: Levels of lists or keyed objects around the evidence items that are opened.
LEVELS = 4


def flatten_lists(keys: pa.Array, lists: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(key, child number, child) of every child of ``lists``, by offsets and take.

    Levels of lists within lists are flattened until a non-list child is reached; the
    child number counts the leaves of one parent row from 0 in order of appearance. A
    null or empty list has no children; a null child counts.
    """
    parent = np.arange(len(lists), dtype=np.int64)
    values: pa.Array = lists
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        step = pc.list_parent_indices(values).to_numpy(zero_copy_only=False)
        parent = parent[step]
        values = pc.list_flatten(values)
    counts = np.bincount(parent, minlength=len(lists)) if len(parent) else np.zeros(len(lists), dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(lists) else np.zeros(0, dtype=np.int64)
    number = np.arange(len(parent), dtype=np.int64) - first[parent]
    return keys.take(pa.array(parent)), pa.array(number.astype(np.int32)), values


def emit_children(df: DataFrame, key: str, lists: dict[str, str], key_type: str = "bigint") -> DataFrame:
    """Rows ``(key, child, child_no, ref)`` for every list column named in ``lists``.

    ``lists`` maps a child name to a column of (nested) lists of strings. Null keys are
    kept, children that are null or blank give no row but keep their number.
    """
    names = list(lists.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = b.column(0), []
            for i, (child, _) in enumerate(names):
                k, n, v = flatten_lists(keys, b.column(i + 1))
                v = pc.utf8_trim_whitespace(v.cast(pa.string()))
                t = pa.RecordBatch.from_arrays([k, pa.array([child]).take(pa.array(np.zeros(len(k), dtype=np.int32))), n, v], names=[key, "child", "child_no", "ref"])
                keep = pc.and_kleene(pc.is_valid(v), pc.not_equal(v, ""))
                out.append(t.filter(keep))
            yield from out

    src = df.select(key, *[F.col(c) for _, c in names])
    return src.mapInArrow(run, f"{key} {key_type}, child string, child_no int, ref string")


def _parts(json_text: Column) -> Column:
    """What stands in a JSON value: a list's elements, the values of an object keyed by item names, else the value alone.

    An object is keyed by item names if it has no field of an item and all of its values
    are objects or lists. Null is one missing item.
    """
    t = F.ltrim(json_text)
    fields = F.from_json(json_text, "map<string,string>")
    opens = lambda v: F.coalesce(F.ltrim(v).substr(1, 1).isin("{", "["), F.lit(False))
    keyed = F.forall(F.map_values(fields), opens) & ~F.exists(F.map_keys(fields), lambda k: k.isin(*ITEM_KEYS))
    return (
        F.when(t.startswith("["), F.from_json(json_text, "array<string>"))
        .when(t.startswith("{"), F.when(keyed, F.map_values(fields)).otherwise(F.array(json_text)))
        .otherwise(F.array(json_text))
    )


def _scalar(c: Column, field: str) -> Column:
    """The text itself, or ``field`` of it where it is an object."""
    return F.when(F.ltrim(c).startswith("{"), F.from_json(c, f"`{field}` string")[field]).otherwise(c)


def read_ideas(df: DataFrame, record: str = "record") -> DataFrame:
    """Open raw idea records into ``idea_id, title, mode, pair_refs, items``.

    A record is readable if the whole text, without an enclosing code fence, is valid
    JSON and has a whole-number ``idea_id``; null, empty and cut-off texts give no row.
    ``pair_refs`` has the ids of the first and the second cluster, ``items`` the paper id
    of every evidence item (null where it has none) in nested lists: items may stand in
    lists of lists or in objects keyed by item names, ``LEVELS`` deep.
    Columns of ``df`` other than ``record`` are ignored, so clashing names do no harm.
    """
    raw = F.regexp_replace(F.col(record), r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "")
    top = "idea_id string, mode string, pair string, idea string, evidence_used string"
    d = df.select(raw.alias("r")).where(is_json(F.col("r")) & F.ltrim("r").startswith("{"))
    d = d.select(F.from_json("r", top).alias("o"))
    d = d.select(
        F.expr("try_cast(try_cast(trim(o.idea_id) as double) as bigint)").alias("idea_id"),
        F.col("o.mode").alias("mode"),
        F.col("o.pair").alias("p"),
        F.when(F.ltrim("o.idea").startswith("{"), F.from_json("o.idea", "title string, evidence_used string")).alias("i"),
        F.col("o.evidence_used").alias("top_evidence"),
    ).where("idea_id is not null")
    pair = F.from_json("p", "cluster_a string, cluster_b string, a string, b string")
    is_list = F.ltrim("p").startswith("[")
    evidence = F.coalesce(F.nullif(F.col("i.evidence_used"), F.lit("null")), F.col("top_evidence"))

    def paper(x: Column) -> Column:
        o = F.from_json(x, ", ".join(f"`{k}` string" for k in PAPER_KEYS) + ", paper string")
        inner = F.when(F.ltrim(o["paper"]).startswith("{"), F.from_json(o["paper"], "id string, paper_id string"))
        return F.when(F.ltrim(x).startswith("{"), F.coalesce(*[o[k] for k in PAPER_KEYS], inner["id"], inner["paper_id"]))

    def opened(x: Column, levels: int) -> Column:
        """``levels`` lists around the paper ids; they stay nested, Arrow offsets flatten them."""
        return F.transform(_parts(x), lambda y: opened(y, levels - 1) if levels > 1 else paper(y))

    pair_list = F.from_json("p", "array<string>")
    return d.select(
        "idea_id",
        "mode",
        F.col("i.title").alias("title"),
        F.when(
            is_list,
            F.array(*[_scalar(F.get(pair_list, F.lit(k)), "cluster_id") for k in (0, 1)]),
        )
        .when(
            F.ltrim("p").startswith("{"),
            F.array(
                F.coalesce(_scalar(pair["cluster_a"], "cluster_id"), _scalar(pair["a"], "cluster_id")),
                F.coalesce(_scalar(pair["cluster_b"], "cluster_id"), _scalar(pair["b"], "cluster_id")),
            ),
        )
        .alias("pair_refs"),
        F.array(F.col("i.title")).alias("titles"),
        F.when(evidence.isNotNull(), opened(evidence, LEVELS)).alias("items"),
    )


#: Fields of an idea, read as text.
IDEA_FIELDS = ("title", "research_question", "method_sketch", "evaluation_plan", "expected_contribution", "assumptions_and_risks", "falsifiable_prediction", "named_baseline")


def wide_ideas(df: DataFrame, record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """One wide row per readable record: ids, pair, the idea's fields, novelty, and counts of its lists.

    Fields that are missing or null are null; ``confidence``, ``novelty_score`` and the
    years are numbers or null however they are written. ``keep`` names columns of ``df``
    that go along. ``candidate_methods`` and ``critique_history`` are the raw JSON lists.
    """
    raw = F.regexp_replace(F.col(record), r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "")
    top = "idea_id string, mode string, pair string, idea string, novelty string, candidate_methods string, critique_history string"
    d = df.select(*keep, raw.alias("_r")).where(is_json(F.col("_r")) & F.ltrim("_r").startswith("{")).select(*keep, F.from_json("_r", top).alias("_o"))
    fields = ", ".join(f"{f} string" for f in IDEA_FIELDS)
    d = d.select(
        *keep,
        F.expr("try_cast(try_cast(trim(_o.idea_id) as double) as bigint)").alias("idea_id"),
        F.col("_o.mode").alias("mode"),
        F.when(F.ltrim("_o.idea").startswith("{"), F.from_json("_o.idea", f"{fields}, confidence string")).alias("_i"),
        F.from_json("_o.pair", "label_a string, label_b string, a struct<label: string>, b struct<label: string>").alias("_p"),
        F.from_json("_o.novelty", "novelty_score string, max_similarity string, n_hits string, closest_paper struct<paperId: string, title: string, year: string>").alias("_n"),
        *[F.col(f"_o.{c}").alias(c) for c in ("candidate_methods", "critique_history")],
    ).where("idea_id is not null")
    number = lambda c, kind: F.col(c).try_cast(kind)
    return d.select(
        *keep,
        "idea_id",
        "mode",
        F.coalesce("_p.label_a", "_p.a.label").alias("label_a"),
        F.coalesce("_p.label_b", "_p.b.label").alias("label_b"),
        *[F.trim(F.col(f"_i.{f}")).alias(f) for f in IDEA_FIELDS],
        number("_i.confidence", "double").alias("idea_confidence"),
        number("_n.novelty_score", "double").alias("novelty_score"),
        number("_n.max_similarity", "double").alias("max_similarity"),
        number("_n.n_hits", "int").alias("n_hits"),
        F.col("_n.closest_paper.paperId").alias("closest_paper_id"),
        F.col("_n.closest_paper.title").alias("closest_title"),
        number("_n.closest_paper.year", "int").alias("closest_year"),
        F.coalesce(F.json_array_length("candidate_methods"), F.lit(0)).alias("n_methods"),
        F.coalesce(F.json_array_length("critique_history"), F.lit(0)).alias("n_critiques"),
        "candidate_methods",
        "critique_history",
    )


def n_leaves(c: str, levels: int) -> Column:
    """Items in ``levels`` nested lists; 0 for null."""

    def total(x: Column, k: int) -> Column:
        return F.aggregate(x, F.lit(0), lambda n, y: n + (total(y, k - 1) if k > 2 else F.size(y)))

    return F.coalesce(total(F.col(c), levels) if levels > 1 else F.size(c), F.lit(0))


def idea_children(df: DataFrame, record: str = "record") -> DataFrame:
    """One distinct row per child of each idea: ``idea_id, child, child_no, ref``."""
    return emit_children(read_ideas(df, record), "idea_id", {"pair": "pair_refs", "idea": "titles", "evidence": "items"}).distinct()


def idea_tables(df: DataFrame, record: str = "record") -> dict[str, DataFrame]:
    """Flat tables linked by ``idea_id``: ``ideas``, ``pair_members``, ``evidence``.

    ``ideas`` has one row per idea: of repeated records the greatest title, mode and
    item count. Member and evidence tables keep the child number as ``ordinal``.
    """
    opened = read_ideas(df, record)
    children = emit_children(opened, "idea_id", {"pair": "pair_refs", "evidence": "items"}).distinct()
    part = lambda name, ref: children.where(F.col("child") == name).select("idea_id", F.col("child_no").alias("ordinal"), F.col("ref").alias(ref))
    ideas = opened.groupBy("idea_id").agg(
        F.max(F.trim("title")).alias("title"), F.max("mode").alias("mode"), F.max(n_leaves("items", LEVELS)).alias("n_items")
    )
    return {"ideas": ideas, "pair_members": part("pair", "cluster_id"), "evidence": part("evidence", "paper_id")}
