"""Column functions on JSON, arrays, maps and dates in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.text import strip


def is_json(c: Column) -> Column:
    """Whether the whole text is one JSON value; null is none. (The parser alone would accept what follows a value.)"""
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return v.isNotNull() & F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()


def tolerant_json(c: Column) -> Column:
    """The first readable JSON object of a text as JSON text, else null.

    Tried in turn: the whole text, the inside of a code fence, the span from the first
    opening to the last closing brace, and the span to ever earlier closing braces.
    """
    fence = F.regexp_extract(c, r"```(?:json|JSON)?\s*([\s\S]*?)```", 1)
    span = F.regexp_extract(c, r"\{[\s\S]*\}", 0)
    ends = F.filter(F.sequence(F.length(span), F.lit(2), F.lit(-1)), lambda i: F.substring(span, i, F.lit(1)) == "}")
    shorter = F.get(F.filter(F.transform(ends, lambda i: F.substring(span, F.lit(1), i)), is_json), F.lit(0))
    ok = lambda x: is_json(x) & F.ltrim(x).startswith("{")
    return F.when(ok(c), c).when(ok(fence), fence).when(ok(span), span).when(F.length(span) > 1, shorter)


def json_list(c: Column, schema: str) -> Column:
    """A JSON list of structs; what is none as an empty list."""
    return F.coalesce(F.from_json(c, f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def first_given(*cs: Column) -> Column:
    """The first that is neither null nor empty; else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def year_token(c: Column) -> Column:
    """First run of exactly four digits between blanks, as a year."""
    return F.regexp_extract(c, r"(?:^|\s)(\d{4})(?:\s|$)", 1).try_cast("int")


def count_shares(values: Column) -> Column:
    """Map from each value of an array to its share; empty for an empty or null array."""
    v = F.coalesce(values, F.array().cast("array<string>"))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(v)), lambda k: F.struct(k, (F.size(F.filter(v, lambda x: x == k)) / F.size(v)).alias("share"))))


def from_positions(inverted: Column) -> Column:
    """Text from a map of words to the places where they stand."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def result_lines(c: Column) -> Column:
    """``seed, metric, value`` of every line ``RESULT: name=value`` or ``SEED: n METRIC: name=value``."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    pattern = rf"(?m)^\s*(?:RESULT:|SEED:\s*\d+\s+METRIC:)\s*[\w.\-/]+\s*=\s*{number}\s*$"
    got = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))

    def part(x: Column) -> Column:
        return F.struct(
            F.regexp_extract(x, r"SEED:\s*(\d+)", 1).try_cast("int").alias("seed"),
            F.regexp_extract(x, r"(?:RESULT:|METRIC:)\s*([\w.\-/]+)\s*=", 1).alias("metric"),
            F.regexp_extract(x, rf"=\s*({number})\s*$", 1).try_cast("double").alias("value"),
        )

    return F.transform(got, part)


def merged_map(base: Column, over: Column) -> Column:
    """Entries of both maps; where both have a key, that of ``over``."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def public_fields(m: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(m, lambda k, _: ~k.startswith("_"))


def revised(new: Column, old: Column, fields: list[str]) -> Column:
    """Struct of ``fields`` from ``new``, from ``old`` where the new one lacks them."""
    return F.struct(*[F.coalesce(new[f], old[f]).alias(f) for f in fields])


def verdict(c: Column) -> Column:
    """``accept``, ``revise`` or ``reject``; anything else asks for a revision."""
    v = F.lower(F.trim(c))
    return F.when(v.isin("accept", "revise", "reject"), v).otherwise(F.lit("revise"))


def known_citations(related: Column, known: Column) -> Column:
    """Related work without papers that are not known; unchanged if nothing is known."""
    return F.when(F.size(known) > 0, F.filter(related, lambda x: F.array_contains(known, x["paper_id"]))).otherwise(related)


#: Fixed value: titles of sections that hold the statements looked for.
GOLD_TITLE = r"\b(future\s+work|future\s+direction|limitation|open\s+problem|open\s+question)s?\b"


def gold_paper(body: Column, key: Column, least_gold: int = 200, least_full: int = 4000) -> Column:
    """Struct ``id, full_text, gold_section_text, gold_section_titles`` of a paper's ``array<struct<section, text>>``; null if it has no gold sections or is too short.

    Texts are stripped, blank ones do not count; titles are distinct in their order. A
    paper without a name is ``unknown``.
    """
    items = F.transform(F.coalesce(body, F.array().cast("array<struct<section:string,text:string>>")), lambda x: F.struct(strip(F.coalesce(x["section"], F.lit(""))).alias("section"), strip(F.coalesce(x["text"], F.lit(""))).alias("text")))
    kept = F.filter(items, lambda x: x["text"] != "")
    gold = F.filter(kept, lambda x: x["section"].rlike("(?iU)" + GOLD_TITLE))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), "\n\n")
    out = F.struct(F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown")).alias("id"), joined(kept).alias("full_text"), joined(gold).alias("gold_section_text"), F.array_distinct(F.transform(gold, lambda x: x["section"])).alias("gold_section_titles"))
    return F.when((F.size(gold) > 0) & (F.length(joined(gold)) >= least_gold) & (F.length(joined(kept)) >= least_full), out)


def critic_score(c: Column) -> Column:
    """A critic's score; 3 where it gives none."""
    return F.coalesce(c.try_cast("double"), F.lit(3.0))


def utc_date(ts: Column) -> Column:
    """Date of a time as ``YYYY-MM-DD`` (sessions here run in UTC)."""
    return F.date_format(ts, "yyyy-MM-dd")
