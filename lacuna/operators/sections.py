"""Sections of papers: headings, windows, tails, styled blocks, and lines out of spans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import last_words, strip, words

#: Fixed value: a heading stands on lines of its own, bare or behind a decimal or Roman number; the group is its title.
HEADING = r"^\s*(?:\d+(?:\.\d+)*\s+|[IVXLC]+\.\s+)?([A-Z][A-Za-z0-9 &\-/,:]{2,80})\s*$"
#: Fixed value: the line behind which nothing counts.
REFERENCES = r"^\s*(references|bibliography)\s*$"
#: Words of a heading that tell the kind of its section; the first kind that fits counts.
KINDS = (
    ("limitations", r"\b(limitations?|threats to validity|caveats?|shortcomings?|weaknesses?|drawbacks?)\b"),
    ("future_work", r"\b(future work|future directions?|future research|outlook|next steps?|further work|further research|open (?:problems?|questions?|issues?)|extensions?|what['']?s next)\b"),
    ("discussion", r"\b(discussion|conclusion(s)?)\b"),
)
#: Fixed value: where the window starts if there are no headings.
KEYWORDS = r"\b(future work|future directions?|future research|limitations?|threats to validity|further work|open (?:problems?|questions?|issues?)|conclusion(?:s)?\s*(?:and|&)\s*(?:future|open))\b"
#: How the patterns are read: Unicode classes, lines end at a line feed only.
_LINES, _ANY_CASE = "(?mdU)", "(?iU)"
#: Order in which kinds of sections are wanted.
PRIORITY = ("limitations", "future_work", "discussion", "fallback", "tail")
_OPEN, _CLOSE = "\u0001", "\u0002"


def before_references(text: Column) -> Column:
    """The text up to the first line that says References or Bibliography."""
    return F.get(F.split(text, f"(?i){_LINES}{REFERENCES}", 2), F.lit(0))


def kind_of(heading: Column) -> Column:
    """Kind of a section by its heading; null if it is none of interest."""
    c = None
    for kind, pattern in KINDS:
        fits = heading.rlike(_ANY_CASE + pattern)
        c = F.when(fits, F.lit(kind)) if c is None else c.when(fits, F.lit(kind))
    return c


def priority(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), kind), F.lit(0)), F.lit(99))


def is_contents(body: Column) -> Column:
    """More than 45 percent blanks, dots and dashes: a table of contents."""
    rest = F.length(F.regexp_replace(body, r"[\s.…·\-_]", ""))
    return F.coalesce(1 - F.try_divide(rest, F.length(body)), F.lit(0.0)) > 0.45


def all_sections(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, ord, heading, body`` of every heading, its number left out; a body ends where the next heading stands."""
    marked = F.regexp_replace(before_references(F.col(text)), _LINES + HEADING, f"{_OPEN}$1{_CLOSE}")
    parts = df.select(key, F.posexplode(F.split(marked, _OPEN)).alias("ord", "part")).where("ord > 0")
    cut = F.split("part", _CLOSE, 2)
    return parts.select(key, "ord", strip(F.get(cut, F.lit(0))).alias("heading"), strip(F.get(cut, F.lit(1))).alias("body"))


def structured_sections(df: DataFrame, key: str = "id", text: str = "text", least: int = 200) -> DataFrame:
    """``key, ord, section_type, heading, section_text`` of the kinds of interest, long enough and no table of contents; of equal (type, first 100 characters) the first."""
    d = all_sections(df, key, text).withColumn("section_type", kind_of(F.col("heading")))
    d = d.where(F.col("section_type").isNotNull() & (F.length("body") >= least) & ~is_contents(F.col("body")))
    w = Window.partitionBy(key, "section_type", F.substring("body", 1, 100)).orderBy("ord")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "ord", "section_type", "heading", F.col("body").alias("section_text"))


def styled_sections(df: DataFrame, key: str = "id", blocks: str = "blocks", least: int = 200) -> DataFrame:
    """As ``structured_sections``, from blocks ``role, text``: a heading block and the body blocks that follow it; blocks from a References heading on do not count."""
    b = df.select(key, F.posexplode(blocks).alias("at", "b")).select(key, "at", "b.role", "b.text")
    stop = F.min(F.when((F.col("role") == "heading") & F.col("text").rlike(f"(?i){_LINES}{REFERENCES}"), F.col("at"))).over(Window.partitionBy(key))
    b = b.withColumn("stop", stop).where("stop is null or at < stop")
    head = (F.col("role") == "heading").cast("int")
    b = b.withColumn("ord", F.sum(head).over(Window.partitionBy(key).orderBy("at"))).where("ord > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "body", F.struct("at", "text")))), lambda x: x["text"]), "\n")
    d = b.groupBy(key, "ord").agg(F.max(F.when(F.col("role") == "heading", F.col("text"))).alias("heading"), text.alias("body"))
    d = d.withColumn("section_type", kind_of(F.col("heading"))).where(F.col("section_type").isNotNull() & (F.length("body") >= least))
    w = Window.partitionBy(key, "section_type", F.substring("body", 1, 100)).orderBy("ord")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "ord", "section_type", "heading", F.col("body").alias("section_text"))


def window_text(text: Column, n: int = 900) -> Column:
    """``n`` words from the first keyword on; null without one."""
    at = F.regexp_instr(text, F.lit(_ANY_CASE + KEYWORDS))
    from_at = F.substring(text, at, F.length(text))
    return F.when(at > 0, F.array_join(F.slice(words(from_at), 1, n), " "))


def tail_text(text: Column, n: int = 900, least: int = 300) -> Column:
    """The last ``n`` words of a text of ``least`` words or more, else null."""
    return F.when(F.size(words(text)) >= least, last_words(text, n))


def sections(df: DataFrame, key: str = "id", text: str = "text", blocks: str | None = None, most: int = 2) -> DataFrame:
    """The cascade: styled blocks, else headings, else a keyword window, else the tail; at most ``most`` per paper by priority.

    A null or empty text gives no rows. ``key, section_type, heading, section_text``.
    """
    found = structured_sections(df, key, text)
    if blocks is not None:
        styled = styled_sections(df, key, blocks)
        found = styled.unionByName(found.join(styled.select(key).distinct(), key, "left_anti"))
    rest = df.select(key, before_references(F.col(text)).alias("t")).join(found.select(key).distinct(), key, "left_anti")
    win = window_text(F.col("t"))
    win = F.when(F.length(win) >= 200, win)
    rest = rest.select(key, F.lit(0).alias("ord"), F.when(win.isNotNull(), "fallback").otherwise("tail").alias("section_type"), F.when(win.isNotNull(), "fallback_window").otherwise("tail_window").alias("heading"), F.coalesce(win, tail_text(F.col("t"))).alias("section_text")).where("section_text is not null")
    d = found.unionByName(rest)
    w = Window.partitionBy(key).orderBy(priority(F.col("section_type")), "ord")
    return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select(key, "section_type", "heading", "section_text")


def paper_text(df: DataFrame, key: str, order: str, most: int = 9000, kind: str = "section_type", text: str = "section_text") -> DataFrame:
    """``key, text, dominant``: sections of a paper in the order of priority, joined, at most ``most`` characters, and the kind of the first."""
    x = F.array_sort(F.collect_list(F.struct(priority(F.col(kind)).alias("p"), F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"), F.col(kind).alias("k"))))
    d = df.where(F.col(key).isNotNull()).groupBy(key).agg(x.alias("x"))
    return d.select(key, F.substring(F.array_join(F.transform("x", lambda s: s["t"]), "\n\n"), 1, most).alias("text"), F.col("x")[0]["k"].alias("dominant"))


def body_size(spans: DataFrame, key: str = "id") -> DataFrame:
    """``key, body_size``: font size, to half points, that most characters have; of equals the one seen first (by ``ord``)."""
    d = spans.groupBy(key, (F.bround(F.col("size") * 2) / 2).alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min("ord").alias("o"))
    return d.groupBy(key).agg(F.max_by("s", F.struct("n", -F.col("o"))).alias("body_size"))


def merge_lines(spans: DataFrame, key: str = "id") -> DataFrame:
    """``key, line, text, size, bold, page, role``: spans of one line put together, headings told by size and weight.

    ``spans`` has ``ord, page, x0, x1, y0, size, bold, text``. A span joins the open
    line if it is on the same page, within 2 points of the line's first span and between
    5 points before and 80 behind the line's end. The state of the open line decides, so
    this runs per document in a grouped task.
    """
    joined = spans.join(body_size(spans, key), key)
    kind = spans.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        y = end = page = None
        for r in pdf.sort_values("ord").itertuples():
            t = (r.text or "").strip()
            if not t:
                continue
            if out and r.page == page and abs(r.y0 - y) <= 2 and -5 <= r.x0 - end <= 80:
                out[-1][0].append(t)
                out[-1][1] = max(out[-1][1], r.size)
                out[-1][2] = out[-1][2] and bool(r.bold)
            else:
                out.append([[t], r.size, bool(r.bold), r.page])
                y, page = r.y0, r.page
            end = r.x1
        body = pdf.body_size.iloc[0]
        rows = []
        for i, (parts, size, bold, pg) in enumerate(out):
            text = " ".join(parts)
            letters = [c for c in text if c.isalpha()]
            caps = sum(c.isupper() for c in letters) / len(letters) if letters else 0.0
            head = len(text.split()) <= 14 and (size >= 1.12 * body or (bold and caps >= 0.7) or (bold and size >= body - 0.5 and size > 0))
            rows.append((pdf[key].iloc[0], i, text, float(size), bold, int(pg), "heading" if head else "body"))
        return pd.DataFrame(rows, columns=[key, "line", "text", "size", "bold", "page", "role"])

    return joined.groupBy(key).applyInPandas(run, f"`{key}` {kind}, line int, text string, size double, bold boolean, page int, role string")
