"""Reports: Markdown tables and LaTeX pages of ideas. Formatting is done on the driver; a table too long for that is refused, not cut."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from string import Template
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import TEX_SIGNS

#: Rows of a report; a longer one raises.
MOST_ROWS = 100_000

_HEAD = r"""\documentclass{$kind}
\begin{document}
\title{$title}
\maketitle
"""
_LIST = r"""\begin{itemize}
$evidence
\end{itemize}
\end{document}
"""
#: Pages by name: all parts of an idea, a short memo, and the frame of a paper.
TEMPLATES = {
    "proposal": Template(
        _HEAD.replace("$kind", "article")
        + "".join(f"\\section*{{{h}}}\n${f}\n" for h, f in (("Question", "research_question"), ("Method", "method_sketch"), ("Evaluation", "evaluation_plan"), ("Contribution", "expected_contribution"), ("Assumptions and risks", "assumptions_and_risks"), ("Prediction", "falsifiable_prediction"), ("Baseline", "named_baseline")))
        + "\\section*{Evidence}\n"
        + _LIST
    ),
    "memo": Template(_HEAD.replace("$kind", "article") + "\\noindent $research_question\n\n$method_sketch\n\n\\emph{Test:} $falsifiable_prediction (against $named_baseline)\n" + _LIST),
    "paper": Template(
        _HEAD.replace("$kind", "article")
        + "\\begin{abstract}\n$expected_contribution\n\\end{abstract}\n"
        + "".join(f"\\section{{{h}}}\n${f}\n" for h, f in (("Introduction", "research_question"), ("Method", "method_sketch"), ("Experiments", "evaluation_plan"), ("Limitations", "assumptions_and_risks")))
        + "\\section{Evidence}\n"
        + _LIST
    ),
}
_FIELDS = ("title", "research_question", "method_sketch", "evaluation_plan", "expected_contribution", "assumptions_and_risks", "falsifiable_prediction", "named_baseline")


def markdown(df: DataFrame, title: str, columns: list[str] | None = None) -> str:
    """A heading and a table of all rows, in the order of ``df``; null shows as a dash. More than ``MOST_ROWS`` rows raise."""
    cols = columns or df.columns
    got = df.select(*cols).limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"a report takes at most {MOST_ROWS} rows")
    cell = lambda v: "—" if v is None or v == "" else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(r[c]) for c in cols] for r in got]
    return "\n".join([f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join(r) + " |" for r in rows]]) + "\n"


def escape_tex(text: Any) -> str:
    return "".join(TEX_SIGNS.get(c, c) for c in str(text or ""))


def idea_page(idea: dict[str, Any], template: str | Template = "proposal") -> str:
    """LaTeX of one idea by a named template or one of the caller's own; missing fields are dashes."""
    items = "\n".join(f"\\item {escape_tex(e.get('gap_sentence'))} ({escape_tex(e.get('paper_id'))})" for e in idea.get("evidence_used") or []) or "\\item —"
    page = template if isinstance(template, Template) else TEMPLATES[template]
    return page.safe_substitute({f: escape_tex(idea.get(f)) or "—" for f in _FIELDS}, evidence=items)


def idea_pages(records: DataFrame, key: str = "idea_id", record: str = "record", template: str | Template = "proposal") -> DataFrame:
    """``key, file, tex`` of every idea record, a map over the rows; the file is named by key and title."""
    kind = records.schema[key].dataType.simpleString()
    page = template if isinstance(template, Template) else TEMPLATES[template]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ideas = [(json.loads(t) or {}).get("idea") or {} for t in pdf[record]]
            names = [f"{k}_{re.sub(r'[^A-Za-z0-9]', '_', str(i.get('title') or ''))[:40]}.tex" for k, i in zip(pdf[key], ideas)]
            yield pd.DataFrame({key: pdf[key], "file": names, "tex": [idea_page(i, page) for i in ideas]})

    return records.where(F.col(record).isNotNull()).select(key, record).mapInPandas(run, f"`{key}` {kind}, file string, tex string")


def evaluation_report(scores: DataFrame) -> str:
    """Markdown of an evaluation: number of ideas, means, and the five best by composite."""
    axes = [a for a in ("novelty", "specificity", "feasibility", "evidence_grounding", "composite", "evidence_overlap") if a in scores.columns]
    m = scores.agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in axes]).first()
    if not m["n"]:
        return "# Evaluation\n\nNo ideas were evaluated.\n"
    lines = ["# Evaluation", "", f"- Rows: {m['n']}", *[f"- Mean {a}: {m[a]:.2f}" for a in axes if m[a] is not None], "", "## Best by composite", ""]
    key = scores.columns[0]
    for r in scores.orderBy(F.desc("composite"), key).limit(5).collect():
        lines += [f"### {r[key]}", ", ".join(f"{a} {r[a]:.2f}" for a in axes if r[a] is not None), f"> {r['overall_critique'] or '—'}", ""]
    return "\n".join(lines)


def library_summary(ideas: DataFrame) -> DataFrame:
    """``mode, n, novelty, confidence`` of an idea library; what is no number does not count."""
    from lacuna.functions.numeric import coerce

    return ideas.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(coerce("novelty_score", None)), 6).alias("novelty"), F.round(F.avg(coerce("idea_confidence", None)), 6).alias("confidence"))
