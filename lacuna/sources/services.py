"""External services behind interfaces, with deterministic offline defaults.

Model calls, paper search and sentence embedding are methods of small protocols; the
engine runs them per partition, one object a task. The defaults need no network and are
substitutes, not equals, of the services they stand for.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import strip
from lacuna.schemas import API_PAPER


class Annotator(Protocol):
    """Finds statements in the text of a paper."""

    def annotate(self, text: str) -> list[dict]: ...


class PaperSearch(Protocol):
    """Looks papers up."""

    def search(self, query: str, limit: int) -> list[dict]: ...

    def batch(self, ids: list[str]) -> list[dict | None]: ...


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


#: Phrases by which the offline annotator tells the kind of a statement.
KINDS = (
    ("future_work", r"future work|future research|we (?:plan|intend) to|next we will|natural extension|left for (?:later|future)"),
    ("limitation", r"limitation|limited to|restricted to|does not account|only tested|could not|fails on|assumes that"),
    ("open_problem", r"open question|remains open|still unknown|not understood|unclear|no agreed"),
)


class PhraseAnnotator:
    """Sentences with a phrase of ``KINDS``, confidence 0.6 and a little more for longer ones."""

    def annotate(self, text: str) -> list[dict]:
        out = []
        for s in re.split(r"(?<=[.!?])\s+", text or ""):
            for kind, pattern in KINDS:
                if re.search(pattern, s, re.IGNORECASE):
                    out.append({"gap_type": kind, "gap_sentence": s.strip(), "paragraph_text": s.strip(), "confidence": round(min(0.9, 0.6 + len(s) / 1000), 3)})
                    break
        return out


class HashEmbedder:
    """Words and word pairs hashed into a unit vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            w = re.findall(r"\w+", (t or "").lower())
            for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                x[i, h % self.dim] += 1.0 if (h >> 32) & 1 else -1.0
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class NoSearch:
    """No paper is ever found."""

    def search(self, query: str, limit: int) -> list[dict]:
        return []

    def batch(self, ids: list[str]) -> list[dict | None]:
        return [None] * len(ids)


def with_retries(call: Callable[[], object], tries: int = 4, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """``call()``, again after doubling waits when it fails; the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(first_wait * 2**k)
    raise ValueError("tries must be at least 1")


def annotate(papers: DataFrame, make: Callable[[], Annotator] = PhraseAnnotator, key: str = "id", text: str = "text") -> DataFrame:
    """Statements of every paper: ``id, gap_type, gap_sentence, paragraph_text, confidence``; a failing paper gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        cols = ["id", "gap_type", "gap_sentence", "paragraph_text", "confidence"]
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[key], pdf[text]):
                try:
                    rows += [(i, *(a.get(c) for c in cols[1:])) for a in service.annotate(t or "")]
                except Exception:  # noqa: S112 - one paper must not lose the others
                    continue
            yield pd.DataFrame(rows, columns=cols)

    got = papers.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, "id string, gap_type string, gap_sentence string, paragraph_text string, confidence double")
    return got.withColumn("gap_sentence", strip(F.regexp_replace("gap_sentence", "\n", " ")))


def embed(df: DataFrame, text: str, make: Callable[[], Embedder] = HashEmbedder, out: str = "embedding") -> DataFrame:
    """Add a vector column; one embedder a task, Arrow batches in and out."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        for pdf in batches:
            yield pdf.assign(**{out: list(service.embed(pdf[text].fillna("").tolist()))})

    return df.mapInPandas(run, schema)


def embed_missing(df: DataFrame, text: str, known: DataFrame, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """``text_key, embedding`` of the texts that ``known(text_key, embedding)`` lacks; the key is a digest of the text."""
    keyed = df.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("text_key"), F.col(text).alias("t")).dropDuplicates(["text_key"])
    return embed(keyed.join(known.select("text_key"), "text_key", "left_anti"), "t", make).select("text_key", "embedding")


def lookup(ids: DataFrame, make: Callable[[], PaperSearch] = NoSearch, key: str = "id", chunk: int = 100) -> DataFrame:
    """``id`` and the paper found for it (``paper``, null if none), asked for in chunks of ``chunk``."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(API_PAPER).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        for pdf in batches:
            got: list = []
            values = pdf[key].tolist()
            for i in range(0, len(values), chunk):
                got += service.batch(values[i : i + chunk])
            yield pd.DataFrame({"id": values, "paper": [None if g is None else {f: g.get(f) for f in fields} for g in got]})

    kind = _parse_datatype_string(API_PAPER).simpleString()
    return ids.select(key).mapInPandas(run, f"id string, paper {kind}")


def flat_paper(found: DataFrame) -> DataFrame:
    """Flat metadata of looked-up papers: ``id`` is always the key asked for, nulls are empty texts."""
    p = lambda f: F.coalesce(F.col(f"paper.{f}").cast("string"), F.lit(""))
    return found.select(
        "id",
        p("externalIds.ArXiv").alias("s2_arxiv_id"),
        p("paperId").alias("paperId"),
        p("title").alias("title"),
        p("abstract").alias("abstract"),
        p("year").alias("year"),
        p("venue").alias("venue"),
        p("citationCount").alias("citation_count"),
        p("openAccessPdf.url").alias("openaccess_pdf"),
        p("url").alias("url"),
    )
