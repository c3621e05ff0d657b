"""File sources and sinks: TSV, JSON lines, snapshots, tar archives, PDF folders."""

from __future__ import annotations

import importlib.util
import json
import os
import tarfile
import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import schemas


def read_tsv(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Tab-separated file with a header; quotes inside quoted fields are doubled. A missing file is an error, or no rows."""
    if missing_ok and "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, sep="\t", header=True, quote='"', escape='"', multiLine=True)


def write_tsv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """Replace ``path`` by a tab-separated export; ``one_file`` for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema: no type is guessed, unknown fields are dropped, missing ones null; lines that are none give no row."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as one struct column ``record``; blank lines are skipped, what is no JSON is null."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)).alias("record"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_one(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table; further columns may come later (``read_merged``)."""
    df.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_snapshot(spark: SparkSession, path: str, categories: list[str], least_year: int, n: int | None = None, seed: int = 42) -> DataFrame:
    """Selected papers of a bulk metadata file; malformed lines are skipped."""
    from lacuna.operators.rows import select_snapshot

    return select_snapshot(read_jsonl(spark, path, schemas.SNAPSHOT), categories, least_year, n, seed)


def read_archives(spark: SparkSession, path: str, open_path: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """``archive, member, ord, record``: each JSON line of the ``.json`` and ``.jsonl`` members of tar archives (plain, gz, bz2, xz).

    Only the paths are listed by Spark; a task opens an archive by its path and streams
    it, decompressing as it goes, so neither the size of an archive nor that of a member
    is held. ``open_path`` opens a path as the executors see it (a mounted or local file
    unless given). Lines that are no JSON are skipped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf.path:
                out: list[tuple] = []
                raw = open_path(name) if open_path else open(unquote(urlparse(name).path), "rb")  # noqa: SIM115
                with raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        if not m.isfile() or not m.name.endswith((".json", ".jsonl")):
                            continue
                        for k, said in enumerate(tar.extractfile(m)):
                            line = said.decode("utf-8", errors="replace")
                            try:
                                json.loads(line)
                            except ValueError:
                                continue
                            out.append((name, m.name, k, line.strip()))
                            if len(out) >= 1000:
                                yield pd.DataFrame(out, columns=["archive", "member", "ord", "record"])
                                out = []
                yield pd.DataFrame(out, columns=["archive", "member", "ord", "record"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition("path").mapInPandas(run, "archive string, member string, ord int, record string")


def scan_until(df: DataFrame, order: str, predicate: str, n: int, most: int) -> DataFrame:
    """The first ``n`` rows that qualify among the first ``most`` by ``order``."""
    return df.orderBy(order).limit(most).where(predicate).orderBy(order).limit(n)


def _opened(content: bytes):
    """A PDF document; raises if the library that reads it is missing."""
    import fitz

    return fitz.open(stream=content, filetype="pdf")


def _need_pdf_library() -> None:
    if importlib.util.find_spec("fitz") is None:
        raise RuntimeError("reading PDF files needs PyMuPDF, or a parse function")


def _pdf_text(content: bytes, pages: int | None) -> str:
    try:
        with _opened(content) as doc:
            out = []
            for k, page in enumerate(doc):
                if pages is not None and k >= pages:
                    break
                try:
                    out.append(page.get_text())
                except Exception:  # noqa: S112 - one bad page must not lose the others
                    continue
            return "\n".join(out)
    except Exception:
        return ""


def _pdf_spans(content: bytes, pages: int | None) -> list[dict]:
    out: list[dict] = []
    try:
        with _opened(content) as doc:
            for k, page in enumerate(doc):
                if pages is not None and k >= pages:
                    break
                for block in page.get_text("dict").get("blocks", []):
                    for line in block.get("lines", []):
                        for s in line.get("spans", []):
                            x0, y0, x1, _ = s["bbox"]
                            out.append({"page": k, "x0": x0, "x1": x1, "y0": y0, "size": s["size"], "bold": bool(s["flags"] & 16) or "bold" in s["font"].lower(), "text": s["text"]})
    except Exception:
        return []
    return out


def _pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def read_pdfs(spark: SparkSession, folder: str, pages: int | None = None, least: int = 500, parse: Callable[[bytes, int | None], str] | None = None) -> DataFrame:
    """``id, text, n_chars`` of the PDF files of a folder, named by their stem, texts of ``least`` characters or more.

    ``parse`` turns bytes into text; the default uses PyMuPDF and raises where that is
    not installed.
    """
    if parse is None:
        _need_pdf_library()
        parse = _pdf_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [parse(c, pages) for c in pdf.content]
            yield pd.DataFrame({"id": [_stem(p) for p in pdf.path], "text": text, "n_chars": [len(t) for t in text]})

    return _pdf_files(spark, folder).mapInPandas(run, "id string, text string, n_chars int").where(F.col("n_chars") >= least).orderBy("id")


def read_pdf_spans(spark: SparkSession, folder: str, pages: int | None = None, parse: Callable[[bytes, int | None], list[dict]] | None = None) -> DataFrame:
    """``id, ord, page, x0, x1, y0, size, bold, text`` of the styled spans of PDF files, in reading order; what ``sections.merge_lines`` takes.

    ``parse`` gives the spans of one file; the default uses PyMuPDF and raises where that
    is not installed. A file that cannot be read gives none.
    """
    if parse is None:
        _need_pdf_library()
        parse = _pdf_spans
    cols = ["id", "ord", "page", "x0", "x1", "y0", "size", "bold", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                # reading order: page, height to five points (halves to even), left edge
                spans = sorted(parse(content, pages), key=lambda s: (s["page"], round(s["y0"] / 5) * 5, s["x0"]))
                rows = [(_stem(path), k, *(s[c] for c in cols[2:])) for k, s in enumerate(spans)]
                yield pd.DataFrame(rows, columns=cols)

    return _pdf_files(spark, folder).mapInPandas(run, "id string, ord int, page int, x0 double, x1 double, y0 double, size double, bold boolean, text string")


def read_pdf_blocks(spans: DataFrame) -> DataFrame:
    """``id, text, blocks`` of papers from their spans: lines with their role, and the text they make; what the styled half of ``sections.sections`` takes."""
    from lacuna.operators.sections import merge_lines

    lines = F.array_sort(F.collect_list(F.struct("line", "role", "text")))
    d = merge_lines(spans).groupBy("id").agg(lines.alias("x"))
    d = d.select("id", F.array_join(F.transform("x", lambda b: b["text"]), "\n").alias("text"), F.transform("x", lambda b: F.struct(b["role"].alias("role"), b["text"].alias("text"))).alias("blocks"))
    return d.withColumn("n_chars", F.length("text")).withColumn("n_headings", F.size(F.filter("blocks", lambda b: b["role"] == "heading")))


#: Fixed value: bytes of a PDF file below which it is none.
LEAST_PDF = 10_000


def download(ids: DataFrame, folder: str, fetch: Callable[[str], tuple[int, bytes]], key: str = "id", parts: int = 8) -> DataFrame:
    """``id, ok, status`` of a download per id into ``folder`` (one that all executors see), at most ``parts`` at a time.

    ``fetch`` gives the status and content of one id. A file of ``LEAST_PDF`` bytes or
    more that is there already is not fetched again; a file appears under its name only
    when it is whole, so a task that is tried again does no harm. Null ids give no row.
    """

    def one(i: str) -> tuple[str, bool, str]:
        path = os.path.join(folder, f"{i.replace('/', '_')}.pdf")
        try:
            if os.path.exists(path) and os.path.getsize(path) > LEAST_PDF:
                return i, True, "cached"
            status, content = fetch(i)
            if status != 200:
                return i, False, f"http {status}"
            if len(content) < LEAST_PDF:
                return i, False, "too small"
            with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
                f.write(content)
            os.replace(f.name, path)
            return i, True, "downloaded"
        except Exception as e:
            return i, False, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            yield pd.DataFrame([one(str(i)) for i in pdf[key]], columns=["id", "ok", "status"])

    return ids.where(F.col(key).isNotNull()).select(key).distinct().repartition(parts).mapInPandas(run, "id string, ok boolean, status string")


def files_present(spark: SparkSession, folder: str, pattern: str = "*", least_bytes: int = 1) -> DataFrame:
    """``path, length`` of files of a size, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").where(F.col("length") >= least_bytes)
