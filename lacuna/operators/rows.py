"""Cleaning, keep-first, top-n, sampling and selection over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.numeric import coerce
from lacuna.functions.text import one_line
from lacuna.session import cut


def keep_first(df: DataFrame, keys: list[str | Column], *order: str | Column) -> DataFrame:
    """The first row of every key by ``order``; null keys are a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def top_per_group(df: DataFrame, keys: list[str | Column], n: int, *order: str | Column, rank: str | None = None) -> DataFrame:
    """At most ``n`` rows of every key by ``order``; ``rank`` keeps their number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return d.withColumnRenamed("_rank", rank) if rank else d.drop("_rank")


def clean_statements(df: DataFrame, sentence: str, order: str, least_length: int = 20, least_confidence: float = 0.5, paragraph: str = "paragraph_text") -> DataFrame:
    """Statements on one line, long and sure enough, one of each per paper.

    A null confidence counts 0 and a null section type is empty; a null sentence is
    dropped. Of equal (id, sentence) the smallest ``order`` stays.
    """
    d = df.withColumn(sentence, one_line(F.col(sentence))).withColumn(paragraph, one_line(F.col(paragraph))).withColumn("confidence", coerce("confidence"))
    d = d.withColumn("section_type", F.coalesce("section_type", F.lit(""))) if "section_type" in df.columns else d.withColumn("section_type", F.lit(""))
    d = d.where((F.col("confidence") >= least_confidence) & (F.length(sentence) >= least_length))
    return keep_first(d, ["id", sentence], order)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chosen by a hash of key and seed; independent of partitions."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """Rows with their number from 0 by ``order`` (unique), without a window over the whole table.

    Rows are put in ranges and kept; each range counts its rows, and a range's numbers
    begin where those before it end. Only one count per range reaches the driver.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    d = cut(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    begin, starts = 0, []
    for r in sorted(d.groupBy("_part").count().collect()):
        starts.append((r["_part"], begin))
        begin += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _begin bigint")
    w = Window.partitionBy("_part").orderBy(*cols)
    return d.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_begin") + F.row_number().over(w) - 1).drop("_part", "_begin")


def bootstrap(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` draws with replacement: ``draw`` and the drawn row's columns.

    Rows are numbered by ``key`` (unique); the k-th draw takes the row whose number is a
    hash of seed and k.
    """
    n = df.count()
    if not n:
        return df.withColumn("draw", F.lit(0).cast("bigint")).limit(0)
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("_no"))
    return draws.join(numbered(df, key, name="_no"), "_no").drop("_no")


def unseen(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among those done; the batch form of resuming."""
    return df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def share_of_max(df: DataFrame, score: str, out: str) -> DataFrame:
    """Score over the greatest score of the table; 0 if that is not positive. One row of maximum is joined, no global window."""
    top = df.agg(F.max(score).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.when(F.col("_top") > 0, F.col(score) / F.col("_top")).otherwise(0.0)).drop("_top")


def select_snapshot(records: DataFrame, categories: list[str], least_year: int, n: int | None, seed: int = 42) -> DataFrame:
    """Papers of any wanted category since a year, then a seeded sample: ``id, title, year, categories, abstract``.

    ``records`` has ``id, title, abstract, categories`` and ``versions`` (array of
    structs with ``created``); the last version's date gives the year, without one the
    paper is dropped.
    """
    from lacuna.functions.records import year_token

    created = F.try_element_at("versions", F.lit(-1))["created"]
    d = records.where(F.arrays_overlap(F.split(F.trim("categories"), r"\s+"), F.array(*[F.lit(c) for c in categories])))
    d = d.select("id", one_line(F.col("title")).alias("title"), year_token(created).alias("year"), "categories", one_line(F.col("abstract")).alias("abstract")).where(F.col("year") >= least_year)
    return d if n is None else seeded_sample(d, "id", n, seed)
