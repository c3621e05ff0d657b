"""Streams: process unseen papers, keep the first of repeated rows, follow revisions.

The sources are folders to which files are added; the checkpoint of a query is its
memory of what was done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lacuna.operators.panels import loop_ends
from lacuna.sources.files import exists


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10, kind: str = "parquet") -> DataFrame:
    """Rows of files as they appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def resume(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id", order: str | None = None):
    """Run ``work`` on the rows whose key has no result yet; handles what there is and ends.

    Results lie in ``out/batch=N`` and the keys asked for in ``out_done/batch=N``, each
    written over what an earlier try of the same batch left; keys done in the same batch
    do not count as done. A stop between the two writes, or before the batch is
    committed, therefore leaves nothing twice. A key that gives no result is not asked
    for again. Of several rows of a key in a batch the first by ``order`` is taken (by
    all of its columns if none is given).
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        done = spark.read.schema(f"`{key}` {kind}, batch bigint").parquet(f"{out}_done").where(F.col("batch") != number).select(key) if exists(spark, f"{out}_done") else spark.createDataFrame([], f"`{key}` {kind}")
        first = Window.partitionBy(key).orderBy(*([order] if order else []), *[c for c in batch.columns if c != order])
        todo = batch.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").join(done, key, "left_anti").persist()
        work(todo).write.mode("overwrite").parquet(f"{out}/batch={number}")
        todo.select(key).write.mode("overwrite").parquet(f"{out}_done/batch={number}")
        todo.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_each(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """One row per key among rows that come within ``late`` of each other; older state is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def revision_states(stream: DataFrame, last: int = 2) -> DataFrame:
    """State of each draft from events ``idea_id, iteration, verdict, score``: ``idea_id, rounds, verdict, finished``."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rounds, verdict, finished = state.get if state.exists else (0, "", False)
        events = pd.concat(list(batches)).sort_values("iteration")
        for e in events.itertuples():
            if finished or e.iteration < rounds:
                continue
            rounds, verdict = int(e.iteration) + 1, str(e.verdict)
            finished = verdict == "accept" or float(e.score) >= 4.0 or rounds > last
        state.update((rounds, verdict, bool(finished)))
        yield pd.DataFrame({"idea_id": [key[0]], "rounds": [rounds], "verdict": [verdict], "finished": [bool(finished)]})

    kind = stream.schema["idea_id"].dataType.simpleString()
    return stream.groupBy("idea_id").applyInPandasWithState(step, f"idea_id {kind}, rounds int, verdict string, finished boolean", "rounds int, verdict string, finished boolean", "update", GroupStateTimeout.NoTimeout)


def finished_rounds(events: DataFrame, last: int = 2) -> DataFrame:
    """Batch form of ``revision_states``: the round at which each draft ends."""
    d = events.where(loop_ends(F.col("verdict"), F.col("score"), F.col("iteration"), last))
    return d.groupBy("idea_id").agg(F.min(F.struct("iteration", "verdict")).alias("x")).select("idea_id", (F.col("x.iteration") + 1).alias("rounds"), "x.verdict")
