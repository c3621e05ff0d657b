"""Session construction, shared-folder checkpoints and table access."""

from __future__ import annotations

import gc
import io
import os
import re
import tempfile
import time
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "lacuna", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every plan here assumes: ANSI, AQE, UTC, Arrow."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir.

    Where that setting is absent and no folder has been set, a local session takes a
    folder under the temporary directory; a cluster is refused, as its executors do not
    share one.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lacuna-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` materialised as compressed columns and read back, and its folder for ``remove``.

    As ``cut``, which writes whole rows, uncompressed, and keeps them for as long as the folder.
    """
    folder = shared_folder(df.sparkSession)
    df.write.mode("append").option("compression", "zstd").parquet(folder)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def release(spark: SparkSession, wait: float = 0.0) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to; it waits for a garbage collection of the driver.

    A plan whose rows went to Python is let go by a thread that looks once a second: ``wait`` for it.
    """
    gc.collect()
    time.sleep(wait)
    spark.sparkContext._jvm.System.gc()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a folder of ``shared_folder``, in the driver or in a task."""
    return (fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)) if re.match("file:|/", folder) else fs.FileSystem.from_uri(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for files that tasks write and read, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    at, path = opened(folder)
    at.create_dir(path)
    return folder


def write_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Arrays as files of a folder of ``shared_folder``; a task that is repeated writes the same files."""
    at, path = opened(folder)
    for k, x in arrays.items():
        # another name until it is whole
        part = f"{path}/{uuid.uuid4().hex}"
        with at.open_output_stream(part) as f:
            np.save(f, x, allow_pickle=False)
        at.move(part, f"{path}/{name}.{k}.npy")


def read_arrays(folder: str, name: str, *names: str) -> list[np.ndarray]:
    """Arrays of ``write_arrays``; those of a local folder are mapped, so that tasks of a machine share their memory."""
    at, path = opened(folder)
    files = [f"{path}/{name}.{k}.npy" for k in names]
    if isinstance(at, fs.LocalFileSystem):
        return [np.load(f, mmap_mode="r", allow_pickle=False) for f in files]
    return [np.load(io.BytesIO(at.open_input_stream(f).read()), allow_pickle=False) for f in files]


def remove(folder: str) -> None:
    """Delete a folder of ``shared_folder`` that nothing reads any more."""
    at, path = opened(folder)
    at.delete_dir(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of the dataset in ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
