"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of Spark's default 64 MB, held in the JVM's direct memory and in Python, cost an executor of 3 GB up to half of it.
ARROW_BYTES = 4 << 20
ROOT = str(Path(__file__).resolve().parents[2])
#: Text bytes that a Python worker holds as Python strings at a time.
SLICE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable in workers, Arrow batches small, and checkpoints possible.

    The shared folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset (tests) a temporary one is made.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":  # the default
        spark.conf.set(size, str(ARROW_BYTES))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="shared-"))


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Materialize in the shared folder, so that a lost executor loses nothing."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """A table that lies in fewer pieces than there are cores, dealt out to all; any other as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def slices(batches, column: int | str = "text"):
    """Record batches cut so that each holds about SLICE_BYTES in ``column``; a row is never cut."""
    for b in batches:
        size = b.column(column).nbytes
        step = max(1, int(b.num_rows * SLICE_BYTES / max(size, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def crc_text(column) -> F.Column:
    return F.crc32(F.encode(column, "UTF-8"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Text of a range that one task sorts and streams; the most ranges whose bounds the driver holds (past it they get larger); rows sampled a range.
RANGE_BYTES, MOST_RANGES, SAMPLED = 32 << 20, 1 << 16, 24


def sampled(docs: DataFrame) -> tuple[int, DataFrame]:
    """Number of rows, and a random sample of them, about SAMPLED for every range of a table with texts of 4 KB; it only serves to place bounds."""
    n = docs.count()
    rows = SAMPLED * min(MOST_RANGES, max(partitions(docs.sparkSession), n * 4096 // RANGE_BYTES))
    return n, docs.sample(fraction=min(1.0, rows / max(1, n)), seed=3)


def bounds(spark: SparkSession, rows: int, seen: list[tuple]) -> list[tuple]:
    """Bounds of ranges of about equal weight, from the sample's (key, ..., bytes); the number of ranges follows the data."""
    seen = sorted(seen)
    weight = np.cumsum([r[-1] + 16 for r in seen])
    if not len(seen):
        return []
    n = min(MOST_RANGES, max(partitions(spark), int(rows * (weight[-1] / len(seen)) // RANGE_BYTES)))
    cuts = np.searchsorted(weight, np.arange(1, n) * (weight[-1] / n))
    return sorted({seen[i][:-1] for i in cuts})
