"""What several text operators share: the shared folder, the word pattern, joins with small tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a pre-aggregated table may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a written table of the shared folder: its lineage is cut and it survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has at most `limit` rows. Count only settled tables."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_of(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that an operator's own column names clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def run_hashes(h: np.ndarray, length: int, factor: int) -> np.ndarray:
    """The 64-bit hash of each `length` words in a row, from the words' hashes."""
    out = np.zeros(max(len(h) - length + 1, 0), np.uint64)
    for k in range(length if len(out) else 0):
        out = out * np.uint64(factor) + h[k : k + len(out)]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python at most so many rows at once; for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
