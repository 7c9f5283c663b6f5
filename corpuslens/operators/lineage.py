"""Cutting the lineage of iterated and reused tables, and joins with tables of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder in spark.checkpoint.dir, which driver and executors share.

    A folder of its own is used only where none is set and Spark runs in one process (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to a shared path and reads it back: computed once, safe against lost executors."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame) -> DataFrame:
    """``table`` for a join: broadcast if it has up to BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
