"""Stores between sessions: the mapping as snapshots, the activity log as appended entries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from redactory.operators.activity import keep_last

MAPPING = "real string, type string, fake string"


def _snapshots(spark: SparkSession, path: str) -> int | None:
    """The number of the last snapshot; folders tell it, no data is read."""
    try:
        found = spark.read.schema(f"{MAPPING}, snapshot int").parquet(path)
    except AnalysisException:
        return None  # nothing was saved yet
    return max((int(m[1]) for m in map(re.compile(r"snapshot=(\d+)/").search, found.inputFiles()) if m), default=None)


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot, or an empty mapping."""
    last = _snapshots(spark, path)
    return spark.createDataFrame([], MAPPING) if last is None else spark.read.schema(MAPPING).parquet(f"{path}/snapshot={last}")


def save_mapping(table: DataFrame, path: str) -> None:
    """A new snapshot, so that the one it is made from can be read meanwhile. An empty table clears the mapping."""
    last = _snapshots(table.sparkSession, path)
    table.select("real", "type", "fake").write.parquet(f"{path}/snapshot={0 if last is None else last + 1}")


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def load_log(spark: SparkSession, path: str, by: str, n: int = 200) -> DataFrame:
    """The last n entries of each ``by``."""
    return keep_last(spark.read.parquet(path), by, n)
