"""Results that several steps read are written once, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that all executors share. A local session that names none gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def compiled_by_parts(spark: SparkSession) -> None:
    """Lowers Spark's bound of a generated method to what the JVM compiles, if the session has not set it.

    Beyond 8,000 bytes the JVM only interprets a method; above the bound Spark cuts a step of many expressions into small ones.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def written(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df marked to be sent to all workers, if it has no more than so many rows (which are counted), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
