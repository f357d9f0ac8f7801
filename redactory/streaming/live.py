"""Streams: counters over stat events, once-only announcements, and restoring answers as they arrive.

They run on Structured Streaming with a checkpoint in the shared folder. A query processes what has arrived and ends
(``availableNow``). Debounced restoring, changing settings, growing mappings and resets are in ``sessions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.io import shared_path, written
from redactory.operators import activity
from redactory.operators.restoring import restore_by_rules, restore_rules
from redactory.streaming import sessions

#: How long after an announcement its like is still held back; the state of older ones is dropped.
HELD_BACK = "60 days"


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A file stream over a table; the pattern lets the table be one file or a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}.parque[t]")


def _finished(stream: DataFrame, mode: str, each=None, schema=None, **trigger) -> DataFrame:
    """The sink's last state for 'complete', all its rows for 'append'; ``each`` maps every micro-batch before it is written."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, "stream")
    schema = schema or stream.schema

    def write(batch: DataFrame, number: int) -> None:
        rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write)
    writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows").select(*[f.name for f in schema])


def platform_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(activity.platform_messages(activity.stat_events(_stream(spark, sf_dir, "events"))), "complete")


def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by session: the key is the session, so a new one starts from none."""
    return _finished(activity.session_counters(activity.stat_events(_stream(spark, sf_dir, "events"))), "complete")


def _announced(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    stats = activity.stat_events(_stream(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return _finished(stats.withWatermark("ts", HELD_BACK).dropDuplicatesWithinWatermark(keys).select(*keys), "append")


def first_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (kind, item) once, the first that arrives; what has not been seen for ``HELD_BACK`` is forgotten."""
    return _announced(spark, sf_dir, ["kind", "item"])


def conversation_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by conversation: another one has announced nothing yet."""
    return _announced(spark, sf_dir, ["session_id", "kind", "item"])


#: What an event of the table is to a session; stand-ins are F0 to F6.
_FAKE = "concat('F', CAST(event_id % 7 AS STRING))"
_ANSWER = f"named_struct('kind', 'answer', 'name', CAST(event_id AS STRING), 'value', concat('see ', {_FAKE}, ' now'))"
_PAIR = f"named_struct('kind', 'pair', 'name', {_FAKE}, 'value', concat('R', CAST(event_id % 7 AS STRING)))"
GROWING = f"CASE WHEN event_type = 'signup' THEN {_PAIR} ELSE {_ANSWER} END"
SETTINGS = """CASE WHEN event_type = 'purchase' THEN named_struct('kind', 'setting', 'name', 'auto_restore', 'value', CAST(event_id % 2 = 0 AS STRING))
  ELSE named_struct('kind', 'message', 'name', concat('p', CAST(user_id % 3 AS STRING)), 'value', CAST(event_id AS STRING)) END"""
RESETS = f"CASE WHEN event_type = 'error' THEN named_struct('kind', 'reset', 'name', '', 'value', '') ELSE named_struct('kind', 'say', 'name', {_FAKE}, 'value', '') END"


def _session_results(spark: SparkSession, sf_dir: str, kinds: str) -> DataFrame:
    return _finished(sessions.live_sessions(sessions.scaled_events(_stream(spark, sf_dir, "events"), kinds)), "append")


def debounced_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of each session: after a pause in its changes, and within the ceiling in a burst."""
    return _session_results(spark, sf_dir, GROWING).where("kind = 'pass'").select("session", "at")


def growing_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each answer shows in the end, by a mapping of which the pairs come with the stream, some after the answer."""
    shown = _session_results(spark, sf_dir, GROWING).where("kind = 'shown'")
    return shown.groupBy("session", F.col("name").cast("long").alias("id")).agg(F.max_by("value", "at").alias("shown"))


def answered_with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by platform that come while their session restores by itself; settings change with the stream."""
    return _session_results(spark, sf_dir, SETTINGS).where("kind = 'message'").groupBy(F.col("name").alias("platform")).agg(F.count("*").alias("n_messages"))


def announcements_after_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each announcement is made in a session: once, and again after each reset."""
    return _session_results(spark, sf_dir, RESETS).where("kind = 'say'").groupBy("session", "name").agg(F.count("*").alias("n"))


def restored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that name customers by their fakes, restored from the mapping as they arrive; a batch meets the rules by a join."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rules = written(restore_rules(customers.select(F.col("c_name").alias("real"), F.lit("CUSTOM").alias("type"), F.concat(F.lit("Client "), F.col("c_custkey").cast("string")).alias("fake"))))
    k = F.col("o_custkey").cast("string")
    answers = _stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Client, "), k, F.lit(" and not Client "), k, F.lit("0x")).alias("t"))
    return _finished(answers, "append", lambda batch: restore_by_rules(batch, rules).select("id", "restored"), spark.createDataFrame([], "id long, restored string").schema)
