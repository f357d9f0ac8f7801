"""Counters, logs and the privacy score over a stream of stat events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def privacy_score(detected: Column, masked: Column, sent: Column) -> Column:
    """100, less 12 for each unmasked send, less up to 10 where under half of what was found was masked; 0 to 100."""
    ratio = masked / F.nullif(detected, F.lit(0))
    nudge = F.when((detected > 0) & (ratio < 0.5), F.floor((1 - ratio) * 10 + 0.5)).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), 100 - sent * 12 - nudge)).cast("long")


def hint_band(score: Column) -> Column:
    return F.when(score < 50, "high exposure").when(score < 80, "some exposure").otherwise("protected")


def stat_events(events: DataFrame) -> DataFrame:
    """Events read as stat messages: what was detected, masked or sent, on which platform."""
    value = F.col("value").cast("long")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("session_id"), F.concat(F.lit("p"), F.pmod("user_id", F.lit(3)).cast("string")).alias("platform"),
        F.when(F.col("event_type").isin("view", "click"), F.pmod(value, F.lit(5))).otherwise(0).alias("detected"),
        F.when(F.col("event_type") == "click", F.pmod(value, F.lit(5))).otherwise(0).alias("masked"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("sent"),
        F.when(F.col("event_type") == "signup", "mask").when(F.col("event_type") == "purchase", "unmask").otherwise("pending").alias("kind"),
        F.pmod("event_id", F.lit(97)).alias("item"),
    )


def session_counters(stats: DataFrame) -> DataFrame:
    return stats.groupBy("session_id").agg(F.sum("detected").alias("detected"), F.sum("masked").alias("masked"), F.sum("sent").alias("sent"))


def platform_messages(stats: DataFrame) -> DataFrame:
    """Stat messages, not sends: one detection and one masking are two."""
    return stats.groupBy("platform").agg(F.count("*").alias("n_messages"))


def keep_last(log: DataFrame, by: str, n: int = 200) -> DataFrame:
    """The last n entries of each group by id."""
    return log.withColumn("_no", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("event_id")))).where(F.col("_no") <= n).drop("_no")


def first_of_each(log: DataFrame, key: list[str]) -> DataFrame:
    """One entry for each key, the first by id; combined before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.min_by(F.struct(*rest), "event_id").alias("r")).select(*key, "r.*")


def numbered_log(log: DataFrame, last_id: int = 0, size: int = 100_000) -> DataFrame:
    """log with ``id``: numbers after ``last_id`` in order of event_id, without gaps.

    Runs of event ids are numbered each by itself after those before them; only the runs' sizes meet in one place.
    """
    runs = log.withColumn("_run", F.floor(F.col("event_id") / size))
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_run", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy("event_id"))
    return runs.withColumn("id", inside).join(starts, "_run").withColumn("id", (F.col("id") + F.col("_before") + last_id).cast("long")).drop("_run", "_before")
