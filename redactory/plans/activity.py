"""Queries over the events table read as stat messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactory.operators import activity

QUERIES, SQL = {}, {}
STATS = """(SELECT event_id, ts, user_id AS session_id, 'p' || CAST(user_id % 3 AS VARCHAR) AS platform,
  CASE WHEN event_type IN ('view', 'click') THEN CAST(trunc(value) AS BIGINT) % 5 ELSE 0 END AS detected, CASE WHEN event_type = 'click' THEN CAST(trunc(value) AS BIGINT) % 5 ELSE 0 END AS masked,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS sent, CASE event_type WHEN 'signup' THEN 'mask' WHEN 'purchase' THEN 'unmask' ELSE 'pending' END AS kind, event_id % 97 AS item FROM events)"""


def _add(name: str, build, sql: str):
    QUERIES[name] = lambda spark, sf_dir: build(activity.stat_events(spark.read.parquet(f"{sf_dir}/events.parquet")))
    SQL[name] = sql.replace("STATS", STATS)


_COUNTERS = "SELECT session_id, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(masked) AS BIGINT) AS masked, CAST(sum(sent) AS BIGINT) AS sent FROM STATS GROUP BY session_id"
_add("session_counters", activity.session_counters, _COUNTERS)


def _scored(stats):
    out = activity.session_counters(stats)
    score = activity.privacy_score(F.col("detected"), F.col("masked"), F.col("sent"))
    return out.select("session_id", score.alias("score")).withColumn("band", activity.hint_band(F.col("score")))


_SCORE = "CAST(least(100, greatest(0, 100 - sent * 12 - CASE WHEN detected > 0 AND masked / detected < 0.5 THEN floor((1 - masked / detected) * 10 + 0.5) ELSE 0 END)) AS BIGINT)"
_add("privacy_score", _scored, f"SELECT session_id, score, CASE WHEN score < 50 THEN 'high exposure' WHEN score < 80 THEN 'some exposure' ELSE 'protected' END AS band FROM (SELECT session_id, {_SCORE} AS score FROM ({_COUNTERS}))")
_add("platform_counts", activity.platform_messages, "SELECT platform, count(*) AS n_messages FROM STATS GROUP BY platform")
_add("recent_swaps_top12", lambda s: s.where("kind = 'mask'").orderBy(F.desc("ts"), "event_id").limit(12).select("event_id", "session_id"), "SELECT event_id, session_id FROM STATS WHERE kind = 'mask' ORDER BY ts DESC, event_id LIMIT 12")
_add("activity_last20", lambda s: s.orderBy(F.desc("event_id")).limit(20).select("event_id", "kind"), "SELECT event_id, kind FROM STATS ORDER BY event_id DESC LIMIT 20")
_add("activity_cap200", lambda s: activity.keep_last(s, "platform").select("platform", "event_id"), "SELECT platform, event_id FROM STATS QUALIFY row_number() OVER (PARTITION BY platform ORDER BY event_id DESC) <= 200")
_add("activity_dedupe", lambda s: activity.first_of_each(s.select("event_id", "kind", "item", "platform"), ["kind", "item"]), "SELECT kind, item, min(event_id) AS event_id, arg_min(platform, event_id) AS platform FROM STATS GROUP BY kind, item")
_add("cleared_log", lambda s: activity.keep_last(s, "platform").where("kind <> 'pending'").groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM (SELECT * FROM STATS QUALIFY row_number() OVER (PARTITION BY platform ORDER BY event_id DESC) <= 200) WHERE kind <> 'pending' GROUP BY kind")
_add(  # entries numbered as they come, without gaps
    "activity_ids", lambda s: activity.numbered_log(s.where("kind = 'mask'").select("event_id", "kind")), "SELECT event_id, kind, row_number() OVER (ORDER BY event_id) AS id FROM STATS WHERE kind = 'mask'",
)
