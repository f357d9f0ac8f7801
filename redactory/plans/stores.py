"""Queries through the stores of mapping and log and through the SQL functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.io import shared_path
from redactory.functions.register import register
from redactory.operators import activity
from redactory.operators.detect import long_form_sql, resolve_sql, scan_sql
from redactory.plans.activity import STATS
from redactory.plans.masking import SQL as _MASKING
from redactory.plans.masking import mapping_table
from redactory.sources import stores
from redactory.sources.messages import messages, messages_sql

_SOURCE = f"SELECT msg_id AS id, t FROM ({messages_sql(True)})"


def stored_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping as a later session finds it, after a first snapshot without passports and a second with all."""
    path, table = shared_path(spark, "mapping"), mapping_table(spark, sf_dir)
    stores.save_mapping(table.where("type <> 'PASSPORT'"), path)
    known = stores.load_mapping(spark, path)
    stores.save_mapping(known.unionByName(table.join(known.select("real"), "real", "left_anti")), path)
    return stores.load_mapping(spark, path)


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 entries of each kind, of a log that is appended to twice."""
    path = shared_path(spark, "log")
    entries = activity.stat_events(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "kind", "item", "session_id")
    stores.append_log(entries.where("event_id % 3 <> 0"), path)
    stores.append_log(entries.where("event_id % 3 = 0"), path)
    return stores.load_log(spark, path, "kind")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through the SQL functions: masked and restored by a map, and what a scan of them finds."""
    register(spark)
    messages(spark, sf_dir).select(F.col("msg_id").alias("id"), "t").createOrReplaceTempView("redactory_texts")
    return spark.sql(
        """SELECT m.id, mask_text(m.t, map('order', 'ticket', 'or', 'OR')) AS masked, restore_text(mask_text(m.t, map('card', '<1>')), map('<1>', 'card')) = m.t AS same, f.type, f.value, f.start
        FROM redactory_texts m, LATERAL scan_pii(m.t) f"""
    )


QUERIES = {"stored_mapping": stored_mapping, "stored_log": stored_log, "sql_functions": sql_functions}
SQL = {
    "stored_mapping": _MASKING["mapping_table"],
    "stored_log": f"SELECT event_id, kind, item, session_id FROM {STATS} QUALIFY row_number() OVER (PARTITION BY kind ORDER BY event_id DESC) <= 200",
    "sql_functions": f"""SELECT id, replace(replace(t, 'order', 'ticket'), 'or', 'OR') AS masked, true AS same, "type", "value", "start" FROM ({_SOURCE}) JOIN ({long_form_sql(resolve_sql(scan_sql(_SOURCE, ["id"]), ["id"]), ["id"])}) USING (id)""",
}
