"""Checksums over numbers derived from orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactory.functions import checks
from redactory.functions.dialect import DUCK, SPARK

QUERIES, SQL = {}, {}
_CASES = {
    "chk_luhn": (checks.luhn, 16, 4_000_000_000_000_000), "chk_tfn": (checks.tfn, 9, 100_000_000), "chk_tfn8": (checks.tfn, 8, 10_000_000),
    "chk_medicare": (checks.medicare, 10, 2_000_000_000), "chk_abn": (checks.abn, 11, 51_000_000_000),
}


def _add(name: str, check, width: int, base: int):
    number = f"{base} + (o_orderkey * 104729) % {10 ** (width - 2)}"

    def query(spark, sf_dir):
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(f"CAST({number} AS STRING)").alias("digits"))
        return orders.select("digits", F.expr(check(SPARK, "digits")).alias("valid")).where("valid")

    QUERIES[name] = query
    SQL[name] = f"SELECT digits, valid FROM (SELECT digits, {check(DUCK, 'digits')} AS valid FROM (SELECT CAST({number} AS VARCHAR) AS digits FROM orders)) WHERE valid"


for _name, (_check, _width, _base) in _CASES.items():
    _add(_name, _check, _width, _base)


def _hosts(spark, sf_dir):
    """Pages by platform: the host is a platform's domain or under it; the first declared wins."""
    domains = ["example.com", "example.net", "example.org"]
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    fits = [F.when((F.col("host") == d) | F.endswith(F.col("host"), F.lit("." + d)), d) for d in domains]
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(host.alias("host")).select(F.coalesce(*fits, F.lit("none")).alias("platform")).groupBy("platform").agg(F.count("*").alias("n"))


QUERIES["host_resolve"] = _hosts
SQL["host_resolve"] = """SELECT platform, count(*) AS n FROM (SELECT CASE WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'example.com' WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 'example.net'
  WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 'example.org' ELSE 'none' END AS platform FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)) GROUP BY platform"""
