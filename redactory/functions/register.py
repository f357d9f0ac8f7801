"""SQL functions of the library for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from redactory.functions import checks
from redactory.functions.dialect import SPARK
from redactory.operators.detect import resolve_sql, scan_sql

_CHECKS = {"luhn_valid": checks.luhn, "tfn_valid": checks.tfn, "medicare_valid": checks.medicare, "abn_valid": checks.abn}


def _swapped(text: str, pairs: str) -> str:
    """The keys of a map replaced by its values, the longest first."""
    order = f"transform(sort_array(transform(map_keys({pairs}), k -> named_struct('n', -length(k), 'k', k))), x -> x.k)"
    return f"aggregate({order}, {text}, (a, k) -> CASE WHEN k = '' THEN a ELSE replace(a, k, element_at({pairs}, k)) END)"


def register(spark: SparkSession) -> list[str]:
    """Creates temporary SQL functions and returns their names.

    Checksums over digits; privacy_score(detected, masked, sent); scan_pii(text), a table of findings to be joined
    laterally; mask_text(text, real to fake) and restore_text(text, fake to real).
    """
    for name, check in _CHECKS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(digits STRING) RETURNS BOOLEAN RETURN {check(SPARK, 'digits')}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION privacy_score(detected BIGINT, masked BIGINT, sent BIGINT) RETURNS BIGINT RETURN CAST(least(100, greatest(0, 100 - sent * 12 - "
        "CASE WHEN detected > 0 AND masked / detected < 0.5 THEN floor((1 - masked / detected) * 10 + 0.5) ELSE 0 END)) AS BIGINT)"
    )
    for name in ("mask_text", "restore_text"):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(input STRING, pairs MAP<STRING, STRING>) RETURNS STRING RETURN {_swapped('input', 'pairs')}")
    found = resolve_sql(scan_sql("SELECT scan_pii.input AS t", [], None, SPARK), [], SPARK)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION scan_pii(input STRING) RETURNS TABLE(type STRING, label STRING, value STRING, start BIGINT, severity STRING) "
        f"RETURN SELECT f.type, f.label, f.value, f.start, f.severity FROM (SELECT explode_outer(findings) AS f FROM ({found})) WHERE f IS NOT NULL"
    )
    return [*_CHECKS, "privacy_score", "mask_text", "restore_text", "scan_pii"]
