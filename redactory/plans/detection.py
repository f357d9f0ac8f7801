"""Queries over findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.operators.detect import long_form, long_form_sql, resolve, resolve_sql, scan, scan_sql, sensitive
from redactory.operators.rules import RULES
from redactory.sources.messages import messages, messages_sql

QUERIES, SQL = {}, {}
_SOURCES = {
    "messages": (lambda s, d: messages(s, d).select(F.col("msg_id").alias("id"), "t"), f"SELECT msg_id AS id, t FROM ({messages_sql(True)})"),
    "documents": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("t")), "SELECT doc_id AS id, text AS t FROM documents"),
    # a licence in every text, as the tables themselves hold none
    "licensed_documents": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nDriver LICENCE no. "), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("t")), "SELECT doc_id AS id, coalesce(text, '') || chr(10) || 'Driver LICENCE no. ' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS t FROM documents"),
    "licensed_pages": (lambda s, d: s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.concat(F.lit("<p>license: AB"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("</p>"), F.coalesce("html", F.lit(""))).alias("t")), "SELECT page_id AS id, '<p>license: AB' || lpad(CAST(page_id AS VARCHAR), 6, '0') || '</p>' || coalesce(html, '') AS t FROM pages"),
    "pages": (lambda s, d: s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.col("html").alias("t")), "SELECT page_id AS id, html AS t FROM pages"),
}


def _detector(source: str, rules: list[str]):
    read, sql = _SOURCES[source]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long_form(scan(read(spark, sf_dir), "t", rules).select("id", "findings")).select("id", "value", "start", "severity")

    return query, f'SELECT id, "value", "start", severity FROM ({long_form_sql(scan_sql(sql, ["id"], rules), ["id"])})'


def _findings(source: str, resolved: bool = True):
    read, sql = _SOURCES[source]

    def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = scan(read(spark, sf_dir), "t").select("id", "findings")
        return resolve(out) if resolved else out

    found = scan_sql(sql, ["id"])
    return frame, resolve_sql(found, ["id"]) if resolved else found


for _rule in RULES:
    for _source in ("messages", "documents", "pages") if _rule.name in ("email", "credit_card", "password_kw", "licence") else ("messages",):
        _name = f"det_{_rule.name}" + ("" if _source == "messages" else f"_{_source}")
        _rules = ["phone_au", "phone_service", "phone_ctx"] if _rule.name == "phone_ctx" else [_rule.name]
        QUERIES[_name], SQL[_name] = _detector(f"licensed_{_source}" if _rule.name == "licence" and _source != "messages" else _source, _rules)


def _register(name: str, source: str, build, sql: str):
    frame, found = _findings(source)
    QUERIES[name] = lambda spark, sf_dir: build(frame(spark, sf_dir))
    SQL[name] = sql.format(found=found, rows=long_form_sql(found, ["id"]))


_ALL = ["id", "type", "label", "value", "start", "severity"]
for _source in ("messages", "documents"):
    _register(f"findings_resolved_{_source}", _source, lambda f: long_form(f).select(*_ALL), 'SELECT id, "type", label, "value", "start", severity FROM ({rows})')
_register(
    "findings_by_type", "messages",
    lambda f: long_form(f).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_texts"), F.min("value").alias("least_value"), F.min(F.struct("id", "start"))["id"].alias("first_id")),
    'SELECT "type", count(*) AS n, count(DISTINCT id) AS n_texts, min("value") AS least_value, min(id) AS first_id FROM ({rows}) GROUP BY "type"',
)
_register(
    "finding_groups", "messages",  # per text: types in the order they first occur, with label and count
    lambda f: long_form(f).groupBy("id", "type").agg(F.min_by("label", F.struct("start", "ord")).alias("label"), F.min("start").alias("first_start"), F.count("*").alias("n")),
    'SELECT id, "type", min_by(label, "start" * 100000000 + ord) AS label, min("start") AS first_start, count(*) AS n FROM ({rows}) GROUP BY id, "type"',
)
_register("sensitive_texts", "documents", lambda f: sensitive(f).select("id", "n_findings"), "SELECT id, CAST(len(findings) AS BIGINT) AS n_findings FROM ({found}) WHERE len(findings) > 0")
_register(
    "findings_by_severity", "messages", lambda f: long_form(f).groupBy("severity", "label").agg(F.count("*").alias("n")),
    "SELECT severity, label, count(*) AS n FROM ({rows}) GROUP BY severity, label",
)


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return long_form(resolve(scan(docs, "text").select("lang", "findings"))).groupBy("lang", "type").agg(F.count("*").alias("n"))


QUERIES["findings_by_lang"] = _by_lang
SQL["findings_by_lang"] = f'SELECT lang, "type", count(*) AS n FROM ({long_form_sql(resolve_sql(scan_sql("SELECT lang, text AS t FROM documents", ["lang"]), ["lang"]), ["lang"])}) GROUP BY lang, "type"'


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules over documents, by type."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return long_form(resolve(scan(docs).select("doc_id", "findings"))).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
