"""Queries over messages under review and a tagger's spans, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.functions.io import written
from redactory.operators import recogniser, views
from redactory.operators.detect import long_form, long_form_sql, resolve, resolve_sql, scan, scan_sql
from redactory.operators.masking import mapping, mapping_sql
from redactory.operators.rules import MASKABLE_TYPES
from redactory.sources.messages import messages, messages_sql

_SOURCE = f"SELECT msg_id AS id, t FROM ({messages_sql(True)})"
_FOUND = long_form_sql(resolve_sql(scan_sql(_SOURCE, ["id"]), ["id"]), ["id"])


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(F.col("msg_id").alias("id"), "t")


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages, and their review models by the mapping of them all."""
    scanned = written(resolve(scan(_texts(spark, sf_dir).withColumn("text", F.col("t")), "text")).withColumnRenamed("text", "t"))
    known = written(mapping(long_form(scanned.select("id", "findings"))))
    return scanned.select("id", "t"), views.review_model(scanned.select("id", "t"), views.review_items(scanned, known))


def review_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each mark stands in the real and in the masked view."""
    return views.marks(_model(spark, sf_dir)[1]).select("id", "type", "real", "fake", "real_start", "real_stop", "masked_start", "masked_stop")


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views after typing before and behind the message and masking its first word by hand."""
    texts, model = _model(spark, sf_dir)
    word = F.length(F.substring_index("t", " ", 1))
    rows = [(0, "edit", "real", F.lit(0), F.lit(0), "Re: "), (1, "edit", "masked", F.lit(1_000_000), F.lit(1_000_000), " [end]"), (2, "mask", "real", F.lit(4), word + 4, "[w]")]
    fields = [F.struct(F.lit(n).alias("seq"), F.lit(a).alias("action"), F.lit(v).alias("view"), x.cast("long").alias("start"), y.cast("long").alias("stop"), F.lit(s).alias("text"), F.lit(None).cast("string").alias("type")) for n, a, v, x, y, s in rows]
    actions = texts.select("id", F.explode(F.array(*fields)).alias("e")).select("id", "e.*")
    return views.shown_views(views.revised(model, actions)).select("id", "real", "masked", "n_marks")


def review_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.legend(views.marks(_model(spark, sf_dir)[1]))


def tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tagger might say of the messages' words, by rule: capitalised words are entities with scores that differ."""
    words = _texts(spark, sf_dir).select("id", F.posexplode(F.split("t", " ")).alias("pos", "token"))
    before = F.coalesce(F.sum(F.length("token") + 1).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = F.element_at(F.array(*map(F.lit, ("B-PER", "I-PER", "B-ORG", "I-LOC"))), ((F.length("token") + F.col("pos")) % 4 + 1).cast("int"))
    label = F.when(F.col("token").rlike("^[A-Z][a-z]+$"), kind).otherwise("O")
    return words.select("id", before.alias("start"), "token", label.alias("label"), (((F.col("id") * 31 + F.col("pos") * 17) % 128) / F.lit(128.0)).alias("score"))


def ner_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagger's findings that the rules do not have."""
    scanned = resolve(scan(_texts(spark, sf_dir), "t"))
    return recogniser.with_recogniser(scanned, tagged_tokens(spark, sf_dir)).where("source = 'nlp'").drop("source")


_TYPES = ", ".join(f"'{t}'" for t in MASKABLE_TYPES)
_MARKS = f"""found AS MATERIALIZED (SELECT r.id, t, r."type", r.label, r."value" AS real, r."start" + instr(substr(t, CAST(r."start" + 1 AS INT)), r."value") - 1 AS a FROM ({_FOUND}) r JOIN ({_SOURCE}) s USING (id) WHERE r."type" IN ({_TYPES}) AND r."value" <> ''),
  marks AS MATERIALIZED (SELECT f.*, m.fake, coalesce(sum(length(m.fake) - length(f.real)) OVER (PARTITION BY id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM found f JOIN ({mapping_sql(_FOUND)}) m ON m.real = f.real)"""
_SPLICED = f"""spliced AS (SELECT id, list_reduce(list({{'a': a, 'z': a + length(real), 'fake': fake}} ORDER BY a), lambda s, x: {{'s': s.s || substr(t, CAST(s.p + 1 AS INT), CAST(x.a - s.p AS INT)) || x.fake, 'p': x.z}}, {{'s': '', 'p': CAST(0 AS BIGINT)}}) AS o, t, count(*) AS n, min(a) AS first FROM marks GROUP BY id, t),
  shown AS (SELECT id, t, o.s || substr(t, CAST(o.p + 1 AS INT)) AS masked, n, first FROM spliced UNION ALL SELECT id, t, t, 0, 1000000 FROM ({_SOURCE}) WHERE id NOT IN (SELECT id FROM spliced))"""
_SPANS = f"""words AS (SELECT id, pos - 1 AS pos, token, sum(length(token) + 1) OVER (PARTITION BY id ORDER BY pos) - length(token) - 1 AS a FROM (SELECT id, unnest(string_split(t, ' ')) AS token, unnest(range(1, len(string_split(t, ' ')) + 1)) AS pos FROM ({_SOURCE}))),
  tagged AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-Z][a-z]+$') THEN ['B-PER', 'I-PER', 'B-ORG', 'I-LOC'][(length(token) + pos) % 4 + 1] ELSE 'O' END AS tag, ((id * 31 + pos * 17) % 128) / 128.0 AS score FROM words),
  cut AS (SELECT *, CASE WHEN tag LIKE 'B-%' OR right(tag, 3) <> lag(right(tag, 3), 1, '') OVER (PARTITION BY id ORDER BY a) THEN 1 ELSE 0 END AS begins FROM tagged),
  numbered AS (SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY a) AS no FROM cut),
  spans AS (SELECT id, right(any_value(tag), 3) AS g, string_agg(token, ' ' ORDER BY a) AS v, min(a) AS a FROM numbered WHERE tag <> 'O' GROUP BY id, no HAVING avg(score) >= 0.6),
  rules AS MATERIALIZED (SELECT id, "start" AS a, "start" + length("value") AS z FROM ({_FOUND}))"""

QUERIES = {"review_offsets": review_offsets, "review_actions": review_actions, "review_legend": review_legend, "ner_findings": ner_findings}
SQL = {
    "review_offsets": f'WITH {_MARKS} SELECT id, "type", real, fake, a AS real_start, a + length(real) AS real_stop, CAST(a + shift AS BIGINT) AS masked_start, CAST(a + shift + length(fake) AS BIGINT) AS masked_stop FROM marks',
    "review_actions": f"""WITH {_MARKS}, {_SPLICED} SELECT id, 'Re: ' || t || ' [end]' AS real, n + CASE WHEN first >= w THEN 1 ELSE 0 END AS n_marks,
      'Re: ' || CASE WHEN first >= w THEN '[w]' || substr(masked, w + 1) ELSE masked END || ' [end]' AS masked FROM (SELECT *, length(split_part(t, ' ', 1)) AS w FROM shown)""",
    "review_legend": f"WITH {_MARKS} SELECT label, count(*) AS n, min(id) AS first_id FROM marks GROUP BY label",
    "ner_findings": f"""WITH {_SPANS} SELECT id, CASE g WHEN 'PER' THEN 'NAME_PII' WHEN 'ORG' THEN 'BUSINESS_CONFIDENTIAL' ELSE 'ADDRESS' END AS "type",
      CASE g WHEN 'PER' THEN 'Person name (NLP)' WHEN 'ORG' THEN 'Organisation (NLP)' ELSE 'Location (NLP)' END AS label, v AS "value", CAST(a AS BIGINT) AS "start", CASE g WHEN 'ORG' THEN 'low' ELSE 'medium' END AS severity
      FROM spans s WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.id = s.id AND s.a < r.z AND s.a + length(s.v) > r.a)""",
}
