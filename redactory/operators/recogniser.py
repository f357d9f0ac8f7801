"""Findings of a named-entity tagger: its tokens assembled into spans, gated by confidence, merged behind the rules'.

The tagger is not part of the library: its tokens come as a table (id, start, token, label, score), one row a token, with
labels O, B-PER, I-PER and so on, and word pieces marked by ##. It is off unless such a table is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.operators.detect import long_form
from redactory.operators.review import without_overlaps

#: Entity groups with the type, label and severity of their findings, and the confidence needed.
ENTITIES = {"PER": ("NAME_PII", "Person name (NLP)", "medium"), "ORG": ("BUSINESS_CONFIDENTIAL", "Organisation (NLP)", "low"), "LOC": ("ADDRESS", "Location (NLP)", "medium")}
GATE = 0.6


def assembled(tokens: DataFrame) -> DataFrame:
    """(id, type, label, value, start, severity, score, source) of the spans of tokens.

    A span begins with a B- label, or where the entity group differs from that of the token before; O ends one. Pieces are
    glued, words put one space apart; the score is the mean of the tokens', and a span without scores passes the gate. Groups
    that are not known give nothing. Spans are cut by a running count inside each text, so no text is gathered.
    """
    by_place = Window.partitionBy("id").orderBy("start", "token")
    group = F.regexp_replace(F.coalesce("label", F.lit("O")), "^[BI]-", "")
    marked = tokens.select("id", "start", "token", "label", "score", group.alias("_group"))
    begins = F.startswith(F.coalesce("label", F.lit("O")), F.lit("B-")) | ~F.col("_group").eqNullSafe(F.lag("_group").over(by_place))
    numbered = marked.withColumn("_span", F.sum(begins.cast("int")).over(by_place)).where(F.col("_group").isin(*ENTITIES))
    spans = numbered.groupBy("id", "_span", "_group").agg(F.min("start").alias("start"), F.avg("score").alias("score"), F.sort_array(F.collect_list(F.struct("start", "token"))).alias("ts"))
    word = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("ts", lambda t: t["token"]), " "), " ##", ""), "^##", "")
    kinds = {k: F.element_at(F.create_map(*[x for g, v in ENTITIES.items() for x in (F.lit(g), F.lit(v[i]))]), F.col("_group")) for i, k in enumerate(("type", "label", "severity"))}
    out = spans.select("id", kinds["type"].alias("type"), kinds["label"].alias("label"), F.trim(word).alias("value"), F.col("start").cast("long").alias("start"), kinds["severity"].alias("severity"), "score", F.lit("nlp").alias("source"))
    return out.where(f"(score IS NULL OR score >= {GATE}) AND value <> ''")


def with_recogniser(scanned: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """All findings of scanned (id, findings) as rows (id, type, label, value, start, severity, source), with the tagger's if there is one.

    A span of the tagger that overlaps a finding of the rules, or a span taken before it, is left out.
    """
    columns = ["id", "type", "label", "value", "start", "severity", "source"]
    found = long_form(scanned.select("id", "findings")).withColumn("source", F.lit("rules")).select(*columns)
    return found if tokens is None else found.unionByName(without_overlaps(assembled(tokens).select(*columns), found).select(*columns))
