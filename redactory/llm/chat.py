"""Chat formatting: typed content parts flattened into one reversible training string (DataFrame functions only).

A visitor walks a turn's parts in order. Text is escaped; image, audio and document parts become placeholders, and
each leaves an attachment record with its reference and the tokens it will take once expanded.

Template of a turn: ``<|turn ROLE|>``, newline, parts joined by newlines, newline, ``</turn>``, newline. ROLE is
URL-encoded. Control strings inside texts get one more backslash in front (after any backslashes that stand there),
and reading takes one away; real control strings always follow a newline or the start, so none is mistaken.

Defined cases: null text or role is empty; null or empty parts give an empty turn; an unknown part type gets the
placeholder ``<|attachment|>`` and no tokens; turns tie-break by role, then by content; rows that repeat are turns of
their own; a null conv_id is a conversation like others; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import read_table

#: Tokens that one unit of an attachment takes: an image tile, a second of audio, a document page.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 512.0}
END = "\n</turn>\n"
_CONTROL = r"(<\|turn |</turn>|<\|image\|>|<\|audio\|>|<\|document\|>|<\|attachment\|>)"
PART = "array<struct<type:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + _CONTROL, "$1$2")


def _placeholder(kind: Column) -> Column:
    return F.when(kind.isin(*TOKENS_PER_UNIT), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(F.lit("<|attachment|>"))


def _visit(part: Column) -> Column:
    """What one part puts into the turn."""
    return F.when(F.coalesce(part["type"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(_placeholder(part["type"]))


def _attachment(part: Column) -> Column:
    rate = F.coalesce(*[F.when(part["type"] == k, F.lit(v)) for k, v in TOKENS_PER_UNIT.items()], F.lit(0.0))
    return F.struct(part["type"].alias("type"), part["ref"].alias("ref"), F.ceil(F.coalesce(part["units"], F.lit(0.0)) * rate).cast("long").alias("n_tokens"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation from rows (conv_id, turn, role, parts).

    Returns conv_id, formatted, loss (for each turn the span of its content if it is under the loss, else null),
    attachments in order and n_attachment_tokens. A conversation is one output row, so it must fit in one; only the
    rendered turns are gathered, the offsets come from a running sum on the same partitioning.
    """
    parts = F.coalesce(F.col("parts"), F.expr(f"CAST(array() AS {PART})"))
    rendered = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, _visit), "\n").alias("body"),
        F.transform(F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text"), _attachment).alias("attached"),
    ).withColumn("head", F.concat(F.lit("<|turn "), F.url_encode("role"), F.lit("|>\n")))
    listed = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "attached", "head"))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    span = F.transform("ts", lambda t: F.when(t["role"] == "assistant", F.struct(F.length(t["head"]).alias("skip"), F.length(t["body"]).alias("length"))))
    attached = F.flatten(F.transform("ts", lambda t: t["attached"]))
    out = listed.select("conv_id", text.alias("formatted"), span.alias("loss"), attached.alias("attachments"))
    return out.withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns again, from nothing but ``formatted`` and ``loss``: adds turns array<struct<role, text, under_loss>>.

    under_loss is the part of the turn that the loss span covers, unescaped, or null.
    """
    pieces = F.split("formatted", END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column, span: Column) -> Column:
        role = F.url_decode(F.regexp_extract(piece, r"\A<\|turn ([^|]*)\|>\n", 1))
        return F.struct(
            role.alias("role"),
            unescape(F.regexp_replace(piece, r"\A<\|turn [^|]*\|>\n", "")).alias("text"),
            F.when(span.isNotNull(), unescape(F.substring(piece, span["skip"] + 1, span["length"]))).alias("under_loss"),
        )

    return formatted.withColumn("turns", F.zip_with(pieces, "loss", turn))


def text_parts(text: Column) -> Column:
    """A plain text as the single part of its turn."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("double").alias("units")))


PROBE = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    back = read_back(format_conversations(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("turns", lambda t: F.coalesce(t["under_loss"], F.lit(""))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"), F.sha2(under.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPED = "regexp_replace(coalesce(text, ''), '(<\\|turn |</turn>|<\\|image\\|>|<\\|audio\\|>|<\\|document\\|>|<\\|attachment\\|>)', '\\\\\\1', 'g')"
OP7_SQL = f"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length({_SQL_ESCAPED}) + 7 + length(url_encode(role)) + 3 + 9) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
