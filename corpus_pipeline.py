"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written and read
again. All but the last return the columns of documents. Which row goes is decided by the operators' production
parameters. Operators see doc_id and text only under these names: other columns, whatever they are called, come back
as they were. Where doc_ids repeat or are null, stages that compare rows number them in a written copy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm.common import read_table, stored
from redactory.llm.decontaminate import contaminated
from redactory.llm.line_dedup import drop_lines
from redactory.llm.near_dedup import near_duplicates
from redactory.llm.packing import pack_documents, public_tokenizer
from redactory.llm.toxicity import fit_toxicity, score_toxicity


def keeps_columns(stage: Callable) -> Callable:
    """The stage sees columns other than doc_id and text under names that nothing else has."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = [n if n in ("doc_id", "text") else f"own_{i}_{n}" if n == "n_chars" else f"own_{i}" for i, n in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*names)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row_no, another for each row: the doc_id if it is one, else a number in a written copy."""
    n, n_ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return docs.withColumn("row_no", F.col("doc_id").cast("long")) if n == n_ids else stored(docs.withColumn("row_no", F.monotonically_increasing_id()))


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, labelled or not; the model learns from the labelled documents that came in.

    Each row is scored by itself, also one that repeats or has no doc_id; null and empty texts get the score of a text
    without words; without labels of both kinds all rows get the same score; an empty table gives none.
    """
    return score_toxicity(docs, fit_toxicity(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))).where("predicted = 0")


@keeps_columns
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in five documents or more stay in one. n_chars follows a changed text.

    All rows stay. A null or empty text has no line that is long enough and stays as it is; rows of one doc_id count as one
    document; rows without a doc_id keep their lines; an empty table gives none.
    """
    out = drop_lines(docs)
    counts = [c for c in docs.columns if c.endswith("_n_chars")]
    return out.withColumns({c: F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)) for c in counts})


@keeps_columns
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row with the least doc_id stays.

    Of rows that share a doc_id only those go whose own text is a copy, and of rows equal in both one stays. Texts without
    words are no copies, and a row without a doc_id stays; an empty table gives none.
    """
    rows = _numbered(docs)
    near = near_duplicates(rows.select(F.col("row_no").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("own_id")), width=5, percent=80, keep=["own_id"])
    near = stored(near.select(F.col("doc_id").alias("row_no"), "own_id", "component_id", (F.expr("n_shingles > 0") & F.col("own_id").isNotNull()).alias("judged")))
    keepers = near.where("judged").groupBy("component_id").agg(F.min(F.struct("own_id", "row_no"))["row_no"].alias("row_no"))
    return rows.join(keepers.select("row_no").unionByName(near.where("NOT judged").select("row_no")), "row_no", "left_semi")


@keeps_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go, each row by itself, with a doc_id or without.

    Null and empty texts hold nothing, and null and empty items are in nothing; an empty table gives none.
    """
    rows = _numbered(docs)
    found = contaminated(rows.select(F.col("row_no").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row_no")).distinct()
    return rows.join(found, "row_no", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: its token ids (little-endian, 32 bits each), and where they are in its document and in its sequence.

    A null or empty text is its end token; rows that repeat are packed each; a null doc_id is carried along; an empty table
    gives none.
    """
    return pack_documents(docs.select("doc_id", "text"), public_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Walks, signatures, segments and plans are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
