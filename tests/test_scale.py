"""Steps whose work a row must stay small: what is looked at in plans and steps, and that results stay."""

import re

from redactory.operators import detect
from redactory.operators.masking import mask
from redactory.operators.review import needs_no_scan
from redactory.sources.messages import messages


def test_typed_texts_meet_by_digest(spark):
    sent = spark.createDataFrame([(1, " a  b\n"), (2, "a b"), (3, None), (4, "x"), (4, "y")], "id long, t string")
    typed = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, ""), (4, "y"), (5, "z")], "id long, masked string")
    out = needs_no_scan(sent, typed)
    assert {tuple(r) for r in out.collect()} == {(1, " a  b\n"), (3, None), (4, "y")}
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line or "Sort" in line]
    assert joins and not any("regexp_replace" in line for line in joins)  # no text is normalised at a comparison


def test_message_keys_are_dealt_out(spark, tmp_path):
    spark.range(1000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    out = messages(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and out.count() == 1000


def test_rules_without_matches_are_skipped(spark):
    steps = detect._steps(detect.SPARK, list(range(len(detect.RULES))))
    found = {c: e for step in steps for c, e in step.items() if re.fullmatch(r"f\d+", c) and "transform" in e}
    assert len(found) == len(detect.RULES) and all(e.startswith(f"CASE WHEN size(g{c[1:]}) > 1 THEN") for c, e in found.items())
    assert all("regexp_replace(x.m, r'[^0-9]', '')" not in e for c, e in found.items() if detect.RULES[int(c[1:])].name in ("tfn", "medicare", "abn"))  # digits are taken once a match
    texts = ["nothing", "", None, "tax file 123 456 782 of Jane Doe, BSB 062-123"]
    got = detect.resolve(detect.scan(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))).orderBy("id").collect()
    assert [[(f.type, f.value, f.start) for f in r.findings] for r in got] == [[], [], [], [("TFN", "123 456 782", 9), ("NAME_PII", "Jane Doe", 24), ("BSB", "062-123", 38)]]


def test_masking_keeps_the_owner(spark):
    """So that owners need not be joined again."""
    scanned = detect.resolve(detect.scan(spark.createDataFrame([(1, 7, "write to a.b@c.org"), (2, 8, "nothing")], "id long, owner long, text string").selectExpr("*", "text AS t"))).withColumnRenamed("text", "t")
    table = spark.createDataFrame([("a.b@c.org", "EMAIL", "x@y.z")], "real string, type string, fake string")
    assert {(r.id, r.owner, r.masked) for r in mask(scanned, table).collect()} == {(1, 7, "write to x@y.z"), (2, 8, "nothing")}
