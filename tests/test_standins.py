"""Stand-ins: permutations of every type's space, a million names, and what an existing mapping holds."""

import re

import pytest
from pyspark.sql import functions as F

from redactory.functions.dialect import SPARK
from redactory.operators import masking, standins
from redactory.operators.masking import MASKABLE_TYPES, mapping


def by_rank(df):
    for columns in (standins.spaces(SPARK), {"h": standins.permuted(SPARK)}, {"l": "h[0]", "r": "h[1]", "lv": "rank div (fa * fb)"}):
        df = df.withColumns({c: F.expr(e) for c, e in columns.items()})
    return df.withColumn("fake", F.expr(standins.ranked(SPARK)))


def test_syllables_tell_names_apart():
    for starts, ends in (standins._GIVEN, standins._SURNAME):
        assert len(set(starts)) == len(starts) and len(set(ends)) == len(ends)
        assert not any(a != b and a.startswith(b) for a in starts for b in starts)
    made = {a + b for a, b in ((x, y) for x in standins._SURNAME[0] for y in standins._SURNAME[1])}
    assert not made & set(masking.LAST_NAMES)


@pytest.mark.parametrize("type_", ["BSB", "DOB", "ADDRESS"])
def test_a_space_is_used_up_before_anything_comes_again(spark, type_):
    """Every rank of the space once, and of the level above."""
    a, b = standins.SPACES[type_]
    n = a * b
    made = by_rank(spark.range(0, n + 1000).select(F.lit(type_).alias("type"), F.col("id").alias("rank")))
    got = made.agg(F.count_distinct("fake").alias("fakes"), F.count_distinct(F.when(F.col("lv") == 0, F.col("h"))).alias("places"), F.count("*").alias("n")).first()
    assert (got["fakes"], got["places"], got["n"]) == (n + 1000, n, n + 1000)


def test_ranks_of_every_type_differ_and_look_unlike_draws(spark):
    kinds = [t for t in MASKABLE_TYPES if t != "PASSWORD"]
    assert set(kinds) == set(standins.SPACES)
    made = by_rank(spark.range(20_000).select(F.explode(F.array(*map(F.lit, kinds))).alias("type"), F.col("id").alias("rank"))).select("type", "rank", "fake").toPandas()
    assert made.groupby("type")["fake"].nunique().eq(20_000).all() and made["fake"].nunique() == len(made)
    drawn = masking._faked(spark.range(20_000).select(F.explode(F.array(*map(F.lit, kinds))).alias("type"), F.col("id").cast("string").alias("real"), F.lit(0).alias("attempt")))
    assert not set(drawn.toPandas()["fake"]) & set(made["fake"])
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s.replace(" ", "")))) % 10
    assert all(luhn(s) == 0 and len(s) == 19 for s in made[made["type"] == "CREDIT_CARD"]["fake"])


def test_a_million_names_are_distinct_and_look_like_names(spark):
    names = spark.range(1_000_000).select("id", F.lit("NAME_PII").alias("type"), F.concat(F.lit("Person"), F.col("id").cast("string")).alias("value"), F.lit(0).alias("start"))
    table = mapping(names).cache()
    got = table.agg(F.count("*").alias("n"), F.count_distinct("real").alias("reals"), F.count_distinct("fake").alias("fakes"), F.count_if(~F.col("fake").rlike("^[A-Z][a-z]+ [A-Z][a-z]+(-[A-Z][a-z]+)?$")).alias("odd")).first()
    table.unpersist()
    assert tuple(got) == (1_000_000, 1_000_000, 1_000_000, 0)


def test_new_stand_ins_keep_clear_of_those_there_are(spark):
    """Also where some have been taken out again, so that ranks begin before the last one used."""
    names = spark.createDataFrame([(i, "NAME_PII", f"First{i} Last{i}", 0) for i in range(2500)], "id long, type string, value string, start long")
    first = mapping(names.where("id < 1500")).cache()
    less = first.where("abs(hash(real)) % 3 <> 0").cache()
    more = mapping(names, less).collect()
    kept = {r.real: r.fake for r in less.collect()}
    assert len(more) == 2500 - len(kept) and not {r.real for r in more} & kept.keys()
    assert len({r.fake for r in more} | set(kept.values())) == 2500
    assert not any(re.search(r"-[0-9a-f]{16}$", r.fake) for r in more)
