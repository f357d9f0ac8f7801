"""Restoring texts by rules made from a mapping, owner by owner, and the way back.

A mapping belongs to somebody: a rule only ever meets texts of its own owner, so no value and no part of a name comes up
in another's text. All rules of a text are matched in one pass from left to right, the longest first where several begin
at one place; what a rule has put in is not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.functions.io import sent_if_small
from redactory.operators.rules import MASKABLE_TYPES

NO_RULES = "CAST(array() AS array<struct<n:int,pattern:string,seek:string,put:string>>)"
#: Rules that are sent to all workers; bits that tell heads of more rules from other words (16 MB).
MOST_SENT, _BITS = 200_000, 1 << 27
_TOKENS = "regexp_extract_all({}, '([A-Za-z0-9]+)', 1)"


def with_owner(df: DataFrame) -> DataFrame:
    """df with an owner; what has none belongs to one and the same."""
    return df if "owner" in df.columns else df.withColumn("owner", F.lit(""))


def owned(findings: DataFrame, table: DataFrame) -> DataFrame:
    """(owner, real, type, fake, first, last): the part of a mapping that each owner's findings (owner, id, type, value, start) made."""
    found = findings.where(F.col("type").isin(*MASKABLE_TYPES) & (F.col("value") != ""))
    at = F.struct("id", "start")
    seen = found.groupBy("owner", F.col("value").alias("real")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return seen.join(sent_if_small(table.select("real", "type", "fake")), "real").select("owner", "real", "type", "fake", "first", "last")


def restore_rules(table: DataFrame, direction: str = "unmask", ambiguous: str = "none") -> DataFrame:
    """(owner, seek, put, pattern, n, head) from a mapping (real, type, fake, and owner if it has one).

    direction: 'unmask' seeks fakes and puts real values, 'mask' the other way. Names also give a rule for each of their
    words. What one owner's mapping gives several values for, such as the stand-in that all secrets share, gets no rule;
    with ambiguous='last' it gets the value seen last, and a part of a name that seen first (needs columns first and last).
    head is the run of letters and digits in seek that the fewest rules share, '' if it has none.
    """
    seek, put = ("fake", "real") if direction == "unmask" else ("real", "fake")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    table = with_owner(table)
    rank = ["first", "last"] if ambiguous == "last" else []
    whole = table.select("owner", F.col(seek).alias("seek"), F.col(put).alias("put"), F.lit(0).alias("part"), *rank)
    names = table.where("type = 'NAME_PII'").select("owner", words(seek).alias("f"), words(put).alias("r"), *rank).where("size(f) = size(r) AND size(f) > 1")
    parts = names.select("owner", F.explode(F.arrays_zip("f", "r")).alias("x"), *rank).select("owner", F.col("x.f").alias("seek"), F.col("x.r").alias("put"), F.lit(1).alias("part"), *rank).where("length(seek) > 1")
    one = whole.unionByName(parts).where("seek <> ''").groupBy("owner", "seek", "part")
    if rank:
        one = one.agg(F.max_by("put", "last").alias("w"), F.min_by("put", "first").alias("p")).select("owner", "seek", "part", F.when(F.col("part") == 0, F.col("w")).otherwise(F.col("p")).alias("put"))
    else:
        one = one.agg(F.min("put").alias("put"), F.max("put").alias("_other")).withColumn("put", F.when(F.col("put") == F.col("_other"), F.col("put")))
    # a whole value goes before a part of a name that reads the same
    rules = one.groupBy("owner", "seek").agg(F.min_by(F.struct("put"), "part").alias("p")).select("owner", "seek", "p.put").where("put IS NOT NULL")
    quoted = F.transform(words("seek"), lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\/-])", r"\\$1"))
    made = rules.select("owner", "seek", "put", F.array_join(quoted, r"[\s,]+").alias("pattern"), F.length("seek").alias("n"))
    tokens = rules.select("owner", "seek", F.explode(F.array_distinct(F.expr(_TOKENS.format("seek")))).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("c"))
    heads = tokens.join(common, "token").groupBy("owner", "seek").agg(F.min(F.struct("c", "token"))["token"].alias("head"))
    return made.join(heads, ["owner", "seek"], "left").withColumn("head", F.coalesce("head", F.lit("")))


def _likely(words: DataFrame, heads: DataFrame) -> DataFrame:
    """words (head, ...) of which the head may be one of heads, by a bitmap of ``_BITS`` hashes that is sent to all workers."""
    at = lambda: F.pmod(F.xxhash64("head"), F.lit(_BITS))
    maps = heads.select(at().alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))
    placed = words.withColumn("_at", at()).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(maps), "_bucket")
    byte = "CAST(conv(hex(substring(_bits, CAST(bitmap_bit_position(_at) div 8 + 1 AS INT), 1)), 16, 10) AS INT)"
    return placed.where(f"shiftright({byte}, CAST(bitmap_bit_position(_at) % 8 AS INT)) & 1 = 1").select(*words.columns)


def fitting_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rules) for texts (id, t, owner): rules of their owner of which the head is a word of the text, the longest first.

    Few rules are sent to the texts; else words are sent only if they are likely the head of some rule. Rules without letters and
    digits meet their owner's texts.
    """
    texts, rules = with_owner(texts), with_owner(rules)
    words = texts.select("owner", "id", F.explode(F.array_distinct(F.expr(_TOKENS.format("t")))).alias("head"))
    entry = F.struct((-F.col("n")).alias("n"), "pattern", "seek", "put")
    headed = rules.where("head <> ''")
    if headed.limit(MOST_SENT + 1).count() <= MOST_SENT:
        headed = F.broadcast(headed)
    else:
        words = _likely(words, headed)
    fits = words.join(headed, ["owner", "head"]).select("id", entry.alias("r"))
    bare = rules.where("head = ''")
    if not bare.isEmpty():
        plain = texts.select("owner", "id", "t").join(sent_if_small(bare), "owner").where("contains(t, regexp_extract(seek, '\\\\S+', 0))")
        fits = fits.unionByName(plain.select("id", entry.alias("r")))
    return fits.groupBy("id").agg(F.sort_array(F.collect_list("r")).alias("rules"))


def restore_by_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """texts (id, t, owner) with restored and hits, what was sought and found. A null text stays null and has no hits."""
    out = texts.join(fitting_rules(texts, rules), "id", "left").withColumn("rules", F.expr(f"coalesce(rules, {NO_RULES})"))
    any_rule = r"concat('(?<![A-Za-z0-9])(?:', array_join(transform(rules, r -> r.pattern), '|'), ')(?![A-Za-z0-9])')"
    out = out.withColumn("_any", F.expr(f"CASE WHEN size(rules) > 0 THEN {any_rule} END"))
    # of the rules, longest first, the one that matched is the first that fits the whole match
    used = r"transform(regexp_extract_all(t, _any, 0), m -> element_at(filter(rules, r -> m RLIKE concat('\\A(?:', r.pattern, ')\\z')), 1))"
    out = out.withColumn("_used", F.expr(f"CASE WHEN _any IS NULL OR t IS NULL THEN CAST(array() AS {NO_RULES.partition(' AS ')[2][:-1]}) ELSE {used} END"))
    pieces = "zip_with(split(t, _any, -1), concat(transform(_used, r -> r.put), array('')), (g, p) -> concat(g, p))"
    restored = F.expr(f"CASE WHEN size(_used) = 0 THEN t ELSE array_join({pieces}, '') END")
    return out.select(*texts.columns, restored.alias("restored"), F.expr("array_distinct(transform(_used, r -> r.seek))").alias("hits"))


def restore_sql(texts: str, table: str, direction: str = "unmask") -> str:
    """DuckDB twin of restore_by_rules for texts (owner, id, t) and a mapping (owner, real, type, fake): id, restored, hits.

    Found by position: every place of every rule, from the left, the longest first. Gaps are taken as they stand.
    """
    seek, put = ("fake", "real") if direction == "unmask" else ("real", "fake")
    words = lambda c: f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"
    other = "regexp_matches(substr(t, {}, 1), '[A-Za-z0-9]')"
    return f"""WITH m AS MATERIALIZED ({table}), texts AS MATERIALIZED ({texts}),
      parts AS (SELECT owner, unnest({words(seek)}) AS seek, unnest({words(put)}) AS put FROM m WHERE type = 'NAME_PII' AND len({words(seek)}) = len({words(put)}) AND len({words(seek)}) > 1),
      every AS (SELECT owner, {seek} AS seek, {put} AS put, 0 AS part FROM m UNION ALL SELECT *, 1 FROM parts WHERE length(seek) > 1),
      one AS (SELECT owner, seek, part, CASE WHEN count(DISTINCT put) = 1 THEN min(put) END AS put FROM every GROUP BY 1, 2, 3),
      rules AS MATERIALIZED (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY owner, seek ORDER BY part) = 1),
      places AS (SELECT id, seek, put, unnest(list_filter(range(1, length(t) - length(seek) + 2), lambda i: substr(t, i, length(seek)) = seek AND NOT (i > 1 AND {other.format('i - 1')}) AND NOT {other.format('i + length(seek)')})) AS place
        FROM texts JOIN rules USING (owner) WHERE put IS NOT NULL AND contains(t, seek)),
      listed AS (SELECT id, list({{'place': place, 'seek': seek, 'put': put}} ORDER BY place ASC, -length(seek) ASC) AS ps FROM places GROUP BY id),
      folded AS (SELECT id, t, list_reduce(ps, lambda a, p: CASE WHEN p.place < a.upto THEN a ELSE {{'s': a.s || substr(t, a.upto, p.place - a.upto) || p.put, 'upto': p.place + length(p.seek), 'hits': list_append(a.hits, p.seek)}} END,
        {{'s': '', 'upto': CAST(1 AS BIGINT), 'hits': CAST([] AS VARCHAR[])}}) AS f FROM texts JOIN listed USING (id))
      SELECT id, f.s || substr(t, f.upto) AS restored, CAST(len(list_distinct(f.hits)) AS BIGINT) AS n_hits FROM folded UNION ALL SELECT id, t, 0 FROM texts WHERE id NOT IN (SELECT id FROM listed)"""
