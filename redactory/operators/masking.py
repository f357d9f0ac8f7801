"""Masking findings with stand-ins and restoring them.

A stand-in is an expression over the type and the real value: the seed is a hash of both, so runs agree. One mapping
table holds real and fake. A real value that would share a fake with another draws again once; if that is taken too, it
gets a stand-in by its rank from a larger pool (see ``standins``), so that every fake stands for one value and can be restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.dialect import DUCK, SPARK
from redactory.functions.io import sent_if_small, written
from redactory.operators import standins
from redactory.operators.detect import long_form
from redactory.operators.rules import MASKABLE_TYPES

#: Pools that stand-ins are drawn from.
FIRST_NAMES = ["David", "Emma", "Liam", "Olivia", "Noah", "Ava", "Jack", "Mia", "Lucas", "Chloe", "Ethan", "Grace", "Oliver", "Sophie", "Henry", "Ruby"]
LAST_NAMES = ["Clarke", "Walker", "Bennett", "Hughes", "Foster", "Reid", "Murphy", "Marshall", "Coleman", "Newman", "Dawson", "Fletcher", "Barker", "Wells"]
STREET_NAMES = ["Oak", "Maple", "Cedar", "Birch", "Elm", "Willow", "Acacia", "Banksia", "Wattle", "Jacaranda", "Eucalypt", "Hibiscus"]
STREET_TYPES = ["Ave", "St", "Rd", "Cres", "Pde", "Ct", "Dr"]
CITIES = ["Melbourne", "Brisbane", "Perth", "Adelaide", "Hobart", "Canberra", "Newcastle", "Geelong", "Cairns", "Darwin"]
EMAIL_DOMAINS = ["placeholder.com", "example.com.au", "sample.net"]
_MULTIPLIER, _INCREMENT = 1103515245, 12345


def seed(d, type_: str, real: str, attempt: str = "0") -> str:
    return d.hash32(f"concat({type_}, ':', {real}, ':', {d.string(attempt)})")


def drawn_digits(d, start: str, n: int) -> str:
    """n digits of a linear congruential sequence modulo 2**32."""
    first = f"(CASE WHEN {start} = 0 THEN 1 ELSE {start} END)"
    states = d.fold(d.count_to(n), d.array(f"CAST({first} AS BIGINT)"), "a", "i", d.append("a", f"({d.last('a')} * {_MULTIPLIER} + {_INCREMENT}) % 4294967296"))
    return d.join(d.transform(d.tail(states), "v", d.string(f"{d.div('v', '65536')} % 10")))


def _part(at: int, n: int) -> str:
    return f"substring(dg, {at}, {n})"


def _card(d) -> str:
    body = f"concat('4', {_part(1, 14)})"
    digit = lambda i: f"CAST(substring({body}, {i}, 1) AS INT)"
    total = " + ".join(f"(({digit(i)} * 2) % 10 + {d.div(f'{digit(i)} * 2', '10')})" if i % 2 else digit(i) for i in range(1, 16))
    full = f"concat({body}, {d.string(f'(10 - ({total}) % 10) % 10')})"
    return "concat(" + ", ' ', ".join(f"substring({full}, {i}, 4)" for i in (1, 5, 9, 13)) + ")"


def _shift(d, bits: int) -> str:
    return d.div("sd", str(1 << bits))


def _money(d) -> str:
    number = f"coalesce({d.number(d.replace_all('real', '[^0-9.]', chr(39) * 2))}, 10000)"
    unit = "(CASE WHEN lower(real) LIKE '%billion%' THEN 1000000000 WHEN lower(real) LIKE '%million%' THEN 1000000 ELSE 1 END)"
    fake = f"greatest(1000, CAST(floor({number} * {unit} * (0.8 + (sd % 400) / CAST(1000 AS DOUBLE)) + 0.5) AS BIGINT))"
    tenths = lambda scale: f"CAST(floor({fake} / CAST({scale} AS DOUBLE) * 10 + 0.5) AS BIGINT)"
    short = lambda scale: d.replace_all(f"concat({d.string(d.div(tenths(scale), '10'))}, '.', {d.string(f'{tenths(scale)} % 10')})", r"\.0$", "''")
    grouped = f"format_number({fake}, 0)" if d.name == "spark" else f"format('{{:,}}', {fake})"
    return f"(CASE WHEN lower(real) LIKE '%billion%' THEN concat('$', {short(10**9)}, ' billion') WHEN lower(real) LIKE '%million%' THEN concat('$', {short(10**6)}, ' million') ELSE concat('$', {grouped}) END)"


def stand_in(d) -> str:
    """The fake value over columns type, real, sd (seed) and dg (15 drawn digits)."""
    lat, lng = "(3300 + sd % 400)", f"(14400 + {_shift(d, 7)} % 700)"
    lat_text = d.replace_all(f"concat('-', {d.string(d.div(lat, '100'))}, '.', {d.pad(f'{lat} % 100', 2)})", r"\.?0+$", "''")
    lat_text = f"(CASE WHEN {lat} % 100 = 0 THEN concat('-', {d.string(d.div(lat, '100'))}) ELSE {lat_text} END)"
    letter = f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(sd % 26 AS INT) + 1, 1)"  # noqa: F541
    n_digits = f"length({d.replace_all('real', '[^0-9]', chr(39) * 2)})"
    cases = {
        "EMAIL": f"concat(lower({d.pick(FIRST_NAMES, 'sd')}), '.', lower({d.pick(LAST_NAMES, _shift(d, 7))}), {d.string(f'{_shift(d, 11)} % 100')}, '@', {d.pick(EMAIL_DOMAINS, _shift(d, 3))})",
        "PHONE": f"concat('04', {_part(1, 2)}, ' ', {_part(3, 3)}, ' ', {_part(6, 3)})",
        "CREDIT_CARD": _card(d),
        "MEDICARE": f"concat('2', {_part(1, 3)}, ' ', {_part(4, 5)}, ' ', {_part(9, 1)})",
        "TFN": f"concat({_part(1, 3)}, ' ', {_part(4, 3)}, ' ', {_part(7, 3)})",
        "ACN": f"concat({_part(1, 3)}, ' ', {_part(4, 3)}, ' ', {_part(7, 3)})",
        "PASSPORT": f"concat({letter}, {_part(1, 7)})",
        "LICENCE": _part(1, 8),
        "BSB": f"concat({_part(1, 3)}, '-', {_part(4, 3)})",
        "BANK_ACCOUNT": f"substring(dg, 1, CAST(CASE WHEN {n_digits} = 0 THEN 8 ELSE {n_digits} END AS INT))",
        "ABN": f"concat({_part(1, 2)}, ' ', {_part(3, 3)}, ' ', {_part(6, 3)}, ' ', {_part(9, 3)})",
        "DOB": f"concat({d.pad('sd % 28 + 1', 2)}, '/', {d.pad(f'{_shift(d, 5)} % 12 + 1', 2)}, '/', {d.string(f'1960 + {_shift(d, 9)} % 45')})",
        "GPS": f"concat({lat_text}, ', ', {d.string(d.div(lng, '100'))}, '.', {d.pad(f'{lng} % 100', 2)}, '00')",
        "MONEY": _money(d),
        "ADDRESS": f"concat({d.string('sd % 200 + 1')}, ' ', {d.pick(STREET_NAMES, _shift(d, 2))}, ' ', {d.pick(STREET_TYPES, _shift(d, 4))}, ' ', {d.pick(CITIES, _shift(d, 6))})",
        "PASSWORD": "'[redacted-secret]'",
        "NAME_PII": f"concat({d.pick(FIRST_NAMES, 'sd')}, ' ', {d.pick(LAST_NAMES, _shift(d, 3))})",
    }
    return "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " ELSE '[redacted]' END"


def _faked(values: DataFrame) -> DataFrame:
    """values (real, type, attempt) with fake."""
    out = values.withColumn("sd", F.expr(seed(SPARK, "type", "real", "attempt"))).withColumn("dg", F.expr(drawn_digits(SPARK, "sd", 15)))
    return out.withColumn("fake", F.expr(stand_in(SPARK))).drop("sd", "dg")


def _owners(drawn: DataFrame, *taken: DataFrame) -> DataFrame:
    """(real, type, fake): the least real value of each fake that is not taken."""
    out = drawn.groupBy("fake").agg(F.min(F.struct("real", "type")).alias("o")).select("o.real", "o.type", "fake")
    for t in taken:
        out = out.join(t.select("fake"), "fake", "left_anti")
    return out.select("real", "type", "fake")


def _ranked(values: DataFrame) -> DataFrame:
    """values (real, type) with rank, from 0 in each type, in the order of a hash.

    Runs of hashes are numbered each by itself after those before them; only the runs' sizes meet in one place.
    """
    hashed = values.withColumn("_h", F.md5(F.col("real").cast("binary"))).withColumn("_run", F.substring("_h", 1, 4))
    sizes = hashed.groupBy("type", "_run").agg(F.count("*").alias("_n"))  # at most 65,536 a type
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("type").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("type", "_run").orderBy("_h", "real"))
    out = hashed.withColumn("_no", inside).join(sizes.select("type", "_run", before.alias("_before")), ["type", "_run"])
    return out.select("real", "type", (F.col("_no") + F.col("_before") - 1).cast("long").alias("rank"))


def _by_rank(values: DataFrame, existing: DataFrame | None) -> DataFrame:
    """values (real, type) with fakes by rank, none of which ``existing`` has: ranks begin after as many as it knows of a type."""
    used = None if existing is None else existing.groupBy("type").agg(F.count("*").alias("_used"))  # a row a type
    done, left, step = [], values, 0
    while True:
        ranked = _ranked(left)
        if used is not None:
            ranked = ranked.join(F.broadcast(used), "type", "left").withColumn("rank", F.col("rank") + F.coalesce("_used", F.lit(0)) + step).drop("_used")
        for columns in (standins.spaces(SPARK), {"h": standins.permuted(SPARK)}, {"l": "h[0]", "r": "h[1]", "lv": "rank div (fa * fb)"}):
            ranked = ranked.withColumns({c: F.expr(e) for c, e in columns.items()})
        made = ranked.select("real", "type", F.expr(standins.ranked(SPARK)).alias("fake"))
        if existing is None:
            return made
        made = written(made)
        known = existing.select("fake").distinct()
        done.append(made.join(known, "fake", "left_anti").select("real", "type", "fake"))
        taken = made.join(known, "fake", "left_semi").select("real", "type")
        if taken.isEmpty():
            break
        left, step = taken, step + made.count()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def mapping(findings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(real, type, fake) for the maskable findings (id, type, value, start): one row a real value, no fake twice.

    A secret's fake is a constant and never told apart. Values that ``existing`` maps keep their fakes and are not
    returned, and no new fake is one of those. Only aggregations and joins on values: no group is gathered.
    """
    found = findings.where(F.col("type").isin(*MASKABLE_TYPES) & (F.col("value") != ""))
    reals = found.groupBy(F.col("value").alias("real")).agg(F.min_by("type", F.struct("id", "start")).alias("type"))
    if existing is not None:
        reals = reals.join(existing.select("real"), "real", "left_anti")
    drawn = written(_faked(reals.withColumn("attempt", F.lit(0))))
    taken = [] if existing is None else [existing]
    told_apart = drawn.where("type <> 'PASSWORD'")
    first = written(_owners(told_apart, *taken))
    left = told_apart.join(first.select("real"), "real", "left_anti").select("real", "type")
    second = written(_owners(_faked(left.withColumn("attempt", F.lit(1))), first, *taken))
    rest = _by_rank(left.join(second.select("real"), "real", "left_anti").select("real", "type"), existing)
    return first.unionByName(second).unionByName(rest).unionByName(drawn.where("type = 'PASSWORD'").select("real", "type", "fake"))


def mapping_sql(findings: str, existing: str | None = None) -> str:
    """DuckDB twin of mapping."""
    types = ", ".join(f"'{t}'" for t in MASKABLE_TYPES)
    known = f"ex AS MATERIALIZED ({existing})" if existing else "ex AS (SELECT '' AS real, '' AS type, '' AS fake WHERE false)"
    reals = f'SELECT "value" AS real, arg_min("type", id * 100000 + "start") AS type FROM ({findings}) WHERE "type" IN ({types}) AND "value" <> \'\' AND "value" NOT IN (SELECT real FROM ex) GROUP BY "value"'

    def faked(q: str) -> str:
        seeded = f"SELECT *, {seed(DUCK, 'type', 'real', 'attempt')} AS sd FROM ({q})"
        return f"SELECT real, type, attempt, {stand_in(DUCK)} AS fake FROM (SELECT *, {drawn_digits(DUCK, 'sd', 15)} AS dg FROM ({seeded}))"

    own = "SELECT min(real) AS real, arg_min(type, real) AS type, fake FROM {0} WHERE type <> 'PASSWORD' AND fake NOT IN (SELECT fake FROM ex){1} GROUP BY fake"
    rest = "SELECT real, type FROM drawn WHERE type <> 'PASSWORD' AND real NOT IN (SELECT real FROM one) AND real NOT IN (SELECT real FROM two)"
    rank = f"SELECT real, type, row_number() OVER (PARTITION BY type ORDER BY md5(real), real) - 1 + (SELECT count(*) FROM ex WHERE ex.type = x.type) AS rank FROM ({rest}) x"
    columns = ", ".join(f"{e} AS {c}" for c, e in standins.spaces(DUCK).items())
    ranked = f"SELECT real, type, {standins.ranked(DUCK)} AS fake FROM (SELECT *, h[1] AS l, h[2] AS r, rank // (fa * fb) AS lv FROM (SELECT *, {standins.permuted(DUCK)} AS h FROM (SELECT *, {columns} FROM ({rank}))))"
    first, second = own.format("drawn", ""), own.format("again", " AND fake NOT IN (SELECT fake FROM one)")
    return f"""WITH {known}, drawn AS MATERIALIZED ({faked(f"SELECT *, 0 AS attempt FROM ({reals})")}), one AS MATERIALIZED ({first}),
      again AS MATERIALIZED ({faked("SELECT real, type, 1 AS attempt FROM drawn WHERE type <> 'PASSWORD' AND real NOT IN (SELECT real FROM one)")}), two AS MATERIALIZED ({second})
      SELECT real, type, fake FROM one UNION ALL SELECT real, type, fake FROM two UNION ALL SELECT real, type, fake FROM drawn WHERE type = 'PASSWORD'
      UNION ALL ({ranked})"""


def preview(values: DataFrame, existing: DataFrame) -> DataFrame:
    """values (real, type) with the fake each would get, registered nowhere: the known one, or a draw that is not taken."""
    known = values.join(existing.select("real", F.col("fake").alias("known")), "real", "left")
    drawn = _faked(known.withColumn("attempt", F.lit(0))).withColumnRenamed("fake", "one")
    drawn = _faked(drawn.withColumn("attempt", F.lit(1))).withColumnRenamed("fake", "two").drop("attempt")
    taken = existing.select(F.col("fake").alias("one"), F.lit(True).alias("is_taken")).distinct()
    return drawn.join(taken, "one", "left").select("real", "type", F.coalesce("known", F.when(F.col("is_taken"), F.col("two")).otherwise(F.col("one"))).alias("fake"))


def registered(existing: DataFrame, pairs: DataFrame) -> DataFrame:
    """existing and pairs (real, fake, type); a real value that is known keeps its fake, a missing type is CUSTOM."""
    new = pairs.groupBy("real").agg(F.min(F.struct("fake", F.coalesce("type", F.lit("CUSTOM")).alias("type"))).alias("p")).join(existing.select("real"), "real", "left_anti")
    return existing.select("real", "type", "fake").unionByName(new.select("real", "p.type", "p.fake"))


def unregistered(existing: DataFrame, reals: DataFrame) -> DataFrame:
    return existing.join(reals.select("real"), "real", "left_anti")


def changed(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """existing with the fakes of changes (real, fake), also for values that were not known."""
    types = existing.select("real", "type")
    return registered(unregistered(existing, changes), changes.join(types, "real", "left"))


def pruned(log: DataFrame, fakes: DataFrame) -> DataFrame:
    """log (kind, fake, ...) without the mask entries of these fakes."""
    return log.join(fakes.select("fake", F.lit("mask").alias("kind")).distinct(), ["kind", "fake"], "left_anti").select(*log.columns)


def mask(scanned: DataFrame, table: DataFrame) -> DataFrame:
    """(id, t, findings, ...) and a mapping -> id, t, ..., masked, swaps.

    Findings are spliced from left to right; one whose place is not where its value is (a licence number is placed at
    its keyword) is replaced wherever the value stands.
    """
    swaps = long_form(scanned.select("id", "findings")).where(F.col("type").isin(*MASKABLE_TYPES)).join(sent_if_small(table.select(F.col("real").alias("value"), "fake")), "value")
    listed = swaps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "value", "fake", "type"))).alias("swaps"))
    out = scanned.drop("findings").join(listed, "id", "left").withColumn("swaps", F.coalesce("swaps", F.expr("CAST(array() AS array<struct<start:bigint,value:string,fake:string,type:string>>)")))
    here = "substring(t, CAST(x.start + 1 AS INT), length(x.value)) = x.value"
    splice = f"""aggregate(filter(swaps, x -> {here}), named_struct('s', '', 'p', CAST(0 AS BIGINT)),
        (a, x) -> named_struct('s', concat(a.s, substring(t, CAST(a.p + 1 AS INT), CAST(x.start - a.p AS INT)), x.fake), 'p', x.start + length(x.value)),
        a -> concat(a.s, substring(t, CAST(a.p + 1 AS INT))))"""
    spliced = out.withColumn("masked", F.expr(splice))
    return spliced.withColumn("masked", F.expr(f"aggregate(filter(swaps, x -> NOT ({here})), masked, (a, x) -> replace(a, x.value, x.fake))"))


def restore_literal(masked: DataFrame) -> DataFrame:
    """masked texts with their swaps -> restored: each fake replaced by its real value, the longest first."""
    order = "transform(sort_array(transform(array_distinct(transform(swaps, x -> named_struct('fake', x.fake, 'value', x.value))), x -> named_struct('n', -length(x.fake), 'x', x))), y -> y.x)"
    return masked.withColumn("restored", F.expr(f"aggregate({order}, masked, (a, x) -> replace(a, x.fake, x.value))"))


def mask_sql(scanned: str, table: str) -> str:
    """DuckDB twin of mask and restore_literal: id, t, masked, n_swaps, restored."""
    types = ", ".join(f"'{t}'" for t in MASKABLE_TYPES)
    here = "substr(t, CAST(x.start + 1 AS INT), CAST(length(x.value) AS INT)) = x.value"
    splice = f"list_reduce(list_filter(swaps, lambda x: {here}), lambda a, x: {{'s': a.s || substr(t, a.p + 1, x.start - a.p) || x.fake, 'p': x.start + length(x.value)}}, {{'s': '', 'p': CAST(0 AS BIGINT)}})"
    return f"""WITH scanned AS MATERIALIZED ({scanned}), pairs AS MATERIALIZED ({table}),
      listed AS (SELECT id, list_sort(list({{'start': f.start, 'value': f.value, 'fake': fake, 'type': f.type}})) AS swaps FROM (SELECT id, unnest(findings) AS f FROM scanned) JOIN pairs ON pairs.real = f.value WHERE f.type IN ({types}) GROUP BY id),
      spliced AS (SELECT id, t, swaps, {splice} AS p FROM scanned JOIN listed USING (id)),
      masked AS (SELECT id, t, swaps, list_reduce(list_filter(swaps, lambda x: NOT ({here})), lambda a, x: replace(a, x.value, x.fake), p.s || substr(t, p.p + 1)) AS masked FROM spliced
        UNION ALL SELECT id, t, [], t FROM scanned WHERE id NOT IN (SELECT id FROM listed)),
      ordered AS (SELECT *, list_sort(list_distinct(list_transform(swaps, lambda x: {{'n': -length(x.fake), 'fake': x.fake, 'value': x.value}}))) AS back FROM masked)
      SELECT id, t, masked, CAST(len(swaps) AS BIGINT) AS n_swaps, list_reduce(back, lambda a, x: replace(a, x.fake, x.value), masked) AS restored FROM ordered"""


#: Patterns of this many characters and more are found by a run of so many; shorter ones by themselves.
GRAM = 8


def _grams(text: str, q: int) -> Column:
    """All runs of q characters, by a look ahead at every place: linear in the text."""
    return F.array_distinct(F.expr(f"regexp_extract_all({text}, '(?s)(?=(.{{{q}}}))', 1)"))


def texts_with_fakes(texts: DataFrame, fakes: DataFrame) -> DataFrame:
    """texts (id, t) in which a fake stands, anywhere in it; an id is one text.

    Each fake is filed under its rarest run of ``GRAM`` characters (as rare among the fakes), a shorter one under itself.
    Texts meet fakes by an equi-join on their own runs, and what meets is looked at exactly. A null text has no fakes, and an
    empty fake stands nowhere.
    """
    wanted = written(fakes.select("fake").where("fake <> ''").distinct().withColumn("q", F.least(F.lit(GRAM), F.length("fake"))))
    sizes = [r["q"] for r in wanted.select("q").distinct().collect()]  # at most GRAM
    if not sizes:
        return texts.limit(0)
    runs = wanted.where(F.col("q") == GRAM).select("fake", "q", F.explode(_grams("fake", GRAM)).alias("gram"))
    common = runs.groupBy("gram").agg(F.count("*").alias("c"))
    long_ones = runs.join(common, "gram").groupBy("fake", "q").agg(F.min(F.struct("c", "gram"))["gram"].alias("gram"))
    filed = written(long_ones.unionByName(wanted.where(F.col("q") < GRAM).select("fake", "q", F.col("fake").alias("gram"))))
    found = [texts.select("id", F.lit(q).alias("q"), F.explode(_grams("t", q)).alias("gram")) for q in sizes]
    met = found[0]
    for x in found[1:]:
        met = met.unionByName(x)
    pairs = met.join(sent_if_small(filed), ["q", "gram"]).select("id", "fake")
    return texts.join(pairs, "id").where(F.contains("t", "fake")).select(*texts.columns).dropDuplicates(["id"])


def shown(type_: Column, real: Column) -> Column:
    """What a panel may show: secrets never."""
    return F.when(type_ == "PASSWORD", "••••••").otherwise(real)
