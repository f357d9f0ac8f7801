"""Queries that mask messages, keep the mapping and restore answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactory.functions.io import written
from redactory.operators import masking, review, segments
from redactory.operators.detect import long_form, long_form_sql, resolve, resolve_sql, scan, scan_sql
from redactory.operators.masking import mapping, mapping_sql, mask, mask_sql, restore_literal
from redactory.operators.restoring import owned, restore_by_rules, restore_rules, restore_sql
from redactory.operators.rules import MASKABLE_TYPES
from redactory.sources.messages import messages, messages_sql

_SOURCE = f"SELECT msg_id AS id, t FROM ({messages_sql(True)})"
_ROWS = long_form_sql(resolve_sql(scan_sql(_SOURCE, ["id"]), ["id"]), ["id"])
_HALF = long_form_sql(resolve_sql(scan_sql(f"SELECT * FROM ({_SOURCE}) WHERE id % 2 = 0", ["id"]), ["id"]), ["id"])
_SCANNED = f"SELECT id, t, findings FROM ({resolve_sql(scan_sql(f'SELECT id, t, t AS text FROM ({_SOURCE})', ['id', 'text']), ['id', 'text AS t'])})"


def _scanned(spark, sf_dir):
    texts = messages(spark, sf_dir).select(F.col("msg_id").alias("id"), F.col("session_id").alias("owner"), "t").withColumn("text", F.col("t"))
    return written(resolve(scan(texts, "text")).withColumnRenamed("text", "t"))  # read by the mapping and by the masking


def _found(scanned):
    return long_form(scanned.select("id", "findings"))


def _masked(spark, sf_dir):
    """Masked messages, scanned ones and the mapping."""
    scanned = _scanned(spark, sf_dir)
    table = written(mapping(_found(scanned)))
    return mask(scanned, table), scanned, table


def mapping_table(spark, sf_dir):
    return mapping(_found(_scanned(spark, sf_dir)))


def _known(spark, sf_dir):
    """The mapping of every second message."""
    scanned = _scanned(spark, sf_dir)
    return scanned, written(mapping(_found(scanned.where("id % 2 = 0"))))


def mapping_upsert(spark, sf_dir):
    """What all messages add to the mapping of every second one."""
    scanned, known = _known(spark, sf_dir)
    return mapping(_found(scanned), known)


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("real"), F.concat(F.lit("Client "), F.col("c_custkey").cast("string")).alias("fake"), "c_custkey")


def mapping_edits(spark, sf_dir):
    """Pairs registered by hand, e-mail addresses forgotten, cards with new fakes."""
    _, known = _known(spark, sf_dir)
    more = masking.registered(known, _customers(spark, sf_dir).select("real", "fake", F.when(F.col("c_custkey") % 2 == 0, "NAME_PII").alias("type")))
    less = masking.unregistered(more, more.where("type = 'EMAIL'"))
    return masking.changed(less, less.where("type = 'PASSPORT'").select("real", F.concat(F.lit("P-"), F.md5(F.col("real").cast("binary"))).alias("fake")))


_EDITS = f"""WITH known AS MATERIALIZED ({mapping_sql(_HALF)}) SELECT real, type, CASE WHEN type = 'PASSPORT' THEN 'P-' || md5(real) ELSE fake END AS fake FROM known WHERE type <> 'EMAIL'
  UNION ALL SELECT c_name, CASE WHEN c_custkey % 2 = 0 THEN 'NAME_PII' ELSE 'CUSTOM' END, 'Client ' || c_custkey FROM customer"""


def mapping_previews(spark, sf_dir):
    """Fakes that values would get, the types of which are wrong for half of them; nothing is registered."""
    scanned, known = _known(spark, sf_dir)
    values = _found(scanned).where("type IN ('PASSPORT', 'BSB', 'EMAIL')").select(F.col("value").alias("real"), "type").distinct()
    return masking.preview(values, known)


def _preview_sql() -> str:
    drawn = lambda k, q: f"SELECT *, {masking.stand_in(masking.DUCK)} AS f{k} FROM (SELECT *, {masking.drawn_digits(masking.DUCK, 'sd', 15)} AS dg FROM (SELECT real, type, {'f0, ' if k else ''}{masking.seed(masking.DUCK, 'type', 'real', str(k))} AS sd FROM ({q})))"
    values = f"""SELECT DISTINCT "value" AS real, "type" AS type FROM ({_ROWS}) WHERE "type" IN ('PASSPORT', 'BSB', 'EMAIL')"""
    return f"WITH known AS MATERIALIZED ({mapping_sql(_HALF)}) SELECT v.real, v.type, coalesce(k.fake, CASE WHEN f0 IN (SELECT fake FROM known) THEN f1 ELSE f0 END) AS fake FROM ({drawn(1, drawn(0, values))}) v LEFT JOIN known k ON k.real = v.real"


def mapping_size(spark, sf_dir):
    return mapping_table(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def mapping_shown(spark, sf_dir):
    """The mapping as a panel may show it."""
    return mapping_table(spark, sf_dir).select(masking.shown(F.col("type"), F.col("real")).alias("real"), F.lower(F.replace("type", F.lit("_"), F.lit(" "))).alias("type"), "fake")


def mask_messages(spark, sf_dir):
    return _masked(spark, sf_dir)[0].select("id", "masked", F.size("swaps").cast("long").alias("n_swaps"))


def restore_messages(spark, sf_dir):
    """Whether the literal way back gives the message again."""
    return restore_literal(_masked(spark, sf_dir)[0]).select("id", "restored", (F.col("restored") == F.col("t")).alias("same"))


def _owned(spark, sf_dir):
    """Masked messages with their owners, and each owner's part of the mapping."""
    masked, scanned, table = _masked(spark, sf_dir)
    return masked, written(owned(long_form(scanned.select("owner", "id", "findings")), table))


def owned_mapping(spark, sf_dir):
    return _owned(spark, sf_dir)[1].select("owner", "real", "type", "fake", F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id"))


def restore_messages_by_rules(spark, sf_dir):
    """Answers that quote an owner's masked message, restored by that owner's rules."""
    masked, mine = _owned(spark, sf_dir)
    answers = masked.select("owner", "id", F.concat(F.lit("Re: "), "masked").alias("t"))
    return restore_by_rules(answers, written(restore_rules(mine))).select("id", "restored", F.size("hits").cast("long").alias("n_hits"))


def remask_messages(spark, sf_dir):
    """The other direction: what of a message an owner's assistant has been shown."""
    masked, mine = _owned(spark, sf_dir)
    answers = masked.select("owner", "id", F.concat(F.lit("Re: "), "t").alias("t"))
    return restore_by_rules(answers, written(restore_rules(mine, "mask"))).select("id", "restored", F.size("hits").cast("long").alias("n_hits"))


def messages_with_fakes(spark, sf_dir):
    """Messages in which the fake of a registered customer stands; messages name customers by key."""
    texts = messages(spark, sf_dir).select(F.col("msg_id").alias("id"), F.concat("t", F.lit(" for Client "), F.col("session_id").cast("string")).alias("t"))
    fakes = _customers(spark, sf_dir).where("c_custkey % 10 = 3").select(F.concat("fake", F.lit("1")).alias("fake"))
    return masking.texts_with_fakes(texts, fakes).select("id")


def manual_masks(spark, sf_dir):
    """Selections in messages of one template: a name, a phrase with a fake of its own, and one that touches a finding."""
    texts = messages(spark, sf_dir).select(F.col("msg_id").alias("id"), "t").where("t LIKE 'Dear John Smith%'")
    at = F.locate(" Acme Corp", F.col("t")) - 1
    picked = F.array(
        F.struct((at).alias("start"), (at + 10).alias("stop"), F.lit(None).cast("string").alias("fake")), F.struct(F.lit(4).alias("start"), F.lit(10).alias("stop"), F.lit("X").alias("fake")),
        F.struct(F.lit(17).alias("start"), F.lit(24).alias("stop"), F.lit("its title").alias("fake")), F.struct(F.lit(16).alias("start"), F.lit(17).alias("stop"), F.lit("never").alias("fake")),
    )
    selections = texts.select("id", F.explode(picked).alias("p")).select("id", "p.*", F.lit(None).cast("string").alias("type"))
    marks = texts.select("id", F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("stop"))
    none = spark.createDataFrame([], "real string, type string, fake string")
    return review.with_masks(texts, review.manual_masks(texts, selections, marks, none)).select("id", "masked")


def _manual_sql() -> str:
    name = f"SELECT {masking.stand_in(masking.DUCK)} AS f FROM (SELECT *, {masking.drawn_digits(masking.DUCK, 'sd', 15)} AS dg FROM (SELECT real, type, {masking.seed(masking.DUCK, 'type', 'real')} AS sd FROM (SELECT 'Acme Corp' AS real, 'NAME_PII' AS type)))"
    return f"SELECT msg_id AS id, replace(replace(t, 'Acme Corp', ({name})), 'my name', 'its title') AS masked FROM ({messages_sql(True)}) WHERE t LIKE 'Dear John Smith%'"


def sent_as_typed(spark, sf_dir):
    """Messages that are sent as they were typed in, but for white space."""
    texts = messages(spark, sf_dir).select(F.col("msg_id").alias("id"), "t")
    sent = texts.select("id", F.concat(F.lit("  "), F.replace("t", F.lit(" "), F.lit(" \n "))).alias("t"))
    typed = texts.select("id", F.when(F.col("id") % 3 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t")).alias("masked"))
    return review.needs_no_scan(sent, typed).select("id")


def extra_findings(spark, sf_dir):
    """Findings of another recogniser, here every run of capitals and digits, without those that overlap others."""
    texts = messages(spark, sf_dir).select(F.col("msg_id").alias("id"), "t")
    extra = long_form(scan(texts.select("id", "t"), "t", ["passport", "bank_account"])).select("id", "start", "value", F.lit("nlp").alias("source"))
    found = long_form(scan(texts.select("id", "t"), "t", ["bsb", "passport"])).where("id % 2 = 0").select("id", "start", "value")
    return review.without_overlaps(extra, found).select("id", "start", "value", "source")


_EXTRA = [long_form_sql(scan_sql(_SOURCE, ["id"], r), ["id"]) for r in (["passport", "bank_account"], ["bsb", "passport"])]


def _answers(spark, sf_dir):
    """Answers of three segments that name customers, and messages with views: some pinned to the fake view."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("msg_id"), F.col("o_custkey").cast("string").alias("k"))
    texts = F.array(F.concat(F.lit("About Client "), "k", F.lit(", and Client")), F.concat("k", F.lit(" or Client\t"), "k"), F.lit(" "), F.concat(F.lit("xClient "), "k", F.lit(" ends in Client,")), F.concat(F.lit(" "), "k", F.lit(".")))
    segs = orders.select("msg_id", F.posexplode(texts).alias("seg_no", "t"))
    pins = orders.select("msg_id", F.when(F.col("msg_id") % 3 == 0, "fake").otherwise("real").alias("view"), F.when(F.col("msg_id") % 3 == 0, "fake").alias("lock"))
    rules = written(restore_rules(_customers(spark, sf_dir).select("real", F.lit("CUSTOM").alias("type"), "fake")))
    return segs, pins, rules


def restored_answers(spark, sf_dir):
    segs, _, rules = _answers(spark, sf_dir)
    return segments.restored_segments(segs, rules).select("msg_id", "seg_no", "restored")


_SEGS = """(SELECT o_orderkey AS msg_id, c_name AS r, CAST(o_custkey AS VARCHAR) AS k FROM orders JOIN customer ON c_custkey = o_custkey)"""
_RESTORED = f"""SELECT msg_id, seg_no, [ 'About ' || r || ', and ' || r, ' or ' || r, ' ', 'xClient ' || k || ' ends in ' || r, '.' ][seg_no + 1] AS restored,
  ['About Client ' || k || ', and Client', k || ' or Client' || chr(9) || k, ' ', 'xClient ' || k || ' ends in Client,', ' ' || k || '.'][seg_no + 1] AS t
  FROM {_SEGS}, (SELECT unnest(range(5)) AS seg_no)"""


def restore_pass(spark, sf_dir):
    """What messages show after a pass with auto-restore, and after one without it."""
    segs, pins, rules = _answers(spark, sf_dir)
    on = segments.with_shown(segments.restored_segments(segs, rules), pins, True, "with_auto")
    both = segments.with_shown(on, segments.toggled(pins, pins.where("msg_id % 2 = 0")), False, "without")
    return both.select("msg_id", "seg_no", "with_auto", "without")


def restore_log(spark, sf_dir):
    """Entries of a pass without auto-restore, numbered, with every second one revealed."""
    segs, pins, rules = _answers(spark, sf_dir)
    _, log = segments.restore_pass(segs, segments.synced(pins, False), rules, False)
    numbered = log.withColumn("id", F.regexp_extract("fake", "([0-9]+)$", 1).cast("long")).withColumn("revealed", F.lit(False))
    return segments.revealed(numbered, numbered.where("id % 2 = 0")).select("id", "kind", "fake", "revealed")


def pruned_log(spark, sf_dir):
    log = _customers(spark, sf_dir).select("fake", F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("mask").alias("kind"), "c_custkey")
    return masking.pruned(log, log.where("c_custkey % 2 = 0")).select("kind", "fake")


QUERIES = {
    "mapping_table": mapping_table, "mapping_upsert": mapping_upsert, "mapping_edits": mapping_edits, "mapping_previews": mapping_previews, "mapping_size": mapping_size, "mapping_shown": mapping_shown,
    "mask_messages": mask_messages, "restore_literal": restore_messages, "restore_rules": restore_messages_by_rules, "remask_messages": remask_messages, "owned_mapping": owned_mapping, "messages_with_fakes": messages_with_fakes, "manual_masks": manual_masks,
    "sent_as_typed": sent_as_typed, "extra_findings": extra_findings, "restored_answers": restored_answers, "restore_pass": restore_pass, "restore_log": restore_log, "pruned_log": pruned_log,
}
_OWNED = f"""SELECT owner, real, any_value(m.type) AS type, any_value(fake) AS fake, min(id) AS first_id, max(id) AS last_id
  FROM ({_ROWS}) r JOIN ({mapping_sql(_ROWS)}) m ON m.real = r."value" JOIN (SELECT msg_id AS id, session_id AS owner FROM ({messages_sql(True)})) USING (id) WHERE r."type" IN ({', '.join(f"'{t}'" for t in MASKABLE_TYPES)}) GROUP BY owner, real"""


def _quoted_sql(text: str) -> str:
    return f"SELECT session_id AS owner, id, 'Re: ' || {text} AS t FROM ({mask_sql(_SCANNED, mapping_sql(_ROWS))}) x JOIN (SELECT msg_id AS id, session_id FROM ({messages_sql(True)})) USING (id)"


SQL = {
    "owned_mapping": _OWNED,
    "restore_rules": restore_sql(_quoted_sql("masked"), _OWNED),
    "remask_messages": restore_sql(_quoted_sql("x.t"), _OWNED, "mask"),
    "mapping_table": mapping_sql(_ROWS),
    "mapping_upsert": mapping_sql(_ROWS, mapping_sql(_HALF)),
    "mapping_edits": _EDITS,
    "mapping_previews": _preview_sql(),
    "mapping_size": f"SELECT type, count(*) AS n FROM ({mapping_sql(_ROWS)}) GROUP BY type",
    "mapping_shown": f"SELECT CASE WHEN type = 'PASSWORD' THEN '••••••' ELSE real END AS real, lower(replace(type, '_', ' ')) AS type, fake FROM ({mapping_sql(_ROWS)})",
    "mask_messages": f"SELECT id, masked, n_swaps FROM ({mask_sql(_SCANNED, mapping_sql(_ROWS))})",
    "restore_literal": f"SELECT id, restored, restored = t AS same FROM ({mask_sql(_SCANNED, mapping_sql(_ROWS))})",
    "messages_with_fakes": f"SELECT msg_id AS id FROM ({messages_sql(True)}) WHERE contains(CAST(session_id AS VARCHAR), '31')",
    "manual_masks": _manual_sql(),
    "sent_as_typed": f"SELECT msg_id AS id FROM ({messages_sql(True)}) WHERE msg_id % 3 <> 0",
    "extra_findings": f"""WITH e AS (SELECT id, "start", "value" FROM ({_EXTRA[0]})), f AS (SELECT id, "start", "value" FROM ({_EXTRA[1]}) WHERE id % 2 = 0),
      alone AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = e.id AND e."start" < f."start" + length(f."value") AND e."start" + length(e."value") > f."start"))
      SELECT DISTINCT id, "start", "value", 'nlp' AS source FROM alone""",
    "restored_answers": f"SELECT msg_id, seg_no, restored FROM ({_RESTORED})",
    "restore_pass": f"SELECT msg_id, seg_no, CASE WHEN msg_id % 3 = 0 THEN t ELSE restored END AS with_auto, CASE WHEN (msg_id % 3 = 0) = (msg_id % 2 = 0) THEN restored ELSE t END AS without FROM ({_RESTORED})",
    "restore_log": "SELECT DISTINCT o_custkey AS id, 'pending' AS kind, 'Client ' || o_custkey AS fake, o_custkey % 2 = 0 AS revealed FROM orders",
    "pruned_log": "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'mask' END AS kind, 'Client ' || c_custkey AS fake FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey % 3 = 0",
}
