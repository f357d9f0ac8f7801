"""Masks that people add by hand: which selections are allowed, their types and fakes, and the text with them in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.operators.cells import one_spaced
from redactory.operators.detect import resolve, scan
from redactory.operators.masking import preview
from redactory.operators.rules import MASKABLE_TYPES


def allowed(texts: DataFrame, selections: DataFrame, marks: DataFrame) -> DataFrame:
    """selections (id, start, stop, ...) of texts (id, t) that hold more than spaces and touch no mark (id, start, stop).

    Added: real (the selected text without outer spaces), and start and stop are those of real.
    """
    spans = marks.select(F.col("id").alias("_id"), F.col("start").alias("_a"), F.col("stop").alias("_z"))
    free = selections.join(spans, (F.col("id") == F.col("_id")) & (F.col("start") <= F.col("_z")) & (F.col("stop") >= F.col("_a")), "left_anti")
    raw = F.substring(F.col("t"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    cut = free.join(texts.select("id", "t"), "id").withColumn("_raw", raw).withColumn("real", F.regexp_replace("_raw", r"^\s+|\s+$", "")).where("real <> ''")
    lead = F.length("_raw") - F.length(F.regexp_replace("_raw", r"^\s+", ""))
    return cut.withColumn("start", F.col("start") + lead).withColumn("stop", F.col("start") + F.length("real")).drop("t", "_raw")


def auto_types(values: DataFrame) -> DataFrame:
    """values (real) with type: of the finding that is the whole value, else of the first one, else a name's."""
    found = resolve(scan(values.select("real").distinct().withColumn("text", F.col("real"))))
    fit = F.filter("findings", lambda f: f["type"].isin(*MASKABLE_TYPES))
    whole = F.filter(fit, lambda f: F.trim(f["value"]) == F.col("real"))
    return found.select("real", F.coalesce(F.get(whole, F.lit(0))["type"], F.get(fit, F.lit(0))["type"], F.lit("NAME_PII")).alias("type"))


def manual_masks(texts: DataFrame, selections: DataFrame, marks: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, start, stop, real, type, fake) of the allowed selections (id, start, stop, fake, type).

    A selection with a fake of its own is CUSTOM unless it names a type; others get the type that fits and a preview's fake.
    """
    own = allowed(texts, selections, marks).withColumnsRenamed({"fake": "_fake", "type": "_type"})
    types = auto_types(own.where("_fake IS NULL AND _type IS NULL"))
    typed = own.join(types, "real", "left").withColumn("type", F.coalesce("_type", F.when(F.col("_fake").isNotNull(), "CUSTOM"), "type")).drop("_type")
    drawn = preview(typed.select("real", "type").distinct(), existing)
    known = existing.select("real", F.col("fake").alias("_known"))
    out = typed.join(drawn, ["real", "type"]).join(known, "real", "left")
    return out.select("id", "start", "stop", "real", "type", F.coalesce("_known", "_fake", "fake").alias("fake"))


def with_masks(texts: DataFrame, masks: DataFrame) -> DataFrame:
    """texts (id, t) with ``masked``: the masks' fakes in place of their spans, which do not overlap."""
    listed = masks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "fake"))).alias("ms"))
    splice = """aggregate(coalesce(ms, array()), named_struct('s', '', 'p', CAST(0 AS BIGINT)),
        (a, x) -> named_struct('s', concat(a.s, substring(t, CAST(a.p + 1 AS INT), CAST(x.start - a.p AS INT)), x.fake), 'p', CAST(x.stop AS BIGINT)),
        a -> concat(a.s, substring(t, CAST(a.p + 1 AS INT))))"""
    return texts.join(listed, "id", "left").withColumn("masked", F.expr(splice)).drop("ms")


def needs_no_scan(sent: DataFrame, typed: DataFrame) -> DataFrame:
    """sent (id, t) that is, but for white space, the masked text (id, masked) that was typed in: it may pass.

    Texts meet by id and digest, taken once a text: an expression as a key would be worked out at each comparison of a sort.
    """
    digest = lambda c: F.unhex(F.sha2(one_spaced(F.col(c)).cast("binary"), 256)).alias("_said")
    return sent.select("id", "t", digest("t")).join(typed.select("id", digest("masked")), ["id", "_said"]).select("id", "t")


def without_overlaps(extra: DataFrame, findings: DataFrame) -> DataFrame:
    """extra findings (id, start, value, ...) that overlap neither the rules' findings nor an extra one taken before, in order of place.

    A finding of the rules overlaps if one that begins no later reaches beyond the extra one's start, or one that begins later
    does so before its end: both are running extremes over the text's findings. An empty value overlaps what it stands inside of,
    and nothing that begins where it stands. The extra ones left are folded one by one.
    """
    end = F.col("start") + F.length("value")
    rest = [c for c in extra.columns if c != "id"]
    row = extra.select("id", F.col("start").cast("long").alias("a"), end.cast("long").alias("z"), F.struct(*rest).alias("row"))
    both = row.withColumn("kind", F.when(F.col("a") < F.col("z"), 1).otherwise(-1)).unionByName(findings.select("id", F.col("start").cast("long").alias("a"), end.cast("long").alias("z"), F.lit(None).cast(row.schema["row"].dataType).alias("row"), F.lit(0).alias("kind")))
    before = Window.partitionBy("id").orderBy("a", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("id").orderBy("a", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reach, next_ = F.max(F.when(F.col("kind") == 0, F.col("z"))).over(before), F.min(F.when(F.col("kind") == 0, F.col("a"))).over(after)
    free = both.withColumn("_reach", F.coalesce(reach, F.col("a"))).withColumn("_next", F.coalesce(next_, F.col("z"))).where("kind <> 0 AND _reach <= a AND _next >= z")
    listed = free.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("a", "z", "row"))).alias("xs"))
    folded = """aggregate(xs, named_struct('a', CAST(-1 AS BIGINT), 'z', CAST(-1 AS BIGINT), 'k', slice(xs, 1, 0)),
        (acc, x) -> CASE WHEN x.a < acc.z AND x.z > acc.a THEN acc ELSE named_struct('a', CASE WHEN x.z >= acc.z THEN x.a ELSE acc.a END, 'z', greatest(x.z, acc.z), 'k', array_append(acc.k, x)) END, acc -> acc.k)"""
    return listed.select("id", F.explode(F.expr(folded)).alias("x")).select("id", "x.row.*")
