"""Restoring answers that come as messages of several text segments, with views that people pin.

segments (msg_id, seg_no, t); rules as ``restoring.restore_rules`` gives them. A message is the unit that meets in one row;
everything else is joins on its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.io import written
from redactory.operators.restoring import NO_RULES, fitting_rules, restore_by_rules


def restored_segments(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """segments with restored and hits: each segment by itself, then values that run over the end of a segment.

    Blank segments stay as they are and are no boundary.
    """
    key = F.struct("msg_id", "seg_no").alias("id")
    single = written(restore_by_rules(segments.select(key, "t"), rules).select("id.*", "t", "restored", "hits"))  # read by itself and joined
    return _across(single, rules.where(r"seek RLIKE '\\S\\s+\\S'"))


def _across(single: DataFrame, rules: DataFrame) -> DataFrame:
    """Of rules with several words: matches in the segments joined by new lines that hold such a joint.

    Of overlapping ones the leftmost stays. The whole replacement goes into the first segment, the rest of the match goes
    from the others.
    """
    blank = F.col("restored").isNull() | F.col("restored").rlike(r"^\s*$")
    ordered = single.where(~blank).groupBy("msg_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", F.col("restored").alias("x")))).alias("xs")).where("size(xs) > 1")
    joined = ordered.select("msg_id", "xs", F.array_join(F.transform("xs", lambda g: g["x"]), "\n").alias("t"))
    fits = fitting_rules(joined.select(F.col("msg_id").alias("id"), "t"), rules).withColumnRenamed("id", "msg_id")
    placed = joined.join(fits, "msg_id").withColumn("segs", F.expr(
        """aggregate(xs, named_struct('p', CAST(0 AS BIGINT), 'o', CAST(array() AS array<struct<no:bigint,s:bigint,e:bigint,x:string>>)),
            (a, g) -> named_struct('p', a.p + length(g.x) + 1, 'o', array_append(a.o, named_struct('no', CAST(g.seg_no AS BIGINT), 's', a.p, 'e', a.p + length(g.x), 'x', g.x))), a -> a.o)"""))  # fmt: skip
    marked = "split(regexp_replace(t, concat('((?<![A-Za-z0-9])', r.pattern, '(?![A-Za-z0-9]))'), concat(char(1), '$1', char(2))), char(1), -1)"
    found = f"""flatten(transform({NO_RULES.replace('CAST(array()', 'CAST(rules')}, (r, k) -> aggregate({marked}, named_struct('p', CAST(-1 AS BIGINT), 'o', CAST(array() AS array<struct<s:bigint,k:int,e:bigint,real:string,fake:string>>)),
        (a, y) -> CASE WHEN a.p < 0 THEN named_struct('p', CAST(length(y) AS BIGINT), 'o', a.o)
          ELSE named_struct('p', a.p + length(y) - 1, 'o', CASE WHEN contains(substring_index(y, char(2), 1), char(10))
            THEN array_append(a.o, named_struct('s', a.p, 'k', k, 'e', a.p + length(substring_index(y, char(2), 1)), 'real', r.put, 'fake', r.seek)) ELSE a.o END) END, a -> a.o)))"""
    kept = """aggregate(sort_array(found), slice(found, 1, 0), (a, m) -> CASE WHEN size(a) = 0 OR m.s >= element_at(a, -1).e THEN array_append(a, m) ELSE a END)"""
    cut = """transform(segs, g -> named_struct('no', g.no, 'n', size(filter(kept, m -> m.s >= g.s AND m.s < g.e)), 'hits', transform(filter(kept, m -> m.s >= g.s AND m.s < g.e), m -> m.fake),
        'x', aggregate(filter(kept, m -> m.s < g.e AND m.e > g.s), named_struct('o', '', 'p', CAST(0 AS BIGINT)),
          (a, m) -> named_struct('o', concat(a.o, substring(g.x, CAST(a.p + 1 AS INT), CAST(greatest(m.s - g.s, 0) - a.p AS INT)), CASE WHEN m.s >= g.s THEN m.real ELSE '' END), 'p', least(m.e, g.e) - g.s),
          a -> concat(a.o, substring(g.x, CAST(a.p + 1 AS INT))))))"""
    crossed = placed.withColumn("found", F.expr(found)).withColumn("kept", F.expr(kept)).where("size(kept) > 0").select("msg_id", F.explode(F.expr(cut)).alias("c"))
    crossed = crossed.select("msg_id", F.col("c.no").alias("seg_no"), F.col("c.x").alias("_x"), F.col("c.hits").alias("_hits"))
    out = single.join(crossed, ["msg_id", "seg_no"], "left")
    return out.select("msg_id", "seg_no", "t", F.coalesce("_x", "restored").alias("restored"), F.array_distinct(F.concat("hits", F.coalesce("_hits", F.expr("CAST(array() AS array<string>)")))).alias("hits"))


def toggled(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """messages (msg_id, view, lock) with the view of these ids turned over and pinned; a message without a view shows the real one."""
    now = F.when(F.col("view") == "fake", "real").otherwise("fake")
    hit = messages.join(ids.select("msg_id", F.lit(True).alias("_hit")).distinct(), "msg_id", "left")
    return hit.select("msg_id", F.when(F.col("_hit"), now).otherwise(F.col("view")).alias("view"), F.when(F.col("_hit"), now).otherwise(F.col("lock")).alias("lock"))


def synced(messages: DataFrame, auto_restore: bool) -> DataFrame:
    """All messages that are not pinned in the default view."""
    return messages.withColumn("view", F.when(F.col("lock").isNull(), "real" if auto_restore else "fake").otherwise(F.col("view")))


def restore_pass(segments: DataFrame, messages: DataFrame, rules: DataFrame, auto_restore: bool) -> tuple[DataFrame, DataFrame]:
    """One pass over an answer: (segments with what they show, log entries (kind, fake)).

    With auto-restore all messages are restored but those pinned to the fake view, and what stood in them is logged as
    unmasked. Without it only messages in the real view change, and what is found in any is logged as pending.
    """
    return passed(restored_segments(segments, rules), messages, auto_restore)


def passed(restored: DataFrame, messages: DataFrame, auto_restore: bool) -> tuple[DataFrame, DataFrame]:
    """restore_pass over segments that restored_segments has restored, so that several passes need it once."""
    out, open_ = _opened(restored, messages, auto_restore)
    seen = out.where(open_) if auto_restore else out
    log = seen.select(F.explode("hits").alias("fake")).distinct().select(F.lit("unmask" if auto_restore else "pending").alias("kind"), "fake")
    return out.select("msg_id", "seg_no", F.when(open_, F.col("restored")).otherwise(F.col("t")).alias("shown")), log


def with_shown(restored: DataFrame, messages: DataFrame, auto_restore: bool, name: str) -> DataFrame:
    """Restored segments with what they show after a pass in a column of this name; passes beside each other need no other join."""
    out, open_ = _opened(restored, messages, auto_restore)
    return out.select(*restored.columns, F.when(open_, F.col("restored")).otherwise(F.col("t")).alias(name))


def _opened(restored: DataFrame, messages: DataFrame, auto_restore: bool) -> tuple[DataFrame, Column]:
    open_ = F.coalesce(F.col("lock") != "fake", F.lit(True)) if auto_restore else F.coalesce(F.col("view") == "real", F.lit(False))
    return restored.join(messages.select("msg_id", "view", "lock"), "msg_id", "left"), open_


def revealed(log: DataFrame, ids: DataFrame) -> DataFrame:
    """log (id, revealed, ...) with these entries revealed."""
    return log.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left").withColumn("revealed", F.coalesce("_hit", "revealed")).select(*log.columns)
