"""A message under review in two views, real and masked, as one table of pieces.

A piece is plain text, the same in both views, or a mark: a real value in one view and its stand-in in the other. Pieces
know where they begin in either view, so that a selection or an edit made in one is found again in the other, whatever
has been masked, unmasked or typed before. A message is one row, and everything is an expression on it.

Defined cases: a null text is empty; findings that are not maskable make no mark; a selection that cuts a mark, or holds
nothing but spaces, is not masked; an edit takes a mark it cuts as a whole; places beyond the text count as its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.operators.masking import preview
from redactory.operators.rules import MASKABLE_TYPES

PIECES = "array<struct<real:string,fake:string,type:string,label:string,manual:boolean,r:bigint,m:bigint>>"
ACTION = "struct<seq:bigint,action:string,view:string,start:bigint,stop:bigint,text:string,type:string>"
_NONE = f"CAST(array() AS {PIECES})"


def _piece(real: str, fake: str, type_: str = "CAST(NULL AS STRING)", label: str = "CAST(NULL AS STRING)", manual: str = "false", r: str = "0", m: str = "0") -> str:
    return f"named_struct('real', {real}, 'fake', {fake}, 'type', {type_}, 'label', {label}, 'manual', {manual}, 'r', CAST({r} AS BIGINT), 'm', CAST({m} AS BIGINT))"


def _plain(text: str) -> str:
    return _piece(text, text)


def _settled(pieces: str) -> str:
    """The pieces without empty ones, plain neighbours united, and their places in both views."""
    last = "try_element_at(a.o, -1)"
    both = _piece(f"concat({last}.real, p.real)", f"concat({last}.fake, p.fake)", r=f"{last}.r", m=f"{last}.m")
    own = _piece("p.real", "p.fake", "p.type", "p.label", "p.manual", "a.r", "a.m")
    grown = f"CASE WHEN p.type IS NULL AND size(a.o) > 0 AND {last}.type IS NULL THEN array_append(slice(a.o, 1, size(a.o) - 1), {both}) ELSE array_append(a.o, {own}) END"
    step = f"CASE WHEN p.type IS NULL AND p.real = '' THEN a ELSE named_struct('o', {grown}, 'r', a.r + length(p.real), 'm', a.m + length(p.fake)) END"
    return f"aggregate({pieces}, named_struct('o', {_NONE}, 'r', CAST(0 AS BIGINT), 'm', CAST(0 AS BIGINT)), (a, p) -> {step}, a -> a.o)"


def _start(view: str) -> str:
    return f"(CASE WHEN {view} = 'real' THEN p.r ELSE p.m END)"


def _end(view: str) -> str:
    return f"(CASE WHEN {view} = 'real' THEN p.r + length(p.real) ELSE p.m + length(p.fake) END)"


def _before(pieces: str, view: str, at: str) -> str:
    """What stands before a place; a mark that is cut goes."""
    cut = _plain(f"substring(p.real, 1, CAST({at} - {_start(view)} AS INT))")
    return f"flatten(transform({pieces}, p -> CASE WHEN {_end(view)} <= {at} THEN array(p) WHEN {_start(view)} >= {at} OR p.type IS NOT NULL THEN {_NONE} ELSE array({cut}) END))"


def _after(pieces: str, view: str, at: str, since: str) -> str:
    """What stands after a place, and not before ``since``."""
    cut = _plain(f"substring(p.real, CAST({at} - {_start(view)} + 1 AS INT))")
    return f"flatten(transform({pieces}, p -> CASE WHEN {_end(view)} <= {since} THEN {_NONE} WHEN {_start(view)} >= {at} THEN array(p) WHEN {_end(view)} <= {at} OR p.type IS NOT NULL THEN {_NONE} ELSE array({cut}) END))"


def review_items(scanned: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, start, stop, value, type, label, fake) for the maskable findings of (id, t, findings): known stand-ins, or previews.

    A value that does not stand where its finding says is looked for from there on. Nothing is registered.
    """
    found = scanned.select("id", "t", F.explode_outer("findings").alias("f")).where("f IS NOT NULL").select("id", "t", "f.type", "f.label", "f.value", F.col("f.start").alias("_at"))
    found = found.where(F.col("type").isin(*MASKABLE_TYPES) & (F.col("value") != "")).withColumn("start", F.expr("CAST(locate(value, t, CAST(_at + 1 AS INT)) - 1 AS BIGINT)")).where("start >= 0")
    fakes = preview(found.select(F.col("value").alias("real"), "type").distinct(), existing).select(F.col("real").alias("value"), "type", "fake")
    return found.join(fakes, ["value", "type"]).select("id", "start", (F.col("start") + F.length("value")).alias("stop"), "value", "type", "label", "fake")


def review_model(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(id, pieces) of texts (id, t) with the marks of items; of items that overlap the first stays."""
    listed = items.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "type", "label", "fake"))).alias("items"))
    joined = texts.select("id", F.coalesce("t", F.lit("")).alias("t")).join(listed, "id", "left").withColumn("items", F.coalesce("items", F.expr("CAST(array() AS array<struct<start:bigint,stop:bigint,type:string,label:string,fake:string>>)")))
    gap = _plain("substring(t, CAST(a.p + 1 AS INT), CAST(x.start - a.p AS INT))")
    mark = _piece("substring(t, CAST(x.start + 1 AS INT), CAST(x.stop - x.start AS INT))", "x.fake", "x.type", "x.label")
    made = f"""aggregate(items, named_struct('p', CAST(0 AS BIGINT), 'o', {_NONE}), (a, x) -> CASE WHEN x.start < a.p THEN a ELSE named_struct('p', x.stop, 'o', concat(a.o, array({gap}, {mark}))) END,
      a -> array_append(a.o, {_plain("substring(t, CAST(a.p + 1 AS INT))")}))"""
    return joined.withColumn("pieces", F.expr(made)).select("id", F.expr(_settled("pieces")).alias("pieces"))


def _let(name: str, value: str, body: str) -> str:
    """body, in which the value is computed once and known by a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _done() -> str:
    """The pieces a.ps after the action e."""
    v = "e.view"
    size = f"aggregate(a.ps, CAST(0 AS BIGINT), (n, p) -> greatest(n, {_end(v)}))"
    typed = f"concat({_before('a.ps', v, 'w.a')}, array({_plain(f'coalesce(e.text, {chr(39) * 2})')}), {_after('a.ps', v, 'w.z', 'w.a')})"
    # a selection lies in one plain piece; its outer spaces stay outside
    home = f"filter(a.ps, p -> p.type IS NULL AND {_start(v)} <= w.a AND w.a < w.z AND w.z <= {_end(v)})"
    text = f"concat_ws('', transform({home}, p -> substring(p.real, CAST(w.a - {_start(v)} + 1 AS INT), CAST(w.z - w.a AS INT))))"
    trimmed = "named_struct('real', regexp_replace(x, '^\\\\s+|\\\\s+$', ''), 'a', w.a + length(x) - length(regexp_replace(x, '^\\\\s+', '')))"
    mark = _piece("y.real", "e.text", "coalesce(e.type, 'CUSTOM')", "coalesce(e.type, 'CUSTOM')", "true")
    masked = f"concat({_before('a.ps', v, 'y.a')}, array({mark}), {_after('a.ps', v, '(y.a + length(y.real))', 'y.a')})"
    chosen = _let("x", text, _let("y", trimmed, f"CASE WHEN y.real = '' OR e.text IS NULL THEN a.ps ELSE {masked} END"))
    freed = f"transform(a.ps, p -> CASE WHEN p.type IS NOT NULL AND {_start(v)} < w.z AND {_end(v)} > w.a THEN {_plain('p.real')} ELSE p END)"
    done = f"CASE e.action WHEN 'edit' THEN {typed} WHEN 'mask' THEN {chosen} WHEN 'unmask' THEN {freed} ELSE a.ps END"
    span = "named_struct('a', least(greatest(e.start, 0), n), 'z', least(greatest(e.stop, e.start, 0), n))"
    return _let("n", size, _let("w", span, done))


def revised(model: DataFrame, actions: DataFrame) -> DataFrame:
    """model (id, pieces) after the actions (id, seq, action, view, start, stop, text, type), in order.

    action: 'mask' a selection with the stand-in ``text``, 'unmask' the marks that it touches, or 'edit': ``text`` comes in
    place of it. view, 'real' or 'masked', says in which one start and stop count.
    """
    fields = F.struct(F.col("seq").cast("long").alias("seq"), "action", "view", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "text", "type")
    listed = actions.groupBy("id").agg(F.sort_array(F.collect_list(fields)).alias("es"))
    out = model.join(listed, "id", "left").withColumn("es", F.coalesce("es", F.expr(f"CAST(array() AS array<{ACTION}>)")))
    folded = f"aggregate(es, named_struct('ps', pieces), (a, e) -> named_struct('ps', {_settled(_done())}), a -> a.ps)"
    return out.select("id", F.expr(folded).alias("pieces"))


def shown_views(model: DataFrame) -> DataFrame:
    """(id, real, masked, n_marks, legend): both texts, and the labels of the marks in the order in which they come first."""
    marks = "filter(pieces, p -> p.type IS NOT NULL)"
    return model.select(
        "id", F.expr("concat_ws('', transform(pieces, p -> p.real))").alias("real"), F.expr("concat_ws('', transform(pieces, p -> p.fake))").alias("masked"),
        F.expr(f"CAST(size({marks}) AS BIGINT)").alias("n_marks"), F.expr(f"array_distinct(transform({marks}, p -> p.label))").alias("legend"),
    )


def marks(model: DataFrame) -> DataFrame:
    """One row a mark: (id, type, label, manual, real, fake) and its span in both views."""
    rows = model.select("id", F.explode("pieces").alias("p")).where("p.type IS NOT NULL")
    return rows.select(
        "id", "p.type", "p.label", "p.manual", "p.real", "p.fake", F.col("p.r").alias("real_start"), (F.col("p.r") + F.length("p.real")).alias("real_stop"),
        F.col("p.m").alias("masked_start"), (F.col("p.m") + F.length("p.fake")).alias("masked_stop"),
    )


def legend(marks: DataFrame) -> DataFrame:
    """(label, n, first_id): the labels of the marks of a selection of messages, and where each comes first."""
    return marks.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def anchored(model: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (id, view, start, stop) with real_start, real_stop, masked_start, masked_stop and n_marks, the marks they touch.

    A span that cuts a mark takes it whole.
    """
    joined = spans.join(model, "id")
    start, end = _start("view"), _end("view")
    size = F.expr(f"aggregate(pieces, CAST(0 AS BIGINT), (n, p) -> greatest(n, {end}))")
    joined = joined.withColumn("_a", F.least(F.greatest("start", F.lit(0)), size)).withColumn("_z", F.least(F.greatest("stop", "start", F.lit(0)), size))
    first = f"try_element_at(filter(pieces, p -> {start} <= _a AND _a < {end}), 1)"
    last = f"try_element_at(filter(pieces, p -> {start} < _z AND _z <= {end}), 1)"
    joined = joined.withColumn("_f", F.expr(first)).withColumn("_l", F.expr(f"CASE WHEN _z > _a THEN {last} END")).withColumn("_touched", F.expr(f"filter(pieces, p -> p.type IS NOT NULL AND {start} < _z AND {end} > _a)"))
    own = {"real": ("r", "real"), "masked": ("m", "fake")}
    out = {}
    for side, (at, text) in own.items():
        whole = f"aggregate(pieces, CAST(0 AS BIGINT), (n, p) -> n + length(p.{text}))"
        begin = f"CASE WHEN _f IS NULL THEN {whole} WHEN _f.type IS NOT NULL THEN _f.{at} ELSE _f.{at} + _a - CASE WHEN view = 'real' THEN _f.r ELSE _f.m END END"
        stop = f"CASE WHEN _l IS NULL THEN {begin} WHEN _l.type IS NOT NULL THEN _l.{at} + length(_l.{text}) ELSE _l.{at} + _z - CASE WHEN view = 'real' THEN _l.r ELSE _l.m END END"
        out |= {f"{side}_start": F.expr(begin), f"{side}_stop": F.expr(stop)}
    return joined.withColumns(out).select(*spans.columns, *out, F.expr("CAST(size(_touched) AS BIGINT)").alias("n_marks"))
