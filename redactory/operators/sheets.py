"""Spreadsheet cells to student rows: sheets, blocks, columns, the rows up to the totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.operators.cells import class_hint, day_mark, iso_date, lunch_mark, stripped, with_suspension

#: Sheets, and columns counted from the block's base.
SHEET_CLASSES = {"el 1": "el1", "el2 daf": "el2d", "el2 hib": "el2h", "pk saf": "pks", "pk lav": "pkl", "jr. kindergarten": "jrk", "kindergarten": "kg"}
SKIPPED = ["age calculator", "total enrolment", "enrolment forecast", "25+ enrolments"]
COLUMNS = {"no": 0, "name": 1, "start": 2, "last": 4, "dob": 5, "mon": 7, "tue": 8, "wed": 9, "thu": 10, "fri": 11, "lunch": 12, "nationality": 13, "parents": 14, "email": 15, "phone": 16, "note": 17, "suspension": 18, "stay": 19, "bond": 20, "paid_from": 21, "paid_until": 22}
BLOCK, BLOCKS, HEADER_ROWS = 25, 5, 3
TOTALS = ["total", "full day", "half day"]


def sheet_classes(cells: DataFrame) -> DataFrame:
    """(sheet, class_id, warning) for sheets that are not skipped."""
    low = F.lower(stripped(F.col("sheet")))
    table = F.create_map(*[F.lit(x) for pair in SHEET_CLASSES.items() for x in pair])
    out = cells.select("sheet").distinct().where(~low.isin(*SKIPPED)).withColumn("class_id", F.coalesce(F.element_at(table, low), class_hint(F.col("sheet"))))
    return out.withColumn("warning", F.when(F.col("class_id").isNull(), F.concat(F.lit("no class for sheet "), "sheet")))


def latest_blocks(cells: DataFrame) -> DataFrame:
    """(sheet, block): the block whose period ends last; the first of equals, and the first where none has a period."""
    block = F.floor(F.col("col_no") / BLOCK).cast("int")
    v = stripped(F.col("value"))
    titles = cells.where(f"row_no = 1 AND col_no % {BLOCK} < 15 AND col_no < {BLOCK * BLOCKS}").select("sheet", block.alias("block"), "col_no", v.alias("v"))
    titles = titles.where(F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]") & ~F.startswith(F.lower("v"), F.lit("occupancy")))
    period = titles.groupBy("sheet", "block").agg(F.min_by("v", "col_no").alias("v"))
    part = lambda k: F.regexp_extract("v", r"(\d{1,2})\s+(\w+)\s+(\d{4})\s*$", k)
    end = F.try_to_date(F.concat_ws(" ", part(1), F.initcap(F.substring(part(2), 1, 3)), part(3)), "d MMM yyyy")
    best = period.select("sheet", F.struct(end.alias("end"), (-F.col("block")).alias("neg")).alias("k")).where("k.end IS NOT NULL").groupBy("sheet").agg((-F.max("k")["neg"]).alias("block"))
    return cells.select("sheet").distinct().join(best, "sheet", "left").select("sheet", F.coalesce("block", F.lit(0)).alias("block"))


def student_cells(cells: DataFrame) -> DataFrame:
    """Typed student rows of the latest block of each sheet, down to its first stop word."""
    heads = cells.where(f"row_no = 2 AND col_no < 5 AND contains(lower(value), 'child name')").groupBy("sheet").agg(F.greatest(F.min("col_no") - 1, F.lit(0)).alias("base"))  # noqa: F541
    placed = cells.where(f"row_no >= {HEADER_ROWS}").join(F.broadcast(latest_blocks(cells)), "sheet").join(F.broadcast(heads), "sheet", "left")
    offset = F.col("col_no") - F.col("block") * BLOCK - F.coalesce("base", F.lit(0))
    table = F.create_map(*[F.lit(x) for name, at in COLUMNS.items() for x in (at, name)])
    named = placed.select("sheet", "row_no", F.try_element_at(table, offset.cast("int")).alias("c"), stripped(F.col("value")).alias("value")).where("c IS NOT NULL")
    rows = named.groupBy("sheet", "row_no").pivot("c", list(COLUMNS)).agg(F.first("value")).na.fill("", list(COLUMNS))
    low = F.lower("name")
    stop = F.startswith(low, F.lit("total")) | F.contains(low, F.lit("holiday suspension")) | low.isin(*TOTALS) | F.lower("no").isin(*TOTALS)
    before = F.max(stop.cast("int")).over(Window.partitionBy("sheet").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rows.withColumn("_stopped", before).where("_stopped = 0 AND name <> '' AND NOT name RLIKE '^[0-9]+$' AND lower(name) NOT IN ('child name', 'no')").drop("_stopped")
    typed = kept.join(F.broadcast(sheet_classes(cells)), "sheet").where("class_id IS NOT NULL")
    days = [day_mark(F.col(d)).alias(d) for d in ("mon", "tue", "wed", "thu", "fri")]
    return typed.select(
        "sheet", "class_id", "row_no", "name", iso_date(F.col("start")).alias("start"), iso_date(F.col("last")).alias("last"), iso_date(F.col("dob")).alias("dob"), *days, lunch_mark(F.col("lunch")).alias("lunch"), "nationality", "parents", "email", "phone",
        with_suspension(F.col("note"), F.col("suspension")).alias("note"), "stay", iso_date(F.col("bond")).alias("bond_paid"), iso_date(F.col("paid_from")).alias("paid_from"), iso_date(F.col("paid_until")).alias("paid_until"),
    )


def import_warnings(cells: DataFrame) -> DataFrame:
    """(sheet, warning): sheets without a class, children without a date of birth, and files without either rows or warnings."""
    students = student_cells(cells)
    unknown = sheet_classes(cells).where("warning IS NOT NULL").select("sheet", "warning")
    undated = students.where("dob = ''").select("sheet", F.concat(F.lit('"'), "name", F.lit('" ('), "sheet", F.lit("): no date of birth")).alias("warning"))
    found = unknown.unionByName(undated)
    nothing = students.select("sheet").limit(1).unionByName(found.select("sheet").limit(1)).agg(F.count("*").alias("n")).where("n = 0")
    return found.unionByName(nothing.select(F.lit("").alias("sheet"), F.lit("no student data found").alias("warning")))


def distinct_parents(students: DataFrame) -> DataFrame:
    """How many parents there are, by name without case."""
    names = students.select(F.explode(F.split("parents", "[/,&]")).alias("p")).select(F.lower(stripped(F.col("p"))).alias("p")).where("p <> ''")
    return names.agg(F.countDistinct("p").alias("n_parents"))


def sheet_counts(students: DataFrame) -> DataFrame:
    """(sheet, class_id, n) for sheets with at least one student."""
    return students.groupBy("sheet", "class_id").agg(F.count("*").alias("n"))
