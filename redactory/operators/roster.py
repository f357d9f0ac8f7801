"""Reports over a roster of students and classes. Absent text is ''. Dates are ISO text with sentinels such as 'tbc'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.io import sent_if_small

ACTIVE, PIPELINE = ("enrolled", "suspended"), ("inquiry", "quote_sent", "invoice_sent")
#: The orders in which statuses change.
STATUS_CYCLE = ["inquiry", "quote_sent", "invoice_sent", "wait_list", "enrolled", "suspended", "left"]
INVOICE_CYCLE = ["not_sent", "sent", "paid", "prepay"]
ADVANCE = {"inquiry": "quote_sent", "quote_sent": "invoice_sent", "invoice_sent": "enrolled", "wait_list": "enrolled"}
STATUS_LABELS = {
    "inquiry": "Inquiry", "quote_sent": "Quote sent", "invoice_sent": "Invoice sent", "wait_list": "Wait list", "enrolled": "Enrolled", "suspended": "Suspended", "left": "Left",
    "cancelled": "Cancelled",
}
INVOICE_LABELS = {"not_sent": "Not sent", "sent": "Sent", "paid": "Paid", "prepay": "Prepay"}
DAY_CYCLE, GENDER_CYCLE = {"": "F", "F": "H", "H": ""}, {"F": "M", "M": "X", "X": "F"}
TODAY = "2026-05-21"


def scope(students: DataFrame, centre: str = "north", class_id: str | None = None) -> DataFrame:
    """Students of a centre, and of a class if one is given, that are not archived."""
    out = students.where((F.col("centre") == centre) & (F.col("archived") == 0))
    return out if class_id is None else out.where(F.col("class_id") == class_id)


def daily_totals(active: DataFrame) -> DataFrame:
    """(day, full, half, total) for each weekday, in one pass."""
    days = active.select(F.expr("stack(5, 'mon', mon, 'tue', tue, 'wed', wed, 'thu', thu, 'fri', fri) AS (day, v)"))
    return days.groupBy("day").agg(F.count_if(F.col("v") == "F").alias("n_full"), F.count_if(F.col("v") == "H").alias("n_half"), F.count_if(F.col("v").isin("F", "H")).alias("n_all"))


def age_text(dob: Column, today: str = TODAY) -> Column:
    """Years and months; days are ignored; a dash where there is no date."""
    d = F.try_to_date(dob, "yyyy-MM-dd")
    months = (F.year(F.lit(today).cast("date")) - F.year(d)) * 12 + F.month(F.lit(today).cast("date")) - F.month(d)
    return F.coalesce(F.concat(F.floor(months / 12).cast("string"), F.lit("Y "), (months % 12).cast("string"), F.lit("M")), F.lit("–"))


def capacity_by_class(students: DataFrame, classes: DataFrame, centre: str) -> DataFrame:
    """Places taken for every class, also the empty ones, with a band."""
    taken = scope(students, centre).where(F.col("status").isin(*ACTIVE)).groupBy("class_id").agg(F.count("*").alias("n"))
    out = classes.join(F.broadcast(taken), classes.id == taken.class_id, "left").select("id", "name", "capacity", F.coalesce("n", F.lit(0)).alias("taken"))
    percent = F.floor(F.col("taken") * 100 / F.col("capacity") + 0.5).cast("long")
    return out.withColumn("percent", percent).withColumn("band", F.when(percent >= 100, "full").when(percent >= 85, "tight").otherwise("open"))


def forecast(students: DataFrame, classes: DataFrame, centre: str, weeks: int = 12) -> DataFrame:
    """(class, week, expected) with a total for each week: places taken plus a fixed wave, never below none."""
    base = capacity_by_class(students, classes, centre).select("id", "taken")
    grid = base.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    wave = F.sin((F.ascii(F.col("id")) + F.col("week")) * F.lit(0.7)) * 2
    cells = grid.select("id", "week", F.greatest(F.lit(0), F.floor(F.col("taken") + wave + 0.5)).cast("long").alias("expected"))
    return cells.rollup("week", "id").agg(F.sum("expected").alias("expected")).where("week IS NOT NULL").select(F.coalesce("id", F.lit("TOTAL")).alias("class_id"), "week", "expected")


def cycled(value: Column, order: list[str]) -> Column:
    """The next in a cycle; what is not in it goes to the first."""
    ring = F.array(*map(F.lit, order))
    return F.element_at(ring, (F.pmod(F.array_position(ring, value), F.lit(len(order))) + 1).cast("int"))


def advanced(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ADVANCE.items() for x in pair])
    return F.coalesce(F.element_at(table, status), status)


def searched(students: DataFrame, text: str, columns: list[str]) -> DataFrame:
    any_of = F.lit(False)
    for c in columns:
        any_of = any_of | F.contains(F.lower(c), F.lit(text.lower()))
    return students.where(any_of)


def archive(students: DataFrame) -> DataFrame:
    return students.where("archived = 1").withColumn("start_year", F.year(F.try_to_date("start_date", "yyyy-MM-dd")))


def numbered(students: DataFrame) -> DataFrame:
    """A running number in each section: active, pipeline, or left and the rest."""
    section = F.when(F.col("status").isin(*ACTIVE), "active").when(F.col("status").isin(*PIPELINE, "wait_list"), "pipeline").otherwise("left")
    return students.withColumn("section", section).withColumn("no", F.row_number().over(Window.partitionBy("class_id", "section").orderBy("id")).cast("long"))


def deletable(classes: DataFrame, students: DataFrame) -> DataFrame:
    """Classes that no student in the roster is in, archived ones aside."""
    used = students.where("archived = 0").select(F.col("class_id").alias("id")).distinct()
    return classes.join(used, "id", "left_anti")


def looked_up(value: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """A small code table as a map expression; what is not in it is ``otherwise``, by default the value itself."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), value if otherwise is None else otherwise)


def forecast_band(expected: Column, capacity: Column) -> Column:
    percent = F.floor(expected * 100 / capacity + 0.5)
    return F.when(percent >= 100, "full").when(percent >= 85, "tight").when(percent >= 60, "filling").otherwise("open")


def next_ids(students: DataFrame, added: DataFrame, key: str, size: int = 100_000) -> DataFrame:
    """Rows to append with ids after the greatest, in order of the key, a whole number that says which row came first.

    Runs of ``size`` keys are numbered each by itself and start after those before them; only the runs' sizes meet in one
    place. Rows without a key come first.
    """
    top = students.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    placed = added.withColumn("_run", F.coalesce(F.floor(F.col(key) / size), F.lit(-(1 << 62))))
    sizes = placed.groupBy("_run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_run", before.alias("_before")).crossJoin(F.broadcast(top))  # one row beside each run
    inside = F.row_number().over(Window.partitionBy("_run").orderBy(key))
    out = placed.withColumn("_no", inside).join(starts, "_run")
    return out.withColumn("id", (F.col("top") + F.col("_before") + F.col("_no")).cast("int")).drop("_run", "_no", "_before", "top")


def updated(students: DataFrame, patches: DataFrame) -> DataFrame:
    """students with the values of patches (id and some of the columns) where they are not null; unknown ids change nothing."""
    changed = [c for c in patches.columns if c != "id"]
    own = patches.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in changed]).dropDuplicates(["id"])
    return students.join(own, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in students.columns])


def archived(students: DataFrame, ids: DataFrame, on: bool = True) -> DataFrame:
    """Soft delete (or its undoing) by id."""
    return students.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left").withColumn("archived", F.when(F.col("_hit"), F.lit(int(on))).otherwise(F.col("archived"))).select(*students.columns)


def deleted(students: DataFrame, ids: DataFrame) -> DataFrame:
    return students.join(ids.select("id"), "id", "left_anti")


def imported(parsed: DataFrame, centre: str, key: str) -> DataFrame:
    """Parsed rows as the whole new roster: ids from 1, this centre, billing reset. Whatever was there before is gone."""
    none = parsed.sparkSession.createDataFrame([], "id int")
    fresh = next_ids(none, parsed, key)
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("Unnamed"))
    return fresh.withColumn("name", name).withColumn("centre", F.lit(centre)).withColumn("invoice", F.lit("not_sent")).withColumn("bond", F.lit(0)).withColumn("archived", F.lit(0))


def import_summary(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, name, n) of what was parsed; a class that is not known is named by its id."""
    counted = parsed.groupBy(F.coalesce(F.nullif("class_id", F.lit("")), F.lit("unknown")).alias("class_id")).agg(F.count("*").alias("n"))
    named = F.broadcast(classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name")))
    return counted.join(named, "class_id", "left").select("class_id", F.coalesce("class_name", "class_id").alias("name"), "n")


def guessed_gender(people: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """people with ``guess``: F, M or X by the first name without accents, from a dictionary (first_name, gender)."""
    plain = F.translate(F.lower(F.regexp_extract(F.trim(F.col(name)), r"^(\S+)", 1)), "áàâãäåéèêëíìîïóòôõöúùûüçñøð", "aaaaaaeeeeiiiiooooouuuucnod")
    first = F.replace(plain, F.lit("æ"), F.lit("ae"))
    known = sent_if_small(dictionary.groupBy(F.col("first_name").alias("_first")).agg(F.min("gender").alias("_gender")))
    return people.withColumn("_first", first).join(known, "_first", "left").withColumn("guess", F.coalesce("_gender", F.lit("X"))).drop("_first", "_gender")
