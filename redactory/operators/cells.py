"""Normalising what people type into forms and sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, tested in this order: (any of these, none of these, class).
CLASS_HINTS = [
    (["el 1", "el1"], [], "el1"), (["1-2"], ["2-3"], "el1"), (["el2 hib", "el2h", "hibiscus"], [], "el2h"), (["el 2", "el2", "daffodil", "2-3"], [], "el2d"),
    (["pk saf", "saffron"], [], "pks"), (["pk lav", "lavender"], [], "pkl"), (["pre k", "pre-k", "pk"], [], "pks"), (["jr", "jun"], [], "jrk"), (["kind"], [], "kg"),
]
FULL, HALF = ["F", "FULL", "FULL DAY", "FD", "Y", "YES"], ["H", "HALF", "HALF DAY", "HD", "AM", "PM"]
LUNCH = ["y", "yes", "true", "1", "✓", "✔", "x"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def class_hint(c: Column) -> Column:
    low, out = F.lower(c), F.lit(None).cast("string")
    for any_of, none_of, name in reversed(CLASS_HINTS):
        test = F.lit(False)
        for x in any_of:
            test = test | F.contains(low, F.lit(x))
        for x in none_of:
            test = test & ~F.contains(low, F.lit(x))
        out = F.when(test, name).otherwise(out)
    return out


def day_mark(c: Column) -> Column:
    v = F.upper(stripped(F.coalesce(c, F.lit(""))))
    return F.when(v.isin(*FULL), "F").when(v.isin(*HALF), "H").otherwise("")


def lunch_mark(c: Column) -> Column:
    return F.lower(stripped(F.coalesce(c, F.lit("")))).isin(*LUNCH)


def iso_date(c: Column) -> Column:
    """d-MMM-yy(yy), ISO, or a serial day number as an ISO date; anything else as it is."""
    v = stripped(F.coalesce(c, F.lit("")))
    part = lambda k: F.regexp_extract(v, r"^(\d{1,2})-([A-Za-z]{3,})-(\d{2,4})$", k)
    months = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))], F.lit("june"), F.lit(6))
    month, year = F.element_at(months, F.lower(part(2))), F.expr("0") + part(3).try_cast("int")
    full = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    written = F.concat(full.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1).try_cast("int").cast("string"), 2, "0"))
    serial = F.when(v.rlike(r"^\d{4,6}(\.0*)?$"), F.date_add(F.lit("1970-01-01").cast("date"), (v.try_cast("double") - 25569).cast("int")).cast("string"))
    return F.coalesce(written, F.try_to_date(v, "yyyy-MM-dd").cast("string"), F.when(v.try_cast("double") > 1000, serial), v)


def title_if_lower(c: Column) -> Column:
    """Words without a capital get one; others stay."""
    return F.array_join(F.transform(F.split(c, " ", -1), lambda w: F.when(F.lower(w) == w, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)), " ")


def slug(c: Column) -> Column:
    """Lower case, underscores for spaces, and four characters of a hash for distinctness."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", "_"), "[^a-z0-9_]", ""), F.lit("_"), F.substring(F.md5(c.cast("binary")), 1, 4))


def short_date(c: Column) -> Column:
    """Day, month and two digits of the year; a dash for none; what is no date as it is."""
    return F.when(c.isNull() | (c == ""), "–").otherwise(F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "d MMM yy"), c))


def recased(c: Column) -> Column:
    """Every word between spaces with a capital and the rest in lower case."""
    return F.array_join(F.transform(F.split(c, " ", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def escaped_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def one_spaced(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def diet_label(c: Column) -> Column:
    """The first ``no_`` and then the first underscore give way to a space."""
    once = lambda x, mark, to: F.when(F.contains(x, F.lit(mark)), F.concat(F.substring_index(x, mark, 1), F.lit(to), F.substring(x, F.length(F.substring_index(x, mark, 1)) + 1 + len(mark), F.lit(1 << 30)))).otherwise(x)
    return once(once(c, "no_", "no "), "_", " ")


def note_head(c: Column, n: int = 40) -> Column:
    return F.when(c.isNull() | (c == ""), "–").otherwise(F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "…").otherwise("")))


def file_size(n: Column) -> Column:
    """Bytes, KB or MB; one decimal, halves upwards."""

    def text(scale: int, unit: str) -> Column:
        tenths = F.floor(n * 10 / scale + 0.5).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, text(1024, " KB")).otherwise(text(1 << 20, " MB"))


def with_suspension(note: Column, suspension: Column) -> Column:
    """The note with a holiday suspension below it, under a heading of its own."""
    own = F.concat(F.lit("Holiday Suspension:\n"), stripped(suspension))
    kept = F.coalesce(note, F.lit(""))
    return F.when(stripped(F.coalesce(suspension, F.lit(""))) == "", kept).when(kept == "", own).otherwise(F.concat(kept, F.lit("\n\n"), own))
