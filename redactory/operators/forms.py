"""Form e-mails to fields: labelled lines, continuations, and details that belong to the question before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.operators.cells import class_hint, stripped, title_if_lower
from redactory.sources.form_mail import DETAILS, ENDS_WAITING, FIELDS, MORE

_LABEL = r"^([^:]{1,100}):\s*(.*)$"
#: (field, field made of it, how).
_DERIVED = [("childNameRaw", "childName", title_if_lower), ("requestedClassRaw", "requestedClass", class_hint)]


def _labelled(mails: DataFrame) -> DataFrame:
    """mails with _fields, structs (key, value) in their order: a line without a label goes on with the field before it."""

    def is_key(x: Column) -> Column:
        return (x["key"] != "") & ~F.contains(x["key"], F.lit("@")) & ~F.startswith(F.lower(x["key"]), F.lit("http")) & ~F.contains(x["key"], F.lit("://"))

    def field(at: Column, upto: Column) -> Column:
        head, more = F.get("_lines", at), F.transform(F.slice("_lines", at + 2, upto - at - 1), lambda x: x["line"])
        values = F.filter(F.concat(F.array(stripped(F.regexp_extract(head["line"], _LABEL, 2))), more), lambda v: v != "")
        return F.struct(F.regexp_replace(stripped(head["key"]), r"\s*\*+\s*$", "").alias("key"), F.array_join(values, "\n").alias("value"))

    lines = F.transform(F.filter(F.transform(F.split("text", "\n", -1), stripped), lambda x: x != ""), lambda x: F.struct(x.alias("line"), F.regexp_extract(x, _LABEL, 1).alias("key")))
    out = mails.withColumn("_lines", lines).withColumn("_at", F.filter(F.transform("_lines", lambda x, i: F.when(is_key(x), i)), lambda i: i.isNotNull()))
    return out.withColumn("_fields", F.transform("_at", lambda at, k: field(at, F.coalesce(F.get("_at", k + 1), F.size("_lines")))))


def form_values(mails: DataFrame) -> DataFrame:
    """mails (mail_id, text) -> (mail_id, fields): structs (name, value) of known fields only, the last value of each.

    Details go under the question they follow. A mail is one row, so it is parsed in its row, and no mails meet.
    """
    table = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    waits = F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair])

    def named(f: Column, i: Column) -> Column:
        more = f["key"].rlike(MORE)
        return F.struct(i.alias("pos"), F.when(~more, F.element_at(table, f["key"])).alias("name"), f["value"].alias("value"), more.alias("more"))

    # the details field, or '' where waiting ends; a line of details ends it too
    mark = lambda f: F.when(f["more"] | f["name"].isin(*ENDS_WAITING), "").otherwise(F.element_at(waits, f["name"]))
    entry = lambda name, f: F.struct(name.alias("name"), f["pos"].alias("pos"), f["value"].alias("value"))
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    out = _labelled(mails).withColumn("_named", F.transform("_fields", named))
    out = out.withColumn("_marked", F.filter(F.transform("_named", lambda f: F.struct(f.alias("f"), mark(f).alias("mark"))), lambda m: m["mark"].isNotNull()))
    # every line of details has a mark, so what it waits for is the mark just before its own
    details = F.transform("_marked", lambda m, k: entry(F.when(m["f"]["more"], F.nullif(F.get("_marked", k - 1)["mark"], F.lit(""))), m["f"]))
    every = F.concat(F.transform("_named", lambda f: entry(f["name"], f)), details)
    out = out.withColumn("_known", F.sort_array(F.filter(every, lambda e: e["name"].isNotNull())))
    last = F.filter("_known", lambda e, k: F.coalesce(F.get("_known", k + 1)["name"] != e["name"], F.lit(True)))
    out = out.withColumn("_last", F.transform(last, lambda e: pair(e["name"], e["value"])))

    def made_of(source: str, name: str, derive) -> Column:
        return F.transform(F.filter("_last", lambda e: e["name"] == source), lambda e: pair(F.lit(name), derive(e["value"])))

    derived = F.filter(F.concat(*[made_of(*d) for d in _DERIVED]), lambda e: e["value"].isNotNull())
    return out.select("mail_id", F.concat("_last", derived).alias("fields"))


def form_fields(mails: DataFrame) -> DataFrame:
    """(mail_id, name, value): known fields only, the last value of each; details under the question they follow."""
    # outer, as a plain generator or a filter on the fields makes the optimizer parse every mail once more for that filter
    return form_values(mails).select("mail_id", F.inline_outer("fields")).where("name IS NOT NULL")


def mail_inquiries(mails: DataFrame) -> DataFrame:
    """inquiry_rows of mails (mail_id, text), each made in the mail's row; a mail without known fields gives none."""
    values = F.when(F.size("fields") > 0, F.array(F.map_from_entries("fields")))
    return _inquiries(form_values(mails).select("mail_id", F.explode_outer(values).alias("values")).where("values IS NOT NULL"))


def inquiry_rows(fields: DataFrame) -> DataFrame:
    """One row a mail, as it joins the roster: status inquiry, class el2d by default, contacts marked by parent."""
    one = fields.groupBy("mail_id", "name").agg(F.first("value").alias("value"))
    return _inquiries(one.groupBy("mail_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values")))


def _inquiries(mails: DataFrame) -> DataFrame:
    names = sorted({*FIELDS.values(), *DETAILS.values(), "childName", "requestedClass"})
    wide = mails.select("mail_id", *(F.element_at("values", n).alias(n) for n in names))
    text = lambda c: F.coalesce(c, F.lit(""))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    low = F.lower(text("gender"))
    gender = F.when(F.startswith(low, F.lit("f")) | F.contains(low, F.lit("girl")), "F").when(F.startswith(low, F.lit("m")) | F.contains(low, F.lit("boy")), "M").otherwise("X")
    joined = lambda by, *cs: F.array_join(F.array_compact(F.array(*cs)), by)
    sibling = lambda k: F.when(some(f"sibling{k}Name").isNotNull(), F.struct(F.col(f"sibling{k}Name").alias("name"), text(f"sibling{k}Dob").alias("dob")))
    parent = lambda k: F.struct(*(text(f"parent{k}{c}").alias(c.lower()) for c in ("Name", "Email", "Phone", "Occupation")))
    pair = lambda a, b, second: F.when(F.coalesce(some(a), some(b)).isNotNull(), F.struct(text(a).alias("name"), text(b).alias(second)))
    kept = ["dob", "nationality", "nativeLanguage", "arrivalDate", "intendedStay", "daysRequested", "halfOrFull", "requestedClassRaw", "formCompletedBy", "epipen"]
    medical = [f"{x}{y}" for x in ("vaccinations", "medicalDisabilities", "medicalProblems", "foodAllergies") for y in ("YesNo", "Details")]
    return wide.select(
        "mail_id", F.coalesce(some("childName"), some("childNameRaw"), F.lit("Unnamed child")).alias("name"), gender.alias("gender"),
        F.coalesce(some("requestedClass"), F.lit("el2d")).alias("class_id"), F.lit("inquiry").alias("status"),
        joined(" / ", some("parent1Name"), some("parent2Name")).alias("parents"), joined("\n", F.concat(some("parent1Phone"), F.lit(" (M)")), F.concat(some("parent2Phone"), F.lit(" (D)"))).alias("phone"),
        joined("\n", some("parent1Email"), some("parent2Email")).alias("email"), F.array_compact(F.array(sibling(1), sibling(2), sibling(3))).alias("siblings"),
        parent(1).alias("parent1"), parent(2).alias("parent2"), pair("nannyName", "nannyPhone", "phone").alias("nanny"), pair("doctorName", "doctorContact", "contact").alias("doctor"),
        *(text(c).alias(c) for c in (*kept, *medical)), text("otherNotes").alias("note"), text("preferredStart").alias("start_date"), F.lit("not_sent").alias("invoice"),
    )
