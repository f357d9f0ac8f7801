"""Form e-mails: the labels of their fields, and mails made from customers by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactory.sources.roster import _FIRST, _LAST, _NATIONS, _pick

#: Each label and the field it fills.
FIELDS = {
    "Name (Person completing this form)": "formCompletedBy",
    "Date of arrival to Bali": "arrivalDate",
    "How long do you intend to stay in Bali?": "intendedStay",
    "What classes are you interested in?": "requestedClassRaw",
    "Which days are you looking to enrol?": "daysRequested",
    "Half Day or Full Day?": "halfOrFull",
    "Preferred Start Date": "preferredStart",
    "Childs Full Name": "childNameRaw",
    "Child's Full Name": "childNameRaw",
    "Nationality": "nationality",
    "Date of Birth": "dob",
    "Gender": "gender",
    "Native Language": "nativeLanguage",
    "Parent 1 Contact": "parent1Name",
    "Parent 1 Email": "parent1Email",
    "Parent 1 Occupation": "parent1Occupation",
    "Parent 1 Phone Number": "parent1Phone",
    "Parent 2 Contact": "parent2Name",
    "Parent 2 Email": "parent2Email",
    "Parent 2 Occupation": "parent2Occupation",
    "Parent 2 Phone Number": "parent2Phone",
    "Sibling 1 Name": "sibling1Name",
    "Sibling 1 D.O.B": "sibling1Dob",
    "Sibling 2 Name": "sibling2Name",
    "Sibling 2 D.O.B": "sibling2Dob",
    "Sibling 3 Name": "sibling3Name",
    "Sibling 3 D.O.B": "sibling3Dob",
    "Pembantu / Nanny Name": "nannyName",
    "Pembantu Phone Number": "nannyPhone",
    "Family Doctor": "doctorName",
    "Family Doctor Contact Details": "doctorContact",
    "Has your child had all of their age appropriate vaccinations?": "vaccinationsYesNo",
    "Does your child have any medical disabilities or special educational needs?": "medicalDisabilitiesYesNo",
    "Does your child have any medical problems or allergies?": "medicalProblemsYesNo",
    "Are there any food allergies that your child has?": "foodAllergiesYesNo",
    "Does your child require an Epipen?": "epipen",
    "Is there anything else you would like us to know about your child?": "otherNotes",
}
#: The question that a "more details" line belongs to, and the two that end such waiting.
DETAILS = {"vaccinationsYesNo": "vaccinationsDetails", "medicalDisabilitiesYesNo": "medicalDisabilitiesDetails", "medicalProblemsYesNo": "medicalProblemsDetails", "foodAllergiesYesNo": "foodAllergiesDetails"}
ENDS_WAITING = ["epipen", "otherNotes"]
MORE = r"(?i)^If yes,?\s*please supply"

_K = "c_custkey"
_MORE = "If yes, please supply us with more details."


def _lines(text: str) -> list[tuple[str, str, str | None]]:
    """(condition, label, value) of each line; a line without a label is only its value."""
    number = f"CAST({_K} AS {text})"
    last = _pick(_LAST, _K)
    child = f"concat(lower({_pick(_FIRST, f'{_K} * 2')}), ' ', {_pick(['', 'Mc'], _K)}, {last})"
    every, some = "true", lambda n: f"{_K} % {n} = 0"
    return [
        (every, "", "'Sent from the form on our site'"), (every, "Name (Person completing this form)", f"concat({_pick(_FIRST, _K)}, ' ', {last})"),
        (every, "Date of arrival to Bali", f"concat(lpad(CAST(1 + {_K} % 28 AS {text}), 2, '0'), '-06-2026')"), (every, "How long do you intend to stay in Bali?", _pick(["a year", "18 months", ""], _K)),
        (every, "What classes are you interested in?", _pick(["EL 2 (2-3 years)", "Kindergarten", "PK Lavender", "no idea yet"], _K)),
        (every, "Which days are you looking to enrol?", "'Monday, Friday'"), (every, "Half Day or Full Day?", "'Full Day (8am: sharp)'"), (every, "Preferred Start Date", "'20-07-2026'"),
        (every, "Childs Full Name", child), (some(3), "Unknown question", "'unread'"), (every, "Nationality", _pick(_NATIONS, _K)), (every, "Date of Birth", "'March 14, 2024'"),
        (every, "Gender", _pick(["Female", "male", "a girl", "our boy", ""], _K)), (every, "Native Language", "'Swedish'"), (some(7), "", "'write to me@home.example: soon'"),
        (every, "Parent 1 Contact", f"concat({_pick(_FIRST, f'{_K} + 3')}, ' ', {last})"), (every, "Parent 1 Email", f"concat('one.', {number}, '@example.com')"),
        (every, "Parent 1 Phone Number", f"concat('+43 ', {number})"), (some(2), "Parent 2 Contact", f"concat({_pick(_FIRST, f'{_K} + 5')}, ' ', {last})"),
        (some(2), "Parent 2 Phone Number", f"concat('+44 ', {number})"), (some(4), "Sibling 1 Name", _pick(_FIRST, f"{_K} + 7")), (some(8), "Sibling 2 Name", _pick(_FIRST, f"{_K} + 9")),
        (some(8), "Sibling 2 D.O.B", "'2021'"), (some(5), "Pembantu / Nanny Name", "'Wayan'"),
        (every, "Has your child had all of their age appropriate vaccinations?", "'Yes'"), (every, _MORE, "'DTP, MMR'"),
        (every, "Does your child have any medical disabilities or special educational needs?", "'No'"), (every, "Does your child have any medical problems or allergies?", "'No'"),
        (every, "Are there any food allergies that your child has? *", _pick(["Yes", "No"], _K)), (some(2), _MORE, f"concat('nuts, case ', {number})"),
        (every, "Does your child require an Epipen?", "'No'"), (some(3), _MORE, "'belongs to nothing'"), (every, "Is there anything else you would like us to know about your child?", "'Loves music'"),
        (some(5), "", "'and dancing'"),
    ]


def _mail(text: str, new_line: str) -> str:
    parts = [f"(CASE WHEN {when} THEN concat('{label}{': ' if label else ''}', {value}, {new_line}) ELSE '' END)" for when, label, value in _lines(text)]
    return f"concat({', '.join(parts)})"


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mail_id, text): one form mail a customer. Only keys are dealt out, as mails are read in the task that makes them."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(_K)
    return keys.repartition(3 * spark.sparkContext.defaultParallelism).selectExpr(f"{_K} AS mail_id", f"{_mail('STRING', 'char(10)')} AS text")


def fields_sql() -> str:
    """(mail_id, name, value) as the mails were made, for DuckDB: no mail is read."""
    values = {FIELDS[label.rstrip(" *")]: (when, value) for when, label, value in _lines("VARCHAR") if label.rstrip(" *") in FIELDS}
    values["nativeLanguage"] = ("true", f"(CASE WHEN {_K} % 7 = 0 THEN 'Swedish' || chr(10) || 'write to me@home.example: soon' ELSE 'Swedish' END)")
    values["otherNotes"] = ("true", f"(CASE WHEN {_K} % 5 = 0 THEN 'Loves music' || chr(10) || 'and dancing' ELSE 'Loves music' END)")
    values["vaccinationsDetails"], values["foodAllergiesDetails"] = ("true", "'DTP, MMR'"), (f"{_K} % 2 = 0", f"'nuts, case ' || {_K}")
    child = values["childNameRaw"][1]
    values["childName"] = ("true", f"(upper(substr({child}, 1, 1)) || substr({child}, 2))")
    values["requestedClass"] = (f"{_K} % 4 < 3", _pick(["el2d", "kg", "pkl", ""], _K))
    return " UNION ALL ".join(f"SELECT {_K} AS mail_id, '{name}' AS name, {value} AS value FROM customer WHERE {when}" for name, (when, value) in values.items())
