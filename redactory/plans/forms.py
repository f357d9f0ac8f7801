"""Queries over form mails and sheets made from customers, with their SQL, which builds what must come out and reads no mail."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactory.operators import forms, sheets
from redactory.sources.form_mail import fields_sql, mails
from redactory.sources.roster import roster_sql, students
from redactory.sources.sheets import SHEETS, sheet_cells


def _fields(spark, sf_dir):
    return forms.form_fields(mails(spark, sf_dir))


def _inquiries(spark, sf_dir):
    rows = forms.mail_inquiries(mails(spark, sf_dir))
    siblings = F.array_join(F.transform("siblings", lambda x: F.concat(x["name"], F.lit("|"), x["dob"])), ";")
    return rows.select("mail_id", "name", "gender", "class_id", "status", "parents", "phone", "email", siblings.alias("siblings"), F.col("nanny.name").alias("nanny"), "note", "foodAllergiesDetails")


def _cells(spark, sf_dir):
    return sheet_cells(students(spark, sf_dir))


def _imported(spark, sf_dir):
    return sheets.student_cells(_cells(spark, sf_dir))


_WIDE = "SELECT mail_id, " + ", ".join(f"max(value) FILTER (name = '{c}') AS {c}" for c in ("childName", "gender", "requestedClass", "parent1Name", "parent2Name", "parent1Phone", "parent2Phone", "parent1Email", "sibling1Name", "sibling2Name", "sibling2Dob", "nannyName", "otherNotes", "foodAllergiesDetails")) + f" FROM ({fields_sql()}) GROUP BY mail_id"
#: Rows that the sheets hold of their latest block, in the order in which they are numbered.
_ROWS = f"""{roster_sql()}, listed AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY id) AS no FROM students WHERE centre = 'north' AND archived = 0 AND class_id <> 'gone')
  SELECT class_id AS sheet, class_id, no + 2 AS row_no, name, CASE WHEN start_date = 'tbc' THEN 'tbc' ELSE start_date END AS start, mon, wed, lunch = 1 AS lunch, parents FROM listed"""

QUERIES = {
    "email_fields": _fields,
    "email_pending_details": lambda spark, sf_dir: _fields(spark, sf_dir).where("name LIKE '%Details'"),
    "email_inquiry_row": _inquiries,
    "import_latest_block": lambda spark, sf_dir: sheets.latest_blocks(_cells(spark, sf_dir)),
    "import_until_total": lambda spark, sf_dir: _imported(spark, sf_dir).select(F.col("class_id").alias("sheet"), "class_id", "row_no", "name", "start", "mon", "wed", "lunch", "parents"),
    "import_sheet_counts": lambda spark, sf_dir: sheets.sheet_counts(_imported(spark, sf_dir)).select("class_id", "n"),
    "import_warnings": lambda spark, sf_dir: sheets.import_warnings(_cells(spark, sf_dir)),
    "distinct_parents": lambda spark, sf_dir: sheets.distinct_parents(_imported(spark, sf_dir)),
}
SQL: dict[str, str] = {
    "email_fields": fields_sql(),
    "email_pending_details": f"SELECT * FROM ({fields_sql()}) WHERE name LIKE '%Details'",
    "email_inquiry_row": f"""SELECT mail_id, childName AS name, CASE WHEN gender IN ('Female', 'a girl') THEN 'F' WHEN gender IN ('male', 'our boy') THEN 'M' ELSE 'X' END AS gender,
      coalesce(requestedClass, 'el2d') AS class_id, 'inquiry' AS status, concat_ws(' / ', parent1Name, parent2Name) AS parents, concat_ws(chr(10), parent1Phone || ' (M)', parent2Phone || ' (D)') AS phone,
      parent1Email AS email, concat_ws(';', sibling1Name || '|', sibling2Name || '|' || sibling2Dob) AS siblings, nannyName AS nanny, otherNotes AS note, coalesce(foodAllergiesDetails, '') AS foodAllergiesDetails FROM ({_WIDE})""",
    "import_until_total": _ROWS,
    "import_warnings": f"""WITH kept AS ({_ROWS.replace("name, CASE", "name, dob, CASE")}), sheets(class_id, sheet) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in SHEETS.items())})
      SELECT s.sheet, '"' || name || '" (' || s.sheet || '): no date of birth' AS warning FROM kept JOIN sheets s USING (class_id) WHERE dob = ''""",
    "import_sheet_counts": f"SELECT class_id, count(*) AS n FROM ({_ROWS}) GROUP BY class_id",
    "distinct_parents": f"SELECT count(DISTINCT p) AS n_parents FROM (SELECT trim(lower(unnest(string_split(parents, '&')))) AS p FROM ({_ROWS})) WHERE p <> ''",
    "import_latest_block": "SELECT * FROM (VALUES ('EL 1', 1), ('EL2 Daf', 0), ('EL2 Hib', 1), ('PK Saf', 1), ('PK Lav', 1), ('Jr. Kindergarten', 1), ('Kindergarten', 1), ('Age Calculator', 0)) AS v(sheet, block)",
}
