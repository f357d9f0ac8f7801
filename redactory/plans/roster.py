"""Roster, form and sheet queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactory.operators import cells, roster
from redactory.sources.roster import classes, roster_sql, students

QUERIES, SQL = {}, {}


def _add(name: str, build, sql: str):
    QUERIES[name] = lambda spark, sf_dir: build(students(spark, sf_dir), classes(spark))
    SQL[name] = f"{roster_sql()} {sql}"


_ACTIVE, _PIPE = "('enrolled', 'suspended')", "('inquiry', 'quote_sent', 'invoice_sent')"
_HERE = "centre = 'north' AND archived = 0"

_add("roster_active", lambda s, c: roster.scope(s, "north", "el2d").where(F.col("status").isin(*roster.ACTIVE)).select("id", "name", "status"), f"SELECT id, name, status FROM students WHERE {_HERE} AND class_id = 'el2d' AND status IN {_ACTIVE}")
_add(
    "roster_sections_rownum", lambda s, c: roster.numbered(roster.scope(s)).select("id", "class_id", "section", "no"),
    f"""SELECT id, class_id, section, row_number() OVER (PARTITION BY class_id, section ORDER BY id) AS no FROM (
        SELECT *, CASE WHEN status IN {_ACTIVE} THEN 'active' WHEN status IN {_PIPE} OR status = 'wait_list' THEN 'pipeline' ELSE 'left' END AS section FROM students WHERE {_HERE})""",
)
_add(
    "daily_totals", lambda s, c: roster.daily_totals(roster.scope(s, "north", "el2d").where(F.col("status").isin(*roster.ACTIVE))),
    "SELECT day, count_if(v = 'F') AS n_full, count_if(v = 'H') AS n_half, count_if(v IN ('F', 'H')) AS n_all FROM ("
    + " UNION ALL ".join(f"SELECT '{d}' AS day, {d} AS v FROM students WHERE {_HERE} AND class_id = 'el2d' AND status IN {_ACTIVE}" for d in ("mon", "tue", "wed", "thu", "fri")) + ") GROUP BY day",
)
_add(
    "dashboard_stats",
    lambda s, c: roster.scope(s).agg(
        F.count("*").alias("n_students"), F.count_if(F.col("status") == "enrolled").alias("n_enrolled"), F.count_if(F.col("status").isin(*roster.PIPELINE)).alias("n_pipeline"),
        F.count_if(F.col("status") == "wait_list").alias("n_wait"), F.count_if(F.col("status") == "suspended").alias("n_suspended"), F.sum("lunch").alias("n_lunch"),
    ),
    f"""SELECT count(*) AS n_students, count_if(status = 'enrolled') AS n_enrolled, count_if(status IN {_PIPE}) AS n_pipeline, count_if(status = 'wait_list') AS n_wait,
        count_if(status = 'suspended') AS n_suspended, CAST(sum(lunch) AS BIGINT) AS n_lunch FROM students WHERE {_HERE}""",
)
_TAKEN = f"""SELECT c.id, c.name, c.capacity, count(s.id) AS taken FROM classes c LEFT JOIN students s ON s.class_id = c.id AND {_HERE} AND s.status IN {_ACTIVE} GROUP BY c.id, c.name, c.capacity"""
_add(
    "capacity_by_class", lambda s, c: roster.capacity_by_class(s, c, "north"),
    f"""SELECT *, CASE WHEN percent >= 100 THEN 'full' WHEN percent >= 85 THEN 'tight' ELSE 'open' END AS band FROM (
        SELECT *, CAST(floor(taken * 100 / capacity + 0.5) AS BIGINT) AS percent FROM ({_TAKEN}))""",
)
_CELLS = f"""SELECT id, week, CAST(greatest(0, floor(taken + sin((ascii(id) + week) * 0.7) * 2 + 0.5)) AS BIGINT) AS expected FROM ({_TAKEN}) CROSS JOIN (SELECT unnest(range(12)) AS week)"""
_add("forecast_grid", lambda s, c: roster.forecast(s, c, "north").where("class_id <> 'TOTAL'"), f"SELECT id AS class_id, week, expected FROM ({_CELLS})")
_add("forecast_totals", lambda s, c: roster.forecast(s, c, "north").where("class_id = 'TOTAL'"), f"SELECT 'TOTAL' AS class_id, week, CAST(sum(expected) AS BIGINT) AS expected FROM ({_CELLS}) GROUP BY week")
_add("follow_ups", lambda s, c: roster.scope(s).where(F.col("status").isin("quote_sent", "invoice_sent")).select("id", "name"), f"SELECT id, name FROM students WHERE {_HERE} AND status IN ('quote_sent', 'invoice_sent')")
_add(
    "prepay_expiring", lambda s, c: roster.scope(s).where("prepay_weeks - prepay_completed <= 5").select("id", "name", (F.col("prepay_weeks") - F.col("prepay_completed")).alias("remaining"), F.floor(F.col("prepay_completed") * 100 / F.col("prepay_weeks") + 0.5).cast("long").alias("percent")),
    f"SELECT id, name, prepay_weeks - prepay_completed AS remaining, CAST(floor(prepay_completed * 100 / prepay_weeks + 0.5) AS BIGINT) AS percent FROM students WHERE {_HERE} AND prepay_weeks - prepay_completed <= 5",
)
_add(
    "suspension_alerts", lambda s, c: roster.scope(s).where("n_suspensions >= 3").select("id", "name", F.when(F.col("n_suspensions") >= 4, "cap reached").otherwise("one left").alias("band")),
    f"SELECT id, name, CASE WHEN n_suspensions >= 4 THEN 'cap reached' ELSE 'one left' END AS band FROM students WHERE {_HERE} AND n_suspensions >= 3",
)
_add("pipeline_by_stage", lambda s, c: s.where("archived = 0").groupBy("centre", "status").agg(F.count("*").alias("n")), "SELECT centre, status, count(*) AS n FROM students WHERE archived = 0 GROUP BY centre, status")
_LIKE = lambda text, columns: "(" + " OR ".join(f"contains(lower({c}), '{text}')" for c in columns) + ")"
_ANY, _WHO = ["name", "nationality", "parents"], ["name", "nationality", "parents", "email"]
_add("all_students_search", lambda s, c: roster.searched(roster.scope(s).where("status = 'enrolled' AND class_id = 'pks'"), "AUSTR", _ANY).select("id", "name", "parents"), f"SELECT id, name, parents FROM students WHERE {_HERE} AND status = 'enrolled' AND class_id = 'pks' AND {_LIKE('austr', _ANY)}")
_add("archive_search", lambda s, c: roster.searched(roster.archive(s).where("start_year = 2023 AND class_id = 'el2d'"), "FAMILY.1", _WHO).select("id", "name", "email", "start_year"), f"SELECT id, name, email, 2023 AS start_year FROM students WHERE archived = 1 AND class_id = 'el2d' AND start_date LIKE '2023%' AND {_LIKE('family.1', _WHO)}")
_add("pipeline_badge", lambda s, c: s.where("centre = 'north' AND archived = 0").where(F.col("status").isin(*roster.PIPELINE, "wait_list")).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM students WHERE {_HERE} AND (status IN {_PIPE} OR status = 'wait_list')")
_add("archive_years", lambda s, c: roster.archive(s).select("start_year").distinct().orderBy(F.desc("start_year")), "SELECT DISTINCT year(TRY_CAST(start_date AS DATE)) AS start_year FROM students WHERE archived = 1 ORDER BY 1 DESC")
_add(
    "ages", lambda s, c: s.select("id", roster.age_text(F.col("dob")).alias("age")),
    """SELECT id, coalesce((m // 12) || 'Y ' || (m % 12) || 'M', '–') AS age FROM (SELECT id, (2026 - year(d)) * 12 + 5 - month(d) AS m FROM (SELECT id, TRY_CAST(dob AS DATE) AS d FROM students))""",
)
_CYCLE = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(roster.STATUS_CYCLE, [*roster.STATUS_CYCLE[1:], roster.STATUS_CYCLE[0]])) + " ELSE 'inquiry' END"
_INVOICE = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(roster.INVOICE_CYCLE, [*roster.INVOICE_CYCLE[1:], roster.INVOICE_CYCLE[0]])) + " ELSE 'not_sent' END"
_add(
    "status_cycle", lambda s, c: s.select("id", roster.cycled(F.col("status"), roster.STATUS_CYCLE).alias("status"), roster.cycled(F.col("invoice"), roster.INVOICE_CYCLE).alias("invoice")),
    f"SELECT id, {_CYCLE.format(c='status')} AS status, {_INVOICE.format(c='invoice')} AS invoice FROM students",
)
_ADVANCE = "CASE status " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in roster.ADVANCE.items()) + " ELSE status END"
_add("advance_pipeline", lambda s, c: s.where("archived = 0").select("id", roster.advanced(F.col("status")).alias("status")), f"SELECT id, {_ADVANCE} AS status FROM students WHERE archived = 0")
_opened = lambda c: c.select("id").unionByName(c.select(F.concat("id", F.lit(" (new)")).alias("id")))  # noqa: E731  each class, and a new one beside it that nobody is in yet
_add("delete_guard", lambda s, c: roster.deletable(_opened(c), roster.scope(s, "south")).select("id"), "SELECT id FROM (SELECT id FROM classes UNION ALL SELECT id || ' (new)' FROM classes) WHERE id NOT IN (SELECT class_id FROM students WHERE archived = 0 AND centre = 'south')")
_add("class_lookup", lambda s, c: s.join(F.broadcast(c.select(F.col("id").alias("cid"), F.col("name").alias("class_name"))), F.col("class_id") == F.col("cid"), "left").select("id", F.coalesce("class_name", "class_id").alias("class_name")), "SELECT s.id, coalesce(c.name, s.class_id) AS class_name FROM students s LEFT JOIN classes c ON c.id = s.class_id")
_add("sidebar_counts", lambda s, c: s.where("centre = 'north'").groupBy("class_id").agg(F.count("*").alias("n")), "SELECT class_id, count(*) AS n FROM students WHERE centre = 'north' GROUP BY class_id")
_NEW = "(SELECT 'New ' || name AS name, id AS k FROM students WHERE archived = 1)"
_add(
    "added_students",
    lambda s, c: s.select("id", "name").unionByName(roster.next_ids(s.select("id"), s.where("archived = 1").select(F.concat(F.lit("New "), "name").alias("name"), F.col("id").alias("k")), "k").select("id", "name")),
    f"SELECT id, name FROM students UNION ALL SELECT CAST((SELECT max(id) FROM students) + row_number() OVER (ORDER BY k) AS INTEGER), name FROM {_NEW}",
)
_add(
    "import_replaces", lambda s, c: roster.imported(s.where("status = 'inquiry'").withColumn("k", F.col("id")).drop("id"), "south", "k").select("id", "name", "centre", "class_id", "invoice", "bond", "archived"),
    """SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS id, name, 'south' AS centre, class_id, 'not_sent' AS invoice, 0 AS bond, 0 AS archived FROM students WHERE status = 'inquiry'""",
)
_add(
    "import_summary", lambda s, c: roster.import_summary(s.where("status = 'enrolled'"), c),
    "SELECT class_id, coalesce(max(c.name), class_id) AS name, count(*) AS n FROM students s LEFT JOIN classes c ON c.id = s.class_id WHERE status = 'enrolled' GROUP BY class_id",
)
_add(
    "updated_students", lambda s, c: roster.updated(s, s.where("id % 5 = 0").select("id", F.lit("wait_list").alias("status"), F.when(F.col("id") % 2 == 0, F.lit("kg")).alias("class_id"))).select("id", "status", "class_id"),
    "SELECT id, CASE WHEN id % 5 = 0 THEN 'wait_list' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 'kg' ELSE class_id END AS class_id FROM students",
)
_add("archived_and_restored", lambda s, c: roster.archived(roster.archived(s, s.where("status = 'left'").select("id")), s.where("id % 26 = 0").select("id"), False).select("id", "archived"), "SELECT id, CAST(CASE WHEN id % 26 = 0 THEN 0 WHEN status = 'left' THEN 1 ELSE archived END AS INTEGER) AS archived FROM students")
_add("deleted_students", lambda s, c: roster.deleted(s, s.where("status = 'cancelled'").select("id")).select("id", "status"), "SELECT id, status FROM students WHERE status <> 'cancelled'")
_add(
    "day_and_gender_cycles", lambda s, c: s.select("id", roster.looked_up(F.col("mon"), roster.DAY_CYCLE).alias("mon"), roster.looked_up(F.col("gender"), roster.GENDER_CYCLE).alias("gender")),
    "SELECT id, CASE mon WHEN '' THEN 'F' WHEN 'F' THEN 'H' ELSE '' END AS mon, CASE gender WHEN 'F' THEN 'M' WHEN 'M' THEN 'X' ELSE 'F' END AS gender FROM students",
)
_BILLED, _NOT_SENT, _FIRST_NAME, _UNKNOWN = "nullif(invoice, 'prepay')", "'Not sent'", "lower(split_part(name, ' ', 1))", "'X'"
_LABELS = lambda c, table, other: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"
_add(
    "code_labels", lambda s, c: s.select("id", roster.looked_up(F.col("status"), roster.STATUS_LABELS).alias("status"), roster.looked_up(F.nullif(F.col("invoice"), F.lit("prepay")), roster.INVOICE_LABELS, F.lit("Not sent")).alias("invoice")),
    f"SELECT id, {_LABELS('status', roster.STATUS_LABELS, 'status')} AS status, {_LABELS(_BILLED, roster.INVOICE_LABELS, _NOT_SENT)} AS invoice FROM students",
)
_add(
    "forecast_bands", lambda s, c: roster.forecast(s, c, "north").where("class_id <> 'TOTAL'").join(F.broadcast(c.select(F.col("id").alias("class_id"), "capacity")), "class_id").select("class_id", "week", roster.forecast_band(F.col("expected"), F.col("capacity")).alias("band")),
    f"""SELECT class_id, week, CASE WHEN p >= 100 THEN 'full' WHEN p >= 85 THEN 'tight' WHEN p >= 60 THEN 'filling' ELSE 'open' END AS band FROM (
        SELECT x.id AS class_id, week, floor(expected * 100 / capacity + 0.5) AS p FROM ({_CELLS}) x JOIN classes c ON c.id = x.id)""",
)
_add(
    "class_changes",  # one class added with an id from its name, one renamed, and one without students deleted
    lambda s, c: roster.deletable(c.where("id = 'el1'"), s).select("id", "name").unionByName(c.where("id <> 'el1'").select("id", F.when(F.col("id") == "kg", "Big kids").otherwise(F.col("name")).alias("name")))
    .unionByName(c.where("id = 'kg'").select(cells.slug(F.lit("After Care!")).alias("id"), F.lit("After Care!").alias("name"))),
    """SELECT id, CASE WHEN id = 'kg' THEN 'Big kids' ELSE name END AS name FROM classes WHERE id <> 'el1' OR id NOT IN (SELECT class_id FROM students WHERE archived = 0)
       UNION ALL SELECT 'after_care_' || substr(md5('After Care!'), 1, 4), 'After Care!'""",
)
_add("short_dates", lambda s, c: s.select("id", cells.short_date(F.col("start_date")).alias("start"), cells.short_date(F.col("last_date")).alias("last")), "SELECT id, coalesce(strftime(TRY_CAST(start_date AS DATE), '%-d %b %y'), start_date) AS start, CASE WHEN last_date = '' THEN '–' ELSE strftime(CAST(last_date AS DATE), '%-d %b %y') END AS last FROM students")
_add("diet_labels", lambda s, c: s.select("id", cells.diet_label(F.col("diet")).alias("diet")), "SELECT id, CASE diet WHEN 'no_nuts' THEN 'no nuts' WHEN 'no_cow_milk' THEN 'no cow milk' ELSE diet END AS diet FROM students")
_add("note_heads", lambda s, c: s.select("id", cells.note_head(F.col("note")).alias("note")), "SELECT id, CASE WHEN note = '' THEN '–' WHEN length(note) > 40 THEN substr(note, 1, 40) || '…' ELSE note END AS note FROM students")
_add(
    "suspension_notes", lambda s, c: s.select("id", cells.with_suspension(F.col("note"), F.when(F.col("n_suspensions") > 2, F.concat(F.lit(" from "), F.col("start_date"), F.lit(" "))).otherwise("")).alias("note")),
    "SELECT id, CASE WHEN n_suspensions <= 2 THEN note ELSE CASE WHEN note = '' THEN '' ELSE note || chr(10) || chr(10) END || 'Holiday Suspension:' || chr(10) || 'from ' || start_date END AS note FROM students",
)
#: First names with a gender, as a school would keep them; any table of (first_name, gender) serves.
_GENDERS = {"ada": "F", "carla": "F", "elif": "F", "gita": "F", "ilse": "F", "karin": "F", "marta": "F", "bruno": "M", "denis": "M", "hugo": "M", "jonas": "M", "luis": "M"}
_add(
    "guessed_genders", lambda s, c: roster.guessed_gender(s.select("id", F.replace(F.col("name"), F.lit("a"), F.lit("á")).alias("name")), s.sparkSession.createDataFrame(list(_GENDERS.items()), "first_name string, gender string")).select("id", "guess"),
    f"SELECT id, {_LABELS(_FIRST_NAME, _GENDERS, _UNKNOWN)} AS guess FROM students",
)


def _sizes(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", cells.file_size(F.octet_length("html").cast("long") * (1 + F.col("page_id") % 3 * 1000)).alias("size"), F.md5(cells.escaped_html(F.col("html")).cast("binary")).alias("escaped"), F.length(cells.one_spaced(F.col("html"))).alias("n"))


QUERIES["page_texts"] = _sizes
SQL["page_texts"] = """SELECT page_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024 + 0.5) / 10) ELSE printf('%.1f MB', floor(n * 10 / 1048576 + 0.5) / 10) END AS size,
  md5(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, CAST(length(trim(regexp_replace(coalesce(html, ''), '\\s+', ' ', 'g'))) AS INTEGER) AS n
  FROM (SELECT page_id, html, strlen(html) * (1 + page_id % 3 * 1000) AS n FROM pages)"""

#: Cells as people type them, for the normalisers.
TYPED = ["F", " full day ", "fd", "yes", "h", "AM", "half", "", "maybe", "1", "X", "✓", "true", "4-May-26", "14-june-1999", "1-Abc-20", "2026-05-04", "46146", "46146.0", "tbc", "–", "EL 1 (1-2 years)", "el2 hib", "EL 2 (2-3 years)", "PK Lav", "pre-k", "Jr. K", "kinder", "none", "noa McRae lindgren"]
_CASES = "CASE c_custkey % " + str(len(TYPED)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TYPED)) + " END"
_TYPED_SQL = f"WITH v AS (SELECT c_custkey AS id, {_CASES} AS x FROM customer)"


def _typed(name: str, build, sql: str):
    QUERIES[name] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.expr(_CASES).alias("x")).select("id", "x", build(F.col("x")).alias("y"))
    SQL[name] = f"{_TYPED_SQL} SELECT id, x, {sql} AS y FROM v"


_typed("day_normalise", cells.day_mark, "CASE WHEN upper(trim(x)) IN ('F','FULL','FULL DAY','FD','Y','YES') THEN 'F' WHEN upper(trim(x)) IN ('H','HALF','HALF DAY','HD','AM','PM') THEN 'H' ELSE '' END")
_typed("lunch_normalise", cells.lunch_mark, "lower(trim(x)) IN ('y','yes','true','1','✓','✔','x')")
_typed(
    "class_guess", cells.class_hint,
    """CASE WHEN contains(lower(x), 'el 1') OR contains(lower(x), 'el1') OR (contains(lower(x), '1-2') AND NOT contains(lower(x), '2-3')) THEN 'el1'
       WHEN regexp_matches(lower(x), 'el2 hib|el2h|hibiscus') THEN 'el2h' WHEN regexp_matches(lower(x), 'el 2|el2|daffodil|2-3') THEN 'el2d' WHEN regexp_matches(lower(x), 'pk saf|saffron') THEN 'pks'
       WHEN regexp_matches(lower(x), 'pk lav|lavender') THEN 'pkl' WHEN regexp_matches(lower(x), 'pre k|pre-k|pk') THEN 'pks' WHEN regexp_matches(lower(x), 'jr|jun') THEN 'jrk' WHEN contains(lower(x), 'kind') THEN 'kg' END""",
)
_typed(
    "excel_dates", cells.iso_date,
    """coalesce(
        CASE WHEN regexp_matches(x, '^\\d{1,2}-[A-Za-z]{3,}-\\d{2,4}$') THEN (
          CASE WHEN length(split_part(x, '-', 3)) > 2 THEN split_part(x, '-', 3) WHEN CAST(split_part(x, '-', 3) AS INTEGER) < 50 THEN '20' || split_part(x, '-', 3) ELSE '19' || split_part(x, '-', 3) END
          || '-' || lpad(CAST(CASE lower(split_part(x, '-', 2)) WHEN 'may' THEN 5 WHEN 'june' THEN 6 END AS VARCHAR), 2, '0') || '-' || lpad(split_part(x, '-', 1), 2, '0')) END,
        CASE WHEN regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}$') THEN x END,
        CASE WHEN TRY_CAST(x AS DOUBLE) > 1000 THEN CAST(CAST(DATE '1970-01-01' + CAST(TRY_CAST(x AS DOUBLE) - 25569 AS INTEGER) AS DATE) AS VARCHAR) END, trim(x))""",
)
_typed("title_case", cells.title_if_lower, "array_to_string(list_transform(string_split(x, ' '), lambda w: CASE WHEN lower(w) = w THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END), ' ')")
_typed("recased", cells.recased, "array_to_string(list_transform(string_split(x, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")
