"""A roster of students and classes. Students are made from customers by rule, so the roster grows with the data.

Every column is an expression over the customer's key that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Id, name, full name, ages, capacity.
CLASSES = [
    ("el1", "EL 1", "Early Learners 1", "1–2 yrs", 16),
    ("el2d", "EL 2 Daffodil", "Early Learners 2 — Daffodil", "2–3 yrs", 18),
    ("el2h", "EL 2 Hibiscus", "Early Learners 2 — Hibiscus", "2–3 yrs", 18),
    ("pks", "PK Saffron", "Pre-Kindergarten Saffron", "3–4 yrs", 20),
    ("pkl", "PK Lavender", "Pre-Kindergarten Lavender", "3–4 yrs", 20),
    ("jrk", "Jr Kindergarten", "Junior Kindergarten", "4–5 yrs", 22),
    ("kg", "Kindergarten", "Kindergarten", "5–6.5 yrs", 24),
]
_FIRST = ["Ada", "Bruno", "Carla", "Denis", "Elif", "Farid", "Gita", "Hugo", "Ilse", "Jonas", "Karin", "Luis", "Marta"]
_LAST = ["Abel", "Berger", "Costa", "Dahl", "Ekman", "Fabre", "Galli", "Horn", "Ito", "Jansen", "Kowal"]
_NATIONS = ["Austrian", "Belgian", "Chilean", "Dutch", "Estonian", "Finnish / Austrian", "Greek", "Hungarian"]
_STATUS = ["enrolled"] * 10 + ["inquiry", "quote_sent", "invoice_sent", "wait_list", "suspended", "suspended", "left", "left", "cancelled"]


def _pick(values: list, at: str) -> str:
    """The value numbered by an expression, which is taken modulo the number of values."""
    quoted = ["'" + str(v).replace("'", "''") + "'" for v in values]
    return f"(CASE ({at}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END)"


def _columns(text: str) -> list[tuple[str, str]]:
    k = "c_custkey"
    two = lambda n: f"lpad(CAST({n} AS {text}), 2, '0')"
    day = lambda y, m, d: f"concat(CAST({y} AS {text}), '-', {two(m)}, '-', {two(d)})"
    status, invoice = _pick(_STATUS, f"{k} * 7"), _pick(["not_sent", "sent", "paid", "prepay"], f"{k} * 3 + 1")
    active = f"{status} IN ('enrolled', 'suspended')"
    mark = lambda i: f"(CASE WHEN {active} THEN {_pick(['F', 'H', 'F', ''], f'{k} + {i}')} ELSE '' END)"
    last = _pick(_LAST, f"{k} * 5")
    return [
        ("id", f"CAST({k} AS INT)"), ("name", f"concat({_pick(_FIRST, k)}, ' ', {last})"), ("gender", _pick(["F", "M", "X"], k)),
        ("centre", f"(CASE WHEN {k} % 9 = 0 THEN 'south' ELSE 'north' END)"),
        # two small classes; the others share the rest
        ("class_id", f"(CASE WHEN {k} % 100 < 2 THEN 'el1' WHEN {k} % 100 < 5 THEN 'el2h' WHEN {k} % 101 = 7 THEN 'gone' ELSE {_pick(['el2d', 'pks', 'pkl', 'jrk', 'kg'], k)} END)"),
        ("status", status),
        ("dob", f"(CASE WHEN {k} % 41 = 0 THEN 'tbc' WHEN {k} % 43 = 0 THEN '' ELSE {day(f'2018 + {k} % 7', f'1 + {k} % 12', f'1 + {k} % 28')} END)"), ("nationality", _pick(_NATIONS, f"{k} * 3")),
        *((d, mark(i)) for i, d in enumerate(("mon", "tue", "wed", "thu", "fri"))), ("lunch", f"CAST({k} % 2 AS INT)"),
        ("start_date", f"(CASE WHEN {k} % 37 = 0 THEN 'tbc' ELSE {day(f'2020 + {k} % 6', f'1 + {k} % 12', f'1 + {k} % 27')} END)"),
        ("last_date", f"(CASE WHEN {status} = 'left' THEN {day('2026', f'1 + {k} % 5', f'1 + {k} % 28')} ELSE '' END)"),
        ("paid_from", f"(CASE WHEN {active} THEN '2026-05-04' ELSE '' END)"), ("paid_until", f"(CASE WHEN {active} THEN {day('2026', 6, f'1 + {k} % 30')} ELSE '' END)"),
        ("invoice", invoice), ("bond", f"CAST(({k} % 2) * 5000000 AS INT)"), ("n_suspensions", f"CAST({k} % 5 AS INT)"),
        ("prepay_weeks", f"(CASE WHEN {invoice} = 'prepay' THEN CAST(20 + {k} % 20 AS INT) END)"), ("prepay_completed", f"(CASE WHEN {invoice} = 'prepay' THEN CAST(20 + {k} % 20 - ({k} * 7) % 12 AS INT) END)"),
        ("archived", f"CAST(CASE WHEN {k} % 13 = 0 THEN 1 ELSE 0 END AS INT)"),
        ("parents", f"(CASE WHEN {k} % 6 = 0 THEN '' ELSE concat({_pick(_FIRST, f'{k} + 3')}, ' ', {last}, ' & ', {_pick(_FIRST, f'{k} * 2')}, ' ', {last}) END)"),
        ("email", f"(CASE WHEN {k} % 10 = 0 THEN '' ELSE concat('family.', CAST({k} AS {text}), '@example.com') END)"),
        ("note", f"(CASE WHEN {k} % 4 = 0 THEN '' ELSE concat('Speaks ', {_pick(_NATIONS, f'{k} * 3')}, ', sees ', {_pick(_FIRST, f'{k} * 2')}, ' on day ', CAST({k} % 28 AS {text})) END)"),
        ("diet", _pick(["", "no_nuts", "no_cow_milk", "halal"], k)),
    ]


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return customers.selectExpr(*[f"{e} AS {c}" for c, e in _columns("STRING")])


def classes(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "pos int, id string, name string, full_name string, age string, capacity int").coalesce(1)


def roster_sql() -> str:
    """WITH clause that defines students and classes for DuckDB."""
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x + "'"
    rows = ", ".join("(" + ", ".join(map(quoted, (i, *c))) + ")" for i, c in enumerate(CLASSES))
    columns = ", ".join(f"{e} AS {c}" for c, e in _columns("VARCHAR"))
    return f"WITH students AS (SELECT {columns} FROM customer), classes(pos, id, name, full_name, age, capacity) AS (VALUES {rows})"
