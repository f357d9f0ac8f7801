"""Messages made from orders and customers, one template a rule, so that every rule has hits and near misses.

The text is built from whole numbers, lpad and concat only, and is the same in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactory.functions.dialect import DUCK, SPARK

#: {n} is a nine-digit number, {d2} two digits 10 to 28, {k} the customer, {p} the customer's name, {y} a year.
TEMPLATES = [
    "Please charge card 4111 1111 1111 1111 for order {k} today",
    "My Medicare is 2123 45670 1 and yours 2123 45671 1",
    "tax file 123 456 782 or 123456789, ref {k}",
    "ABN 51 824 753 556 issued to customer {k}",
    "The company number is 123 456 789, acn {n}",
    "Passport PA{n7} expires in {y}",
    "driver licence: {n8} and licence renewal due",
    "BSB 062-{n3} account {n8} at the bank, room 01{d2}-{n3}",
    "transfer savings to {n8} please, order {k}",
    "we meet at -33.8688, 151.{n4} tomorrow",
    "write to user.{k}@example.com.au or x@y",
    "call me on 04{d2} {n3} {n3} or +61 2 9{n3} {n4}",
    "service line 1300 {n3} {n3} is free",
    "my mobile 1414 {n3} 274, est 9{n4}",
    "ship to {d2} Old Mill Road, Sydney NSW 2000",
    "born {d2} March 19{d2} and {d2}/03/1981, paid 12/03/1981",
    "invoice payment ${k},{n3} due, cost ${n4}0",
    "a deal of $2.4 million and salary $85,{n3}",
    "strictly confidential, do not share item {k}",
    "our annual revenue was up; client list {k} attached",
    "diagnosed with diabetes, {d2} mg dosage",
    "court order, case no: AB-{n3}/{d2} and subpoena",
    "visa subclass 482, work permit {k}",
    "my password is Hunter{d2}!x. token = ....",
    "use Str0ng-Pass{d2}! or http://a.b/C0de-{k}",
    "Dear John Smith, my name is Jane Doe and I bank with Acme Corp",
    "é{n4} numéro é04{d2} {n3} {n3}, Jane Doe, card é4111111111111111",
    "nothing of note in order {k}",
    "this is {p}, order {k}",
]
_NAMES = (["Ada", "Bo", "Cleo", "Dag", "Eva", "Finn", "Gus"], ["lin", "ra", "mund", "nie", "ta"], ["Abel", "Berg", "Cort", "Dahl", "Ek", "Falk", "Gren", "Holm", "Ivar", "Jul", "Krog"], ["sen", "strom", "man", "by", "lund", "quist", "ner"])

_FIELDS = {
    "{k}": "CAST(o_custkey AS {text})", "{n}": "lpad(CAST((o_orderkey * 7919 + 12345) % 1000000000 AS {text}), 9, '0')",
    "{n7}": "lpad(CAST((o_orderkey * 7919) % 10000000 AS {text}), 7, '0')", "{n8}": "lpad(CAST((o_orderkey * 104729) % 100000000 AS {text}), 8, '0')",
    "{n4}": "lpad(CAST((o_orderkey * 31) % 10000 AS {text}), 4, '0')", "{n3}": "lpad(CAST((o_orderkey * 17) % 1000 AS {text}), 3, '0')",
    "{d2}": "CAST(10 + o_orderkey % 19 AS {text})", "{y}": "CAST(1990 + o_orderkey % 40 AS {text})",
}


def _name(d) -> str:
    """A name for each of some 2,700 keys, then the same again."""
    given = f"{d.pick(_NAMES[0], 'o_custkey')}, {d.pick(_NAMES[1], d.div('o_custkey', '7'))}"
    return f"concat({given}, ' ', {d.pick(_NAMES[2], 'o_custkey')}, {d.pick(_NAMES[3], d.div('o_custkey', '35'))})"


def _template(parts: str, text: str) -> str:
    out, rest = [], parts
    fields = _FIELDS | {"{p}": _name(DUCK if text == "VARCHAR" else SPARK)}
    while rest:
        at = [(rest.find(k), k) for k in fields if k in rest]
        if not at:
            out.append(f"'{rest}'")
            break
        i, k = min(at)
        if i:
            out.append(f"'{rest[:i]}'")
        out.append(fields[k].format(text=text))
        rest = rest[i + len(k) :]
    return f"concat({', '.join(out)})"


def messages_sql(duck: bool) -> str:
    text = "VARCHAR" if duck else "STRING"
    cases = " ".join(f"WHEN {i} THEN {_template(t, text)}" for i, t in enumerate(TEMPLATES))
    integer = "//" if duck else "div"
    return (
        f"SELECT o_orderkey AS msg_id, o_custkey AS session_id, (o_orderkey {integer} {len(TEMPLATES)}) % 3 AS platform_no, "
        f"CASE o_orderkey % {len(TEMPLATES)} {cases} END AS t FROM orders"
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, session_id, platform_no, t).

    Keys are dealt out before the texts are made: an order takes few bytes in its file and much work as a message, so that the
    file's splits are too few and uneven.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    orders = orders.repartition(3 * spark.sparkContext.defaultParallelism, "o_orderkey")
    return orders.selectExpr(*[x.strip() for x in _columns(messages_sql(False))])


def _columns(sql: str) -> list[str]:
    """The select list of messages_sql, cut at its top-level commas."""
    body, out, depth, quoted, start = sql[len("SELECT ") : sql.rindex(" FROM ")], [], 0, False, 0
    for i, c in enumerate(body):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(body[start:i])
                start = i + 1
    return [*out, body[start:]]
