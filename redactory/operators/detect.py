"""Scanning texts for findings: match arrays, rules, the gated name rule, overlaps.

Everything is an expression on the row, so a scan is one map stage: no shuffle, no Python. Steps are separate
projections so that each regular expression runs once a text.

A finding is struct<type, label, value, start, severity, ord>; start counts code points from 0; ord is the order in
which findings arise. Null and empty texts have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.functions.dialect import DUCK, SPARK
from redactory.functions.io import compiled_by_parts
from redactory.operators.rules import ACCOUNT_WORDS, BANK_CONTEXT, DOB_WORDS, IDENTIFIER_TYPES, INTRO_PHRASES, MONEY_WORDS, PHONE_WORDS, RULES

FIELDS = {"type": "string", "label": "string", "value": "string", "start": "bigint", "severity": "string", "ord": "bigint"}
BY_NAME = {r.name: (i, r) for i, r in enumerate(RULES)}


def _clean(d, text: str) -> str:
    return f"translate(coalesce({text}, ''), concat({d.char(1)}, {d.char(2)}), '')"


def _raw(d, k: int, with_digits: bool = False) -> str:
    """Matches of rule k as structs (m, s, i) from its marked segments; for Spark, on request, with their digits, d."""
    seg = f"g{k}"
    if d.name == "spark":  # one pass that carries the place
        match, more = "substring_index(y, char(2), 1)", {"d": "string"} if with_digits else {}
        found = d.struct(m=match, s="a.p", i="CAST(size(a.o) AS BIGINT)", **{c: f"regexp_replace({match}, '[^0-9]+', '')" for c in more})
        start = f"named_struct('p', CAST(length(element_at({seg}, 1)) AS BIGINT), 'o', {d.empty({'m': 'string', 's': 'bigint', 'i': 'bigint', **more})})"
        return f"aggregate({d.tail(seg)}, {start}, (a, y) -> named_struct('p', a.p + length(y) - 1, 'o', array_append(a.o, {found})), a -> a.o)"
    position = f"CAST(list_sum(list_transform({seg}[1:i], lambda z: length(z))) - (i - 1) AS BIGINT)"
    return f"list_transform({d.tail(seg)}, lambda y, i: {{'m': split_part(y, chr(2), 1), 's': {position}, 'i': CAST(i - 1 AS BIGINT)}})"


def _found(d, k: int) -> str:
    rule = RULES[k]
    keep = rule.keep(d)
    kept = d.filter(_raw(d, k, "x.d" in keep) if d.name == "spark" else f"r{k}", "x", f"coalesce({keep}, false)")
    fields = {
        "type": f"'{rule.type}'", "label": f"'{rule.label}'", "value": rule.value(d), "start": f"CAST({rule.start(d)} AS BIGINT)",
        "severity": rule.severity(d), "ord": f"CAST({k * 1_000_000} + x.i AS BIGINT)",
    }
    found = d.transform(kept, "x", d.struct(**fields))
    return f"CASE WHEN size(g{k}) > 1 THEN {found} END" if d.name == "spark" else found  # most rules find nothing in a text


def _together(d, rules: list[int]) -> str:
    """The findings of some rules; for Spark a rule without matches has null."""
    return d.concat_lists([f"coalesce(f{k}, {d.empty(FIELDS)})" if d.name == "spark" else f"f{k}" for k in rules])


#: Spark can look ahead, so the token rule need not list every long word there; the same tokens result.
_TOKEN = r"(?:^|\s)(?=\S{0,63}[a-z])(?=\S{0,63}[A-Z])(?=\S{0,63}\d)(?=\S{0,63}[^A-Za-z0-9\s])\S{8,64}"
#: The characters with which a match can begin: looked at first, as most places of a text are none.
_FIRST = {
    "credit_card": "0-9", "medicare": "2-6", "tfn": "0-9", "abn": "0-9", "acn": "0-9", "passport": "A-Z", "licence": "dl", "bsb": "0-9", "bank_account": "0-9", "phone_au": "+60", "phone_service": "1",
    "phone_ctx": "0-9", "address": "0-9", "dob_written": "0-3", "dob_numeric": "0-3", "confidential": "cdinp", "business": "artmpevgnc", "health": "mdp0-9scabht", "legal": "lcspd",
    "immigration": "vsipwbcg", "password_kw": "plcast", "name": "A-Z",
}
#: Rules of which a match can begin or end with what is no letter or digit, so that the boundary there looks both ways.
_LOOSE_START, _LOOSE_END = ["email"], ["credit_card", "legal"]


def _spark_pattern(name: str, pattern: str) -> str:
    """The same matches, found sooner: a boundary beside a letter or digit looks one way only."""
    if name == "password_token":
        return _TOKEN
    flag, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    parts = body.split(r"\b")
    out = parts[0]
    for k, part in enumerate(parts[1:], 1):
        if (k == 1 and name in _LOOSE_START) or (part == "" and name in _LOOSE_END):
            out += SPARK.boundary + part
        else:  # the first boundary is before a word, any other after one
            out += (r"(?<!\w)" if k == 1 and (not parts[0] or name == "phone_au") else r"(?!\w)") + part
    return flag + (f"(?=[{_FIRST[name]}])" if name in _FIRST else "") + out


def _pattern(d, k: int) -> str:
    return _spark_pattern(RULES[k].name, RULES[k].pattern) if d.name == "spark" else RULES[k].pattern


#: What a text must hold for a rule to find anything: so many digits at least, one of these words (in small letters), these
#: characters. A rule whose needs are not met is skipped, so that most texts are looked through once and not once a rule.
NEEDS: dict[str, tuple[int, list[str], str]] = {
    "credit_card": (13, [], ""), "medicare": (10, [], ""), "tfn": (8, [], ""), "abn": (11, [], ""), "acn": (9, ["acn", "company number"], ""), "passport": (7, [], ""), "licence": (0, ["licence", "license"], ""),
    "bsb": (6, [], "-"), "bank_account": (6, ACCOUNT_WORDS, ""), "gps": (11, [], ".,"), "email": (0, [], "@."), "phone_au": (10, [], ""), "phone_service": (10, [], ""), "phone_ctx": (7, PHONE_WORDS, ""),
    "address": (1, [], ""), "dob_written": (5, DOB_WORDS, ""), "dob_numeric": (6, DOB_WORDS, ""), "money": (4, MONEY_WORDS, "$"), "money_verbal": (1, ["million", "billion", "trillion"], "$"),
    "confidential": (0, ["confidential", "do not ", "internal ", "non-disclosure", "nda", "proprietary", "classified", "not for distribution"], ""),
    "business": (0, ["revenue", "turnover", "arr", "mrr", "profit", "ebitda", "valuation", "gross margin", "net income", "client list", "customer list"], ""),
    "health": (0, [
        "medicare", "diagnos", "prescri", "medication", "dosage", "mg", "symptom", "cancer", "diabet", "depression", "anxiety", "bipolar", "schizophreni", "hiv", "aids", "pregnan", "therapy", "psychiatr",
        "mental health", "blood test", "medical "], ""),
    "legal": (0, ["lawsuit", "litigation", "court ", "case", "settlement agreement", "legal proceedings", "subpoena", "plaintiff", "defendant"], ""),
    "immigration": (0, ["subclass", "visa", "immigration", "permanent residency", "work permit", "citizenship application", "sponsorship", "green card"], ""),
    "password_kw": (0, ["pass", "pwd", "login", "credential", "key", "secret", "token", "auth"], ""), "password_token": (1, [], ""), "name": (0, [], ""),
}


def _holds(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lo, {SPARK.text(w)})" for w in words) + ")"


def _may_find(name: str) -> str:
    """Over t, lo (t in small letters) and nd (its digits)."""
    n, words, characters = NEEDS[name]
    tests = ([f"nd >= {n}"] if n else []) + [f"contains(t, '{c}')" for c in characters] + ([_holds(words)] if words else [])
    return " AND ".join(tests) or "true"


_SIGNATURE = {"lo": "lower(t)", "nd": "CASE WHEN t RLIKE '[0-9]' THEN length(regexp_replace(t, '[^0-9]+', '')) ELSE 0 END"}


def _marked(d, k: int, when: str | None = None) -> str:
    marked = d.marked("t", _pattern(d, k))
    return f"CASE WHEN {when or _may_find(RULES[k].name)} THEN {marked} END" if d.name == "spark" else marked


def _steps(d, rules: list[int]) -> list[dict[str, str]]:
    """Projections to be applied one after another; each adds columns to those before it."""
    services = [k for k in rules if RULES[k].name in ("phone_au", "phone_service")]
    name = BY_NAME["name"][0]
    gated = name in rules and len(rules) > 1
    first = [k for k in rules if k != name] if gated and d.name == "spark" else rules  # for Spark names wait for their gate
    steps = [{"t": _clean(d, "t")}, *([_SIGNATURE] if d.name == "spark" else []), {f"g{k}": _marked(d, k) for k in first}]
    steps += ([] if d.name == "spark" else [{f"r{k}": _raw(d, k) for k in first}]) + [{f"f{k}": _found(d, k) for k in first}]
    last: dict[str, str] = {}
    ctx = BY_NAME["phone_ctx"][0]
    if ctx in rules and services:
        known = _together(d, services)
        inside = d.exists(known, "g", "g.start <= x.start AND x.start + length(x.value) <= g.start + length(g.value)")
        last[f"f{ctx}"] = d.filter(f"f{ctx}", "x", f"NOT {inside}")
    if last:
        steps.append(last)
    if gated:
        if d.name == "spark":
            known = " OR ".join(f"coalesce(size(f{k}), 0) > 0" for k in rules if RULES[k].type in IDENTIFIER_TYPES) or "false"
            bank = f"contains(lo, 'bank') OR contains(lo, 'account holder') OR contains(lo, 'savings account')) AND {d.matches('t', _spark_pattern('bank', BANK_CONTEXT))}"
            steps += [{"others": known}, {f"g{name}": _marked(d, name, f"(others OR {_holds(INTRO_PHRASES)} OR (({bank}))")}, {f"f{name}": _found(d, name)}]
        else:
            others = d.concat_lists([f"f{k}" for k in rules if k != name])
            types = ", ".join(f"'{t}'" for t in IDENTIFIER_TYPES)
            known = d.exists(others, "g", f"g.type IN ({types})")
            gate = f"({known} OR {d.matches('t', BANK_CONTEXT)} OR {d.matches('lower(t)', '|'.join(INTRO_PHRASES))})"
            steps.append({f"f{name}": f"CASE WHEN {gate} THEN f{name} ELSE {d.empty(FIELDS)} END"})
    steps.append({"findings": _together(d, rules)})
    return steps


def _rule_numbers(names: list[str] | None) -> list[int]:
    return list(range(len(RULES))) if names is None else [BY_NAME[n][0] for n in names]


def scan(docs: DataFrame, text: str = "text", rules: list[str] | None = None) -> DataFrame:
    """docs with ``findings``: every match of the rules, before overlaps are resolved.

    The name rule takes part only if another identifier, a banking word or an introduction stands in the text; asked
    for alone, it is ungated.
    """
    numbers = _rule_numbers(rules)
    compiled_by_parts(docs.sparkSession)
    out = docs.select(*[c for c in docs.columns if c not in ("findings", "t")], F.col(text).alias("t"))
    kept = [c for c in out.columns if c != "t"]
    for step in _steps(SPARK, numbers):
        names = [c for c in out.columns if c not in step]
        out = out.select(*names, *[F.expr(e).alias(c) for c, e in step.items()])
    return out.select(*kept, "findings")


def scan_sql(source: str, keys: list[str], rules: list[str] | None = None, d=DUCK) -> str:
    """SQL (DuckDB's by default): a query that gives ``keys`` and ``findings`` for a relation with a column ``t``."""
    query, columns = source, [*keys, "t"]
    for step in _steps(d, _rule_numbers(rules)):
        names = [c for c in columns if c not in step]
        query = f"SELECT {', '.join([*names, *(f'{e} AS {c}' for c, e in step.items())])} FROM ({query})"
        columns = [*names, *step]
    return f"SELECT {', '.join([*keys, 'findings'])} FROM ({query})"


def _resolved(d) -> str:
    """Longest first, then leftmost, then in order of arising; what overlaps one taken before goes; then by start."""
    key = {"neg": "-CAST(length(x.value) AS BIGINT)", "at": "x.start", "o": "x.ord", "f": "x"}
    ordered = d.transform(d.sort(d.transform("findings", "x", d.struct(**key))), "x", "x.f")
    clash = d.exists("acc", "g", "(x.start < g.start + length(g.value) AND x.start + length(x.value) > g.start) OR (x.type = g.type AND x.start = g.start AND x.value = g.value)")
    taken = d.fold(ordered, d.empty(FIELDS), "acc", "x", f"CASE WHEN {clash} THEN acc ELSE {d.append('acc', 'x')} END")
    by_start = d.sort(d.transform(taken, "x", d.struct(at="x.start", neg="-CAST(length(x.value) AS BIGINT)", o="x.ord", f="x")))
    resolved = d.transform(by_start, "x", "x.f")
    return f"CASE WHEN size(findings) > 1 THEN {resolved} ELSE findings END" if d.name == "spark" else resolved


def resolve(scanned: DataFrame) -> DataFrame:
    """Repeated and overlapping findings removed, inside the row."""
    return scanned.withColumn("findings", F.expr(_resolved(SPARK)))


def resolve_sql(scanned: str, keys: list[str], d=DUCK) -> str:
    return f"SELECT {', '.join([*keys, _resolved(d)])} AS findings FROM ({scanned})"


def long_form(scanned: DataFrame) -> DataFrame:
    """One row a finding.

    The outer explode matters: from a plain one the optimizer infers a filter on the size of ``findings``, pushes it
    below the scan's projections and so writes the whole scan out inside that filter, over and over.
    """
    keys = [c for c in scanned.columns if c != "findings"]
    return scanned.select(*keys, F.explode_outer("findings").alias("f")).where("f IS NOT NULL").select(*keys, "f.*")


def sensitive(scanned: DataFrame) -> DataFrame:
    """Rows with a finding, and how many (n_findings).

    Counting is marked as not deterministic, so that the filter stays above the scan (see ``long_form``).
    """
    counted = scanned.withColumn("n_findings", F.when(F.spark_partition_id() >= 0, F.size("findings").cast("long")))
    return counted.where("n_findings > 0")


def long_form_sql(scanned: str, keys: list[str]) -> str:
    fields = ", ".join(f'f."{c}"' for c in FIELDS)
    return f"SELECT {', '.join(keys)}, {fields} FROM (SELECT {', '.join(keys)}, unnest(findings) AS f FROM ({scanned}))"
