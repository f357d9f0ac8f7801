"""The few forms in which Spark SQL and DuckDB differ for array and text expressions.

Detectors and generators are declared once as expressions over these forms. Spark gets Catalyst expressions from them
(no Python in the job); the same declaration as DuckDB SQL is what results are compared with.
"""

from __future__ import annotations


class Spark:
    name = "spark"
    #: Spark's ``\b`` follows Unicode; the rules need ASCII word boundaries.
    boundary = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

    def text(self, s: str) -> str:
        return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'

    def regex(self, pattern: str) -> str:
        return self.text(pattern.replace(r"\b", self.boundary))

    def filter(self, xs, var, cond):
        return f"filter({xs}, {var} -> {cond})"

    def transform(self, xs, var, value, index=None):
        return f"transform({xs}, ({var}, {index}) -> {value})" if index else f"transform({xs}, {var} -> {value})"

    def exists(self, xs, var, cond):
        return f"exists({xs}, {var} -> {cond})"

    def fold(self, xs, init, acc, var, value):
        return f"aggregate({xs}, {init}, ({acc}, {var}) -> {value})"

    def struct(self, **fields):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def empty(self, fields: dict[str, str]):
        return "CAST(array() AS array<struct<" + ", ".join(f"{k}: {t}" for k, t in fields.items()) + ">>)"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def concat_lists(self, xs):
        return f"concat({', '.join(xs)})"

    def append(self, xs, x):
        return f"array_append({xs}, {x})"

    def last(self, xs):
        return f"element_at({xs}, -1)"

    def at_list(self, xs, i):
        return f"element_at({xs}, {i})"

    def tail(self, xs):
        return f"slice({xs}, 2, greatest(size({xs}) - 1, 0))"

    def head(self, xs, n):
        return f"slice({xs}, 1, {n})"

    def count_to(self, n):
        return f"sequence(1, {n})"

    def join(self, xs):
        return f"array_join({xs}, '')"

    def sort(self, xs):
        return f"sort_array({xs})"

    def size(self, xs):
        return f"size({xs})"

    def replace_all(self, s, pattern, to):
        return f"regexp_replace({s}, {self.regex(pattern)}, {to})"

    def marked(self, s, pattern):
        return f"split(regexp_replace({s}, {self.regex('(' + pattern + ')')}, concat(char(1), '$1', char(2))), char(1), -1)"

    def matches(self, s, pattern):
        return f"({s} RLIKE {self.regex(pattern)})"

    def extract(self, s, pattern, group):
        return f"regexp_extract({s}, {self.regex(pattern)}, {group})"

    def before(self, s, mark):
        return f"substring_index({s}, {mark}, 1)"

    def at(self, s, i):
        return f"substring({s}, {i}, 1)"

    def position(self, s, part):
        return f"locate({part}, {s})"

    def pick(self, pool: list[str], i):
        return f"element_at(array({', '.join(self.text(p) for p in pool)}), CAST(({i}) % {len(pool)} AS INT) + 1)"

    def div(self, a, b):
        return f"(({a}) div {b})"

    def hash32(self, s):
        return f"CAST(conv(substring(md5(CAST({s} AS BINARY)), 1, 8), 16, 10) AS BIGINT)"

    def pad(self, n, width):
        return f"lpad(CAST({n} AS STRING), {width}, '0')"

    def string(self, x):
        return f"CAST({x} AS STRING)"

    def number(self, s):
        return f"try_cast({s} AS DOUBLE)"

    def char(self, n):
        return f"char({n})"


class Duck(Spark):
    name = "duck"
    boundary = r"\b"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def filter(self, xs, var, cond):
        return f"list_filter({xs}, lambda {var}: {cond})"

    def transform(self, xs, var, value, index=None):
        if index:  # DuckDB counts from 1
            return f"list_transform({xs}, lambda {var}, {index}_: {value.replace('{' + index + '}', index)})".replace(f"{index}_:", f"{index}:")
        return f"list_transform({xs}, lambda {var}: {value})"

    def exists(self, xs, var, cond):
        return f"(len(list_filter({xs}, lambda {var}: {cond})) > 0)"

    def fold(self, xs, init, acc, var, value):
        return f"list_reduce({xs}, lambda {acc}, {var}: {value}, {init})"

    def struct(self, **fields):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def empty(self, fields):
        kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT"}
        return "CAST([] AS STRUCT(" + ", ".join(f'"{k}" {kinds[t]}' for k, t in fields.items()) + ")[])"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def concat_lists(self, xs):
        out = xs[0]
        for x in xs[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def append(self, xs, x):
        return f"list_append({xs}, {x})"

    def last(self, xs):
        return f"{xs}[-1]"

    def at_list(self, xs, i):
        return f"{xs}[{i}]"

    def tail(self, xs):
        return f"{xs}[2:]"

    def head(self, xs, n):
        return f"{xs}[1:{n}]"

    def count_to(self, n):
        return f"range(1, CAST({n} AS BIGINT) + 1)"

    def join(self, xs):
        return f"array_to_string({xs}, '')"

    def sort(self, xs):
        return f"list_sort({xs})"

    def size(self, xs):
        return f"len({xs})"

    def replace_all(self, s, pattern, to):
        return f"regexp_replace({s}, {self.regex(pattern)}, {to}, 'g')"

    def marked(self, s, pattern):
        return f"string_split(regexp_replace({s}, {self.regex('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"

    def matches(self, s, pattern):
        return f"regexp_matches({s}, {self.regex(pattern)})"

    def before(self, s, mark):
        return f"split_part({s}, {mark}, 1)"

    def at(self, s, i):
        return f"substr({s}, {i}, 1)"

    def position(self, s, part):
        return f"instr({s}, {part})"

    def pick(self, pool, i):
        return f"([{', '.join(self.text(p) for p in pool)}])[CAST(({i}) % {len(pool)} AS INT) + 1]"

    def div(self, a, b):
        return f"(({a}) // {b})"

    def hash32(self, s):
        return f"CAST('0x' || substr(md5({s}), 1, 8) AS BIGINT)"

    def pad(self, n, width):
        return f"lpad(CAST({n} AS VARCHAR), {width}, '0')"

    def string(self, x):
        return f"CAST({x} AS VARCHAR)"

    def number(self, s):
        return f"TRY_CAST({s} AS DOUBLE)"

    def char(self, n):
        return f"chr({n})"


SPARK, DUCK = Spark(), Duck()
