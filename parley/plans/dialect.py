"""One relational definition, two engines: Spark SQL to run, DuckDB SQL to compare with."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import needs
from ..functions.patterns import ASCII_B
from .scratch import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

#: Control characters with a JSON escape of one letter.
CONTROLS = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


class Duck:
    """DuckDB's spelling of what differs."""

    def steps(self, groups: list[tuple[list[str], str]]) -> str:
        """Groups of relations in order, each with the names of those that later ones read more than once."""
        return ", ".join(relations for _, relations in groups)

    def table(self, name: str) -> str:
        return name

    def lit(self, pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def like(self, x: str, pattern_column: str) -> str:
        return f"regexp_matches({x}, {pattern_column})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def spans(self, x: str, pattern: str) -> str:
        """All matches of a detector's pattern."""
        return self.all(x, pattern)

    def spread(self, key: str) -> str:
        """A hint behind SELECT: rows go to tasks by a key, for work that is large for its bytes and goes on by that key."""
        return ""

    def first(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {by}, 'g')"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.lit(pattern)})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def where(self, x: str, condition: str) -> str:
        return f"list_filter({x}, lambda x: {condition})"

    def map(self, x: str, value: str) -> str:
        return f"list_transform({x}, lambda x: {value})"

    def join(self, x: str, sep: str) -> str:
        return f"array_to_string({x}, '{sep}')"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def fold(self, x: str, first: str, step: str) -> str:
        return f"list_reduce(list_prepend({first}, {x}), lambda a, x: {step})"

    def slice(self, x: str, start: str, length: str) -> str:
        return f"list_slice({x}, {start}, {start} + {length} - 1)"

    def ordered(self, value: str, by: str) -> str:
        return f"list({value} ORDER BY {by})"

    def total(self, x: str) -> str:
        return f"coalesce(list_sum({x}), 0)"

    def each(self, x: str) -> str:
        return f"unnest({x})"

    def hmac(self, key: str, message: str) -> str:
        inner, outer = _pads(key)
        return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"

    def overlap(self, x: str, y: str) -> str:
        return f"list_has_any({x}, {y})"

    def less(self, x: str, y: str) -> str:
        """The items of x that y has not."""
        return f"list_filter({x}, lambda w: NOT list_contains({y}, w))"

    def words(self, items: tuple[str, ...] | list[str]) -> str:
        return "CAST([" + ", ".join(self.text(i) for i in items) + "] AS VARCHAR[])"

    def hex32(self, x: str) -> str:
        """The number that eight hexadecimal digits write."""
        return f"CAST(concat('0x', {x}) AS BIGINT)"

    def distinct(self, x: str) -> str:
        return f"list_distinct({x})"

    def set_of(self, x: str) -> str:
        """The distinct values of a group, sorted."""
        return f"list(DISTINCT {x} ORDER BY {x})"

    def json_text(self, x: str) -> str:
        """x as a JSON string; of control characters those that have a letter of their own are escaped."""
        quoted = f"""replace(replace({x}, '\\', '\\\\'), '"', '\\"')"""
        for code, letter in CONTROLS.items():
            quoted = f"replace({quoted}, chr({code}), '\\{letter}')"
        return f"""('"' || {quoted} || '"')"""

    def json_object(self, fields: dict[str, str]) -> str:
        """A JSON object of JSON values, null where a value is, in this order."""
        return "concat('{', " + ", ',', ".join(f"""'"{k}":', coalesce({v}, 'null')""" for k, v in fields.items()) + ", '}')"

    def json_list(self, x: str) -> str:
        """A JSON array of a list of JSON values."""
        return f"concat('[', {self.join(x, ',')}, ']')"

    def hours_after(self, x: str, hours: int) -> str:
        return f"({x} + INTERVAL {hours} HOUR)"

    def days_after(self, x: str, days: str) -> str:
        return f"({x} + to_days(CAST({days} AS INTEGER)))"

    def rows(self, alias: str, columns: list[str], values: list[str]) -> str:
        return f"(SELECT * FROM (VALUES {', '.join(values)}) AS {alias}({', '.join(columns)}))"

    def array(self, items: list[str]) -> str:
        return "CAST([" + ", ".join(f"'{i}'" for i in items) + "] AS VARCHAR[])"

    def made(self, columns: dict[str, str]) -> str:
        """Columns that cost much and are used more than once."""
        return ", ".join(f"{v} AS {k}" for k, v in columns.items())

    def xor(self, x: str, y: str) -> str:
        return f"xor({x}, {y})"

    def div(self, x: str, y: str) -> str:
        return f"({x}) // ({y})"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def any_of(self, words: list[str]) -> str:
        return "(" + ", ".join(self.text(w) for w in words) + ")"

    def items(self, values: list[str]) -> str:
        return "[" + ", ".join(values) + "]"

    def none(self) -> str:
        return "CAST([] AS BIGINT[])"

    #: The place of an item, from 1, inside a function that each() or those() is given.
    place = "i"

    def each_item(self, x: str, var: str, body: str) -> str:
        return f"list_transform({x}, lambda {var}: {body})"

    def those(self, x: str, var: str, condition: str) -> str:
        return f"list_filter({x}, lambda {var}: {condition})"

    def item(self, x: str, i: str) -> str:
        return f"{x}[{i}]"

    def most(self, x: str) -> str:
        return f"list_max({x})"

    def least(self, x: str) -> str:
        return f"list_min({x})"

    def find(self, x: str, value: str) -> str:
        """Place of a value from 1, null without."""
        return f"nullif(list_position({x}, {value}), 0)"

    def concat_lists(self, lists: list[str]) -> str:
        return "flatten([" + ", ".join(lists) + "])"

    def lengths(self, x: str, n: str) -> str:
        """Characters in the first n texts of a list."""
        return f"coalesce(list_sum(list_transform(list_slice({x}, 1, {n}), lambda w: length(w))), 0)"

    def apart(self, x: str, start: str, end: str) -> str:
        """Of a list of keys in order those that start no earlier than the last one taken ends; start and end are formats."""
        lists = f"list_prepend({self.none()}, list_transform(list_sort({x}), lambda k: [k]))"
        return f"list_reduce({lists}, lambda a, b: CASE WHEN {start.format('b[1]')} < {end.format('a[-1]')} THEN a ELSE list_concat(a, b) END)"

    def numbered(self, x: str, i: str, value: str) -> str:
        """A row for each item, with its place from 1."""
        return f"generate_subscripts({x}, 1) AS {i}, unnest({x}) AS {value}"

    def struct(self, fields: dict[str, str]) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    string = "VARCHAR"


class Spark(Duck):
    """Spark's."""

    def __init__(self, suffix: str, tasks: int = 8):
        self.suffix = suffix
        #: into how many tasks rows are spread, whatever their bytes
        self.tasks = tasks
        #: relations to write before the query runs, in order
        self.todo: dict[str, str] = {}
        self.written: set[str] = set()

    def steps(self, groups: list[tuple[list[str], str]]) -> str:
        have: list[str] = []
        for names, relations in groups:
            have.append(relations)
            if names:
                text = ", ".join(have)
                views = {name: f"{name}_{self.suffix}_{zlib.crc32(text.encode()):x}" for name in names}
                self.todo |= {view: f"WITH {text} SELECT * FROM {name}" for name, view in views.items()}
                have = [h for h in have[:-1] if h in self.written] + [f"{name} AS (SELECT * FROM {view})" for name, view in views.items()]
                self.written.update(have)
        return ", ".join(have)

    def table(self, name: str) -> str:
        return f"{name}_{self.suffix}"

    def lit(self, pattern: str) -> str:
        flags, pattern = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        if flags and not pattern.isascii():
            flags = "(?iu)"
        if pattern.startswith(r"\b"):  # what follows the first \b is a word character in all of our patterns
            pattern = "(?<![A-Za-z0-9_])" + pattern[2:]
        pattern = flags + pattern.replace(r"\b", ASCII_B)
        return 'r"' + pattern.replace('"', r"\x22") + '"'

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.lit(pattern)})"

    def like(self, x: str, pattern_column: str) -> str:
        return f"({x} rlike {pattern_column})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def spans(self, x: str, pattern: str) -> str:
        if pattern in needs.LITERAL_OF:
            may = f"contains({x}, {self.text(needs.LITERAL_OF[pattern])})"
        elif pattern in needs.PATTERN_OF:
            may = self.matches(x, needs.PATTERN_OF[pattern])
        else:
            return self.all(x, pattern)
        return f"CASE WHEN NOT {may} THEN CAST(array() AS ARRAY<STRING>) ELSE {self.all(x, pattern)} END"

    def spread(self, key: str) -> str:
        return f"/*+ REPARTITION({self.tasks}, {key}) */ "

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {by})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)}, -1)"

    def size(self, x: str) -> str:
        return f"size({x})"

    def where(self, x: str, condition: str) -> str:
        return f"filter({x}, x -> {condition})"

    def map(self, x: str, value: str) -> str:
        return f"transform({x}, x -> {value})"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, '{sep}')"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def fold(self, x: str, first: str, step: str) -> str:
        return f"aggregate({x}, {first}, (a, x) -> {step})"

    def slice(self, x: str, start: str, length: str) -> str:
        return f"slice({x}, {start}, {length})"

    def ordered(self, value: str, by: str) -> str:
        return f"transform(array_sort(collect_list(named_struct('k', {by}, 'v', {value}))), s -> s.v)"

    def total(self, x: str) -> str:
        return f"aggregate({x}, 0, (a, x) -> a + x)"

    def each(self, x: str) -> str:
        return f"explode({x})"

    def hmac(self, key: str, message: str) -> str:
        inner, outer = _pads(key)
        return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', cast({message} AS BINARY)), 256))), 256)"

    def overlap(self, x: str, y: str) -> str:
        return f"arrays_overlap({x}, {y})"

    def less(self, x: str, y: str) -> str:
        return f"filter({x}, w -> NOT array_contains({y}, w))"

    def words(self, items: tuple[str, ...] | list[str]) -> str:
        return "CAST(array(" + ", ".join(self.text(i) for i in items) + ") AS ARRAY<STRING>)"

    def hex32(self, x: str) -> str:
        return f"CAST(conv({x}, 16, 10) AS BIGINT)"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})"

    def set_of(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def json_text(self, x: str) -> str:
        quoted = f"""replace(replace({x}, r'\\', r'\\\\'), '"', r'\\"')"""
        for code, letter in CONTROLS.items():
            quoted = f"replace({quoted}, chr({code}), r'\\{letter}')"
        return f"""concat('"', {quoted}, '"')"""

    def hours_after(self, x: str, hours: int) -> str:
        return f"({x} + INTERVAL '{hours}' HOUR)"

    def days_after(self, x: str, days: str) -> str:
        return f"({x} + make_dt_interval(CAST({days} AS INT)))"

    def made(self, columns: dict[str, str]) -> str:
        # a generator, for the optimizer would put the expressions into each of their uses
        return "inline(array(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in columns.items()) + ")))"

    def array(self, items: list[str]) -> str:
        return "CAST(array(" + ", ".join(f"'{i}'" for i in items) + ") AS ARRAY<STRING>)"

    def xor(self, x: str, y: str) -> str:
        return f"({x} ^ {y})"

    def div(self, x: str, y: str) -> str:
        return f"(({x}) div ({y}))"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def items(self, values: list[str]) -> str:
        return "array(" + ", ".join(values) + ")"

    def none(self) -> str:
        return "CAST(array() AS ARRAY<BIGINT>)"

    place = "(i + 1)"

    def each_item(self, x: str, var: str, body: str) -> str:
        return f"transform({x}, {_params(var)} -> {body})"

    def those(self, x: str, var: str, condition: str) -> str:
        return f"filter({x}, {_params(var)} -> {condition})"

    def item(self, x: str, i: str) -> str:
        return f"element_at({x}, CAST({i} AS INT))"

    def most(self, x: str) -> str:
        return f"array_max({x})"

    def least(self, x: str) -> str:
        return f"array_min({x})"

    def find(self, x: str, value: str) -> str:
        return f"nullif(array_position({x}, {value}), 0)"

    def concat_lists(self, lists: list[str]) -> str:
        return "concat(" + ", ".join(lists) + ")"

    def lengths(self, x: str, n: str) -> str:
        return f"aggregate(slice({x}, 1, CAST({n} AS INT)), 0, (s, w) -> s + length(w))"

    def apart(self, x: str, start: str, end: str) -> str:
        return f"aggregate(array_sort({x}), {self.none()}, (a, k) -> CASE WHEN {start.format('k')} < {end.format('try_element_at(a, -1)')} THEN a ELSE array_append(a, k) END)"

    def numbered(self, x: str, i: str, value: str) -> str:
        return f"inline(transform({x}, (v, i) -> named_struct('{i}', i + 1, '{value}', v)))"

    def struct(self, fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    string = "STRING"


def _params(var: str) -> str:
    return f"({var})" if "," in var else var


def _pads(key: str) -> tuple[str, str]:
    """The padded keys of HMAC-SHA-256, in hex; the key is known where the plan is made."""
    raw = key.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def runs(define: Callable[[Duck], str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the definition over the tables in a folder.

    Relations that are read more than once are written first. With spark.parley.reuse = true those that a session has written
    are read again by its later queries: for tables that do not change meanwhile."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Spark(f"{zlib.crc32(sf_dir.encode()):x}", int(spark.conf.get("spark.sql.shuffle.partitions")))
        text = define(engine)
        for name in TABLES:
            if any(engine.table(name) in t for t in (text, *engine.todo.values())):
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(engine.table(name))
        again = spark.conf.get("spark.parley.reuse", "false") == "true"
        for view, relations in engine.todo.items():
            if not (again and spark.catalog.tableExists(view)):
                stored(spark.sql(relations)).createOrReplaceTempView(view)
        return spark.sql(text)

    return query
