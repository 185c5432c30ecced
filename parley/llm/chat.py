"""Chat formatting: turn-aligned windows under a token budget, with a loss mask and a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, saved

T = TypeVar("T")

#: The template's control strings. A turn is what stands between the opening and the closing string of its role;
#: a role without strings of its own is named in <<ROLE>> ... <</ROLE>> before its turn.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER, NAME = ("[TURN]", "[/TURN]"), ("<<ROLE>>", "<</ROLE>>")
CONTROLS = ["<s>", *(c for pair in (*TURNS.values(), OTHER, NAME) for c in pair)]
ESCAPED = re.compile("|".join(map(re.escape, ["\\", *CONTROLS])))
TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    """A backslash before each control string and each backslash."""
    return ESCAPED.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def written(role: str, text: str) -> tuple[str, str, str]:
    """The formatted turn: what comes before its text, the escaped text, what comes after. One blank parts text and strings."""
    opened, closed = TURNS.get(role, OTHER)
    name = "" if role in TURNS else f"{NAME[0]} {escape(role)} {NAME[1]}"
    return f"{name}{opened} ", escape(text), f" {closed}"


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted window, by a scan in which a backslash hides what follows it."""
    marks, at = [], 0
    opening = {o: r for r, (o, _) in TURNS.items()} | {OTHER[0]: None}
    for m in _MARKS.finditer(formatted):
        if m.group()[0] != "\\":
            marks.append((m.group(), m.start(), m.end()))
    out, role, i = [], None, 0
    while i < len(marks):
        mark, _, end = marks[i]
        if mark == NAME[0]:
            role = unescape(formatted[end + 1 : marks[i + 1][1] - 1])
            i += 2
        elif mark in opening:
            out.append((opening[mark] or role or "", unescape(formatted[end + 1 : marks[i + 1][1] - 1])))
            i += 2
        else:
            i += 1
        at = end
    return out


_MARKS = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROLS)), re.DOTALL)


def tokens(text: str) -> int:
    """Tokens of a turn by the budget's count: words and marks, and two for its strings."""
    return len(TOKEN.findall(text)) + 2


def spans(turns: Iterable[tuple[str, str]], budget: int, history: int) -> Iterator[tuple[list[tuple[str, str]], int]]:
    """Windows of whole turns (role, text): (turns, how many of the first are repeats)."""
    return windows_of(((role, tokens(text), (role, text)) for role, text in turns), budget, history)


def windows_of(turns: Iterable[tuple[str, int, T]], budget: int, history: int) -> Iterator[tuple[list[T], int]]:
    """Windows of turns (role, size, whatever stands for the turn): (these, how many of the first are repeats).

    The running sum of turn tokens decides: a window ends before the turn that would pass the budget. Each
    later window begins with the conversation's first system turn and then with those last turns before it
    that fit into `history` tokens and leave room for the first new turn. A turn longer than what the budget
    leaves makes a window of its own. Only one window is held.
    """
    system: tuple[int, T] | None = None
    held: list[tuple[int, T]] = []
    total = repeats = 0
    for role, size, item in turns:
        if len(held) > repeats and total + size > budget:
            yield [x for _, x in held], repeats
            room = min(history, budget - size - (system[0] if system else 0))
            past: list[tuple[int, T]] = []
            for turn in reversed(held):
                if turn is system:
                    continue
                room -= turn[0]
                if room < 0:
                    break
                past.insert(0, turn)
            held = ([system] if system else []) + past
            repeats, total = len(held), sum(k for k, _ in held)
        held.append((size, item))
        if system is None and role == "system":
            system = held[-1]
        total += size
    if held:
        yield [x for _, x in held], repeats


def in_order(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in rows:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def formatted_window(window: list[tuple[str, str]], repeats: int) -> tuple[str, str]:
    """The text of a window, and the spans of its targets: assistant texts that are no repeats."""
    parts, loss, at = ["<s>"], [], 3
    for i, (role, text) in enumerate(window):
        before, body, after = written(role, text)
        if role == "assistant" and i >= repeats:
            loss.append(f"{at + len(before)}:{at + len(before) + len(body)}")
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), ",".join(loss)


def format_chats(turns: DataFrame, **settings) -> DataFrame:
    """(conv_id, window, formatted, n_repeated, loss): the windows of each conversation, with settings as in windows_in_parts.

    loss holds the spans start:end (code points, end exclusive) of the assistant texts in formatted that are
    targets: those of repeated turns are masked, so each is a target once.

    Turns are in order of turn, then role, then text. A null text is empty, a null role is the empty role, a null conversation
    is a conversation. Equal rows are turns of their own. An empty table gives an empty result. Other columns are ignored.
    """
    whole, parts = windows_in_parts(turns, **settings)
    return whole if parts is None else whole.union(parts)


def digest_chats(turns: DataFrame, **settings) -> DataFrame:
    """digest_windows of format_chats; windows that come out of their conversation's own task are not dealt again."""
    whole, parts = windows_in_parts(turns, **settings)
    told = digest_windows(whole, dealt=True)
    return told if parts is None else told.union(digest_windows(parts))


def windows_in_parts(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 256, large_turns: int = 100_000) -> tuple[DataFrame, DataFrame | None]:
    """Windows of conversations that one task formats, and those of conversations of more than large_turns turns, if there are any.

    Rows are dealt by conversation and stream through in order, one window in memory. Of a large conversation, which may hold a
    third of all rows, only a turn's number, role and size go to one task, which says by running sums to which windows it belongs;
    its texts are then dealt by window, so that any number of tasks format them. Texts that share a turn and a role are in order of
    text there too: the distinct ones are ranked for each such turn, and the rank goes along.
    """
    rows = turns.select(quoted(conv_id).cast("long").alias("conv_id"), quoted(turn).cast("long").alias("turn"), F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, own in groupby(in_order(batches), key=lambda r: r[0]):
            for number, (window, repeats) in enumerate(spans(((r[2], r[3]) for r in own), budget, history)):
                formatted, loss = formatted_window(window, repeats)
                out.append((conv, number, formatted, repeats, loss))
                size += len(formatted)
                if size > 1 << 22:
                    yield _batch(out, _WINDOWS)
                    out, size = [], 0
        if out:
            yield _batch(out, _WINDOWS)

    def whole(x: DataFrame) -> DataFrame:
        return x.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)

    large = saved(rows.groupBy("conv_id").count().where(F.col("count") > large_turns).select(F.col("conv_id").alias("large")))
    if large.isEmpty():
        return whole(rows), None
    same = F.col("conv_id").eqNullSafe(F.col("large"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [tokens(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], ["conv_id", "turn", "role", "text", "size"])

    told = rows.join(large, same, "left_semi").mapInArrow(sized, "conv_id long, turn long, role string, text string, size long")
    told = saved(told.withColumn("row", F.monotonically_increasing_id()))  # written, so that a row keeps its number

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, own in groupby(in_order(batches), key=lambda r: r[0]):
            for number, (window, repeats) in enumerate(windows_of(((r[2], r[4], r[5]) for r in own), budget, history)):
                out += [(conv, number, place, row, repeats) for place, row in enumerate(window)]
                if len(out) > 1 << 17:
                    yield _batch(out, _PLACES)
                    out = []
        if out:
            yield _batch(out, _PLACES)

    # where several texts have one turn and role, their rank by text goes with the light row: those texts alone are sorted
    key = ["conv_id", "turn", "role"]
    again = saved(told.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    match = lambda a, b, names: reduce(Column.__and__, (a[c].eqNullSafe(b[c]) for c in names))
    tied = told.join(again, match(told, again, key), "left_semi").select(*key, "text").distinct()
    ranks = saved(tied.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("text"))))
    ranked = told.join(ranks, match(told, ranks, [*key, "text"]), "left").select(*(told[c] for c in (*key, "size", "row")), F.coalesce(ranks["rank"], F.lit(0)).alias("rank"))
    light = ranked.select(*key, "rank", "size", "row").repartition("conv_id").sortWithinPartitions(*key, "rank", "row")
    places = saved(light.mapInArrow(walked, "conv_id long, window long, place long, row long, repeats long"))
    dealt = places.join(told.select("row", "role", "text"), "row").select("conv_id", "window", "place", "repeats", "role", "text")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, number), own in groupby(in_order(batches), key=lambda r: (r[0], r[1])):
            own = list(own)
            formatted, loss = formatted_window([(r[4], r[5]) for r in own], own[0][3])
            out.append((conv, number, formatted, own[0][3], loss))
            if len(out) >= 256:
                yield _batch(out, _WINDOWS)
                out = []
        if out:
            yield _batch(out, _WINDOWS)

    parts = dealt.repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "place").mapInArrow(joined, SCHEMA)
    return whole(rows.join(large, same, "left_anti")), parts


SCHEMA = "conv_id long, window long, formatted string, n_repeated long, loss string"
_PLACES = (("conv_id", pa.int64()), ("window", pa.int64()), ("place", pa.int64()), ("row", pa.int64()), ("repeats", pa.int64()))
_WINDOWS = (("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("n_repeated", pa.int64()), ("loss", pa.string()))
_DIGESTS = (("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()))


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def digest_windows(windows: DataFrame, *, dealt: bool = False) -> DataFrame:
    """Of each conversation what its formatted windows say, read back: turns once each, and all text under the loss mask.

    A digest is sequential, so the windows of a conversation are dealt to one task, sorted, and stream through it. With
    `dealt` they are so already and are not dealt again. A conversation without
    windows has no row; an empty table gives an empty result; other columns are ignored.
    """
    windows = windows.select("conv_id", "window", "formatted", "n_repeated", "loss")
    windows = windows if dealt else windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, own in groupby(in_order(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = formatted_chars = n_windows = 0
            for _, _, formatted, repeats, spans_ in own:
                for role, text in read(formatted)[repeats:]:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in filter(None, spans_.split(",")):
                    a, b = map(int, span.split(":"))
                    target = unescape(formatted[a:b])
                    loss.update(target.encode("utf-8", "surrogatepass"))
                    chars += len(target)
                formatted_chars += len(formatted)
                n_windows += 1
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars, n_windows))
        if out:
            yield _batch(out, _DIGESTS)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
