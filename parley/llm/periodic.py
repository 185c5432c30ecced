"""Runs of periodic words: exact counts of matches by lag, then scans of the few lags that can hold a run."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted


def lag_counts(ids: np.ndarray) -> np.ndarray:
    """How many places i have ids[i] == ids[i + lag], for each lag up to half the length.

    Words that are frequent (heavy) are counted by the autocorrelation of their places, whose sums over one transform are
    rounded to the whole numbers that they are; the pairs of all others (light) one by one. A word is heavy where its pairs
    are more work than a transform, so that the sum of both is the least.
    """
    n, half = len(ids), len(ids) // 2
    out = np.zeros(half + 1, np.int64)
    count = np.bincount(ids)
    size = 1 << (n + half).bit_length()  # no lag up to half wraps round
    heavy = np.flatnonzero(count.astype(np.float64) ** 2 > 1.5 * size * np.log2(size))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            at = np.fft.rfft((ids == word).astype(np.float64), size)
            power += at.real**2 + at.imag**2
        out += np.rint(np.fft.irfft(power, size)[: half + 1]).astype(np.int64)
    light = (count > 1) & (count**2 <= 1.5 * size * np.log2(size))
    place = np.argsort(ids, kind="stable")
    place = place[light[ids[place]]]
    word, first, step = ids[place], np.arange(len(place)), 0
    held, waiting = [], 0
    while len(first):
        step += 1
        first = first[: np.searchsorted(first, len(place) - step)]
        first = first[word[first] == word[first + step]]
        lag = place[first + step] - place[first]
        near = lag <= half
        first = first[near]  # the next of a word's places are further still
        held.append(lag[near])
        waiting += len(first)
        if waiting > n + 4096 or not len(first):
            out += np.bincount(np.concatenate(held), minlength=half + 1)
            held, waiting = [], 0
    out[0] = 0
    return out


@lru_cache(maxsize=65536)
def prime_factors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def promising(ids: np.ndarray, lag: int, need: int) -> bool:
    """False if no `need` places in a row match at this lag. Of anchors need // 2 apart two in a row, and what is between, match."""
    step = need // 2
    at = np.arange(step - 1, len(ids) - lag, step)
    hit = ids[at] == ids[at + lag]
    at = at[:-1][hit[:-1] & hit[1:]]
    for between in sorted({step * i // 16 for i in range(1, 16)} - {0}):
        if not len(at):
            return False
        at = at[ids[at + between] == ids[at + between + lag]]
    return bool(len(at))


def periodic_runs(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period: the stretches that have this smallest period, are at least `least` and
    two periods long, and that no neighbour extends.

    A run of period q has max(least - q, q) matching places in a row at lag q, so only lags with as many matches are scanned,
    the smallest first. A run's matches at the multiples of its period are taken off the counts there: those islands are the
    run itself, as a stretch with a period and a length of at least a multiple of it has no other extension at that lag.
    """
    n, out = len(ids), []
    if n < least:
        return out
    count = lag_counts(ids)
    lags = np.arange(len(count))
    for q in np.flatnonzero((count >= np.maximum(least - lags, lags)) & (lags > 0)).tolist():
        need = max(least - q, q)
        if count[q] < need or not promising(ids, q, need):
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids[q:] == ids[:-q], [False]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= need
        for s, e in zip(starts[long].tolist(), (ends[long] + q).tolist(), strict=True):
            if any(np.array_equal(ids[s + q // p : e], ids[s : e - q // p]) for p in prime_factors(q)):
                continue  # a smaller period
            out.append((s, e - s, q))
            more = np.arange(2 * q, min(e - s, len(count)), q)
            count[more] -= e - s - more
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has behind its first period, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        start, length, period = np.array(runs).T
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        words = [w for w, drop in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not drop]
    return b" ".join(words)


def find_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, runs, collapsed) of every whole text: its runs as structs of start, length and period (numbers of words, from 0) by
    start, then period, and its words without repetitions, joined by one space.

    Words are what ASCII white space parts; equal words are equal bytes. A text is one row's work, linear in memory, and in time
    near n * sqrt(n log n) at the worst; no row is shuffled. A null, empty or blank text has no runs and an empty
    collapsed text. Null and repeated ids are rows like others; ties do not occur, as runs differ in start or period. An
    empty table gives an empty one. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, texts = [], []
                for t in part.column(1).cast(pa.large_binary()):
                    words = (t.as_py() or b"").split()
                    number: dict[bytes, int] = {}
                    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                    runs = periodic_runs(ids, least) if len(number) < len(words) else []
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(collapsed(words, runs).decode())
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of h = crc32(doc_id as text) and g = h // 10, texts with h % 10 = 0 repeat the p words behind their first a
    up to their end, a = g % n and p = 1 + (n - a) // (3 + g % 8). Others, those of null ids too, stay as they are."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    some = F.coalesce(n > 0, F.lit(False))
    a = F.when(some, g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice("words", a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return chosen.select("doc_id", F.when(some, F.array_join(F.concat(F.slice("words", F.lit(1), a), again), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of find_runs: counts, the longest run (ties: the smallest start, then period) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    most = F.expr("1000 * best.length div -best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), most.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
