"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, in_blocks, in_parts, matrix, saved

#: A base for the rolling hash, and the odd multipliers' seed.
BASE, SEED = 0x9E3779B97F4A7C15, 20240613


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each."""
    out = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        x = np.full(n, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int) -> tuple[np.ndarray, int, int]:
    """Sorted distinct 64-bit hashes of a text's word shingles, and a 128-bit hash of its whole word sequence.

    A-Z are lower-cased; words are what white space (ASCII) parts. With fewer words than a shingle has, the
    whole sequence is one; without words there is none. All bytes are hashed at once by prefix sums.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64), 0, 0
    raw = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    size = 1 << max(16, len(raw).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    if len(starts) >= words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    whole = int(sums[-1])
    # the second half weighs the words' own hashes by place, so that it is independent of the first
    place = np.arange(1, len(hashed) + 1, dtype=np.uint64)
    other = int(np.bitwise_xor.reduce(_mixed(hashed + place * np.uint64(0xD1342543DE82EF95))))
    return np.unique(hashed), whole, other


class Signer:
    """Band keys and odd sketch of a shingle set."""

    def __init__(self, bands: int, rows: int, samples: int, bits: int):
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 2**31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, samples, dtype=np.uint32)
        self.salt = rng.integers(0, 2**63, samples, dtype=np.uint64)
        self.bands, self.rows, self.samples, self.bits = bands, rows, samples, bits

    def sign(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, dtype=np.uint32)
        for i in range(0, len(low), 2048):  # a bounded block of the products at a time
            np.minimum(least, (((low[i : i + 2048, None] ^ self.b) * self.a)).min(axis=0), out=least)
        keyed = _mixed(least.astype(np.uint64) * np.uint64(BASE) + self.salt)
        n = self.bands * self.rows
        weight = np.arange(1, self.rows + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        keys = _mixed((keyed[:n].reshape(self.bands, self.rows) * weight).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))
        odd = np.bincount((keyed % np.uint64(self.bits)).astype(np.int64), minlength=self.bits) & 1
        sketch = np.packbits(odd.astype(np.uint8)).view(np.uint64)
        return keys.view(np.int64), sketch.view(np.int64)


def most_bits(similarity: float, samples: int, bits: int) -> int:
    """The XOR population count at which the odd-sketch estimate 1 + bits / 4k * ln(1 - 2z / bits) is similarity."""
    return int(bits / 2 * (1 - np.exp((similarity - 1) * 4 * samples / bits)))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = 20, rows: int = 5, samples: int = 160, bits: int = 512, slack: float = 0.15, sharp_samples: int = 1024, sharp_bits: int = 2048, sharp_slack: float = 0.07, block_shingles: int = 300_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable) and kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of word shingles. A pair at
    the threshold of 0.8 shares one of the 20 bands of 5 MinHash samples with probability 0.9996; odd
    sketches of all samples drop a candidate only if their estimate is slack (four standard
    deviations) below the threshold; all others are confirmed on whole sets.

    Documents of equal word sequences are one class, represented by its smallest id. In each band bucket its
    leader, the one with most bucket mates over all bands (of edited copies, the original), is compared with
    all others: first each document with its best leader, then what still joins two components. In buckets
    that still hold several components, all rows of different ones are compared by sharper odd sketches and
    confirmed where they are, in blocks of block_shingles; so no bucket is capped, and no group of copies
    ever emits all of its pairs.

    Null, empty and blank texts have no shingles and link with nothing. Rows with a null id take no part:
    n_shingles is given, component_id is null and kept is true. Repeated ids give a row each; if their
    texts differ, the id has the links of all of them. An empty table
    gives an empty result. Other columns are ignored.
    """
    sharp = Signer(0, rows, sharp_samples, sharp_bits)
    signer, cut = Signer(bands, rows, samples, bits), most_bits(percent / 100 - slack, samples, bits)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found, one, two = shingles(t, words)
                keys, sketch = signer.sign(found) if len(found) else (None, None)
                out.append((i, len(found), one - 2**63, two - 2**63, keys, sketch))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["doc_id", "n_shingles", "one", "two", "bands", "sketch"])

    signed = saved(docs.mapInArrow(sign, "doc_id long, n_shingles long, one long, two long, bands array<long>, sketch array<long>"))
    linked = signed.where("doc_id is not null and n_shingles > 0")
    classes = saved(linked.groupBy("one", "two").agg(F.min("doc_id").alias("rep")))
    members = saved(linked.join(classes, ["one", "two"]).select("doc_id", "n_shingles", "one", "two", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"), F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch")))
    reps = members.where("doc_id = rep").dropDuplicates(["doc_id", "one", "two"])
    least = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    again = saved(least.where("a <> b").select("doc_id", "a").join(members.select("doc_id", F.col("rep").alias("b")), "doc_id").select("a", "b"))
    keyed = saved(reps.select("doc_id", F.posexplode("bands").alias("band", "key")))
    buckets = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    mates = saved(keyed.join(buckets, "key").select("key", "doc_id", "n"))
    ids = saved(mates.groupBy("doc_id").agg(F.sum("n").alias("mates")))
    ranked = saved(mates.join(ids, "doc_id").select("key", "doc_id", "mates"))
    leaders = saved(ranked.groupBy("key").agg(F.max(F.struct("mates", "doc_id"))["doc_id"].alias("leader")))
    shared = saved(ranked.join(leaders, "key").select("key", "doc_id", "leader"))
    ids = ids.select("doc_id")
    sketches = saved(reps.join(ids, "doc_id").select("doc_id", "sketch"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            found = [shingles(t, words)[0] for t in part.column(1).cast(pa.binary()).to_pylist()]
            sketches = [sharp.sign(x)[1] for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "shingles", "sharp"])

    whole = saved(docs.join(ids.hint("merge"), "doc_id").mapInArrow(sets, "doc_id long, shingles array<long>, sharp array<long>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose whole sets are similar enough."""
        own = whole.select("doc_id", "shingles")
        a = saved(pairs.select("a", "b").distinct().join(own.withColumnsRenamed({"doc_id": "a", "shingles": "x"}), "a"))
        both = a.join(own.withColumnsRenamed({"doc_id": "b", "shingles": "y"}), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.withColumn("c", common).where(F.col("c") * 100 >= (F.size("x") + F.size("y") - F.col("c")) * percent).select("a", "b")

    stars = shared.where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct()
    stars = saved(stars.join(sketches.withColumnsRenamed({"doc_id": "a", "sketch": "x"}), "a"))
    stars = stars.join(sketches.withColumnsRenamed({"doc_id": "b", "sketch": "y"}), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    stars = saved(stars.select("a", "b", apart.alias("z")).where(F.col("z") <= cut))
    best = stars.groupBy("a").agg(F.min(F.struct("z", "b"))["b"].alias("b"))
    edges = saved(confirmed(best).union(again))
    labels = components(edges)

    def across(pairs: DataFrame) -> DataFrame:
        """Those pairs that would join two components."""
        named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        half = saved(pairs.join(named("a"), "a", "left"))
        return half.join(named("b"), "b", "left").where("coalesce(a_label, a) <> coalesce(b_label, b)").select("a", "b")

    edges = saved(edges.union(confirmed(across(stars))))
    labels = components(edges)

    within = saved(shared.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    mixed = saved(within.groupBy("key").agg(F.min("label").alias("lo_label"), F.max("label").alias("hi_label")).where("lo_label <> hi_label").select("key"))
    sizes = members.where("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    there = saved(saved(within.join(mixed, "key")).join(sizes, "doc_id"))
    dealt = in_blocks(there, ["key"], "doc_id", block_shingles, "n").select("key", "lo", "hi", "block", "doc_id", "label")
    more = by_group(dealt.join(whole, "doc_id"), ["key", "lo", "hi"], _joins(most_bits(percent / 100 - sharp_slack, sharp.samples, sharp.bits), percent), "a long, b long")
    labels = components(edges.union(more))
    named = saved(least.select("doc_id", F.col("a").alias("rep"))).join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(saved(named), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _joins(cut: int, percent: int):
    """Of a block pair: confirmed links (a, b) between components, as many as join what they can join, no more.

    The odd sketches name the candidates of each row; these are confirmed on whole sets, all at once. Rows
    that are joined meanwhile are compared no more.
    """

    def find(rows: pa.Table) -> pa.Table:
        lo, hi, block, ids, labels = (rows.column(c).to_numpy() for c in ("lo", "hi", "block", "doc_id", "label"))
        sketch = matrix(rows.column("sharp")).view(np.uint64)
        lists = rows.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        size = np.diff(ends)
        root = np.unique(labels, return_inverse=True)[1]
        left = np.flatnonzero(block == lo[0])
        right = left if lo[0] == hi[0] else np.flatnonzero(block == hi[0])
        out = []
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            z = np.zeros((len(part), len(right)), np.int32)
            for w in range(sketch.shape[1]):
                z += np.bitwise_count(sketch[part, None, w] ^ sketch[None, right, w])
            for i, row in zip(part, z, strict=True):
                near = right[(row <= cut) & (root[right] != root[i]) & ((right > i) if lo[0] == hi[0] else True)]
                if not len(near):
                    continue
                own = flat[ends[i] : ends[i + 1]]
                every = np.concatenate([flat[ends[j] : ends[j + 1]] for j in near])
                place = np.minimum(np.searchsorted(own, every), len(own) - 1)
                common = np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum(size[near]) - size[near])
                for j in near[common * 100 >= (size[i] + size[near] - common) * percent]:
                    if root[j] != root[i]:
                        out.append((ids[i], ids[j]))
                        root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return find
