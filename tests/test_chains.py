"""Chains against a plain fold, long ones in linear time, and what a changed or missing entry does."""

import hashlib
import time

from pyspark.sql import functions as F

from parley.operators import chains


def fold(payloads, link="genesis"):
    out = []
    for p in payloads:
        link = hashlib.sha256((link + (p or "")).encode()).hexdigest()
        out.append(link)
    return out


def test_links_equal_a_fold(spark):
    rows = [(c, t, f"{c}:{t}é") for c in (1, 2, None) for t in (3, 1, 2, 10)] + [(1, 3, "a"), (2, 4, None), (2, None, "first")]
    found = {}
    for r in chains.chain(spark.createDataFrame(rows, "conv_id long, turn long, payload string").repartition(3)).collect():
        found.setdefault(r.conv_id, []).append((r.k, r.prev, r.link))
    for c in (1, 2, None):
        own = [p for _, _, p in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))]
        links = fold(own)
        assert sorted(found[c]) == [(k + 1, (["genesis", *links])[k], links[k]) for k in range(len(own))]
    assert chains.chain(spark.createDataFrame([], "conv_id long, turn long, payload string")).collect() == []


def test_a_long_chain_is_linear_and_goes_on_from_its_tail(spark):
    every = spark.range(100_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("turn "), "id").alias("payload"))
    every = every.union(spark.range(50).select(F.col("id") + 100, F.lit(0), F.lit("x")))
    want = fold(f"turn {k}" for k in range(100_000))
    began = time.time()
    links = chains.stored(chains.chain(every))
    assert {r.conv_id: r.link for r in chains.tails_of(links).collect()}[7] == want[-1] and time.time() - began < 30
    assert chains.verified(links).where("not holds").count() == 0
    half = chains.stored(chains.tails_of(chains.chain(every.where("turn < 60000"))))
    later = chains.chain(every.where("turn >= 60000"), half)
    first, last = later.orderBy("k").first(), chains.tails_of(later).collect()
    assert (first.k, first.prev) == (60_001, want[59_999]) and [(r.conv_id, r.k, r.link) for r in last] == [(7, 100_000, want[-1])]


def test_changed_and_missing_entries_are_found(spark):
    links = chains.stored(chains.chain(spark.createDataFrame([(c, t, f"{t}") for c in (1, 2) for t in range(6)], "conv_id long, turn long, payload string")))
    bad = links.withColumn("payload", F.when((F.col("conv_id") == 1) & (F.col("k") == 4), F.lit("other")).otherwise(F.col("payload")))
    assert [(r.conv_id, r.k) for r in chains.verified(bad).where("not holds").collect()] == [(1, 4)]
    assert [(r.conv_id, r.k) for r in chains.verified(links.where("not (conv_id = 2 and k = 3)")).where("not holds").collect()] == [(2, 4)]
