"""What the corpus operators share: reading tables, shared scratch tables, blocks of a group, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import stored as saved

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_blocks(members: DataFrame, key: list[str], member: str, block: int, weight: str | None = None) -> DataFrame:
    """Deal the members of each key into block pairs (lo, hi) such that any two members meet in exactly one.

    A group of at most `block` rows, or of that total weight, is one block (0, 0). A larger one is salted into n blocks by the
    hash of its member, and each row goes to the n pairs that hold its block. In a pair with lo < hi only
    rows of different blocks are to be compared. Adds the columns block, lo and hi.
    """
    sizes = members.groupBy(*key).agg(F.ceil((F.sum(weight) if weight else F.count(F.lit(1))) / F.lit(block)).cast("int").alias("_n"))
    large = saved(sizes.where("_n > 1"))
    if large.isEmpty():
        return members.withColumns({c: F.lit(0) for c in ("block", "lo", "hi")})
    # one key may hold a third of all rows: both sides are read from tables, so the join can be split where it is skewed
    dealt = members.join(large, key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.col(member), F.lit(77)), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumns({"lo": F.least("block", "_with"), "hi": F.greatest("block", "_with")}).drop("_n", "_with")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of edges (a, b) can reach.

    Labels fall by min-label propagation with pointer jumping. Every round joins two written tables, so a
    node with very many edges is a skewed join that Spark splits, and the minimum is taken with map-side
    combining; the rounds end when the sum of the labels no longer falls.
    """
    both = saved(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).where("src <> dst").distinct())
    labels = saved(both.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("label")))
    total = lambda x: x.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    last = total(labels)
    while last is not None:
        told = both.join(labels, both.src == labels.node).select(F.col("dst").alias("node"), "label")
        labels = saved(told.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = saved(labels.join(up, "label").select("node", F.least("label", "above").alias("label")))
        now = total(labels)
        if now == last:
            break
        last = now
    return labels


def by_group(df: DataFrame, keys: list[str], found: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What found makes of the rows of each key, as applyInArrow does, without its cost for each small group.

    Rows are dealt and sorted by key and stream through; a group that goes on in the next batch is held.
    """
    keys_and_rest = [*keys, *(c for c in df.columns if c not in keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            values = np.stack([rows.column(k).to_numpy() for k in keys])
            ends = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
            done = [out for a, b in zip([0, *ends[:-1]], ends, strict=False) if (out := found(rows.slice(a, b - a))).num_rows]
            held = rows.slice(ends[-1] if len(ends) else 0)
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from found(held).combine_chunks().to_batches()

    return df.select(*keys_and_rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def shared(make: Callable, *of: Any) -> Any:
    """What make makes of these, once per worker process, so that tasks that follow each other share it and what it has learned."""
    return make(*of)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 256, *, sharing: bool = False) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, that many at a time, so that what a task makes of a batch of long texts is never there all at once.

    Workers live on: a task that shares nothing first lets go of what another operator's tasks have left in its process.
    """
    if not sharing:
        shared.cache_clear()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix of its own type, single precision in double."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.float64) if flat.dtype == np.float32 else flat
    return flat.reshape(len(lists), -1)


def quoted(name: str) -> F.Column:
    """The column of exactly this name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame, columns: list[str] | None) -> tuple[list[F.Column], list[str], list[str], list[F.Column]]:
    """Columns that pass through an operator: to select as _0, _1 and so on, for a name may be any; their schema fields; these inner
    names; and to select at the end, with _ before their own names."""
    inner = [f"_{k}" for k in range(len(columns or []))]
    fields = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(inner, columns or [], strict=True)]
    named = list(zip(inner, columns or [], strict=True))
    return [quoted(c).alias(k) for k, c in named], fields, inner, [F.col(k).alias(f"_{c}") for k, c in named]


def drawn_rows(docs: DataFrame, by: str, most: F.Column, marks: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """About `most` rows (doc_id, text and others), at the most, of each value of `by`, equal ones once: those whose hash is
    below the value's share. `by` is a column of docs or, by id, of marks. Only ids and hashes are joined, counted, drawn and
    shuffled before the drawn texts move; rows of one id are drawn apart."""
    known = docs.select("doc_id", F.xxhash64("text").alias("_text"), *([] if marks else [by])).distinct()
    known = saved(known.join(marks, "doc_id", how) if marks else known)
    share = known.groupBy(by).agg(F.least(F.lit(1.0), F.first(most).cast("double") / F.count(F.lit(1))).alias("_share"))
    place = F.pmod(F.xxhash64("doc_id", "_text", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = known.join(share.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).where(place < F.col("_share"))
    ids = saved(ids.select("doc_id", "_text", *([by] if marks else [])).distinct())
    # of a size that the parameters bound: Spark broadcasts it if it is as small as that, and else merges
    return docs.withColumn("_text", F.xxhash64("text")).join(ids, ["doc_id", "_text"]).dropDuplicates(["doc_id", "_text"]).drop("_text")


def held_out(doc_id: F.Column, folds: int, fold: int) -> F.Column:
    """True where crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
