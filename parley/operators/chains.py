"""Hash chains: every link in one pass, chains that go on from a stored tail, and verification of stored links."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Duck, runs
from ..plans.fixtures import prompts
from ..plans.scratch import stored

GENESIS = "genesis"
SCHEMA = "conv_id long, k long, payload string, prev string, link string"


def chain(entries: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """(conv_id, k, payload, prev, link): the links of entries (conv_id, turn, payload), each the hash of the one before and its payload.

    A conversation begins with `genesis`, or goes on from its row in tails (conv_id, k, link): what is stored is not read or hashed
    again. A chain is sequential, so a conversation's entries stream in order through one task, which keeps one link; the work is
    linear in the entries whatever their number. Equal turns are in order of payload; a null payload is an empty one; a null
    conversation is a conversation. Without entries there are no links.
    """
    rows = entries.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    if tails is None:
        rows = rows.withColumns({"from_k": F.lit(0).cast("long"), "from_link": F.lit(GENESIS)})
    else:
        tail = tails.select(F.col("conv_id").alias("tail_of"), F.col("k").cast("long").alias("from_k"), F.col("link").alias("from_link"))
        rows = rows.join(tail, F.col("conv_id").eqNullSafe(F.col("tail_of")), "left").drop("tail_of")
        rows = rows.withColumns({"from_k": F.coalesce("from_k", F.lit(0).cast("long")), "from_link": F.coalesce("from_link", F.lit(GENESIS))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, link = object(), 0, GENESIS
        for batch in batches:
            out: list[tuple] = []
            for conv, payload, from_k, from_link in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "payload", "from_k", "from_link")), strict=True):
                if conv != now:
                    now, k, link = conv, from_k, from_link
                prev, k = link, k + 1
                link = hashlib.sha256((prev + payload).encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, k, payload, prev, link))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "k", "payload", "prev", "link"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "payload").mapInArrow(run, SCHEMA)


def tails_of(links: DataFrame) -> DataFrame:
    """(conv_id, k, link): the last link of each chain, by an aggregate that keeps one row for each conversation and task."""
    return links.groupBy("conv_id").agg(F.max("k").alias("k"), F.max_by("link", "k").alias("link"))


def verified(links: DataFrame) -> DataFrame:
    """(conv_id, k, prev, holds): stored links (conv_id, k, payload, link), each held against the one before it and its payload.

    Every link meets its predecessor in a join by conversation and number, so a long chain is verified by as many tasks as
    there are, although making it took one. A link whose predecessor is missing is held against `genesis`."""
    own = links.select("conv_id", "k", "payload", "link")
    before = links.select(F.col("conv_id").alias("of"), (F.col("k") + 1).alias("next"), F.col("link").alias("prev"))
    met = own.join(before, (F.col("k") == F.col("next")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    prev = F.coalesce("prev", F.lit(GENESIS))
    return met.select("conv_id", "k", prev.alias("prev"), (F.col("link") == F.sha2(F.concat(prev, "payload").cast("binary"), 256)).alias("holds"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's conversations as entries: a record's number and turn as JSON."""
    return runs(lambda e: f"WITH {prompts(e)} SELECT conv_id, turn, {payload(e)} AS payload FROM prompts")(spark, sf_dir)


def payload(e: Duck) -> str:
    return f"concat('{{\"record\":', CAST(record_id AS {e.string}), ',\"turn\":', CAST(turn AS {e.string}), '}}')"


def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every conversation."""
    return chain(entries(spark, sf_dir)).select("conv_id", "k", "prev", "link")


def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored chain, of which some conversations' third payload was changed afterwards, verified."""
    links = stored(chain(entries(spark, sf_dir)))
    changed = F.when((F.col("k") == 3) & (F.col("conv_id") % 4 == 0), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return verified(stored(links.withColumn("payload", changed)))


def chain_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which the first turns are stored and the others come later: the chains go on from the stored tails. The last
    link of each, which is that of the whole chain."""
    every = entries(spark, sf_dir)
    first = F.col("turn") < 2 + F.col("conv_id") % 5
    tails = stored(tails_of(chain(every.where(first))))
    later = tails_of(chain(every.where(~first), tails))
    ends = later.unionByName(tails.join(later.select("conv_id"), "conv_id", "left_anti"))
    return ends.select("conv_id", F.col("k").alias("links"), F.col("link").alias("tail"))


def _links(e: Duck) -> str:
    folded = e.fold(e.slice("payloads", "1", "k"), f"'{GENESIS}'", e.sha("concat(a, x)"))
    return f"""{prompts(e)}, chains AS (SELECT conv_id, {e.ordered(payload(e), "turn")} AS payloads FROM prompts GROUP BY conv_id), places AS (SELECT conv_id, payloads, {e.numbered("payloads", "k", "payload")} FROM chains),
        stored AS (SELECT conv_id, CAST(k AS BIGINT) AS k, payload, {folded} AS link FROM places)"""


def _links_sql(e: Duck) -> str:
    return f"WITH {_links(e)} SELECT conv_id, k, coalesce(lag(link) OVER (PARTITION BY conv_id ORDER BY k), '{GENESIS}') AS prev, link FROM stored"


def _verify_sql(e: Duck) -> str:
    changed = "CASE WHEN k = 3 AND conv_id % 4 = 0 THEN concat(payload, ' ') ELSE payload END"
    return f"""WITH {_links(e)}, read AS (SELECT conv_id, k, {changed} AS payload, link, coalesce(lag(link) OVER (PARTITION BY conv_id ORDER BY k), '{GENESIS}') AS prev FROM stored)
        SELECT conv_id, k, prev, link = {e.sha("concat(prev, payload)")} AS holds FROM read"""


def _append_sql(e: Duck) -> str:
    return f"WITH {prompts(e)} SELECT conv_id, count(*) AS links, {e.fold(e.ordered(payload(e), 'turn'), repr(GENESIS), e.sha('concat(a, x)'))} AS tail FROM prompts GROUP BY conv_id"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (chain_links, chain_verify, chain_append)}
SQL = {"chain_links": _links_sql, "chain_verify": _verify_sql, "chain_append": _append_sql}
