"""The settlement worker: a tick takes the next payments behind a stored cursor, reconciles and expires them, and commits all at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.dialect import Duck, runs
from ..plans.fixtures import payments
from ..plans.scratch import shared_dir, stored
from ..sources.store import Store
from .payments import settlement_worker

#: Payments of a tick, and what they are expired against.
PER_TICK, AS_OF = 50, "2000-01-01 00:00:00"
WRITER = "settlement"
#: Ranges of numbers that are counted at once.
RANGES = 4096
LEDGER = "event_key string, payment_id long, kind string, cents long"
CHANGES = "allocation_id long, status string, at_version long"
HELD = ("reserved", "transferring", "review")


def opened(store: Store) -> Store:
    """The store with the worker's own tables, if it has none yet: what it changed, its ledger, payments to look at, and the cursor."""
    if not store.version():
        empty = lambda schema: store.spark.createDataFrame([], schema)
        store.publish(0, replace={"changes": empty(CHANGES), "ledger": empty(LEDGER), "retries": empty("payment_id long, at_version long"), "cursor": empty("payment_id long")})
    return store


def entries(own: DataFrame, allocations: DataFrame, transfers: DataFrame, refunds: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, ledger, retries) of payments `own` with their allocations as they are, the provider's transfers and refunds.

    A transfer under way is made if the provider has it with the same amount and destination; where these differ the payment is
    left to be tried again. Past its date a paid payment's reservations are cancelled, unless a refund is there already; then, if
    nothing is uncertain, what is left is asked back."""
    theirs = transfers.select("allocation_id", F.col("cents").alias("t_cents"), "destination")
    met = allocations.join(theirs, "allocation_id", "left")
    going = F.col("status") == "transferring"
    found = going & F.col("t_cents").isNotNull()
    same = (F.col("t_cents") == F.col("cents")) & (F.col("destination") == F.col("user_id"))
    met = stored(met.withColumn("verdict", F.when(found & same, "made").when(found, "differs")))
    retries = met.where("verdict = 'differs'").select("payment_id").distinct()
    made = met.where("verdict = 'made'")
    state = F.when(F.col("verdict") == "made", "transferred").otherwise(F.col("status"))
    amount = lambda *states: F.coalesce(F.sum(F.when(F.col("now").isin(*states), F.col("cents"))), F.lit(0))
    sums = met.withColumn("now", state).groupBy("payment_id").agg(amount("transferred", "reversing").alias("gone"), F.max(F.col("now").isin("transferring", "review", "reversing").cast("int")).alias("unsure"))
    due = own.where((F.col("status") == "paid") & (F.col("created") < F.lit(as_of).cast("timestamp"))).join(retries, "payment_id", "left_anti").join(refunds.select("payment_id"), "payment_id", "left_anti")
    cancelled = met.where("status = 'reserved'").join(due.select("payment_id"), "payment_id", "left_semi")
    left = due.join(sums, "payment_id", "left").withColumn("left", F.col("funded") - F.coalesce("gone", F.lit(0))).where((F.coalesce("unsure", F.lit(0)) == 0) & (F.col("left") > 0))
    row = lambda frame, name, of, kind, cents: frame.select(F.concat(F.lit(f"{name}:"), of).alias("event_key"), "payment_id", F.lit(kind).alias("kind"), F.col(cents).cast("long").alias("cents"))
    ledger = row(made, "transfer", "allocation_id", "transferred", "cents").union(row(cancelled, "cancel", "allocation_id", "reservation_cancelled", "cents"))
    ledger = ledger.union(row(left, "funding", "payment_id", "funded", "funded")).union(row(left, "refund-request", "payment_id", "refund_requested", "left"))
    changes = made.select("allocation_id", F.lit("transferred").alias("status")).union(cancelled.select("allocation_id", F.lit("cancelled")))
    return changes, ledger, retries


def reach(ids: DataFrame, n: int) -> tuple[int, int, int]:
    """The first and the n-th number, or the last, of a column payment_id in order, and how many that are: by counts within ranges, so that of
    any n only RANGES counts come to the driver."""
    low, high, total = ids.agg(F.min("payment_id"), F.max("payment_id"), F.count("payment_id")).first()
    if not total:
        return 0, -1, 0
    first, rest = low, n
    if total <= n:
        return low, high, total
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        place = F.expr(f"(payment_id - {low}) div {width}").alias("place")
        for k, count in sorted(map(tuple, ids.where(F.col("payment_id").between(low, high)).groupBy(place).count().collect())):
            if count >= rest:
                break
            rest -= count
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
    return first, low, n


def tick(store: Store, batch: int, sources: dict[str, DataFrame], per_tick: int = PER_TICK, as_of: str = AS_OF) -> int:
    """One tick: the next `per_tick` payments with an intent, by number, behind the cursor; from the start again where they end.

    Only these payments' rows are read of the sources (payments, allocations, transfers, refunds) and only theirs are written. Changes,
    ledger entries, retries and the cursor are published as one version under the batch's number: a tick that died is done again
    from the same cursor, and one that was published is not done twice. Entries whose key the ledger has are not made again."""
    seen = store.version()
    if store.manifest(seen)["writers"].get(WRITER, -1) >= batch:
        return seen
    at = store.read("cursor", seen).agg(F.max("payment_id")).first()[0]
    open_ = sources["payments"].where("has_intent")
    low, high, n = reach((open_.where(F.col("payment_id") > at) if at is not None else open_).select("payment_id"), per_tick)
    cursor = [(high,)] if n == per_tick else []
    mine = lambda frame: frame.join(own.select("payment_id"), "payment_id", "left_semi")
    own = stored(open_.where(F.col("payment_id").between(low, high)))
    newest = Window.partitionBy("allocation_id").orderBy(F.desc("at_version"))
    allocations = mine(sources["allocations"].where(F.col("payment_id").between(low, high)))
    changed = store.read("changes", seen).join(allocations.select("allocation_id"), "allocation_id", "left_semi").withColumn("k", F.row_number().over(newest)).where("k = 1").select("allocation_id", F.col("status").alias("later"))
    allocations = allocations.join(changed, "allocation_id", "left").withColumn("status", F.coalesce("later", "status")).drop("later")
    asked = store.read("ledger", seen).where("kind = 'refund_requested'").select("payment_id")
    refunds = sources["refunds"].select("payment_id").union(asked)
    changes, ledger, retries = entries(own, allocations, sources["transfers"], mine(refunds), as_of)
    ledger = ledger.join(store.read("ledger", seen).select("event_key"), "event_key", "left_anti").select("event_key", "payment_id", "kind", "cents")
    stamp = F.lit(seen + 1).cast("long").alias("at_version")
    append = {"changes": changes.select("allocation_id", "status", stamp), "ledger": ledger, "retries": retries.select("payment_id", stamp)}
    return store.publish(seen, append=append, replace={"cursor": store.spark.createDataFrame(cursor, "payment_id long")}, writer=WRITER, batch=batch)


def worker(spark: SparkSession, store: Store, sources: dict[str, DataFrame], checkpoint: str, seconds: int = 60, per_tick: int = PER_TICK) -> StreamingQuery:
    """Ticks every so many seconds, never two at once, exactly once each: the stream's batch number is the tick's."""
    opened(store)
    return settlement_worker(spark, lambda number: tick(store, number, sources, per_tick), checkpoint, seconds)


def provided(e: Duck) -> str:
    """payments, allocations (one of each number), refunds; transfers: what the provider tells of those under way, with some faults."""
    return f"""{payments(e)}, ranked_allocations AS (SELECT *, row_number() OVER (PARTITION BY allocation_id ORDER BY record_id, user_id, cents, created) AS k FROM allocations), each_allocation AS (SELECT allocation_id, payment_id, user_id, cents, status FROM ranked_allocations WHERE k = 1),
        transfers AS (SELECT allocation_id, CASE WHEN cents % 97 = 0 THEN cents + 1 ELSE cents END AS cents, CASE WHEN cents % 89 = 0 THEN user_id + 1 ELSE user_id END AS destination FROM each_allocation WHERE status = 'transferring' AND cents % 5 <> 0)"""


def settlement_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after ticks over all payments, each over a fifth of them."""
    tables = {"payments": "payments", "allocations": "each_allocation", "refunds": "refunds", "transfers": "transfers"}
    sources = {k: stored(runs(lambda e, name=name: f"WITH {provided(e)} SELECT * FROM {name}")(spark, sf_dir)) for k, name in tables.items()}
    store = opened(Store(spark, f"{shared_dir(spark)}/parley/settled-{uuid.uuid4().hex}"))
    per_tick = sources["payments"].where("has_intent").count() // 5 + 1
    for batch in range(5):
        tick(store, batch, sources, per_tick)
    return store.read("ledger")


def _ticks_sql(e: Duck) -> str:
    """The entries of all payments at once."""
    return f"""WITH {provided(e)}, own AS (SELECT * FROM payments WHERE has_intent), met AS (SELECT a.*, CASE WHEN a.status = 'transferring' AND t.cents IS NOT NULL THEN CASE WHEN t.cents = a.cents AND t.destination = a.user_id THEN 'made' ELSE 'differs' END END AS verdict
            FROM each_allocation a JOIN own o ON o.payment_id = a.payment_id LEFT JOIN transfers t ON t.allocation_id = a.allocation_id),
        now AS (SELECT *, CASE WHEN verdict = 'made' THEN 'transferred' ELSE status END AS state FROM met), again AS (SELECT DISTINCT payment_id FROM met WHERE verdict = 'differs'),
        due AS (SELECT * FROM own WHERE status = 'paid' AND created < TIMESTAMP '{AS_OF}' AND payment_id NOT IN (SELECT payment_id FROM again) AND payment_id NOT IN (SELECT payment_id FROM refunds)),
        sums AS (SELECT payment_id, CAST(coalesce(sum(CASE WHEN state IN ('transferred', 'reversing') THEN cents END), 0) AS BIGINT) AS gone, max(CASE WHEN state IN ('transferring', 'review', 'reversing') THEN 1 ELSE 0 END) AS unsure FROM now GROUP BY payment_id),
        back AS (SELECT d.payment_id, d.funded, d.funded - coalesce(s.gone, 0) AS rest FROM due d LEFT JOIN sums s ON s.payment_id = d.payment_id WHERE coalesce(s.unsure, 0) = 0 AND d.funded - coalesce(s.gone, 0) > 0)
        SELECT concat('transfer:', allocation_id) AS event_key, payment_id, 'transferred' AS kind, cents FROM met WHERE verdict = 'made' UNION ALL SELECT concat('cancel:', allocation_id), payment_id, 'reservation_cancelled', cents FROM met WHERE status = 'reserved' AND payment_id IN (SELECT payment_id FROM due)
        UNION ALL SELECT concat('funding:', payment_id), payment_id, 'funded', funded FROM back UNION ALL SELECT concat('refund-request:', payment_id), payment_id, 'refund_requested', rest FROM back"""


STREAMS = {"settlement_ticks": settlement_ticks}
TWINS = {"settlement_ticks": _ticks_sql}
