"""Payment events as streams: once each and counted by day, folded into payment states, and the worker that settles in ticks."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.funds import payment_state_batch
from ..plans.dialect import Duck, runs
from ..plans.fixtures import payment_events
from ..plans.scratch import shared_dir

# the process that sets a stream's state up does not know the driver's path: what it runs is sent along
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def last_updates(stream: DataFrame, folder: str, key: list[str]) -> DataFrame:
    """Run a stream of updates over what is there, written batch by batch as files; of each key the newest. A batch that is run again
    replaces its own files."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    newest = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return stream.sparkSession.read.parquet(f"{folder}/out").withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k", "batch", "part")


def event_days_stream(events: DataFrame, watermark: str = "30 days") -> DataFrame:
    """(window, event_type, n) of a stream of events (event_id, ts, event_type). Deliveries of an event count once if they come within
    the watermark of each other; ids and days older than that leave the state, and events that late are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def event_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and day: read as a stream, delivered twice, deduplicated within the watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    days = event_days_stream(source.unionByName(source)).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return last_updates(days, f"{shared_dir(spark)}/parley/days-{uuid.uuid4().hex}", ["day", "event_type"])


KINDS = {"paid": 0, "failed": 1, "refunded": 2, "disputed": 2}
#: Buckets of payments that share state, and consecutive numbers of events on a page of it; what stands for a number that is null.
BUCKETS, PAGE, NONE = 4096, 1 << 16, -(1 << 63)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Payments(StatefulProcessor):
    """Of each payment when it was first paid and first failed, how many reversals and how many events it has.

    Of an event delivered more than once the first arrival counts, in whatever order and batch its deliveries come: a typed map has each
    event's first arrival and kind. Payments share state by a bucket of their number, and an entry of a bucket's map is a page, the events
    of PAGE consecutive numbers, so a batch reads and writes a page once, whatever it has of it; a page of any payment is bounded. An
    event may be forgotten by age, and a page with its last one. Only where an earlier arrival takes a decision back (the event was
    of another kind) is the map read through, once a batch and bucket."""

    def __init__(self, known: int | None):
        self.known = known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "payment array<long>, paid array<long>, failed array<long>, reversals array<long>, events array<long>")
        self.seen = handle.getMapState("seen", "page long", "payment array<long>, event array<long>, arrival array<long>, kind array<int>, written array<long>", self.known)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, time = self.now.get(), timerValues.getCurrentProcessingTimeInMs() if self.known else 0
        own = {p: row for p, *row in zip(*now, strict=True)} if now else {}
        new = pd.concat(list(rows)).sort_values(["arrival"], kind="stable").drop_duplicates(["payment_id", "event_id"]).sort_values(["event_id"], kind="stable")
        touched, doubtful = {}, {}
        told = zip(new["payment_id"].tolist(), new["event_id"].tolist(), new["arrival"].tolist(), new["kind"], strict=True)
        for page, part in groupby(told, lambda r: r[1] // PAGE):
            known, changed = self._known(self.seen.getValue((page,)), time), False
            for p, event, at, name in part:
                kind, row = KINDS.get(name, 3), own.setdefault(p, [None, None, 0, 0])
                touched[p], was = row, known.get((p, event))
                if was is not None and was[0] <= at:
                    continue
                known[p, event], changed = (at, kind, time), True
                row[3] += was is None
                row[2] += (kind == 2) - (was is not None and was[1] == 2)
                if was is not None and was[1] < 2 and was[1] != kind and row[was[1]] == was[0]:
                    doubtful[p, was[1]] = None
                if kind < 2:
                    row[kind] = at if row[kind] is None else min(row[kind], at)
            if changed:
                of, said = zip(*known, strict=True), zip(*known.values(), strict=True)
                self.seen.updateValue((page,), (*map(list, of), *map(list, said)))
        if doubtful:
            for _, entry in self.seen.iterator():
                for (p, _), (at, kind, _) in self._known(entry, time).items():
                    if (p, kind) in doubtful and (doubtful[p, kind] is None or at < doubtful[p, kind]):
                        doubtful[p, kind] = at
            for (p, kind), at in doubtful.items():
                own[p][kind] = at
        self.now.update((list(own), *map(list, zip(*own.values(), strict=True))))
        yield pd.DataFrame({"payment_id": list(touched), "events": [row[3] for row in touched.values()], "state": [_state(*row[:3]) for row in touched.values()]})

    def _known(self, entry: tuple | None, time: int) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Arrival, kind and time of writing of a page's events that are not forgotten."""
        rows = zip(*entry, strict=True) if entry else ()
        return {(p, event): (at, kind, written) for p, event, at, kind, written in rows if not self.known or written + self.known > time}

    def close(self) -> None:
        pass


def _state(paid: int | None, failed: int | None, reversals: int) -> str:
    return "reversed" if reversals else "paid" if paid is not None and (failed is None or paid < failed) else "failed" if failed is not None else "pending"


def payment_states(events: DataFrame, known_days: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The state of each payment from a stream of (event_id, payment_id, kind, arrival), as updates. Needs the state store that has typed
    maps (RocksDB), which stateful() sets.

    With known_days an event is forgotten that long after it was last written, and a delivery after that counts as another event: so the
    state of a stream that never ends is bounded. Such a stream keeps asking for batches and does not end by availableNow."""
    known = None if known_days is None else int(known_days * 24 * 3600 * 1000)
    whole = {k: F.coalesce(k, F.lit(NONE)) for k in ("payment_id", "event_id")}  # pandas would make a column with nulls one of fractions
    dealt = events.withColumns(whole | {"bucket": F.pmod(F.xxhash64("payment_id"), F.lit(buckets))})
    states = dealt.groupBy("bucket").transformWithStateInPandas(Payments(known), "payment_id long, events long, state string", "Update", "ProcessingTime" if known else "None")
    return states.withColumn("payment_id", F.nullif("payment_id", F.lit(NONE)))


def payment_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payment_state_batch as a stream: events are written once as files, then read as a stream, in four batches at most unless four files make
    one; the last update of each payment."""
    folder = f"{shared_dir(spark)}/parley/payments-{uuid.uuid4().hex}"
    events = runs(lambda e: f"WITH {payment_events(e)} SELECT event_id, payment_id, kind, arrival FROM payment_events")(spark, sf_dir)
    events.write.parquet(f"{folder}/in")
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(4, -(-files // 4))).parquet(f"{folder}/in")
    stateful(spark)
    return last_updates(payment_states(source), folder, ["payment_id"])


def settlement_worker(spark: SparkSession, tick: Callable[[int], None], checkpoint: str, seconds: int = 60) -> StreamingQuery:
    """Calls tick(number) every so many seconds until the query is stopped. A tick that takes longer delays the next: there are never
    two at once, and after a failure the worker goes on with the tick that failed."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.option("checkpointLocation", checkpoint)
    return ticks.trigger(processingTime=f"{seconds} seconds").foreachBatch(lambda _, number: tick(number)).start()


def event_days(e: Duck) -> str:
    return f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM {e.table('events')} GROUP BY ALL"


STREAMS = {"event_dedup_stream": event_dedup_stream, "payment_state_stream": payment_state_stream}
TWINS = {"event_dedup_stream": event_days, "payment_state_stream": payment_state_batch}
