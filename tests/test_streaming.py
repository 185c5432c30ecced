"""Streams over several batches, and the worker's ticks."""

import random
import time

from parley.streaming.payments import last_updates, payment_states, settlement_worker, stateful


def test_states_over_batches_in_any_order(spark, tmp_path):
    """Deliveries of one event in several batches count once, by the first arrival; a reversal holds whatever comes later."""
    batches = [
        [(1, 10, "failed", 5), (2, 11, "paid", 1), (3, 12, "refunded", 9)],
        [(4, 10, "paid", 7), (2, 11, "failed", 8), (5, 12, "paid", 2), (6, 13, "ignored", 3)],
        [(7, 10, "paid", 4), (1, 10, "failed", 6), (8, 11, "failed", 0)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, payment_id long, kind string, arrival long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful(spark)
    got = {r.payment_id: (r.events, r.state) for r in last_updates(payment_states(source), str(tmp_path), ["payment_id"]).collect()}
    assert got == {10: (3, "paid"), 11: (2, "failed"), 12: (2, "reversed"), 13: (1, "pending")}


def test_a_decision_is_taken_back_by_an_earlier_arrival(spark, tmp_path):
    """An event that first seemed paid, failed or reversed, and of which an earlier delivery says otherwise, counts as that one; what else was
    paid decides then. Random deliveries in random batches against a plain version."""
    rnd, stateful_kinds = random.Random(7), ["paid", "failed", "refunded", "ignored", None]
    rows = [(rnd.randrange(12) + 100 * p, p, rnd.choice(stateful_kinds if p % 3 else stateful_kinds[:2]), k) for k, p in enumerate(rnd.choices(range(15), k=400))]
    told = rows[:]
    rnd.shuffle(told)
    for k in range(5):
        spark.createDataFrame(told[k * 80 : (k + 1) * 80], "event_id long, payment_id long, kind string, arrival long").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stateful(spark)
    got = {r.payment_id: (r.events, r.state) for r in last_updates(payment_states(source), str(tmp_path), ["payment_id"]).collect()}
    want = {}
    for p in {r[1] for r in rows}:
        first = {}
        for event, of, kind, at in rows:  # in order of arrival
            if of == p:
                first.setdefault(event, (at, kind))
        when = lambda k: min((a for a, kind in first.values() if kind == k), default=float("inf"))
        paid, failed = when("paid"), when("failed")
        want[p] = (len(first), "reversed" if when("refunded") < float("inf") else "paid" if paid < failed else "failed" if failed < float("inf") else "pending")
    assert got == want and {"paid", "failed", "reversed"} <= {s for _, s in got.values()}


def test_events_are_forgotten_by_age(spark, tmp_path):
    """Known for two seconds, an event that comes again at once counts once, and as another one later; what it decided stays."""
    schema, seen = "event_id long, payment_id long, kind string, arrival long", []
    put = lambda k, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    put(0, [(1, 10, "paid", 1), (1, 10, "paid", 2)])
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in" / "0")).schema).parquet(str(tmp_path / "in" / "*"))
    stateful(spark)
    run = payment_states(source, known_days=2 / 86_400).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="500 milliseconds").foreachBatch(lambda b, _: seen.extend(b.collect())).start()
    try:
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.2)
        time.sleep(3)
        put(1, [(1, 10, "failed", 3)])
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        run.stop()
    assert [(r.events, r.state) for r in seen] == [(1, "paid"), (2, "paid")]


def test_worker_ticks_one_after_another(spark, tmp_path):
    seen, busy = [], []

    def tick(number):
        assert not busy
        busy.append(1)
        time.sleep(0.3)
        busy.pop()
        seen.append(number)

    query = settlement_worker(spark, tick, str(tmp_path / "log"), seconds=1)
    try:
        until = time.time() + 30
        while len(seen) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[:3] == sorted(set(seen[:3])) and len(seen) >= 3
