"""Sessions and convergence over several batches, by hand and by plain versions."""

from datetime import datetime, timedelta

from parley.streaming.convergence import appended, closing, converged
from parley.streaming.payments import last_updates, payment_states
from parley.streaming.sessions import payment_sessions, stateful, step

START = datetime(2024, 1, 1)
EVENTS = "event_id long, payment_id long, ts timestamp, kind string, session_id long, arrival long"


def batches(spark, folder, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    frame = spark.read.schema(schema).parquet(f"{folder}/*")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_steps_of_a_payment():
    now = ("pending", None, 0)
    for kind, of, want in [
        ("checkout", 5, ("pending", 5, 1)), ("failed", 4, ("pending", 5, 1)), ("failed", 5, ("failed", 5, 1)), ("paid", 5, ("failed", 5, 1)), ("checkout", 6, ("pending", 6, 2)),
        ("paid", 5, ("pending", 6, 2)), ("paid", 6, ("paid", 6, 2)), ("checkout", 7, ("paid", 6, 2)), ("failed", 6, ("paid", 6, 2)), ("refunded", None, ("reversed", 6, 2)), ("paid", 6, ("reversed", 6, 2)),
    ]:
        now = step(*now, kind, of)
        assert now == want
    assert step("pending", None, 0, "paid", 9) == ("paid", None, 0) and step("pending", None, 0, "failed", 9) == ("pending", None, 0)


def test_state_is_bounded_and_redeliveries_count_once(spark, tmp_path):
    """A payment with five events a day for sixty days, each delivered again the day after: ids of the last days are held, no more."""
    parts, n = [], 0
    for day in range(0, 60, 10):
        rows = []
        for d in range(day, day + 10):
            for k in range(5):
                event = d * 5 + k
                at = START + timedelta(days=d, hours=k)
                rows += [(event, 1, at, "checkout" if k == 0 else "failed", d * 5, n), (event, 1, at, "failed", None, n + 12)]
                n += 1
        parts.append(rows)
    parts[-1].append((9999, 2, START + timedelta(days=59), "checkout", 7, n + 1))
    stateful(spark)
    told = payment_sessions(batches(spark, tmp_path / "in", parts, EVENTS))
    seen = []
    run = told.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend(b.collect())).start()
    run.awaitTermination()
    own = [r for r in seen if r.payment_id == 1]
    assert [r.events for r in own] == [50 * (k + 1) for k in range(6)]
    assert max(r.held for r in own) <= 5 * 21 and own[-1].held <= own[2].held + 5  # the watermark's ten days, and the batch's ten
    assert (own[-1].status, own[-1].attempt) == ("failed", 60)


def test_sessions_over_batches(spark, tmp_path):
    day = lambda k: START + timedelta(days=k)
    parts = [
        [(1, 10, day(0), "checkout", 100, 1), (2, 10, day(0), "failed", 100, 2), (3, 11, day(0), "paid", None, 3)],
        [(4, 10, day(1), "checkout", 101, 4), (2, 10, day(0), "failed", 100, 5), (5, 10, day(1), "paid", 100, 6)],
        [(6, 10, day(2), "paid", 101, 7), (7, 11, day(2), "disputed", None, 8), (8, 12, day(2), "failed", 9, 9)],
    ]
    stateful(spark)
    out = last_updates(payment_sessions(batches(spark, tmp_path / "in", parts, EVENTS)), str(tmp_path), ["payment_id"])
    assert {r.payment_id: (r.status, r.session_id, r.attempt, r.events) for r in out.collect()} == {10: ("paid", 101, 2, 5), 11: ("reversed", None, 0, 2), 12: ("pending", None, 0, 1)}


def test_convergence_in_any_order(spark, tmp_path):
    at = lambda d: START + timedelta(days=d)
    schema = "user_id long, conv_id long, at timestamp_ntz"
    matches = [(1, 10, at(0)), (1, 11, at(3)), (2, 10, at(5)), (2, 12, at(6)), (None, 13, at(1)), (3, 14, at(1))]
    packages = [(1, 10, at(4)), (1, 11, at(1)), (2, 12, at(90)), (3, 15, at(2)), (3, 14, at(1)), (3, 14, at(2))]
    want = {(1, 10, 0, 4), (1, 11, 3, 1), (2, 10, 5, None), (2, 12, 6, None), (2, 12, None, 90), (None, 13, 1, None), (3, 15, None, 2), (3, 14, 1, 1), (3, 14, 1, 2)}
    for name, order in (("a", 1), ("b", -1)):
        sides = []
        for side, rows in (("m", matches), ("p", packages)):
            rows = rows[::order]
            ends = closing(spark.createDataFrame([], schema)).collect()
            sides.append(batches(spark, tmp_path / name / side, [rows[:2], rows[2:4], rows[4:], ends], schema))
        found = appended(converged(*sides, late="200 days"), str(tmp_path / name)).where("conv_id IS NOT NULL").collect()
        days = lambda t: None if t is None else (t - START).days
        assert {(r.user_id, r.conv_id, days(r.matched), days(r.packaged)) for r in found} == want and len(found) == len(want)


def test_sessions_of_events_that_come_late(spark, tmp_path):
    """A table whose second half, by arrival, is as old as the first: no event is dropped, and state is by buckets."""
    import duckdb

    from parley.catalogue import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id + k * 1000 AS event_id, CASE WHEN event_id % 97 <> 5 THEN user_id END AS user_id) FROM '/root/testdata/sf0.001/events.parquet', (SELECT unnest([0, 1, 2]) AS k) WHERE event_id < 400 OR event_id > 900) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    plain = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist()), key=repr)
    assert plain(queries()["session_states"](spark, str(tmp_path)).toPandas()) == plain(con.execute(oracle_sql()["session_states"]).df())
    payments = [(k, k, START, "checkout", k, k) for k in range(3000)]
    stateful(spark)
    run = payment_sessions(batches(spark, tmp_path / "many", [payments], EVENTS), buckets=2).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(lambda b, _: b.count()).start()
    run.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress[:1]) < 100


def test_payments_share_state(spark, tmp_path):
    """Three thousand payments' events are a few rows of state, in two buckets' pages."""
    rows = [(k, k, "paid", k) for k in range(3000)]
    spark.createDataFrame(rows, "event_id long, payment_id long, kind string, arrival long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stateful(spark)
    source = spark.readStream.schema("event_id long, payment_id long, kind string, arrival long").parquet(str(tmp_path / "in"))
    run = payment_states(source, buckets=2).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(lambda b, _: b.count()).start()
    run.awaitTermination()
    assert run.recentProgress[0]["stateOperators"][0]["numRowsTotal"] < 100


def test_ranges_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    """Each range is as many files, a batch takes a whole range, and none of it comes twice or out of order."""
    from parley.streaming import sessions

    monkeypatch.setattr(sessions, "FILE_ROWS", 50)
    told = sessions.in_order(spark.range(0, 1000, 1, 8).withColumnRenamed("id", "at"), "at", str(tmp_path / "in"))
    assert {len(spark.read.parquet(str(tmp_path / "in" / str(k))).inputFiles()) for k in range(4)} in ({4}, {5})
    seen = []
    told.writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(lambda b, _: seen.append(sorted(r.at for r in b.collect()))).start().awaitTermination()
    assert len(seen) == 4 and sum(seen, []) == list(range(1000))
