"""Requests for a payment's money, let in one after another."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Duck, runs
from ..plans.fixtures import payments

TARGET, PER_USER = 3, 1
SCHEMA = "payment_id long, available long, asked long, admitted long, cents long"


def admitted(requests: DataFrame, available: DataFrame, *, target: int = TARGET, per_user: int = PER_USER) -> DataFrame:
    """(payment_id, available, asked, admitted, cents) of requests (payment_id, place, cents, user_id) for payments (payment_id, available).

    In order of place, then cents, then user, a request is let in while fewer than `target` are, fewer than `per_user` of its user,
    and its money is there. What is refused uses nothing up, so no running sum says it: the requests of a payment stream in order
    through one task that keeps a count, a sum and the users let in, of whom there are `target` at the most. A queue of any length takes
    that memory and one pass. Null users are one user; null cents are asked for and never let in; requests of payments that are
    not there are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, there, asked, spent, users = None, 0, 0, 0, Counter()
        for batch in batches:
            for payment, most, cents, user in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payment != now:
                    if now is not None:
                        out.append((now, there, asked, users.total(), spent))
                    now, there, asked, spent, users = payment, most, 0, 0, Counter()
                asked += 1
                if cents is not None and spent + cents <= there and users.total() < target and users[user] < per_user:
                    spent += cents
                    users[user] += 1
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if now is not None:
            out.append((now, there, asked, users.total(), spent))
        if out:
            yield _batch(out)

    rows = requests.where("payment_id IS NOT NULL").join(available.select("payment_id", "available"), "payment_id")
    dealt = rows.repartition("payment_id").sortWithinPartitions("payment_id", "place", "cents", "user_id")
    return dealt.select(F.col("payment_id").cast("long").alias("payment_id"), F.col("available").cast("long").alias("available"), F.col("cents").cast("long").alias("cents"), F.col("user_id").cast("long").alias("user_id")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["payment_id", "available", "asked", "admitted", "cents"])


def _queue(e: Duck) -> tuple[str, str]:
    available = f"SELECT payment_id, CASE WHEN has_intent AND status = 'paid' THEN {e.div('funded', '20')} ELSE 0 END AS available FROM payments"
    return "SELECT payment_id, allocation_id AS place, cents, user_id FROM allocations WHERE status <> 'cancelled'", available


def allocation_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payment's queue: allocations that are not cancelled ask for a twentieth of what was funded."""
    return admitted(*(runs(lambda e, k=k: f"WITH {payments(e)} {_queue(e)[k]}")(spark, sf_dir) for k in (0, 1)))


def _admission_sql(e: Duck) -> str:
    """The same as a fold over each payment's list."""
    requests, available = _queue(e)
    none = "CAST([] AS STRUCT(c BIGINT, u BIGINT)[])"
    own, spent = "len(list_filter(s, lambda y: y.u = x[1].u))", "coalesce(list_sum(list_transform(s, lambda y: y.c)), 0)"
    fold = f"list_reduce(list_prepend({none}, list_transform(asks, lambda k: [k])), lambda s, x: CASE WHEN len(s) < {TARGET} AND {own} < {PER_USER} AND {spent} + x[1].c <= available THEN list_concat(s, x) ELSE s END)"
    return f"""WITH {payments(e)}, q AS ({requests}), a AS ({available}), lists AS (SELECT payment_id, list({{'c': CAST(cents AS BIGINT), 'u': CAST(user_id AS BIGINT)}} ORDER BY place, cents, user_id) AS asks FROM q GROUP BY payment_id),
        done AS (SELECT l.payment_id, a.available, l.asks, {fold} AS s FROM lists l JOIN a ON a.payment_id = l.payment_id)
        SELECT payment_id, available, CAST(len(asks) AS BIGINT) AS asked, CAST(len(s) AS BIGINT) AS admitted, CAST({spent} AS BIGINT) AS cents FROM done"""


QUERIES = {"allocation_admission": allocation_admission}
SQL = {"allocation_admission": _admission_sql}
