"""Queues of any length, and webhooks by hand."""

import hashlib
import hmac
import time

from pyspark.sql import functions as F

from parley.operators.admission import admitted
from parley.sources import webhooks


def plain(rows, available, target, per_user):
    taken, spent = [], 0
    for _, cents, user in sorted(rows):
        if len(taken) < target and taken.count(user) < per_user and spent + cents <= available:
            taken.append(user)
            spent += cents
    return len(rows), len(taken), spent


def test_requests_equal_a_plain_queue(spark):
    import random

    rnd = random.Random(1)
    rows = [(p, rnd.randrange(9), rnd.randrange(1, 60), rnd.choice([1, 1_000_001, 2_000_001, 5])) for p in range(40) for _ in range(rnd.randrange(1, 30))]
    money = {p: rnd.randrange(0, 200) for p in range(40)}
    frame = spark.createDataFrame(rows, "payment_id long, place long, cents long, user_id long").repartition(5)
    for target, per_user in ((3, 1), (5, 2)):
        found = {r.payment_id: (r.asked, r.admitted, r.cents) for r in admitted(frame, spark.createDataFrame(list(money.items()), "payment_id long, available long"), target=target, per_user=per_user).collect()}
        assert found == {p: plain([r[1:] for r in rows if r[0] == p], money[p], target, per_user) for p in money}


def test_a_million_requests_of_one_payment(spark):
    rows = spark.range(1_000_000).select(F.lit(7).alias("payment_id"), F.col("id").alias("place"), (F.col("id") % 50 + 1).alias("cents"), (F.col("id") % 3 * 1_000_000 + 1).alias("user_id"))
    rows = rows.union(spark.createDataFrame([(8, 0, 10, 1), (8, 1, None, 2), (8, 2, 5, None), (None, 0, 1, 1), (9, 0, 1, 1)], "payment_id long, place long, cents long, user_id long"))
    began = time.time()
    found = {r.payment_id: tuple(r)[2:] for r in admitted(rows, spark.createDataFrame([(7, 10**9), (8, 15)], "payment_id long, available long"), target=3).collect()}
    assert found == {7: (1_000_000, 3, 6), 8: (3, 2, 15)}  # users 1, 1000001 and 2000001 are three
    assert time.time() - began < 60


def test_webhooks_by_hand(spark):
    key, now = b"whsec_x", 1_700_000_000
    sign = lambda t, body: hmac.new(key, f"{t}.{body}".encode(), hashlib.sha256).hexdigest()
    body, good = '{"id":"evt_1","text":"é"}', sign(now, '{"id":"evt_1","text":"é"}')
    cases = [
        (now, f"t={now},v1={good}", body, "accepted"), (now + 300, f"t={now},v1={good}", body, "accepted"), (now + 301, f"t={now},v1={good}", body, "stale"), (now - 301, f"t={now},v1={good}", body, "stale"),
        (now, f"t={now},v1={good}", body + " ", "changed"), (now, f"t={now + 1},v1={good}", body, "changed"), (now, f"t={now},v1={'0' * 64},v0=a,v1={good}", body, "accepted"), (now, f"v1={good}", body, "malformed"), (now, f"t={now}", body, "malformed"),
        (now, f"t={now},v1={good[:-1]}", body, "malformed"), (now, f"t=x,v1={good}", body, "malformed"), (now, f"t={now},t={now},v1={good}", body, "malformed"), (now, "", body, "malformed"), (now, None, body, "malformed"), (now, f"t={now},v1={good}", None, "malformed"),
        (now, f"t={now},v1={sign(now, '')}", "", "accepted"), (now, f"t={now},v0={good}", body, "malformed"),
    ]
    frame = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k long, received long, header string, body string")
    assert {r.k: r.verdict for r in webhooks.verified(frame, key.decode()).collect()} == {k: c[3] for k, c in enumerate(cases)}
