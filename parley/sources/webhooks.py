"""Webhooks as they come: bodies and signature headers, verified before anything in them is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.dialect import Duck, Spark, runs
from ..plans.scratch import shared_dir
from ..streaming.convergence import appended

SECRET = "whsec-of-the-fixture"
#: Seconds that a signature may be old, or ahead.
TOLERANCE = 300


def verdict(e: Duck, secret: str = SECRET) -> str:
    """SQL: what becomes of a row (received, header, body); received in seconds. A header is `t=<seconds>` and any number of `v1=<64 hexadecimal
    digits>` among other parts, with commas between; one of the signatures must be the HMAC of `<seconds>.<body>` with nothing changed."""
    parts = e.split("header", ",")
    times = e.those(parts, "p", e.matches("p", r"\At=[0-9]{1,18}\z"))
    signatures = e.each_item(e.those(parts, "p", e.matches("p", r"\Av1=[0-9a-f]{64}\z")), "p", "substr(p, 4)")
    at = f"substr({e.item(times, '1')}, 3)"
    found = f"coalesce({e.find(signatures, e.hmac(secret, f'concat({at}, {chr(39)}.{chr(39)}, body)'))}, 0) > 0"
    return f"""CASE WHEN header IS NULL OR body IS NULL THEN 'malformed' WHEN {e.size(times)} <> 1 OR {e.size(signatures)} = 0 THEN 'malformed' WHEN NOT {found} THEN 'changed'
        WHEN abs(received - CAST({at} AS BIGINT)) > {TOLERANCE} THEN 'stale' ELSE 'accepted' END"""


def verified(hooks: DataFrame, secret: str = SECRET) -> DataFrame:
    """Rows (received, header, body, ...) of a table or a stream with their verdict: accepted, stale, changed or malformed. Null headers and
    bodies are malformed. Other columns stay."""
    hooks = hooks.withColumn("received", hooks["received"].cast("long"))
    return hooks.selectExpr("*", f"{verdict(Spark('x'), secret)} AS verdict")


def deliveries(e: Duck) -> str:
    """deliveries(event_id, received, header, body): events as their service would send them; some headers lack a part or bring a second
    signature, some bodies were changed on the way, and some came late."""
    at = f"CAST({'floor(epoch(ts))' if type(e) is Duck else 'unix_seconds(CAST(ts AS TIMESTAMP))'} AS BIGINT)"
    text = lambda x: f"CAST({x} AS {e.string})"
    body = f"""concat('{{"id":"evt_', {text("event_id")}, '","type":"', event_type, '","user":', {text("user_id")}, '}}')"""
    signature = e.hmac(SECRET, f"concat({text('sent_at')}, '.', body)")
    header = f"CASE WHEN event_id % 17 = 0 THEN concat('v1=', signature) WHEN event_id % 19 = 0 THEN concat('t=', {text('sent_at')}, ',v0=', signature) WHEN event_id % 13 = 0 THEN concat('t=', {text('sent_at')}, ',v1=', repeat('0', 64), ',v0=x,v1=', signature) ELSE concat('t=', {text('sent_at')}, ',v1=', signature) END"
    return f"""sent AS (SELECT event_id, user_id, value, {at} AS sent_at, {body} AS body FROM {e.table("events")}), signed AS (SELECT *, {signature} AS signature FROM sent),
        deliveries AS (SELECT event_id, sent_at + CAST(floor(value * 4) AS BIGINT) AS received, {header} AS header, CASE WHEN user_id % 9 = 0 THEN concat(body, ' ') ELSE body END AS body FROM signed)"""


def webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries read as a stream of files, as they came, and what becomes of each."""
    folder = f"{shared_dir(spark)}/parley/hooks-{uuid.uuid4().hex}"
    raw = runs(lambda e: f"WITH {deliveries(e)} SELECT * FROM deliveries")(spark, sf_dir)
    raw.write.json(f"{folder}/in")
    source = spark.readStream.schema("event_id long, received long, header string, body string").option("maxFilesPerTrigger", 4).json(f"{folder}/in")
    return appended(verified(source), folder).select("event_id", "verdict")


def _hooks_sql(e: Duck) -> str:
    return f"WITH {deliveries(e)} SELECT event_id, {verdict(e)} AS verdict FROM deliveries"


STREAMS = {"webhook_stream": webhook_stream}
TWINS = {"webhook_stream": _hooks_sql}
