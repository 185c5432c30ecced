"""All queries of the library with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import admission, chains, external, funds, ingest, market, policy, provenance, settlement, valuation
from .plans.dialect import Duck, runs
from .sources import briefs, webhooks
from .streaming import convergence, payments, sessions, worker

DEFINITIONS = valuation.DEFINITIONS | policy.DEFINITIONS | market.DEFINITIONS | provenance.DEFINITIONS | funds.DEFINITIONS | settlement.DEFINITIONS | external.DEFINITIONS | ingest.DEFINITIONS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: runs(f) for k, f in DEFINITIONS.items()} | chains.QUERIES | admission.QUERIES | webhooks.STREAMS | payments.STREAMS | sessions.STREAMS | convergence.STREAMS | worker.STREAMS | {"brief_ingest": briefs.brief_ingest}


def oracle_sql() -> dict[str, str]:
    return {k: f(Duck()) for k, f in DEFINITIONS.items()} | {k: f(Duck()) for k, f in (payments.TWINS | sessions.TWINS | convergence.TWINS | worker.TWINS | webhooks.TWINS | admission.SQL | chains.SQL).items()} | {"brief_ingest": briefs.BRIEF_INGEST_SQL}
