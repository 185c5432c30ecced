"""Word counts, length tiers, cents and ranges; ingest checks."""

from ..functions import patterns as P
from ..plans.dialect import Duck


def words(e: Duck, x: str) -> str:
    return e.size(e.where(e.split(x, P.WS + "+"), "x <> ''"))


def tier(n: str) -> str:
    return f"CASE WHEN {n} < 10 THEN 'short' WHEN {n} <= 50 THEN 'medium' ELSE 'long' END"


def word_counts(e: Duck) -> str:
    return f"SELECT conv_id, turn, CAST({words(e, 'text')} AS BIGINT) AS words FROM {e.table('conversations')}"


def prompt_tiers(e: Duck) -> str:
    return f"""WITH w AS ({word_counts(e)} WHERE role = 'user') SELECT conv_id, turn, {tier('words')} AS tier FROM w"""


def conversation_valuation(e: Duck) -> str:
    counts = ", ".join(f"CAST(sum(CASE WHEN tier = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{t}" for t in P.CENTS)
    cents = " + ".join(f"n_{t} * {c}" for t, c in P.CENTS.items())
    return f"WITH t AS ({prompt_tiers(e)}), c AS (SELECT conv_id, {counts} FROM t GROUP BY conv_id) SELECT *, CAST({cents} AS BIGINT) AS cents FROM (SELECT * FROM c) v"


def estimate_range(e: Duck) -> str:
    high = "CAST(sum(cents) AS BIGINT)"
    return f"SELECT {high} AS high_cents, CAST({e.div(f'{high} * {100 - P.ATTRITION}', '100')} AS BIGINT) AS low_cents, 'USD' AS currency FROM ({conversation_valuation(e)}) v"


def ingest_validation(e: Duck) -> str:
    """Each row with the first rule that it breaks; rows that break none are valid."""
    return f"""WITH r AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 9 = 0 THEN substr({e.sha("CAST(o_orderkey AS " + e.string + ")")}, 1, 63) ELSE {e.sha("CAST(o_orderkey AS " + e.string + ")")} END AS exact_hash,
            CASE WHEN o_orderkey % 10 = 0 THEN 'XYZ' ELSE 'CA' END AS country, CASE WHEN o_orderkey % 8 = 0 THEN 'Bad Tag' ELSE 'law_1' END AS tag, o_orderkey % 5000 - 10 AS turn FROM {e.table('orders')})
        SELECT record_id, CASE WHEN NOT {e.matches('exact_hash', P_HEX)} THEN 'exact_hash' WHEN NOT {e.matches('country', P_COUNTRY)} THEN 'country'
            WHEN NOT {e.matches('tag', P_TAG)} THEN 'tag' WHEN turn < 0 THEN 'turn' ELSE 'valid' END AS verdict FROM r"""


P_HEX, P_COUNTRY, P_TAG = r"\A[0-9a-f]{64}\z", r"\A[A-Z]{2}\z", r"\A[a-z0-9_-]+\z"
DEFINITIONS = {f.__name__: f for f in (word_counts, prompt_tiers, conversation_valuation, estimate_range, ingest_validation)}
