"""Requests and their bounds, references, durations and names."""

from __future__ import annotations

from ..plans.dialect import Duck
from ..plans.fixtures import prompts

#: Records of a request, characters of a prompt.
REQUEST, LONGEST = 500, 20_000
#: Ranges in which conversations are numbered.
RANGES = 256


def request_bounds(e: Duck) -> str:
    """A conversation's upload as a request: 1 to 500 records, each of 1 to 20,000 characters and of its own number; and what its consent
    block must say. The first rule that it breaks."""
    return f"""WITH r AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS turns, max(length(text)) AS longest, min(length(coalesce(text, ''))) AS shortest, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS asked FROM {e.table("conversations")} GROUP BY conv_id),
        c AS (SELECT c_custkey AS conv_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS consent FROM {e.table("customer")})
        SELECT r.conv_id, r.n, CASE WHEN r.n > {REQUEST} THEN 'records' WHEN r.turns < r.n THEN 'turn' WHEN r.shortest = 0 OR r.longest > {LONGEST} THEN 'text' WHEN r.asked = 0 THEN 'prompts' WHEN c.consent IS NULL THEN 'consent' ELSE 'valid' END AS verdict FROM r LEFT JOIN c ON c.conv_id = r.conv_id"""


def references(e: Duck) -> str:
    """References of 24 hexadecimal digits behind what they refer to; of the key, where the service draws them."""
    ref = lambda prefix, key: f"concat('{prefix}_', substr({e.sha(f'concat({chr(39)}{prefix}{chr(39)}, CAST({key} AS {e.string}))')}, 1, 24))"
    return f"SELECT o_orderkey, {ref('brf', 'o_orderkey')} AS brief_ref, {ref('rec', 'o_orderkey')} AS record_ref, {ref('buy', 'o_custkey')} AS buyer_ref FROM {e.table('orders')}"


def durations(e: Duck) -> str:
    """Seconds of durations as 15m or 7d; null for what is none."""
    told = f"concat(CAST(n_nationkey AS {e.string}), CASE n_regionkey WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'h' WHEN 3 THEN 'd' ELSE ' weeks' END)"
    number, unit = e.first("told", r"\A(\d+)[smhd]\z", 1), e.first("told", r"\A\d+([smhd])\z", 1)
    return f"""WITH t AS (SELECT n_nationkey, {told} AS told FROM {e.table("nation")}), p AS (SELECT n_nationkey, told, {number} AS number_, {unit} AS unit FROM t)
        SELECT n_nationkey, told, CASE WHEN unit <> '' THEN CAST(number_ AS BIGINT) * CASE unit WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END AS seconds FROM p"""


def names(e: Duck) -> str:
    """Addresses trimmed and in lower case, names trimmed and null where nothing is left; the first of equal addresses has it."""
    raw = "concat(CASE WHEN c_nationkey < 5 THEN '  ' ELSE '' END, c_name, '@Mail.Example ')"
    return f"""WITH c AS (SELECT c_custkey, lower(trim({raw})) AS email, nullif(trim(CASE WHEN c_acctbal < 0 THEN '   ' ELSE concat(' ', c_name) END), '') AS name FROM {e.table("customer")})
        SELECT email, min(c_custkey) AS c_custkey, min(name) AS name FROM c GROUP BY email"""


def first_turns(e: Duck) -> str:
    """Conversations in the order in which their first records came, with how many records each has.

    On Spark no task gets all of them: 255 quantiles of the first records part them into ranges, places count within a range, and
    a range's offset is the sum of those before it, over as many rows as there are ranges."""
    firsts = f"{prompts(e)}, firsts AS (SELECT conv_id, min(record_id) AS first_record, count(*) AS records FROM prompts GROUP BY conv_id)"
    if type(e) is Duck:
        return f"WITH {firsts} SELECT conv_id, first_record, records, rank() OVER (ORDER BY first_record) AS place FROM firsts"
    shares = ", ".join(f"{k / RANGES}D" for k in range(1, RANGES))
    return f"""WITH {e.steps([(["firsts"], firsts)])}, cuts AS (SELECT percentile_approx(first_record, array({shares})) AS cuts FROM firsts),
        parted AS (SELECT conv_id, first_record, records, size(filter(cuts, c -> c < first_record)) AS part FROM (SELECT *, (SELECT cuts FROM cuts) AS cuts FROM firsts) f),
        offsets AS (SELECT part, sum(n) OVER (ORDER BY part) - n AS before FROM (SELECT part, count(*) AS n FROM parted GROUP BY part) sizes)
        SELECT p.conv_id, p.first_record, p.records, o.before + rank() OVER (PARTITION BY p.part ORDER BY p.first_record) AS place FROM parted p JOIN offsets o ON o.part = p.part"""


DEFINITIONS = {f.__name__: f for f in (request_bounds, references, durations, names, first_turns)}
