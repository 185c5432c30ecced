"""Balances, ledgers, candidates, submissions, reconciliation and the payment state machine."""

from ..plans.dialect import Duck, Spark
from ..plans.fixtures import payment_events, payments, sales

AS_OF = "TIMESTAMP '2000-01-01 00:00:00'"
MONEY = "CAST(coalesce(sum(CASE WHEN {c} THEN cents END), 0) AS BIGINT)"


def held(*states: str) -> str:
    return MONEY.format(c="status IN (" + ", ".join(f"'{s}'" for s in states) + ")")


def balance_rows(e: Duck) -> str:
    return f"""a AS (SELECT payment_id, {held('reserved', 'transferring', 'review')} AS reserved, {held('transferred', 'reversing')} AS transferred FROM allocations GROUP BY payment_id),
        r AS (SELECT payment_id, {held('succeeded')} AS refunded, {held('pending', 'review')} AS refund_pending FROM refunds GROUP BY payment_id),
        b AS (SELECT p.payment_id, p.status, CASE WHEN has_intent THEN funded ELSE 0 END AS funded, coalesce(reserved, 0) AS reserved, coalesce(transferred, 0) AS transferred, coalesce(refunded, 0) AS refunded, coalesce(refund_pending, 0) AS refund_pending
            FROM payments p LEFT JOIN a ON a.payment_id = p.payment_id LEFT JOIN r ON r.payment_id = p.payment_id)"""


def fund_balances(e: Duck) -> str:
    return f"WITH {payments(e)}, {balance_rows(e)} SELECT payment_id, funded, reserved, transferred, refunded, refund_pending, CASE WHEN status IN ('refunded', 'disputed') THEN 0 ELSE funded - reserved - transferred - refunded - refund_pending END AS available FROM b"


def ledger_totals(e: Duck) -> str:
    return f"WITH {payments(e)} SELECT status, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM allocations GROUP BY status"


def contributor_totals(e: Duck) -> str:
    return f"WITH {payments(e)} SELECT user_id, {held('transferred')} AS paid, {held('reserved', 'transferring')} AS due, count(CASE WHEN status = 'review' THEN 1 END) AS in_review FROM allocations GROUP BY user_id"


def ledger_top20(e: Duck) -> str:
    return f"WITH {payments(e)} SELECT user_id, allocation_id, k FROM (SELECT user_id, allocation_id, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, allocation_id) AS k FROM allocations) t WHERE k <= 20"


def page_2(e: Duck) -> str:
    return f"WITH {payments(e)} SELECT payment_id, funded FROM payments ORDER BY created DESC, payment_id LIMIT 51 OFFSET 50"


def keyset_page(e: Duck) -> str:
    return f"WITH {payments(e)} SELECT payment_id, funded FROM payments WHERE payment_id > 100 ORDER BY payment_id LIMIT 50"


def settlement_candidates(e: Duck) -> str:
    """Passed results that no live allocation holds, by themselves or by their record: two anti-joins, where one with OR would
    compare all rows. A line is a result; it is passed if it was not returned, and allocations are those of shipped lines."""
    return f"""WITH {payments(e)}, qa AS (SELECT l_orderkey * 10 + l_linenumber AS qa_id, l_partkey * 100000 + l_suppkey AS record_id FROM {e.table('lineitem')} WHERE l_returnflag <> 'R'),
        live AS (SELECT a.allocation_id, a.record_id * 100000 + a.user_id AS record_id FROM allocations a WHERE a.status NOT IN ('cancelled', 'reversed'))
        SELECT qa_id, record_id FROM qa WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.allocation_id = qa.qa_id) AND NOT EXISTS (SELECT 1 FROM live WHERE live.record_id = qa.record_id)"""


def submission_status(e: Duck) -> str:
    """One state per record that a contributor has of a part: of all of its allocations the newest that is not cancelled decides, else the
    newest; where there is none, what all of its checks allow. A check (a line) has an allocation unless it was returned."""
    return f"""WITH {payments(e)}, {sales(e)}, of_check AS (SELECT c.record_ref, c.qa_id, c.status AS verdict, c.cents, a.allocation_id, a.status, a.created FROM checks c
            LEFT JOIN allocations a ON a.allocation_id = c.qa_id AND c.status = 'passed'),
        ranked AS (SELECT record_ref, status, row_number() OVER (PARTITION BY record_ref ORDER BY CASE WHEN status = 'cancelled' THEN 1 ELSE 0 END, created DESC, allocation_id, status) AS k FROM of_check WHERE allocation_id IS NOT NULL),
        told AS (SELECT record_ref, max(CASE WHEN verdict = 'passed' THEN 1 ELSE 0 END) AS passed, max(CASE WHEN verdict = 'passed' AND cents >= 1 THEN 1 ELSE 0 END) AS ready FROM of_check GROUP BY record_ref)
        SELECT r.record_ref, CASE WHEN r.status = 'revoked' THEN 'withdrawn' WHEN k.status IS NOT NULL THEN k.status WHEN t.ready = 1 THEN 'awaiting_acceptance' WHEN t.passed = 1 THEN 'awaiting_eligible_brief'
            WHEN t.record_ref IS NOT NULL THEN 'quality_not_passed' ELSE 'awaiting_matching' END AS status
        FROM records r LEFT JOIN ranked k ON k.record_ref = r.record_ref AND k.k = 1 LEFT JOIN told t ON t.record_ref = r.record_ref"""


def transfer_reconciliation(e: Duck) -> str:
    """Our transfers against the provider's, by allocation: what only it has is completed here, what only we have is missing there, and
    amounts and destinations have to be equal. The provider's rows are a fixture with some of each fault."""
    return f"""WITH {payments(e)}, ours AS (SELECT allocation_id, cents, user_id FROM allocations WHERE status = 'transferred'),
        theirs AS (SELECT allocation_id, CASE WHEN cents % 97 = 0 THEN cents + 1 ELSE cents END AS cents, CASE WHEN cents % 89 = 0 THEN user_id + 1 ELSE user_id END AS destination FROM allocations WHERE status IN ('transferred', 'transferring') AND cents % 53 <> 0)
        SELECT coalesce(o.allocation_id, t.allocation_id) AS allocation_id, CASE WHEN o.allocation_id IS NULL THEN 'to_complete' WHEN t.allocation_id IS NULL THEN 'missing_at_provider' WHEN o.cents <> t.cents THEN 'amount' WHEN o.user_id <> t.destination THEN 'destination' ELSE 'matched' END AS verdict
        FROM ours o FULL OUTER JOIN theirs t ON o.allocation_id = t.allocation_id"""


#: From which states a step leads where; from any other it is refused and the state stays.
STEPS = {"release": ("reserved", "transferring"), "confirm": ("transferring", "transferred"), "doubt": ("transferring", "review"), "reverse": ("transferred", "reversing"), "settle": ("reversing", "reversed"), "cancel": ("reserved", "cancelled")}


def allocation_lifecycle(e: Duck) -> str:
    """Each allocation's state after the steps that its line's flags ask for, one after another: a step that its state does not have is
    refused and changes nothing."""
    step = lambda state, asked: "CASE " + " ".join(f"WHEN {asked} = '{n}' AND {state} = '{a}' THEN '{b}'" for n, (a, b) in STEPS.items()) + f" ELSE {state} END"
    asks = e.items(["CASE returnflag WHEN 'A' THEN 'release' WHEN 'R' THEN 'cancel' ELSE 'release' END", "CASE WHEN quantity > 25 THEN 'confirm' ELSE 'doubt' END", "CASE WHEN linestatus = 'F' THEN 'reverse' ELSE 'cancel' END", "'settle'"])
    refused = lambda i: f"CASE WHEN s{i} = s{i - 1} THEN 1 ELSE 0 END"
    told = "SELECT l_orderkey * 10 + l_linenumber AS allocation_id, l_partkey, l_suppkey, l_returnflag AS returnflag, l_quantity AS quantity, l_linestatus AS linestatus FROM " + e.table("lineitem")
    at = lambda i: e.item("asks", str(i))
    return f"""WITH asked AS (SELECT allocation_id, l_partkey, l_suppkey, {asks} AS asks FROM ({told}) t), one AS (SELECT allocation_id, l_partkey, l_suppkey, asks, 'reserved' AS s0, {step("'reserved'", at(1))} AS s1 FROM asked),
        two AS (SELECT allocation_id, l_partkey, l_suppkey, asks, s0, s1, {step("s1", at(2))} AS s2 FROM one), three AS (SELECT allocation_id, l_partkey, l_suppkey, asks, s0, s1, s2, {step("s2", at(3))} AS s3 FROM two),
        four AS (SELECT allocation_id, l_partkey, l_suppkey, s0, s1, s2, s3, {step("s3", at(4))} AS s4 FROM three)
        SELECT allocation_id, l_partkey, l_suppkey, s4 AS state, CAST({" + ".join(refused(i) for i in range(1, 5))} AS BIGINT) AS refused FROM four"""


def payment_state_batch(e: Duck) -> str:
    """Events count once; a reversal holds whatever comes later; paid and failed only move a pending payment."""
    return f"""WITH {payment_events(e)}, once AS (SELECT event_id, min(arrival) AS arrival FROM payment_events GROUP BY event_id), kept AS (SELECT p.payment_id, p.kind, p.arrival FROM payment_events p JOIN once o ON o.event_id = p.event_id AND o.arrival = p.arrival),
        s AS (SELECT payment_id, max(CASE WHEN kind IN ('refunded', 'disputed') THEN 1 ELSE 0 END) AS reversed, min(CASE WHEN kind = 'paid' THEN arrival END) AS paid_at, min(CASE WHEN kind = 'failed' THEN arrival END) AS failed_at, count(*) AS events FROM kept GROUP BY payment_id)
        SELECT payment_id, events, CASE WHEN reversed = 1 THEN 'reversed' WHEN paid_at IS NOT NULL AND (failed_at IS NULL OR paid_at < failed_at) THEN 'paid' WHEN failed_at IS NOT NULL THEN 'failed' ELSE 'pending' END AS state FROM s"""


def expiry_sweep(e: Duck) -> str:
    """Past its date a payment's reservations are cancelled and what is left is refunded, unless a transfer is uncertain."""
    return f"""WITH {payments(e)}, {balance_rows(e)}, unsure AS (SELECT payment_id, max(CASE WHEN status IN ('transferring', 'review') THEN 1 ELSE 0 END) AS unsure, {held('reserved')} AS freed FROM allocations GROUP BY payment_id)
        SELECT b.payment_id, CASE WHEN coalesce(unsure, 0) = 1 THEN 'held' ELSE 'refund' END AS action, CASE WHEN coalesce(unsure, 0) = 1 THEN 0 ELSE b.funded - b.reserved + coalesce(freed, 0) - b.transferred - b.refunded - b.refund_pending END AS cents
        FROM b JOIN payments p ON p.payment_id = b.payment_id LEFT JOIN unsure u ON u.payment_id = b.payment_id WHERE p.created < {AS_OF} AND b.status = 'paid'"""


def submission_readiness(e: Duck) -> str:
    """Why an allocation's sale would not go through now: the first reason, in the order that they are asked."""
    return f"""WITH {payments(e)}, {sales(e)} SELECT a.allocation_id, CASE WHEN a.cents < 1 THEN 'No payable valuation' WHEN NOT p.has_intent OR p.status <> 'paid' OR NOT b.escrow THEN 'Waiting for verified buyer funding'
        WHEN b.expires <= {AS_OF} THEN 'Matched brief has expired' WHEN b.brief_status <> 'live' THEN 'Matched brief is not active' ELSE 'ready' END AS reason FROM allocations a JOIN payments p ON p.payment_id = a.payment_id JOIN brief_of b ON b.payment_id = a.payment_id"""


def allocation_transitions(e: Duck) -> str:
    """Steps between states of one record, in time, that the life cycle does not have."""
    return f"""WITH {payments(e)}, steps AS (SELECT record_id, lag(status) OVER (PARTITION BY record_id ORDER BY created, allocation_id) AS was, status FROM allocations)
        SELECT was, status, count(*) AS n, (was, status) IN (('reserved', 'transferring'), ('reserved', 'cancelled'), ('transferring', 'transferred'), ('transferring', 'review'), ('transferred', 'reversing'), ('reversing', 'reversed')) AS allowed FROM steps WHERE was IS NOT NULL GROUP BY was, status"""


DEFINITIONS = {f.__name__: f for f in (fund_balances, ledger_totals, contributor_totals, ledger_top20, page_2, keyset_page, settlement_candidates, submission_status, transfer_reconciliation, payment_state_batch, expiry_sweep, submission_readiness, allocation_transitions, allocation_lifecycle)}
