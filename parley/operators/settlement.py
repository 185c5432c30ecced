"""Eligibility of sales, what is written to the ledger, and the pages that read it."""

from __future__ import annotations

from ..plans.dialect import Duck
from ..plans.fixtures import payment_events, payments, sales
from .funds import AS_OF, held

#: What a quote may be, in cents; hours in which a step may be tried again; rows a page and a tick; entries of a payment.
LEAST, MOST, RECOVERY, PAGE, TICK, ENTRIES = 50, 99_999_999, 23, 50, 50, 20
READY = "p.status = 'paid' AND p.has_intent AND b.escrow AND b.brief_status = 'live' AND b.expires > {at}"


def base(e: Duck) -> str:
    return f"{payments(e)}, {sales(e)}"


def quote_validity(e: Duck) -> str:
    """A quote is whole cents between the bounds; it is asked for a brief without payment or escrow that is drafted or paused."""
    return f"""WITH {base(e)} SELECT p.payment_id, CAST({e.div("p.funded", "100")} AS BIGINT) AS quote, CASE WHEN {e.div("p.funded", "100")} NOT BETWEEN {LEAST} AND {MOST} THEN 'invalid quote' WHEN b.escrow THEN 'already funded'
        WHEN b.brief_status NOT IN ('draft', 'paused') THEN 'brief is not open to quotes' WHEN b.expires <= {AS_OF} THEN 'brief has expired' ELSE 'ok' END AS verdict FROM payments p JOIN brief_of b ON b.payment_id = p.payment_id"""


def checkout_eligibility(e: Duck) -> str:
    """Who may pay: the brief's own buyer, in US dollars, a pending payment that is quoted, before the brief expires."""
    return f"""WITH {base(e)} SELECT p.payment_id, CASE WHEN p.buyer_id <> b.buyer_id THEN 'not the owner' WHEN p.status <> 'pending' THEN 'not pending' WHEN b.currency <> 'usd' THEN 'currency' WHEN p.funded < {LEAST} THEN 'not quoted'
        WHEN b.escrow OR b.brief_status NOT IN ('draft', 'paused') THEN 'brief is not open' WHEN b.expires <= {AS_OF} THEN 'brief has expired' ELSE 'ok' END AS verdict FROM payments p JOIN brief_of b ON b.payment_id = p.payment_id"""


def reserve_eligibility(e: Duck) -> str:
    """Why a quality result's record may not be reserved now, the first reason in the order that they are asked; existing reservations
    come back as they are, and a record is sold once: no other live allocation of it."""
    return f"""WITH {base(e)}, held AS (SELECT c.qa_id, c.record_ref FROM allocations a JOIN checks c ON c.qa_id = a.allocation_id WHERE a.status NOT IN ('cancelled', 'reversed')),
        active AS (SELECT record_ref, min(qa_id) AS by_qa FROM held GROUP BY record_ref)
        SELECT c.qa_id, CASE WHEN c.status <> 'passed' OR coalesce(c.cents, 0) < 1 THEN 'no current pass with a valuation' WHEN p.payment_id IS NULL THEN 'no funding' WHEN NOT ({READY.format(at=AS_OF)}) THEN 'brief must be live, funded and unexpired'
            WHEN h.qa_id IS NOT NULL THEN 'exists' WHEN t.by_qa IS NOT NULL THEN 'allocated to another brief'
            WHEN r.record_ref IS NULL OR r.user_id <> c.user_id OR r.status <> 'available' OR r.chain_hash <> c.chain_hash OR NOT r.has_receipt OR r.withdrawn THEN 'unavailable or consent withdrawn' ELSE 'ok' END AS verdict
        FROM checks c LEFT JOIN payments p ON p.payment_id = c.payment_id LEFT JOIN brief_of b ON b.payment_id = c.payment_id LEFT JOIN held h ON h.qa_id = c.qa_id LEFT JOIN active t ON t.record_ref = c.record_ref LEFT JOIN records r ON r.record_ref = c.record_ref"""


def release_eligibility(e: Duck) -> str:
    """Why a reserved amount may not be released: the charge, the contributor's account, the brief, then whatever changed since."""
    return f"""WITH {base(e)}, charge AS (SELECT payment_id, max(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) AS refunded FROM refunds GROUP BY payment_id)
        SELECT a.allocation_id, CASE WHEN a.status = 'transferred' THEN 'transferred' WHEN coalesce(x.refunded, 0) = 1 OR p.status = 'disputed' THEN 'refunded or disputed' WHEN NOT coalesce(u.connected, false) THEN 'no payout account'
            WHEN NOT (u.transfers_active AND u.payouts) THEN 'onboarding is incomplete' WHEN a.status = 'transferring' THEN 'transferring' WHEN a.status <> 'reserved' OR NOT ({READY.format(at=AS_OF)}) THEN 'not eligible'
            WHEN c.status <> 'passed' OR coalesce(c.cents, -1) <> a.cents OR r.chain_hash <> c.chain_hash OR r.status <> 'available' OR NOT r.has_receipt OR r.withdrawn THEN 'quality or consent changed' ELSE 'ok' END AS verdict
        FROM allocations a JOIN payments p ON p.payment_id = a.payment_id JOIN brief_of b ON b.payment_id = a.payment_id JOIN checks c ON c.qa_id = a.allocation_id JOIN records r ON r.record_ref = c.record_ref
        LEFT JOIN accounts u ON u.user_id = a.user_id LEFT JOIN charge x ON x.payment_id = a.payment_id"""


def payment_verification(e: Duck) -> str:
    """A provider's report is taken only if payment, session, currency and amount all are what was asked."""
    return f"""WITH {base(e)}, reported AS (SELECT payment_id, CASE WHEN funded % 1000 < 20 THEN payment_id + 1 ELSE payment_id END AS named, CASE WHEN funded % 100 < 3 THEN funded - 1 ELSE funded END AS amount, CASE WHEN funded % 10 = 7 THEN 'eur' ELSE 'usd' END AS currency FROM payments)
        SELECT p.payment_id, CASE WHEN r.named <> p.payment_id THEN 'id' WHEN r.currency <> b.currency THEN 'currency' WHEN r.amount <> p.funded THEN 'amount' ELSE 'verified' END AS verdict
        FROM payments p JOIN reported r ON r.payment_id = p.payment_id JOIN brief_of b ON b.payment_id = p.payment_id"""


#: Kinds of entries of an allocation: what their keys begin with, in which order they are written, and of which states they are; null is any.
WRITES = {"reserved": ("reserve:", 2, None), "funded": ("funding:", 3, None), "reservation_cancelled": ("cancel:", 4, ("cancelled",)), "transferred": ("transfer:", 5, ("transferred", "reversing", "reversed")), "transfer_reversed": ("reverse:", 6, ("reversed",))}


def ledger_entries(e: Duck, of: str = "") -> str:
    """The ledger, once by event key: whatever is written again under a key that is there counts for nothing. With `of`, a relation with
    payment_id, only those payments' entries. Allocations and refunds are read once, whatever a row of them
    writes; payments twice, for their own entries and for their allocations'."""
    only = f" WHERE payment_id IN (SELECT payment_id FROM {of})" if of else ""
    kinds = e.those(e.items([f"CASE WHEN {'true' if states is None else f'a.status IN {e.any_of(list(states))}'} THEN '{k}' END" for k, (_, _, states) in WRITES.items()]), "k", "k IS NOT NULL")
    by_kind = lambda f: "CASE kind " + " ".join(f"WHEN '{k}' THEN {f(v)}" for k, v in WRITES.items()) + " END"
    key = lambda prefix, x: f"concat({prefix}, CAST({x} AS {e.string}))"
    refunded = e.each(e.those(e.items(["'refund_requested'", "CASE WHEN status = 'succeeded' THEN 'refunded' END"]), "k", "k IS NOT NULL"))
    written = f"""SELECT {key("'funding:'", "payment_id")} AS event_key, 'funded' AS kind, payment_id, funded AS cents, 1 AS step FROM own_payments WHERE status = 'paid' AND has_intent
        UNION ALL SELECT {key(by_kind(lambda v: f"'{v[0]}'"), "CASE kind WHEN 'funded' THEN payment_id ELSE allocation_id END")}, kind, payment_id, CASE kind WHEN 'funded' THEN funded ELSE cents END, {by_kind(lambda v: v[1])} FROM of_allocations WHERE kind <> 'funded' OR funded IS NOT NULL
        UNION ALL SELECT {key("CASE kind WHEN 'refunded' THEN 'refund:' ELSE 'refund-request:' END", "payment_id")}, kind, payment_id, cents, CASE kind WHEN 'refunded' THEN 8 ELSE 7 END FROM of_refunds"""
    return f"""own_payments AS (SELECT payment_id, funded, status, has_intent FROM payments{only}), own_allocations AS (SELECT allocation_id, payment_id, cents, status FROM allocations{only}),
        of_allocations AS (SELECT a.allocation_id, a.payment_id, a.cents, p.funded, {e.each(kinds)} AS kind FROM own_allocations a LEFT JOIN own_payments p ON p.payment_id = a.payment_id),
        of_refunds AS (SELECT payment_id, cents, {refunded} AS kind FROM refunds{only}),
        written AS ({written}), ledger AS (SELECT event_key, min(kind) AS kind, min(payment_id) AS payment_id, min(cents) AS cents, min(step) AS step FROM written GROUP BY event_key)"""


def ledger_once(e: Duck) -> str:
    return f"WITH {base(e)}, {ledger_entries(e)} SELECT kind, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM ledger GROUP BY kind"


def ledger_top20_of_payment(e: Duck) -> str:
    return f"""WITH {base(e)}, {ledger_entries(e)} SELECT payment_id, event_key, kind, cents FROM (SELECT payment_id, event_key, kind, cents, row_number() OVER (PARTITION BY payment_id ORDER BY step DESC, event_key) AS k FROM ledger) t WHERE k <= {ENTRIES}"""


def funding_dashboard(e: Duck) -> str:
    """The newest hundred payments with their buyers, balances, allocations (newest first) and last twenty entries: nothing is funded without
    an intent, the refund is the larger of ours and what the provider reports, and nothing is available once money went back or is
    disputed. The hundred are picked first; allocations, refunds and entries are only theirs."""
    ranked = "SELECT payment_id, event_key, kind, cents, row_number() OVER (PARTITION BY payment_id ORDER BY step DESC, event_key) AS k FROM ledger"
    told = lambda name, cents: f"concat({name}, ':', CAST({cents} AS {e.string}))"
    return f"""WITH {base(e)}, newest AS (SELECT payment_id, buyer_id, status, has_intent, funded, created FROM payments ORDER BY created DESC, payment_id DESC LIMIT 100),
        theirs AS (SELECT payment_id, allocation_id, status, cents, row_number() OVER (PARTITION BY payment_id ORDER BY created DESC, allocation_id) AS k FROM allocations WHERE payment_id IN (SELECT payment_id FROM newest)),
        a AS (SELECT payment_id, {held('reserved', 'transferring', 'review')} AS reserved, {held('transferred', 'reversing')} AS transferred, {e.join(e.ordered(told("status", "cents"), "k"), ",")} AS allocations FROM theirs GROUP BY payment_id),
        r AS (SELECT payment_id, {held('succeeded')} AS refunded, {held('pending', 'review')} AS refund_pending, max(CASE WHEN status IN ('succeeded', 'review') THEN cents END) AS reported FROM refunds WHERE payment_id IN (SELECT payment_id FROM newest) GROUP BY payment_id),
        {ledger_entries(e, "newest")}, last_entries AS (SELECT payment_id, {e.join(e.ordered(told("kind", "cents"), "k"), ",")} AS entries FROM ({ranked}) t WHERE k <= {ENTRIES} GROUP BY payment_id),
        b AS (SELECT n.payment_id, n.buyer_id, n.status, n.created, CASE WHEN n.has_intent THEN n.funded ELSE 0 END AS funded, coalesce(a.reserved, 0) AS reserved, coalesce(a.transferred, 0) AS transferred, coalesce(a.allocations, '') AS allocations,
            coalesce(r.refunded, 0) AS refunded, coalesce(r.refund_pending, 0) AS refund_pending, coalesce(r.reported, 0) AS reported FROM newest n LEFT JOIN a ON a.payment_id = n.payment_id LEFT JOIN r ON r.payment_id = n.payment_id)
        SELECT b.payment_id, c.c_name AS buyer, b.status, o.brief_status, o.expires, b.funded, b.reserved, b.transferred, greatest(b.refunded, b.reported) AS refunded,
            CASE WHEN b.status IN ('refunded', 'disputed') THEN 0 ELSE b.funded - b.reserved - b.transferred - b.refunded - b.refund_pending END AS available, b.allocations, coalesce(l.entries, '') AS entries
        FROM b JOIN brief_of o ON o.payment_id = b.payment_id JOIN {e.table("customer")} c ON c.c_custkey = b.buyer_id LEFT JOIN last_entries l ON l.payment_id = b.payment_id"""


def visible_payments(e: Duck) -> str:
    """Rows by role: each payment as an administrator, its buyer and each contributor that it pays may see it. The first two see what was
    funded, a contributor only its own share; nobody else has a row."""
    who = lambda x: f"CAST({x} AS {e.string})"
    return f"""WITH {base(e)} SELECT 'admin' AS role, 'all' AS who, payment_id, funded AS cents FROM payments UNION ALL SELECT 'buyer', {who("buyer_id")}, payment_id, funded FROM payments
        UNION ALL SELECT 'user', {who("user_id")}, payment_id, CAST(sum(cents) AS BIGINT) FROM allocations GROUP BY payment_id, user_id"""


def newest_hundred(e: Duck) -> str:
    return f"WITH {base(e)} SELECT record_ref, user_id, status FROM records ORDER BY created DESC, record_ref DESC LIMIT 100"


def submissions_page(e: Duck) -> str:
    """A contributor's second page of records, newest first, each with its state, and whether there are more pages: 51 rows tell.
    A quality result counts only while it is of the record as it now is; the newest allocation that is not cancelled decides."""
    ready = f"c.cents >= 1 AND {READY.format(at=AS_OF)}"
    return f"""WITH {base(e)}, mine AS (SELECT record_ref, user_id, status, chain_hash, created FROM records WHERE user_id = 1), page AS (SELECT record_ref, status, chain_hash, created FROM mine ORDER BY created DESC, record_ref DESC LIMIT {PAGE + 1} OFFSET {PAGE}),
        visible AS (SELECT record_ref, status, chain_hash, created, row_number() OVER (ORDER BY created DESC, record_ref DESC) AS k, count(*) OVER () > {PAGE} AS has_more FROM page),
        own AS (SELECT c.record_ref, a.status, row_number() OVER (PARTITION BY c.record_ref ORDER BY CASE WHEN a.status = 'cancelled' THEN 1 ELSE 0 END, a.created DESC, a.allocation_id) AS k FROM visible v JOIN checks c ON c.record_ref = v.record_ref JOIN allocations a ON a.allocation_id = c.qa_id),
        told AS (SELECT v.record_ref, max(CASE WHEN c.status = 'passed' THEN 1 ELSE 0 END) AS passed, max(CASE WHEN c.status = 'passed' AND a.allocation_id IS NULL AND {ready} THEN 1 ELSE 0 END) AS ready
            FROM visible v JOIN checks c ON c.record_ref = v.record_ref AND c.chain_hash = v.chain_hash LEFT JOIN allocations a ON a.allocation_id = c.qa_id LEFT JOIN payments p ON p.payment_id = c.payment_id LEFT JOIN brief_of b ON b.payment_id = c.payment_id GROUP BY v.record_ref)
        SELECT v.record_ref, v.has_more, CASE WHEN v.status = 'revoked' THEN 'withdrawn' WHEN o.status IS NOT NULL THEN o.status WHEN t.ready = 1 THEN 'awaiting_acceptance' WHEN t.passed = 1 THEN 'awaiting_eligible_brief' WHEN t.record_ref IS NOT NULL THEN 'quality_not_passed' ELSE 'awaiting_matching' END AS state
        FROM visible v LEFT JOIN own o ON o.record_ref = v.record_ref AND o.k = 1 LEFT JOIN told t ON t.record_ref = v.record_ref WHERE v.k <= {PAGE}"""


def cursor_tick(e: Duck) -> str:
    """What the worker takes in one tick: fifty payments behind the cursor, and from the start again where the end leaves room."""
    return f"""WITH {base(e)}, behind AS (SELECT payment_id, 0 AS round_ FROM payments WHERE payment_id > (SELECT max(payment_id) - 20 FROM payments) ORDER BY payment_id LIMIT {TICK}),
        start AS (SELECT payment_id, 1 AS round_ FROM payments ORDER BY payment_id LIMIT {TICK}), taken AS (SELECT * FROM behind UNION ALL SELECT s.payment_id, s.round_ FROM start s WHERE NOT EXISTS (SELECT 1 FROM behind b WHERE b.payment_id = s.payment_id))
        SELECT payment_id, k FROM (SELECT payment_id, row_number() OVER (ORDER BY round_, payment_id) AS k FROM taken) t WHERE k <= {TICK}"""


def settlement_pairs(e: Duck) -> str:
    """Records that are both matched and packaged, whichever came first: quality is asked once both are there."""
    return f"""WITH {base(e)}, matched AS (SELECT record_ref, min(checked) AS checked FROM checks GROUP BY record_ref)
        SELECT r.record_ref, CASE WHEN m.checked > r.created THEN 'package, then match' ELSE 'match, then package' END AS came, greatest(m.checked, r.created) AS asked_at FROM records r JOIN matched m ON m.record_ref = r.record_ref"""


def recovery_window(e: Duck) -> str:
    """Transfers in doubt: those of the last hours may be tried again, older ones are reconciled by hand."""
    return f"""WITH {base(e)} SELECT allocation_id, CASE WHEN {e.hours_after("created", RECOVERY)} < TIMESTAMP '1998-06-01 12:00:00' THEN 'reconcile' ELSE 'retry' END AS action FROM allocations WHERE status = 'transferring'"""


def session_retries(e: Duck) -> str:
    """A payment's sessions: each failure while it is pending starts another; a failure of an earlier session changes nothing. The
    session that an event is of is its payment's number of failures at the time it was made, two events before it came."""
    return f"""WITH {payment_events(e)}, once AS (SELECT event_id, min(arrival) AS arrival FROM payment_events GROUP BY event_id), kept AS (SELECT p.payment_id, p.kind, p.arrival FROM payment_events p JOIN once o ON o.event_id = p.event_id AND o.arrival = p.arrival),
        paid AS (SELECT payment_id, min(arrival) AS paid_at FROM kept WHERE kind IN ('paid', 'refunded', 'disputed') GROUP BY payment_id),
        fails AS (SELECT k.payment_id, k.arrival, row_number() OVER (PARTITION BY k.payment_id ORDER BY k.arrival) AS n, lag(k.arrival) OVER (PARTITION BY k.payment_id ORDER BY k.arrival) AS was FROM kept k LEFT JOIN paid p ON p.payment_id = k.payment_id WHERE k.kind = 'failed' AND (p.paid_at IS NULL OR k.arrival < p.paid_at))
        SELECT payment_id, count(*) AS failures, CAST(sum(CASE WHEN was IS NULL OR arrival - was > 2 THEN 1 ELSE 0 END) AS BIGINT) AS attempts FROM fails GROUP BY payment_id"""


def candidates_named(e: Duck) -> str:
    """Passed results that no live allocation holds, by themselves or by their record, with their contributors' names: two anti-joins,
    where one with OR would compare all rows."""
    return f"""WITH {base(e)}, live AS (SELECT a.allocation_id, c.record_ref FROM allocations a JOIN checks c ON c.qa_id = a.allocation_id WHERE a.status NOT IN ('cancelled', 'reversed'))
        SELECT c.qa_id, c.record_ref, coalesce(CASE WHEN u.connected THEN u.name END, 'Contributor') AS contributor, CASE WHEN coalesce(c.cents, 0) < 1 THEN 'No payable valuation' WHEN NOT (p.has_intent AND p.status = 'paid' AND b.escrow) THEN 'Waiting for verified buyer funding'
            WHEN b.expires <= {AS_OF} THEN 'Matched brief has expired' WHEN b.brief_status <> 'live' THEN 'Matched brief is not active' END AS blocked
        FROM checks c JOIN payments p ON p.payment_id = c.payment_id JOIN brief_of b ON b.payment_id = c.payment_id LEFT JOIN accounts u ON u.user_id = c.user_id
        WHERE c.status = 'passed' AND NOT EXISTS (SELECT 1 FROM live l WHERE l.allocation_id = c.qa_id) AND NOT EXISTS (SELECT 1 FROM live l WHERE l.record_ref = c.record_ref)"""


DEFINITIONS = {f.__name__: f for f in (quote_validity, checkout_eligibility, reserve_eligibility, release_eligibility, payment_verification, ledger_once, ledger_top20_of_payment, funding_dashboard)}
DEFINITIONS |= {f.__name__: f for f in (visible_payments, newest_hundred, submissions_page, cursor_tick, settlement_pairs, recovery_window, session_retries, candidates_named)}
