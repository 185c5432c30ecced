"""Hash chains, keyed identifiers, receipts, bundles and datasheets."""

from ..plans.dialect import Duck, Spark
from ..plans.fixtures import briefs, consents, contributions, payments, prompts, sales
from . import screening
from .policy import outcome_rows

KEY, PRINTS, NAME = "receipt-signing-key", "prints", "name"


def attestation_chain(e: Duck) -> str:
    """The last link of each conversation's chain, in turn order."""
    payload = f"concat('{{\"record\":', CAST(record_id AS {e.string}), ',\"turn\":', CAST(turn AS {e.string}), '}}')"
    return f"WITH {prompts(e)} SELECT conv_id, count(*) AS links, {e.fold(e.ordered(payload, 'turn'), chr(39) + 'genesis' + chr(39), e.sha('concat(a, x)'))} AS tail FROM prompts GROUP BY conv_id"


def pseudonymous_ids(e: Duck) -> str:
    return f"SELECT c_custkey, concat('pseu_', substr({e.hmac(KEY, 'c_name')}, 1, 24)) AS pseudonym FROM {e.table('customer')}"


def buyer_scoped_ids(e: Duck) -> str:
    return f"SELECT o_orderkey, concat('cv_', substr({e.hmac(KEY, f'concat(CAST(o_custkey % 7 AS {e.string}), {chr(39)}:{chr(39)}, CAST(o_orderkey AS {e.string}))')}, 1, 24)) AS scoped FROM {e.table('orders')}"


def receipts(e: Duck) -> str:
    """What follows outcomes: receipts(conv_id, n, receipt_ref, body), one for each conversation that has kept prompts: canonical JSON, its
    fields nested in fixed order with nulls kept, with the prompts' fingerprints in turn order, who gave them by pseudonym,
    what was authorised and shown, where, and that it may be revoked. The reference is made of the conversation and its prompts."""
    who = f"concat('pseu_', substr({e.hmac(KEY, f'CAST(f.conv_id AS {e.string})')}, 1, 24))"
    told = lambda x: e.json_list(e.each_item(x, "v", e.json_text("v")))
    fixed = lambda x: f"'\"{x}\"'"
    body = e.json_object({
        "receipt_id": e.json_text("ref"), "receipt_version": fixed("1.0"), "pattern": fixed("Kantara consent-receipt / ISO-IEC 27560"), "issued_at": e.json_text("issued"),
        "contributor": e.json_object({"pseudonymous_id": e.json_text(who)}),
        "scope": e.json_object({"content": fixed("prompts-only"), "source_provider": e.json_text("c.provider"), "conversation_fingerprints": told("f.prints")}),
        "purpose": fixed("sale/licence for AI training / RLHF"), "authorisation": e.json_object({"buyer_categories": told("c.categories"), "notify_on_sale": "'true'"}),
        "disclosures": e.json_object({"version": e.json_text("c.version"), "shown": told("c.shown")}), "jurisdiction": e.json_text("c.jurisdiction"),
        "revocation": e.json_object({"revocable_while_unsold": "'true'", "revoked_at": "'null'"}),
    })
    ref = f"concat('rcpt_', substr({e.sha(f'concat(CAST(conv_id AS {e.string}), {chr(39)}:{chr(39)}, {e.join(PRINTS, chr(44))})')}, 1, 24))"
    return f"""fingerprints AS (SELECT o.conv_id, count(*) AS n, {e.ordered(e.sha("o.final_text"), "o.turn")} AS prints, concat(CAST(CAST(max(d.o_orderdate) AS DATE) AS {e.string}), 'T00:00:00.000Z') AS issued
            FROM outcomes o JOIN {e.table("orders")} d ON d.o_orderkey = o.record_id WHERE o.outcome = 'kept' GROUP BY o.conv_id), referenced AS (SELECT conv_id, n, prints, issued, {ref} AS ref FROM fingerprints), {consents(e)},
        receipts AS (SELECT f.conv_id, f.n, f.ref AS receipt_ref, {body} AS body FROM referenced f LEFT JOIN consents c ON c.conv_id = f.conv_id)"""


def consent_receipts(e: Duck, spans: screening.Detector = screening.spanned) -> str:
    return f"WITH {outcome_rows(e, spans)}, {receipts(e)} SELECT conv_id, n AS prompts, receipt_ref, body, {e.hmac(KEY, 'body')} AS signature FROM receipts"


def receipt_sign_verify(e: Duck) -> str:
    """A signature over the receipt's text, and whether a receipt of which a byte was added still has it."""
    changed = "CASE WHEN conv_id % 5 = 0 THEN concat(body, ' ') ELSE body END"
    return f"WITH {outcome_rows(e)}, {receipts(e)} SELECT conv_id, {e.hmac(KEY, 'body')} AS signature, {e.hmac(KEY, 'body')} = {e.hmac(KEY, changed)} AS valid FROM receipts"


def packaged(e: Duck) -> str:
    """packaged(conv_id, kept, prompts, gaps, captured, language, tags, content): the records that are sold; what a device did not tell
    of a conversation is und and general."""
    turns = f"CAST(turn AS {e.string})"
    meta = f"meta AS (SELECT conv_id, min(lang) AS lang, min(domain) AS domain FROM (SELECT c_custkey AS conv_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'en' END AS lang, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'coding' END AS domain FROM {e.table('customer')}) m GROUP BY conv_id)"
    return f"""{meta}, kept_rows AS (SELECT conv_id, turn, final_text FROM outcomes WHERE outcome = 'kept' AND final_text <> ''),
        packed AS (SELECT conv_id, count(*) AS kept, {e.join(e.ordered("final_text", "turn"), "~")} AS prompts, {e.join(e.ordered(turns, "turn"), ",")} AS turns, max(turn) - min(turn) + 1 - count(*) AS gaps FROM kept_rows GROUP BY conv_id),
        packaged AS (SELECT p.conv_id, p.kept, p.prompts, p.turns, p.gaps, coalesce(m.lang, 'und') AS language, coalesce(m.domain, 'general') AS tag, {e.sha("p.prompts")} AS content FROM packed p LEFT JOIN meta m ON m.conv_id = p.conv_id)"""


def packaged_bundles(e: Duck, spans: screening.Detector = screening.spanned) -> str:
    return f"WITH {outcome_rows(e, spans)}, {packaged(e)} SELECT conv_id, kept, turns, gaps, language, tag, content FROM packaged"


def batch_rows(e: Duck) -> str:
    """What follows outcomes: batch(conv_id, ref, line, language, tag, captured, n): the records of a buyer's batch as canonical JSON: the
    buyer's own reference, language, prompts in order, capture window, receipt, and characteristics."""
    ref = f"concat('cv_', substr({e.hmac(KEY, f'concat({chr(39)}7:{chr(39)}, CAST(p.conv_id AS {e.string}))')}, 1, 24))"
    line = e.json_object({
        "id": e.json_text(f"concat('rec_', substr(p.content, 1, 24))"), "conversation_id": e.json_text("p.ref"), "language": e.json_text("p.language"), "prompts": "p.lines", "source": e.json_object({"captured": e.json_text("p.captured")}),
        "provenance": e.json_object({"consent_receipt_ref": e.json_text("r.receipt_ref")}), "characteristics": e.json_object({"domain_tags": f"concat('[', {e.json_text('p.tag')}, ']')", "turn_type": "'\"conversation\"'", "prompt_count": f"CAST(p.kept AS {e.string})"}),
    })
    return f"""{receipts(e)}, {packaged(e)}, listed AS (SELECT o.conv_id, {e.json_list(e.ordered(e.json_text("o.final_text"), "o.turn"))} AS lines, {e.join(e.set_of(quarter(e, "d.o_orderdate")), "–")} AS captured
            FROM outcomes o JOIN {e.table("orders")} d ON d.o_orderkey = o.record_id WHERE o.outcome = 'kept' AND o.final_text <> '' GROUP BY o.conv_id),
        sold_rows AS (SELECT p.conv_id, p.kept, p.language, p.tag, p.content, l.lines, l.captured, {ref} AS ref FROM packaged p JOIN listed l ON l.conv_id = p.conv_id),
        batch AS (SELECT p.conv_id, p.ref, p.language, p.tag, p.captured, p.kept AS n, {line} AS line FROM sold_rows p LEFT JOIN receipts r ON r.conv_id = p.conv_id)"""


def buyer_records(e: Duck) -> str:
    """What a buyer gets of a record, as a line of JSON and signed: its reference under the buyer's own key, its texts, window and receipt,
    and nothing of the contributor."""
    return f"WITH {outcome_rows(e)}, {batch_rows(e)} SELECT ref AS conversation_ref, line, {e.hmac(KEY, 'line')} AS signature FROM batch"


def datasheet(e: Duck) -> str:
    """The batch's datasheet, one row of canonical JSON: its name, size, windows, and the shares of languages and tags, which are in order of
    name. Shares are rounded half up to two decimals."""
    share = lambda column: f"SELECT {column} AS name, floor(CAST(count(*) AS DOUBLE) / max(total) * 100 + 0.5) / 100 AS share FROM sized GROUP BY {column}"
    shares = lambda rows: f"SELECT concat('{{', {e.join(e.ordered(f'concat({e.json_text(NAME)}, {chr(39)}:{chr(39)}, CAST(share AS {e.string}))', 'name'), ',')}, '}}') AS told FROM {rows}"
    fixed = lambda x: f"'\"{x}\"'"
    body = e.json_object({
        "datasheet_version": fixed("1.0"), "batch_id": e.json_text(f"concat('batch_', s.quarter_, '_', CASE WHEN s.n < 1000 THEN lpad(CAST(s.n AS {e.string}), 4, '0') ELSE CAST(s.n AS {e.string}) END)"),
        "consent": e.json_object({"basis": fixed("per-record consent receipts (Kantara / ISO 27560 pattern)"), "revocable": "'true'"}), "temporal": e.json_object({"capture_window": e.json_text("s.windows")}),
        "composition": e.json_object({"record_count": f"CAST(s.n AS {e.string})", "languages": "l.told", "domain_tags": "t.told"}), "legal": e.json_object({"rights": fixed("contributor-granted per consent receipt")}),
    })
    return f"""WITH {outcome_rows(e)}, {batch_rows(e)}, sized AS (SELECT language, tag, captured, count(*) OVER () AS total FROM batch),
        by_language AS ({share("language")}), by_tag AS ({share("tag")}), l AS ({shares("by_language")}), t AS ({shares("by_tag")}),
        s AS (SELECT count(*) AS n, {e.join(e.set_of("captured"), "–")} AS windows, replace(max({e.item(f"string_split(captured, {chr(39)}–{chr(39)})" if type(e) is Duck else f"split(captured, {chr(39)}–{chr(39)})", "1")}), '-', '') AS quarter_ FROM batch)
        SELECT {body} AS datasheet FROM s, l, t"""


def datasheet_tags(e: Duck) -> str:
    """The share of each tag over the bundles' lists of tags."""
    return f"""WITH {briefs(e)}, {contributions(e)}, t AS (SELECT {e.each("tags")} AS tag FROM bundles), c AS (SELECT tag, count(*) AS n FROM t GROUP BY tag)
        SELECT tag, floor(CAST(n AS DOUBLE) / sum(n) OVER () * 100 + 0.5) / 100 AS share FROM c"""


def batch_ids(e: Duck) -> str:
    """The name of each quarter's batch: four digits for its size, more where it is larger."""
    n = f"CASE WHEN n < 1000 THEN lpad(CAST(n AS {e.string}), 4, '0') ELSE CAST(n AS {e.string}) END"
    return f"SELECT concat('batch_', quarter_, '_', {n}) AS batch_id, n FROM (SELECT concat(CAST(year(o_orderdate) AS {e.string}), 'Q', CAST(quarter(o_orderdate) AS {e.string})) AS quarter_, count(*) AS n FROM {e.table('orders')} GROUP BY 1) q"


def attestation_rows(e: Duck) -> str:
    """What follows outcomes: attested, metadata only: counts by kind, kinds of quasi-identifiers before and after, whom the record
    speaks of, what was done and why. Records that a gate stopped have no counts: theirs is made before these."""
    kind = screening.acts(e)[1]
    did = ", ".join(f"max(CASE WHEN {c} THEN '{a}' END) AS {n}" for n, a, c in (("redacts", "REDACT", "c.new LIKE '[%'"), ("generalises", "GENERALISE", "c.new IS NOT NULL AND c.new NOT LIKE '[%'")))
    return f"""acts_said AS (SELECT s.record_id, {e.each("s.spans")} AS o FROM screened s WHERE s.reason = 'none' AND {e.size("s.spans")} > 0), said AS (SELECT record_id, o.k % {screening.RULES} AS rule, o.b AS bucket FROM acts_said),
        by_kind AS (SELECT record_id, {kind} AS kind, count(*) AS n FROM said GROUP BY record_id, {kind}),
        redacted AS (SELECT record_id, {e.join(e.ordered(f"concat(kind, ':', CAST(n AS {e.string}))", "kind"), ",")} AS identifiers FROM by_kind WHERE kind IN ({", ".join(repr(k) for k in screening.IDENTIFIERS)}) GROUP BY record_id),
        fired AS (SELECT record_id, {e.join(e.set_of("bucket"), ",")} AS buckets FROM said WHERE bucket IN ('self', 'third_party') GROUP BY record_id),
        done AS (SELECT record_id, {did} FROM changes c GROUP BY record_id),
        kinds_of AS (SELECT record_id, count(*) AS before_, CAST(sum(CASE WHEN suppressed THEN 0 ELSE 1 END) AS BIGINT) AS after_ FROM quasi_kinds GROUP BY record_id),
        attested AS (SELECT o.conv_id, o.turn, o.record_id, o.outcome, coalesce(r.identifiers, '') AS identifiers, coalesce(k.before_, 0) AS qi_before, coalesce(k.after_, 0) AS qi_after, coalesce(f.buckets, '') AS buckets,
            concat_ws(',', d.redacts, d.generalises, CASE WHEN k.before_ > k.after_ OR o.touched THEN 'SUPPRESS' END, CASE WHEN o.outcome LIKE 'EXC%' THEN 'EXCLUDE' END) AS actions,
            concat_ws(',', CASE WHEN s.minor THEN 'FLAG_ACCOUNT_REVIEW_MINOR' END, CASE WHEN s.recovered THEN 'FICTION_RECOVERED' END, CASE WHEN o.outcome = 'EXC_ATTRIBUTION_AMBIGUOUS' THEN 'ATTR_AMBIGUOUS' END,
                CASE WHEN k.before_ > k.after_ OR o.touched THEN 'SUPPRESS_SINGLING_OUT' END, CASE WHEN o.outcome <> 'kept' THEN o.outcome END) AS codes
            FROM outcomes o JOIN screened s ON s.record_id = o.record_id LEFT JOIN redacted r ON r.record_id = o.record_id LEFT JOIN fired f ON f.record_id = o.record_id LEFT JOIN done d ON d.record_id = o.record_id LEFT JOIN kinds_of k ON k.record_id = o.record_id)"""


def attestations(e: Duck) -> str:
    return f"WITH {outcome_rows(e)}, {attestation_rows(e)} SELECT record_id, outcome, identifiers, qi_before, qi_after, buckets, actions, codes FROM attested"


def reason_codes(e: Duck) -> str:
    one = e.each("split(codes, ',')" if type(e) is Spark else "string_split(codes, ',')")
    return f"SELECT code, count(*) AS n FROM (WITH {outcome_rows(e)}, {attestation_rows(e)} SELECT {one} AS code FROM attested WHERE codes <> '') c GROUP BY code"


def edit_log(e: Duck) -> str:
    """What was done where, without any text: every edit of a record's own, by offset."""
    return f"""WITH {e.steps(screening.marked(e))} SELECT record_id, begins AS span_start, ends AS span_end, CASE WHEN late = 1 THEN 'SUPPRESS' WHEN new LIKE '[%' THEN 'REDACT' ELSE 'GENERALISE' END AS action FROM changes WHERE new IS NOT NULL"""


def datasheet_distribution(e: Duck) -> str:
    return f"SELECT lang, floor(CAST(n AS DOUBLE) / total * 100 + 0.5) / 100 AS share FROM (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM {e.table('documents')} GROUP BY lang) s"


def quarter(e: Duck, x: str) -> str:
    return f"concat(CAST(year({x}) AS {e.string}), '-Q', CAST(quarter({x}) AS {e.string}))"


def capture_windows(e: Duck) -> str:
    distinct = "array_sort(collect_set(w))" if type(e) is Spark else "list(DISTINCT w ORDER BY w)"
    return f"WITH {prompts(e)}, q AS (SELECT conv_id, {quarter(e, 'captured')} AS w FROM prompts) SELECT conv_id, {e.join(distinct, '–')} AS windows FROM q GROUP BY conv_id"


def latest_bundle(e: Duck) -> str:
    return f"SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS k FROM {e.table('documents')}) r WHERE k = 1"


def first_seen_fingerprint(e: Duck) -> str:
    return f"SELECT source, {e.sha('text')} AS exact, min(doc_id) AS first_seen, count(*) AS seen FROM {e.table('documents')} GROUP BY source, {e.sha('text')}"


def revocation_status(e: Duck) -> str:
    """What a withdrawal does: a record that is sold stays sold, any other is revoked; what nobody withdrew stays as it is."""
    return f"""WITH {payments(e)}, {sales(e)} SELECT record_ref, status AS was, CASE WHEN status = 'sold' THEN 'sold' WHEN withdrawn AND has_receipt THEN 'revoked' ELSE status END AS status FROM records"""


DEFINITIONS = {f.__name__: f for f in (attestation_chain, pseudonymous_ids, buyer_scoped_ids, consent_receipts, receipt_sign_verify, packaged_bundles, buyer_records, datasheet, datasheet_tags, batch_ids, attestations, reason_codes, edit_log, datasheet_distribution, capture_windows, latest_bundle, first_seen_fingerprint, revocation_status)}
