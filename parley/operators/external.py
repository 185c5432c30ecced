"""An external detector's spans, as a table, through the whole cascade: labels, merging with our own rules, gates, texts, receipts."""

from __future__ import annotations

from ..functions import labels as L
from ..functions import patterns as P
from ..plans.dialect import Duck
from ..plans.fixtures import answers, prompts
from . import policy, provenance, screening, texts

#: Our own rules that are asked besides: external detectors tell neither ages nor secrets.
OURS = [i for i, (k, _, _) in enumerate(P.DETECTORS) if k in ("AGE", "SECRET")]


def kind_of(label: str) -> str:
    """The kind of an external label; one that is not listed stays as it is."""
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LABELS.items()) + f" ELSE {label} END"


def group(kind: str) -> str:
    """The group of a kind: what is not listed is unknown, and fails closed."""
    one = {"SECRET": "secret", "PERSON": "person", "ORG": "org", "GPE": "location", "LOC": "location", "FAC": "location", "DATE": "date", "AGE": "age", "NORP": "norp"}
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    return f"CASE WHEN {kind} IN ({listed(L.PLACEHOLDERS)}) THEN 'identifier' " + " ".join(f"WHEN {kind} = '{k}' THEN '{g}'" for k, g in one.items()) + f" WHEN {kind} IN ({listed(L.BENIGN)}) THEN 'benign' ELSE 'unknown' END"


def rule_of(kind: str, score: str) -> str:
    """The rule that a span is handled by: what is too unsure for its action is benign, or weak where it still says something."""
    number = {k: i for i, k in reversed([*enumerate(screening.KINDS)])}
    sure = lambda k, least, else_: f"WHEN {kind} = '{k}' THEN CASE WHEN {score} >= {least} THEN {number[k]} ELSE {else_} END"
    cases = [sure("PERSON", L.SURE["person"], number["WEAK_PERSON"])] + [sure(k, L.SURE["generalise"], number["BENIGN"]) for k in ("GPE", "LOC", "FAC", "DATE")]
    cases += [f"WHEN {kind} = 'NORP' THEN CASE WHEN {score} >= {L.SURE['exclude']} THEN {number['NORP']} WHEN {score} >= {L.SURE['suppress']} THEN {number['WEAK_NORP']} ELSE {number['BENIGN']} END"]
    cases += [f"WHEN {kind} = '{k}' THEN {number[k]}" for k in (*L.PLACEHOLDERS, "SECRET", "AGE", "ORG")]
    return "CASE " + " ".join(cases) + f" WHEN {kind} IN ({', '.join(repr(k) for k in L.BENIGN)}) THEN {number['BENIGN']} ELSE {number['UNKNOWN']} END"


def valid(e: Duck, told: str = "") -> str:
    """valid(record_id, n, kind, begins, ends, score): answers that lie within their text. told says runs and analysed."""
    return f"""{told or answers(e)}, valid AS (SELECT a.record_id, a.n, {kind_of("a.label")} AS kind, a.begins, a.ends, a.score FROM analysed a JOIN prompts t ON t.record_id = a.record_id
        WHERE a.begins >= 0 AND a.begins < a.ends AND a.ends <= length(t.text))"""


def spanned(e: Duck, told: str = "") -> str:
    """spanned, as screening has it, of the external detector's spans and our own ages and secrets.

    Both sets meet in one list for each text: the earlier span holds, of those of one start the longer, of equal ones the
    detector's own, in the order of its answer. Answers are gathered by text once; texts that it failed on carry one
    span that says so, which closes the first gate."""
    matched = {f"m{i}": e.spans("text", P.DETECTORS[i][2]) for i in OURS} | {"sm": e.all("text", P.SENTENCE)}
    cut = {f"g{i}": f"CASE WHEN {e.size(f'm{i}')} > 0 THEN {e.split('text', P.DETECTORS[i][2])} END" for i in OURS} | {"sg": e.split("text", P.SENTENCE)}
    one = screening.key("begins", "ends - begins", "0") + f" + first % {screening.RULES}"
    own = e.those(e.concat_lists([screening.spans_of(e, i) for i in OURS]), "k", "k IS NOT NULL")
    place = e.div("k", str(screening.RULES))
    new = e.those("own", "k", f"coalesce({e.find('taken', place)}, 0) = 0")
    failed = e.items([screening.key("0", "0", screening.KINDS.index("UNANSWERED"))])
    kept = f"CASE WHEN answered THEN {screening.disjoint_keys(e, e.concat_lists(['told', new]))} ELSE {failed} END"
    return f"""{valid(e, told)}, firsts_told AS (SELECT record_id, begins, ends, min(n * {screening.RULES} + {rule_of("kind", "score")}) AS first FROM valid GROUP BY record_id, begins, ends),
        keys_told AS (SELECT record_id, {one} AS k FROM firsts_told), lists_told AS (SELECT record_id, {e.ordered("k", "k")} AS told FROM keys_told GROUP BY record_id),
        spread AS (SELECT {e.spread("record_id")}conv_id, turn, record_id, text FROM prompts),
        known AS (SELECT p.conv_id, p.turn, p.record_id, p.text, r.record_id IS NOT NULL AS answered, coalesce(l.told, {e.none()}) AS told FROM spread p LEFT JOIN runs r ON r.record_id = p.record_id LEFT JOIN lists_told l ON l.record_id = p.record_id),
        matched AS (SELECT conv_id, turn, record_id, text, answered, told, {e.made(matched)} FROM known), cut AS (SELECT conv_id, turn, record_id, text, answered, told, {', '.join(matched)}, {e.made(cut)} FROM matched),
        sides AS (SELECT conv_id, turn, record_id, text, answered, told, {e.made({'own': own, 'whole': screening.sentence_keys(e), 'taken': e.each_item('told', 'k', place)})} FROM cut),
        found AS (SELECT conv_id, turn, record_id, text, whole, {e.made({'kept': kept})} FROM sides),
        spanned AS (SELECT conv_id, turn, record_id, text, kept, {screening.WHOLE.format(any=e.size('whole'), text=e.items([screening.key('0', 'length(text)', 0)]))} AS sents FROM found)"""


NO_ANSWER = "CAST(array() AS ARRAY<STRUCT<n: BIGINT, label: STRING, begins: BIGINT, ends: BIGINT, score: DOUBLE>>)"


def told_texts(e: Duck) -> screening.Groups:
    """On Spark: keyed, the records with their text's number and their answers; texts, the different texts with different answers; screened_texts."""
    one = "named_struct('n', n, 'label', label, 'begins', begins, 'ends', ends, 'score', score)"
    keyed = f"""answer_lists AS (SELECT record_id, array_sort(collect_list({one})) AS answers FROM analysed GROUP BY record_id),
        keyed AS (SELECT p.conv_id, p.turn, p.record_id, p.captured, x.plain_id, r.record_id IS NOT NULL AS answered, coalesce(a.answers, {NO_ANSWER}) AS answers FROM prompts p JOIN plain_texts x ON x.text <=> p.text LEFT JOIN runs r ON r.record_id = p.record_id LEFT JOIN answer_lists a ON a.record_id = p.record_id)"""
    own = "prompts AS (SELECT t.text_id AS conv_id, 0 AS turn, t.text_id AS record_id, x.text FROM texts t JOIN plain_texts x ON x.plain_id = t.plain_id)"
    told = "runs AS (SELECT text_id AS record_id FROM texts WHERE answered), analysed AS (SELECT text_id AS record_id, inline(answers) FROM texts)"
    return [
        (["plain_texts"], f"{prompts(e)}, plain_texts AS ({texts.numbered('plain_id', 'text', 'prompts')})"), (["keyed"], f"{prompts(e)}, {answers(e)}, {keyed}"),
        (["texts"], f"texts AS ({texts.numbered('text_id', 'plain_id, answered, answers', 'keyed')})"), (["screened_texts"], f"{own}, {spanned(e, told)}, {texts.cascade(e)}"),
    ]


def told_records(e: Duck) -> str:
    return "records AS (SELECT k.conv_id, k.turn, k.record_id, k.captured, t.text_id FROM keyed k JOIN texts t ON t.plain_id = k.plain_id AND t.answered = k.answered AND t.answers = k.answers)"


def merged_spans(e: Duck) -> str:
    """What is left of both detectors' spans of each text: those of the detector by the rule that handles them."""
    kind = "CASE rule " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(screening.KINDS)) + " END"
    return f"""WITH {prompts(e)}, {spanned(e)}, s AS (SELECT record_id, {e.each('kept')} AS k FROM spanned), r AS (SELECT record_id, {screening.start(e, 'k')} AS span_start, {screening.start(e, 'k')} + {screening.length(e, 'k')} AS span_end, k % {screening.RULES} AS rule FROM s)
        SELECT record_id, span_start, span_end, {kind} AS kind FROM r"""


def external_spans(e: Duck) -> str:
    """The detector's answers by kind and group, with every age and secret that our own rules find in texts that it answered."""
    own = e.those(e.concat_lists([screening.spans_of(e, i) for i in OURS]), "k", "k IS NOT NULL")
    matched = {f"m{i}": e.all("text", P.DETECTORS[i][2]) for i in OURS} | {f"g{i}": e.split("text", P.DETECTORS[i][2]) for i in OURS}
    ours = "CASE k % {} ".format(screening.RULES) + " ".join(f"WHEN {i} THEN '{P.DETECTORS[i][0]}'" for i in OURS) + " END"
    score = "CASE k % {} ".format(screening.RULES) + " ".join(f"WHEN {i} THEN CAST({P.DETECTORS[i][1]} AS DOUBLE)" for i in OURS) + " END"
    return f"""WITH {prompts(e)}, {valid(e)}, m AS (SELECT p.record_id, p.text, {e.made(matched)} FROM prompts p JOIN runs r ON r.record_id = p.record_id), o AS (SELECT record_id, {e.each(own)} AS k FROM m),
        every AS (SELECT record_id, kind, begins, ends, score FROM valid UNION ALL SELECT record_id, {ours}, {screening.start(e, 'k')}, {screening.start(e, 'k')} + {screening.length(e, 'k')}, {score} FROM o)
        SELECT record_id, kind, {group('kind')} AS grp, begins AS span_start, ends AS span_end, score FROM every"""


def external_actions(e: Duck) -> str:
    """What becomes of spans in records that no gate stopped: the edit, the flag, and whether it tells an employer."""
    if type(e) is not Duck:
        flag = "CASE kind WHEN 'UNKNOWN' THEN 'FLAG_UNKNOWN_ENTITY' WHEN 'GOV_ID' THEN 'FLAG_GOV_ID' WHEN 'ACCOUNT' THEN 'FLAG_FINANCIAL' END"
        return f"""WITH {e.steps(screening.marked(e, spanned))} SELECT r.record_id, o.kind, o.begins AS span_start, o.ends AS span_end, o.new, {flag} AS flag, CASE WHEN o.employs THEN 'employer' END AS quasi FROM records r JOIN edits_of o ON o.text_id = r.text_id WHERE o.name IS NULL
            UNION ALL SELECT record_id, 'PERSON', begins, ends, {texts.PERSON}, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM called"""
    return f"""WITH {e.steps(screening.gated(e, spanned))}, {screening.edits(e)}
        SELECT k.record_id, k.kind, k.begins AS span_start, k.ends AS span_end, d.new, CASE k.kind WHEN 'UNKNOWN' THEN 'FLAG_UNKNOWN_ENTITY' WHEN 'GOV_ID' THEN 'FLAG_GOV_ID' WHEN 'ACCOUNT' THEN 'FLAG_FINANCIAL' END AS flag, CASE WHEN k.employs THEN 'employer' END AS quasi
        FROM kinds k JOIN edits d ON d.record_id = k.record_id AND d.begins = k.begins AND d.ends = k.ends"""


def external_outcomes(e: Duck) -> str:
    """What becomes of each record, after its conversation has been looked at as a whole; a text without an answer is excluded."""
    return f"WITH {policy.outcome_rows(e, spanned)} SELECT conv_id, record_id, outcome, touched FROM outcomes"


def external_final_texts(e: Duck) -> str:
    return f"WITH {policy.outcome_rows(e, spanned)} SELECT conv_id, record_id, final_text, touched FROM outcomes WHERE outcome = 'kept'"


def external_quasi(e: Duck) -> str:
    """Quasi-identifiers of each record, employers among them, and which of more than three kinds go."""
    return f"WITH {e.steps(screening.marked(e, spanned))} SELECT record_id, kind, suppressed FROM quasi_kinds"


def external_receipts(e: Duck) -> str:
    """Receipts of what the external detector's outcomes keep: a text without an answer is in none."""
    return provenance.consent_receipts(e, spanned)


def external_bundles(e: Duck) -> str:
    return provenance.packaged_bundles(e, spanned)


def detector_parity(e: Duck) -> str:
    """Spans that only one of the two detectors has, of the kinds that both know; none means the same sets."""
    kind = "CASE rule " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(screening.KINDS)) + " END"
    both = "('EMAIL', 'PHONE', 'IP', 'GOV_ID', 'URL')"
    return f"""WITH {prompts(e)}, {valid(e)}, ours AS (SELECT record_id, {kind} AS kind, span_start AS begins, span_end AS ends FROM ({screening.span_dedupe(e)}) d), mine AS (SELECT record_id, kind, begins, ends FROM ours WHERE kind IN {both}), theirs AS (SELECT record_id, kind, begins, ends FROM valid WHERE kind IN {both})
        SELECT kind, side, count(*) AS n FROM (SELECT 'ours only' AS side, x.kind FROM (SELECT * FROM mine EXCEPT SELECT * FROM theirs) x UNION ALL SELECT 'theirs only', y.kind FROM (SELECT * FROM theirs EXCEPT SELECT * FROM mine) y) z GROUP BY kind, side"""


def fail_closed(e: Duck) -> str:
    """Records that the detector gave no answer for are excluded, whatever they say; the fixture's detector fails on texts of fewer than
    twelve characters."""
    return f"WITH {prompts(e)}, {answers(e)} SELECT p.record_id, p.conv_id, CASE WHEN r.record_id IS NULL THEN 'EXC_STAGE6_UNAVAILABLE' ELSE 'screened' END AS outcome FROM prompts p LEFT JOIN runs r ON r.record_id = p.record_id"


DEFINITIONS = {f.__name__: f for f in (external_spans, merged_spans, external_actions, external_outcomes, external_final_texts, external_quasi, external_receipts, external_bundles, detector_parity, fail_closed)}
