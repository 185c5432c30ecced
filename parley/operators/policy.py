"""Detection, sentences, attribution, redaction, ceilings, pseudonyms and quasi-identifiers."""

from functools import partial

from ..functions import patterns as P
from ..plans.dialect import Duck, Spark
from ..plans.fixtures import prompts
from . import screening, texts

KINDS = tuple(dict.fromkeys(k for k, _, _ in P.DETECTORS))
ON_DOCUMENTS = ("EMAIL", "PHONE", "ACCOUNT", "IP")
FULL_NAME = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"


def rules(kind: str) -> list[str]:
    return [p for k, _, p in P.DETECTORS if k == kind]


def hits(e: Duck, kind: str, x: str = "text") -> str:
    return " + ".join(e.size(e.spans(x, p)) for p in rules(kind))


def detect(e: Duck, kind: str) -> str:
    """Rows with spans of a kind: how many, and the first rule's values."""
    base, key, first = (f"(SELECT doc_id AS id, text FROM {e.table('documents')})", "id", "") if kind in ON_DOCUMENTS else ("prompts", "record_id", f"WITH {prompts(e)} ")
    return f"{first}SELECT {key}, CAST({hits(e, kind)} AS BIGINT) AS n, {e.join(e.all('text', rules(kind)[0]), '|')} AS found FROM {base} d WHERE {hits(e, kind)} > 0"


def span_offsets(e: Duck) -> str:
    """Where each e-mail starts: the lengths of the gaps and matches before it, since matching tells none."""
    p = rules("EMAIL")[0]
    cut = f"SELECT doc_id, {e.split('text', p)} AS gaps, {e.all('text', p)} AS found FROM {e.table('documents')}"
    lens = (lambda a, n: f"aggregate(transform(slice({a}, 1, {n}), x -> length(x)), 0, (s, x) -> s + x)") if type(e) is Spark else (lambda a, n: f"coalesce(list_sum(list_transform(list_slice({a}, 1, {n}), lambda x: length(x))), 0)")
    at = f"SELECT doc_id, gaps, found, {'explode(sequence(1, size(found)))' if type(e) is Spark else 'unnest(range(1, len(found) + 1))'} AS i FROM ({cut}) c WHERE {e.size('found')} > 0"
    item = "element_at(found, CAST(i AS INT))" if type(e) is Spark else "found[i]"
    n = "CAST(i AS INT)"
    return f"SELECT doc_id, CAST({lens('gaps', n)} + {lens('found', n + ' - 1')} AS BIGINT) AS span_start, {item} AS value FROM ({at}) s"


def identifier_counts(e: Duck) -> str:
    """Spans of each kind over all documents, and the documents with any: one scan, a column a kind, then a row a kind."""
    counts = ", ".join(f"{hits(e, k)} AS n_{k}" for k in KINDS)
    sums = ", ".join(f"CAST(sum(n_{k}) AS BIGINT) AS s_{k}, CAST(sum(CASE WHEN n_{k} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS t_{k}" for k in KINDS)
    each = e.each(e.items([e.struct({"kind": f"'{k}'", "spans": f"s_{k}", "texts": f"t_{k}"}) for k in KINDS]))
    return f"SELECT r.kind AS kind, r.spans AS spans, r.texts AS texts FROM (SELECT {each} AS r FROM (SELECT {sums} FROM (SELECT {counts} FROM {e.table('documents')}) c) s) x"


def record_identifiers(e: Duck) -> str:
    """Identifiers redacted in each record by kind, and the flags that these raise."""
    if type(e) is not Duck:
        return f"""WITH {e.steps(screening.marked(e))}, per_text AS (SELECT text_id, kind, count(*) AS n FROM edits_of WHERE kind IN ({", ".join(repr(k) for k in screening.IDENTIFIERS)}) GROUP BY text_id, kind)
            SELECT r.record_id, t.kind, t.n, CASE t.kind WHEN 'GOV_ID' THEN 'FLAG_GOV_ID' WHEN 'ACCOUNT' THEN 'FLAG_FINANCIAL' END AS flag FROM records r JOIN per_text t ON t.text_id = r.text_id"""
    rows, kind = screening.acts(e)
    return f"""WITH {screening.base(e)}, {rows}, named_spans AS (SELECT record_id, {kind} AS kind FROM acts)
        SELECT record_id, kind, count(*) AS n, CASE kind WHEN 'GOV_ID' THEN 'FLAG_GOV_ID' WHEN 'ACCOUNT' THEN 'FLAG_FINANCIAL' END AS flag FROM named_spans
        WHERE kind IN ({", ".join(repr(k) for k in screening.IDENTIFIERS)}) GROUP BY record_id, kind"""


def sentence_rows(e: Duck) -> str:
    """sents(record_id, conv_id, turn, sentence): sentences that are not blank, or the whole text."""
    found = e.where(e.all("text", P.SENTENCE), "trim(x) <> ''")
    return f"sents AS (SELECT record_id, conv_id, turn, {e.each(f'CASE WHEN {e.size(found)} > 0 THEN {found} ELSE ' + ('array(text)' if type(e) is Spark else '[text]') + ' END')} AS sentence FROM prompts)"


def sentences(e: Duck) -> str:
    found = e.where(e.all("text", P.SENTENCE), "trim(x) <> ''")
    return f"SELECT doc_id, CAST({e.size(found)} AS BIGINT) AS n, CAST({e.total(e.map(found, 'length(x)'))} AS BIGINT) AS chars FROM {e.table('documents')}"


def bucket(e: Duck, x: str, person: str = "") -> str:
    """Who a sentence speaks of. Fiction phrases are cut first, so that their own "my" is none of the author's. person says
    whether the sentence names one; without, two capitalised words are a name."""
    bare = x
    for p in P.FICTION_STRONG:
        bare = e.sub(bare, p, "' '")
    strong = " OR ".join(e.matches(x, p) for p in P.FICTION_STRONG)
    return f"""CASE WHEN {e.matches(bare, P.THIRD_PARTY)} THEN 'third_party' WHEN {e.matches(bare, P.SELF)} THEN 'self' WHEN {strong} THEN 'fiction'
        WHEN {e.matches(x, P.FICTION_MEDIUM)} OR {e.matches(x, P.FICTION_WEAK)} THEN 'ambiguous' WHEN {person or e.matches(x, FULL_NAME)} THEN 'ambiguous' ELSE 'unattributed' END"""


def attribution_buckets(e: Duck) -> str:
    return f"WITH {prompts(e)}, {sentence_rows(e)} SELECT record_id, sentence, {bucket(e, 'sentence')} AS bucket FROM sents"


def span_attribution(e: Duck) -> str:
    """Names right after a relation phrase are third parties', whatever their sentence is."""
    direct = P.THIRD_PARTY.removesuffix(r"\b") + r"\s+[A-Z]"
    return f"WITH {prompts(e)}, {sentence_rows(e)} SELECT record_id, {e.first('sentence', FULL_NAME)} AS name, CASE WHEN {e.matches('sentence', direct.replace('(?i)', '', 1))} THEN 'third_party' ELSE {bucket(e, 'sentence')} END AS bucket FROM sents WHERE {e.matches('sentence', FULL_NAME)}"


def ceilings(e: Duck, out: str, finals: str) -> str:
    """out(conv_id, turn, record_id, final_text, n, marks, outcome): texts with their tokens, placeholders and ceilings."""
    tokens = e.where(e.split("final_text", P.WS + "+"), "x <> ''")
    marks = e.where("tokens", e.matches("x", P.PLACEHOLDER))
    return f"""{out}_tokens AS (SELECT conv_id, turn, record_id, reason, final_text, {e.made({"tokens": tokens})} FROM {finals}),
        {out}_counted AS (SELECT conv_id, turn, record_id, reason, final_text, {e.size("tokens")} AS n, {e.size(marks)} AS marks FROM {out}_tokens),
        {out} AS (SELECT conv_id, turn, record_id, final_text, n, marks, CASE WHEN reason <> 'none' THEN reason WHEN n - marks < {P.MIN_TOKENS} THEN 'DROP_TOO_SHORT'
            WHEN marks > {P.MAX_DENSITY} * n THEN 'DROP_REDACTION_DENSITY' ELSE 'kept' END AS outcome FROM {out}_counted)"""


def first_rows(e: Duck, spans: screening.Detector = screening.spanned) -> screening.Groups:
    """first, the outcomes of each record by itself."""
    if type(e) is not Duck:
        return texts.first(e, spans)
    return [*screening.marked(e, spans), (["first"], f"{screening.rebuilt(e, 'finals', 'changes', 'screened')}, {ceilings(e, 'first', 'finals')}")]


def outcome_rows(e: Duck, spans: screening.Detector = screening.spanned) -> str:
    """outcomes, as they are after each conversation has been looked at as a whole; and verdicts of the conversations.

    With five kinds of quasi-identifiers or more in its kept records the most telling go, down to four, from all of them;
    their texts are rebuilt and meet the ceilings again. If that touches more than four in ten of the kept records, or
    leaves fewer than two, or if there are eight kinds, the whole conversation is excluded."""
    if type(e) is not Duck:
        return e.steps(texts.outcomes(e, spans))
    return e.steps([*first_rows(e, spans), ([], reworked(e))])


def reworked(e: Duck) -> str:
    left = "quasi_left AS (SELECT q.conv_id, q.turn, q.record_id, q.kind, q.place, q.begins, q.ends FROM quasi q JOIN quasi_kinds k ON k.record_id = q.record_id AND k.kind = q.kind WHERE NOT k.suppressed)"
    return f"""{left}, bundle AS (SELECT DISTINCT q.conv_id, q.kind, q.place FROM quasi_left q JOIN first f ON f.record_id = q.record_id WHERE f.outcome = 'kept'),
        ranked AS (SELECT conv_id, kind, count(*) OVER (PARTITION BY conv_id) AS kinds, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS k FROM bundle),
        going AS (SELECT q.record_id, q.kind, q.begins, q.ends FROM quasi_left q JOIN first f ON f.record_id = q.record_id JOIN ranked r ON r.conv_id = q.conv_id AND r.kind = q.kind
            WHERE f.outcome = 'kept' AND r.kinds >= {P.CONV_QI} AND r.kinds < {P.CONV_QI_OUT} AND r.k <= r.kinds - {P.CONV_QI_KEEP}),
        touched AS (SELECT DISTINCT record_id FROM going),
        again AS (SELECT s.conv_id, s.turn, s.record_id, s.text, s.reason, s.lines, s.cuts FROM screened s JOIN touched t ON t.record_id = s.record_id),
        more AS (SELECT record_id, begins, ends, new, late FROM changes WHERE record_id IN (SELECT record_id FROM touched) UNION ALL SELECT record_id, begins, ends, {screening.mark("kind")}, 2 FROM going),
        {screening.rebuilt(e, "reworked", "more", "again")}, {ceilings(e, "second", "reworked")},
        merged AS (SELECT f.conv_id, f.turn, f.record_id, coalesce(s.final_text, f.final_text) AS final_text, coalesce(s.n, f.n) AS n, coalesce(s.marks, f.marks) AS marks, coalesce(s.outcome, f.outcome) AS outcome, f.outcome = 'kept' AS was_kept, s.record_id IS NOT NULL AS touched
            FROM first f LEFT JOIN second s ON s.record_id = f.record_id),
        sums AS (SELECT m.conv_id, coalesce(max(r.kinds), 0) AS kinds, max(m.kept) AS kept, max(m.usable) AS usable, max(m.touched) AS touched
            FROM (SELECT conv_id, CAST(sum(CASE WHEN was_kept THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN outcome = 'kept' THEN 1 ELSE 0 END) AS BIGINT) AS usable, CAST(sum(CASE WHEN touched THEN 1 ELSE 0 END) AS BIGINT) AS touched FROM merged GROUP BY conv_id) m
            LEFT JOIN ranked r ON r.conv_id = m.conv_id GROUP BY m.conv_id),
        verdicts AS (SELECT conv_id, kinds, kept, usable, touched, CASE WHEN kinds >= {P.CONV_QI_OUT} THEN 'excluded' WHEN kinds < {P.CONV_QI} THEN 'as_is' WHEN 10 * touched > 4 * kept OR usable < 2 THEN 'excluded' ELSE 'suppressed' END AS verdict FROM sums),
        outcomes AS (SELECT m.conv_id, m.turn, m.record_id, m.final_text, m.n, m.marks, m.touched, CASE WHEN m.was_kept AND v.verdict = 'excluded' THEN 'EXC_SINGLING_OUT' ELSE m.outcome END AS outcome FROM merged m JOIN verdicts v ON v.conv_id = m.conv_id)"""


def quality_ceiling(e: Duck) -> str:
    return f"WITH {e.steps(first_rows(e))} SELECT record_id, CAST(n AS BIGINT) AS tokens, CAST(marks AS BIGINT) AS marks, outcome FROM first"


def outcome_counts(e: Duck) -> str:
    return f"WITH {outcome_rows(e)} SELECT conv_id, outcome, count(*) AS n FROM outcomes GROUP BY conv_id, outcome"


def final_texts(e: Duck) -> str:
    """The kept texts, after their conversation has been looked at as a whole."""
    return f"WITH {outcome_rows(e)} SELECT conv_id, record_id, final_text, touched FROM outcomes WHERE outcome = 'kept'"


def redaction_density(e: Duck) -> str:
    """Placeholders among the tokens of each conversation's kept texts; a conversation without any has density 1."""
    kept = "CASE WHEN outcome = 'kept' THEN {} ELSE 0 END"
    return f"WITH {outcome_rows(e)} SELECT conv_id, round(CASE WHEN sum({kept.format('n')}) = 0 THEN 1.0 ELSE CAST(sum({kept.format('marks')}) AS DOUBLE) / sum({kept.format('n')}) END, 6) AS density FROM outcomes GROUP BY conv_id"


def qi_types(e: Duck) -> str:
    if type(e) is not Duck:
        return f"WITH {e.steps(screening.marked(e))}, per_text AS (SELECT text_id, count(*) AS kinds FROM kinds_each GROUP BY text_id) SELECT r.record_id, t.kinds FROM records r JOIN per_text t ON t.text_id = r.text_id"
    return f"WITH {e.steps(screening.marked(e))} SELECT record_id, count(*) AS kinds FROM quasi_kinds GROUP BY record_id"


def qi_suppression(e: Duck) -> str:
    """Of a record with more than three kinds the most telling go, down to three."""
    return f"WITH {e.steps(screening.marked(e))} SELECT record_id, kind, suppressed FROM quasi_kinds"


def conversation_singling_out(e: Duck) -> str:
    """Each conversation's kinds of quasi-identifiers, its kept, touched and usable records, and the verdict."""
    return f"WITH {outcome_rows(e)} SELECT conv_id, kinds, kept, touched, usable, verdict FROM verdicts"


DEFINITIONS = {f"detect_{k.lower()}": partial(detect, kind=k) for k in KINDS}
DEFINITIONS |= {f.__name__: f for f in (span_offsets, identifier_counts, record_identifiers, sentences, attribution_buckets, span_attribution, quality_ceiling, outcome_counts, redaction_density, final_texts, qi_types, qi_suppression, conversation_singling_out)}
DEFINITIONS |= screening.DEFINITIONS
