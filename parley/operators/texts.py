"""The cascade on Spark: each different text is screened once, and each different set of edits of a text is made once.

A text's spans, gates, quasi-identifiers and edits depend on nothing but the text and what another detector said of it; only the numbers
of names, and the kinds that a conversation gives up, come from around it. So texts are searched by a table of different ones, records
carry their text's number, and final texts are a table of versions: a text with the numbers of its names, and with the kinds that go.
Where all texts differ these tables are as long as the records, and are joined as such. Record ids are keys."""

from __future__ import annotations

from ..functions import patterns as P
from ..plans.dialect import Duck
from ..plans.fixtures import prompts
from . import screening

NO_NAMES = "CAST(array() AS ARRAY<STRUCT<name: STRING, n: INT>>)"
NO_KINDS = "CAST(array() AS ARRAY<STRUCT<place: INT, kind: STRING>>)"


#: Texts in the place of prompts.
OWN = "prompts AS (SELECT text_id AS conv_id, 0 AS turn, text_id AS record_id, text FROM texts)"


def numbered(name: str, columns: str, rows: str) -> str:
    """The different rows with a number each. It holds once the relation is stored."""
    return f"SELECT monotonically_increasing_id() AS {name}, {columns} FROM (SELECT DISTINCT {columns} FROM {rows}) d"


def own_texts(e: Duck) -> screening.Groups:
    """texts(text_id, text), and screened_texts."""
    return [(["texts"], f"{prompts(e)}, texts AS ({numbered('text_id', 'text', 'prompts')})"), (["screened_texts"], f"{OWN}, {screening.spanned(e)}, {cascade(e)}")]


def own_records(e: Duck) -> str:
    return f"{prompts(e)}, records AS (SELECT p.conv_id, p.turn, p.record_id, p.captured, t.text_id FROM prompts p JOIN texts t ON t.text <=> p.text)"


def cascade(e: Duck) -> str:
    """What follows spanned: screened_texts."""
    return f"{screening.judged(e)}, {screening.categories(e)}, {screening.screened(e)}, screened_texts AS (SELECT record_id AS text_id, text, lines, cuts, spans, reason, minor, recovered FROM screened)"


def detector(spans: screening.Detector) -> tuple:
    """The groups that screen a detector's texts, and the relation of its records (conv_id, turn, record_id, captured, text_id)."""
    if spans is screening.spanned:
        return own_texts, own_records
    from . import external

    return external.told_texts, external.told_records


def gated(e: Duck, spans: screening.Detector) -> screening.Groups:
    """screened, as SQL has it."""
    groups, records = detector(spans)
    return [*groups(e), ([], f"{records(e)}, {SCREENED}")]


SCREENED = "screened AS (SELECT r.conv_id, r.turn, r.record_id, t.text, t.lines, t.cuts, t.spans, t.reason, t.minor, t.recovered FROM records r JOIN screened_texts t ON t.text_id = r.text_id)"


def acted(e: Duck, spans: screening.Detector) -> screening.Groups:
    """edits_of(text_id, begins, ends, rule, kind, bucket, employs, new, name): spans and what takes their place, where that is not the number of
    a name; quasi_of(text_id, kind, place, begins, ends, suppressed)."""
    rows, kind = screening.acts(e)
    own = "screened AS (SELECT text_id AS conv_id, 0 AS turn, text_id AS record_id, text, lines, spans, reason FROM screened_texts)"
    kinds = f"kinds AS (SELECT conv_id, turn, record_id, begins, ends, rule, {kind} AS kind, value, bucket, employs FROM acts)"
    edits = f"edits_of AS (SELECT record_id AS text_id, begins, ends, rule, kind, bucket, employs, {screening.renewed(e, 'NULL')} AS new, {screening.named_key(e)} AS name FROM kinds)"
    quasi = "quasi_of AS (SELECT q.record_id AS text_id, q.kind, q.place, q.begins, q.ends, k.suppressed FROM quasi q JOIN quasi_kinds k ON k.record_id = q.record_id AND k.kind = q.kind)"
    return [*detector(spans)[0](e), (["edits_of", "quasi_of"], f"{own}, {rows}, {kinds}, {edits}, {screening.quasi(e)}, {screening.quasi_kinds(e)}, {quasi}")]


def called() -> str:
    """called: names in records with their numbers in their conversation, by where each name comes first."""
    return f"""spoken AS (SELECT r.conv_id, r.turn, r.record_id, r.captured, r.text_id, o.begins, o.ends, o.name FROM records r JOIN (SELECT text_id, begins, ends, name FROM edits_of WHERE name IS NOT NULL) o ON o.text_id = r.text_id),
        heard AS (SELECT *, min(CAST(turn AS BIGINT) * {screening.LONG} + begins) OVER (PARTITION BY conv_id, name) AS first_at FROM spoken),
        called AS (SELECT conv_id, turn, record_id, captured, text_id, begins, ends, name, dense_rank() OVER (PARTITION BY conv_id ORDER BY first_at) AS n FROM heard)"""


PERSON = "CASE WHEN conv_id IS NOT NULL THEN concat('[PERSON_', CAST(n AS STRING), ']') END"


def marked(e: Duck, spans: screening.Detector) -> screening.Groups:
    """screened, edits, quasi, quasi_kinds and changes, as SQL has them."""
    rows = f"""{detector(spans)[1](e)}, {SCREENED}, {called()},
        edits AS (SELECT r.record_id, o.begins, o.ends, o.new FROM records r JOIN edits_of o ON o.text_id = r.text_id WHERE o.name IS NULL UNION ALL SELECT record_id, begins, ends, {PERSON} FROM called),
        quasi AS (SELECT r.conv_id, r.turn, r.record_id, q.kind, q.place, q.begins, q.ends FROM records r JOIN quasi_of q ON q.text_id = r.text_id),
        kinds_each AS (SELECT DISTINCT text_id, kind, place, suppressed FROM quasi_of),
        quasi_kinds AS (SELECT r.conv_id, r.record_id, k.kind, k.place, k.suppressed FROM records r JOIN kinds_each k ON k.text_id = r.text_id),
        changes AS (SELECT record_id, begins, ends, new, 0 AS late FROM edits
            UNION ALL SELECT r.record_id, q.begins, q.ends, {screening.mark('q.kind')}, 1 FROM records r JOIN quasi_of q ON q.text_id = r.text_id WHERE q.suppressed)"""
    return [*acted(e, spans), ([], rows)]


def changes_of(e: Duck, out: str, of: str) -> str:
    """out(record_id, begins, ends, new, late): the changes of versions `of` (id, text_id, names) by themselves."""
    number = "element_at(filter(v.names, x -> x.name = o.name), 1).n"
    return f"""{out} AS (SELECT v.id AS record_id, o.begins, o.ends, CASE WHEN o.name IS NULL THEN o.new WHEN {number} > 0 THEN concat('[PERSON_', CAST({number} AS STRING), ']') END AS new, 0 AS late FROM {of} v JOIN edits_of o ON o.text_id = v.text_id
            UNION ALL SELECT v.id, q.begins, q.ends, {screening.mark('q.kind')}, 1 FROM {of} v JOIN quasi_of q ON q.text_id = v.text_id WHERE q.suppressed)"""


def rows_of(out: str, of: str) -> str:
    return f"{out} AS (SELECT v.id AS conv_id, 0 AS turn, v.id AS record_id, t.text, t.reason, t.lines, t.cuts FROM {of} v JOIN screened_texts t ON t.text_id = v.text_id)"


def first_groups(e: Duck, spans: screening.Detector) -> screening.Groups:
    """versed, the records with the numbers of their texts' names; first_of(version_id, text_id, names, reason, final_text, print, n, marks, outcome)."""
    from .policy import ceilings

    versed = f"""versed AS (SELECT r.conv_id, r.turn, r.record_id, r.captured, r.text_id, {NO_NAMES} AS names FROM records r LEFT ANTI JOIN (SELECT DISTINCT text_id FROM edits_of WHERE name IS NOT NULL) o ON o.text_id = r.text_id
            UNION ALL SELECT conv_id, turn, record_id, captured, text_id, array_sort(collect_set(named_struct('name', name, 'n', CASE WHEN conv_id IS NULL THEN 0 ELSE n END))) FROM called GROUP BY conv_id, turn, record_id, captured, text_id)"""
    of = "v AS (SELECT version_id AS id, text_id, names FROM versions)"
    firsts = "first_of AS (SELECT v.id AS version_id, v.text_id, v.names, w.reason, f.final_text, f.n, f.marks, f.outcome FROM first_rows f JOIN v ON v.id = f.record_id JOIN first_texts w ON w.record_id = f.record_id)"
    return [
        *acted(e, spans), (["versed"], f"{detector(spans)[1](e)}, {called()}, {versed}"), (["versions"], f"versions AS ({numbered('version_id', 'text_id, names', 'versed')})"),
        (["first_of"], f"{of}, {rows_of('asked_rows', 'v')}, {changes_of(e, 'asked_changes', 'v')}, {screening.rebuilt(e, 'first_texts', 'asked_changes', 'asked_rows')}, {ceilings(e, 'first_rows', 'first_texts')}, {firsts}"),
    ]


def first(e: Duck, spans: screening.Detector) -> screening.Groups:
    """first and finals, as SQL has them."""
    rows = """first AS (SELECT r.conv_id, r.turn, r.record_id, f.final_text, f.n, f.marks, f.outcome FROM versed r JOIN first_of f ON f.text_id = r.text_id AND f.names = r.names),
        finals AS (SELECT r.conv_id, r.turn, r.record_id, f.reason, f.final_text FROM versed r JOIN first_of f ON f.text_id = r.text_id AND f.names = r.names)"""
    return [*first_groups(e, spans), ([], rows)]


def outcomes(e: Duck, spans: screening.Detector) -> screening.Groups:
    """outcomes and verdicts, as SQL has them, with what marked says; the conversation's bundle of kinds is gathered along its records.

    Rows that go by conversation carry numbers of versions; their texts come last."""
    from .policy import ceilings

    bundle = f"array_sort(array_distinct(flatten(collect_set(CASE WHEN r.conv_id IS NULL THEN {NO_KINDS} ELSE t.left_kinds END) OVER (PARTITION BY r.conv_id))))"
    going = f"CASE WHEN outcome = 'kept' AND size(bundle) >= {P.CONV_QI} AND size(bundle) < {P.CONV_QI_OUT} THEN array_sort(filter(left_kinds, x -> array_contains(slice(bundle, 1, size(bundle) - {P.CONV_QI_KEEP}), x))) ELSE {NO_KINDS} END"
    reworks = f"""left_of AS (SELECT text_id, collect_set(named_struct('place', place, 'kind', kind)) AS left_kinds FROM quasi_of WHERE NOT suppressed GROUP BY text_id),
        telling AS (SELECT f.version_id, f.text_id, f.names, f.outcome, CASE WHEN f.outcome = 'kept' THEN coalesce(l.left_kinds, {NO_KINDS}) ELSE {NO_KINDS} END AS left_kinds FROM first_of f LEFT JOIN left_of l ON l.text_id = f.text_id),
        gathered AS (SELECT r.conv_id, r.turn, r.record_id, r.captured, t.version_id, t.outcome, t.left_kinds, {bundle} AS bundle FROM versed r JOIN telling t ON t.text_id = r.text_id AND t.names = r.names),
        reworks AS (SELECT conv_id, turn, record_id, captured, version_id, outcome, size(bundle) AS kinds, {going} AS going FROM gathered)"""
    of = "v AS (SELECT w.second_id AS id, f.text_id, f.names, w.going FROM rewritten w JOIN first_of f ON f.version_id = w.version_id)"
    more = f"more AS (SELECT record_id, begins, ends, new, late FROM own_changes UNION ALL SELECT v.id, q.begins, q.ends, {screening.mark('q.kind')}, 2 FROM v JOIN quasi_of q ON q.text_id = v.text_id WHERE NOT q.suppressed AND exists(v.going, x -> x.kind = q.kind))"
    seconds = "second_of AS (SELECT w.second_id, w.version_id, w.going, s.final_text, s.n, s.marks, s.outcome FROM second_rows s JOIN rewritten w ON w.second_id = s.record_id)"
    whole = "OVER (PARTITION BY conv_id)"
    n = lambda condition: f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END)"
    verdict = f"CASE WHEN kinds >= {P.CONV_QI_OUT} THEN 'excluded' WHEN kinds < {P.CONV_QI} THEN 'as_is' WHEN 10 * touched > 4 * kept OR usable < 2 THEN 'excluded' ELSE 'suppressed' END"
    rows = f"""merged AS (SELECT r.conv_id, r.turn, r.record_id, r.captured, r.version_id, s.second_id, r.kinds, r.outcome = 'kept' AS was_kept, s.second_id IS NOT NULL AS is_touched, coalesce(s.outcome, r.outcome) AS outcome
            FROM reworks r LEFT JOIN second_of s ON s.version_id = r.version_id AND s.going = r.going),
        weighed AS (SELECT conv_id, turn, record_id, captured, version_id, second_id, kinds, was_kept, is_touched, outcome, {n("was_kept")} {whole} AS BIGINT) AS kept, {n("outcome = 'kept'")} {whole} AS BIGINT) AS usable, {n("is_touched")} {whole} AS BIGINT) AS touched FROM merged WHERE conv_id IS NOT NULL),
        decided AS (SELECT conv_id, turn, record_id, captured, version_id, second_id, is_touched, CASE WHEN was_kept AND {verdict} = 'excluded' THEN 'EXC_SINGLING_OUT' ELSE outcome END AS outcome FROM weighed),
        outcomes AS (SELECT d.conv_id, d.turn, d.record_id, d.captured, coalesce(s.final_text, f.final_text) AS final_text, coalesce(s.n, f.n) AS n, coalesce(s.marks, f.marks) AS marks, d.is_touched AS touched, d.outcome
            FROM decided d JOIN first_of f ON f.version_id = d.version_id LEFT JOIN second_of s ON s.second_id = d.second_id),
        sums AS (SELECT conv_id, CAST(max(kinds) AS BIGINT) AS kinds, {n("was_kept")} AS BIGINT) AS kept, {n("outcome = 'kept'")} AS BIGINT) AS usable, {n("is_touched")} AS BIGINT) AS touched FROM merged GROUP BY conv_id),
        verdicts AS (SELECT conv_id, kinds, kept, usable, touched, {verdict} AS verdict FROM sums)"""
    return [
        *first_groups(e, spans), (["reworks"], reworks), (["rewritten"], f"rewritten AS ({numbered('second_id', 'version_id, going', '(SELECT version_id, going FROM reworks WHERE size(going) > 0) t')})"),
        (["second_of"], f"{of}, {rows_of('again', 'v')}, {changes_of(e, 'own_changes', 'v')}, {more}, {screening.rebuilt(e, 'reworked', 'more', 'again')}, {ceilings(e, 'second_rows', 'reworked')}, {seconds}"),
        ([], f"{marked(e, spans)[-1][1]}, {rows}"),
    ]
