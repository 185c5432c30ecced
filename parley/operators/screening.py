"""Spans with offsets, whom they speak of, sensitive categories, exclusion, and texts rebuilt from edits.

A span is one number, so that lists of spans sort and compare as they are: start, then length downwards, then rule.
Spans of a record stay in arrays on its row; texts of prompts are bounded by the ingest rules, and so are the arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import labels as L
from ..functions import patterns as P
from ..functions import places as G
from ..functions import sensitive
from ..plans.dialect import Duck
from ..plans.fixtures import prompts

#: Kinds by the number of their rule: those of our own rules, then names and places, then what only other detectors tell.
OWN = [k for k, _, _ in P.DETECTORS]
PERSON, PLACE = len(OWN), len(OWN) + 1
#: A name or membership that is not sure enough for its first action is WEAK; UNANSWERED stands for a text that its detector failed on.
KINDS = [*OWN, "PERSON", "GPE", *(k for k in L.PLACEHOLDERS if k not in OWN), "ORG", "LOC", "FAC", "BENIGN", "UNKNOWN", "WEAK_PERSON", "WEAK_NORP", "UNANSWERED"]
IDENTIFIERS = tuple(L.PLACEHOLDERS)
NOT_BLANK = P.WS.replace("[", "[^", 1)
LOOK_BACK, SLACK, DENSITY, ADULT = 40, 2, 15, 18
LONG, RULES = 1 << 29, 64


def key(start: str, length: str, rule: int) -> str:
    return f"(CAST({start} AS BIGINT) * {LONG * RULES} + ({LONG - 1} - CAST({length} AS BIGINT)) * {RULES} + {rule})"


def start(e: Duck, k: str) -> str:
    return e.div(k, str(LONG * RULES))


def length(e: Duck, k: str) -> str:
    return f"({LONG - 1} - {e.div(k, str(RULES))} % {LONG})"


def value(e: Duck, k: str) -> str:
    return f"substr(text, CAST({start(e, k)} + 1 AS INT), CAST({length(e, k)} AS INT))"


def is_kind(k: str, *kinds: str) -> str:
    return f"{k} % {RULES} IN (" + ", ".join(str(i) for i, name in enumerate(KINDS) if name in kinds) + ")"


def begins(e: Duck, found: str, gaps: str) -> str:
    """Where item i of the matches begins: behind the gaps and matches before it."""
    return f"({e.lengths(gaps, e.place)} + {e.lengths(found, e.place + ' - 1')})"


def spans_of(e: Duck, rule: int, as_rule: int | None = None) -> str:
    """Keys of the matches of a rule, under the rule's own number or another."""
    at = begins(e, f"m{rule}", f"g{rule}")
    if rule == PERSON:
        place = f"lower(v) IN {e.any_of([c for cs in G.CITIES.values() for c in cs] + G.REGIONS + G.COUNTRIES)}"
        words = e.split("v", r"\s+")
        named = f"({e.size(words)} BETWEEN 2 AND 3 AND lower({e.item(words, '1')}) NOT IN {e.any_of(G.STARTERS)}) OR lower(v) IN {e.any_of(G.FIRST_NAMES)}"
        return e.each_item(f"m{rule}", "v, i", f"CASE WHEN {place} THEN {key(at, 'length(v)', PLACE)} WHEN {named} THEN {key(at, 'length(v)', PERSON)} END")
    if KINDS[rule] == "AGE":
        digits = e.first("v", r"\d{1,2}")
        return e.each_item(f"m{rule}", "v, i", key(f"{at} + instr(v, {digits}) - 1", f"length({digits})", rule if as_rule is None else as_rule))
    return e.each_item(f"m{rule}", "v, i", key(at, "length(v)", rule if as_rule is None else as_rule))


def spanned(e: Duck) -> str:
    """spanned(conv_id, turn, record_id, text, kept, sents): spans that do not overlap, and sentences, as keys."""
    rules = [p for _, _, p in P.DETECTORS] + [G.CAPITALISED]
    rules = {str(i): p for i, p in enumerate(rules)}
    matched = {f"m{i}": e.spans("text", p) for i, p in rules.items()} | {"sm": e.all("text", P.SENTENCE)}
    # most rules find nothing in most texts, and then nothing is split
    cut = {f"g{i}": f"CASE WHEN {e.size(f'm{i}')} > 0 THEN {e.split('text', p)} END" for i, p in rules.items()} | {"sg": e.split("text", P.SENTENCE)}
    every = e.those(e.concat_lists([spans_of(e, i) for i in range(PERSON + 1)]), "k", "k IS NOT NULL")
    sents = sentence_keys(e)
    disjoint = disjoint_keys(e, every)
    return f"""spread AS (SELECT {e.spread("record_id")}conv_id, turn, record_id, text FROM prompts),
        matched AS (SELECT conv_id, turn, record_id, text, {e.made(matched)} FROM spread),
        cut AS (SELECT conv_id, turn, record_id, text, {', '.join(matched)}, {e.made(cut)} FROM matched),
        found AS (SELECT conv_id, turn, record_id, text, {e.made({'kept': disjoint, 'whole': sents})} FROM cut),
        spanned AS (SELECT conv_id, turn, record_id, text, kept, {WHOLE.format(any=e.size('whole'), text=e.items([key('0', 'length(text)', 0)]))} AS sents FROM found)"""


#: Sentences, or the text where there is none.
WHOLE = "CASE WHEN {any} > 0 THEN whole ELSE {text} END"


def sentence_keys(e: Duck) -> str:
    """Keys of the sentences that are not blank, from sm (matches) and sg (gaps)."""
    return e.those(e.each_item("sm", "v, i", f"CASE WHEN {e.matches('v', NOT_BLANK)} THEN {key(begins(e, 'sm', 'sg'), 'length(v)', 0)} END"), "k", "k IS NOT NULL")


def disjoint_keys(e: Duck, keys: str) -> str:
    """Of spans that overlap the earlier, then longer, then of lower rule."""
    return e.apart(keys, start(e, "{0}"), f"({start(e, '{0}')} + {length(e, '{0}')})")


def judged(e: Duck) -> str:
    """judged: a row for each sentence, whom it speaks of (bucket), and its own spans (owns: k, and b for whom it speaks of)."""
    from .policy import bucket

    inside = f"{start(e, 'k')} >= {start(e, 'y')} AND {start(e, 'k')} < {start(e, 'y')} + {length(e, 'y')}"
    owner = e.each_item("kept", "k", f"coalesce({e.find(e.each_item('sents', 'y', inside), 'true')}, {e.size('sents')})")
    mine = e.those("kept", "k, i", f"{e.item('owner', e.place)} = idx")
    person = f"{e.size(e.those('mine', 'k', is_kind('k', 'PERSON', 'WEAK_PERSON')))} > 0"
    return f"""owned AS (SELECT conv_id, turn, record_id, text, kept, sents, {e.made({'owner': owner})} FROM spanned),
        dealt AS (SELECT conv_id, turn, record_id, text, kept, owner, {e.numbered('sents', 'idx', 'skey')} FROM owned),
        lines AS (SELECT conv_id, turn, record_id, text, idx, skey, {start(e, 'skey')} AS sstart, {e.made({'sentence': value(e, 'skey'), 'mine': mine})} FROM dealt),
        about AS (SELECT conv_id, turn, record_id, text, idx, skey, sstart, sentence, mine, {e.made({'bucket': bucket(e, 'sentence', person)})} FROM lines),
        judged AS (SELECT conv_id, turn, record_id, text, idx, skey, sstart, sentence, bucket, {e.made({'owns': e.each_item('mine', 'k', e.struct({'k': 'k', 'b': span_bucket(e, 'k')}))})} FROM about)"""


def span_bucket(e: Duck, k: str) -> str:
    """A relation phrase right before a span says whose it is, whatever its sentence says."""
    begin = f"greatest(sstart, {start(e, k)} - {LOOK_BACK})"
    before = f"substr(text, CAST({begin} + 1 AS INT), CAST({start(e, k)} - {begin} AS INT))"
    first = e.first(before, P.THIRD_PARTY)
    gap = e.item(e.split(before, P.THIRD_PARTY), "1")
    near = e.matches(before, rf"{P.THIRD_PARTY}[\s\S]{{0,{SLACK}}}\z")  # seldom, and then the first match decides
    return f"CASE WHEN {near} AND length({gap}) + length({first}) >= length({before}) - {SLACK} THEN 'third_party' ELSE bucket END"


def categories(e: Duck) -> str:
    """hits: judged with a list of category:confidence, in the order of the rules."""
    def one(name: str) -> str:
        tier = {t: " OR ".join(e.matches("sentence", p) for p in sensitive.patterns(name, t)) for t in ("exclude", "flag")}
        sure = f"WHEN {tier['exclude']} THEN '{name}:90' " if tier["exclude"] else ""
        return f"CASE {sure}WHEN {tier['flag']} THEN CASE WHEN bucket IN ('self', 'third_party') THEN '{name}:65' ELSE '{name}:30' END END"

    found = e.those(e.items([one(c) for c in sensitive.CATEGORIES]), "c", "c IS NOT NULL")
    return f"hits AS (SELECT conv_id, turn, record_id, text, idx, skey, sstart, owns, bucket, {e.made({'hit': found})} FROM judged)"


def screened(e: Duck) -> str:
    """screened(conv_id, turn, record_id, reason, minor, recovered): the first gate that closes; later gates are not asked."""
    def has(k: str, condition: str = "true") -> str:
        return e.size(e.those("owns", "o", f"{k} AND {condition}"))

    ends = {n: f"{e.size(e.those('hit', 'c', f'{chr(99)} LIKE {chr(39)}%:{n}{chr(39)}'))} > 0" for n in (90, 65)}
    young = f"{years(e, value(e, 'o.k'))} < {ADULT}"
    # CASE, for the engines may ask both sides of AND, and only an age is a number
    minor = e.size(e.those("owns", "o", f"CASE WHEN {is_kind('o.k', 'AGE')} THEN {young} AND o.b = 'self' ELSE false END"))
    told = e.those("owns", "o", f"{is_kind('o.k', 'NORP')} AND o.b NOT IN ('unattributed', 'fiction')")
    weak = has(is_kind("o.k", "WEAK_NORP"), "o.b NOT IN ('unattributed', 'fiction')")
    norp = e.least(e.each_item(told, "o", f"{start(e, 'o.k')} * 2 + CASE WHEN o.b = 'ambiguous' THEN 1 ELSE 0 END"))
    line = e.struct({"a": "sstart", "b": f"sstart + {length(e, 'skey')}", "gone": "likely", "bucket": "bucket"})
    return f"""gates AS (SELECT conv_id, turn, record_id, text, bucket, idx, sstart, skey, owns, {e.made({'secrets': has(is_kind('o.k', 'SECRET')), 'ids': has(is_kind('o.k', *IDENTIFIERS)), 'minor': minor, 'failed': has(is_kind('o.k', 'UNANSWERED')), 'sure': ends[90], 'likely': f'({ends[65]} OR {weak} > 0)', 'norp': norp})} FROM hits),
        closed AS (SELECT conv_id, turn, record_id, min(text) AS text, {e.ordered(line, 'sstart')} AS lines, flatten({e.ordered('owns', 'sstart')}) AS spans, max(CASE WHEN likely THEN 1 ELSE 0 END) AS cuts, sum(failed) AS failed, sum(secrets) AS secrets, sum(ids) AS ids, sum(minor) AS minors, min(norp) AS norp,
            min(CASE WHEN sure AND bucket IN ('self', 'third_party', 'ambiguous') THEN idx * 2 + CASE WHEN bucket = 'ambiguous' THEN 1 ELSE 0 END END) AS category,
            max(CASE WHEN sure AND bucket = 'fiction' THEN 1 ELSE 0 END) AS recovered FROM gates GROUP BY conv_id, turn, record_id),
        screened AS (SELECT conv_id, turn, record_id, text, lines, cuts, spans, CASE WHEN failed > 0 THEN 'EXC_STAGE6_UNAVAILABLE' WHEN secrets > 0 THEN 'EXC_LIVE_SECRET' WHEN ids >= {DENSITY} THEN 'EXC_PII_DENSITY' WHEN minors > 0 THEN 'EXC_SPECIAL_CATEGORY'
            WHEN coalesce(category, norp) % 2 = 0 THEN 'EXC_SPECIAL_CATEGORY' WHEN coalesce(category, norp) % 2 = 1 THEN 'EXC_ATTRIBUTION_AMBIGUOUS' ELSE 'none' END AS reason,
            failed = 0 AND secrets = 0 AND ids < {DENSITY} AND minors > 0 AS minor, failed = 0 AND secrets = 0 AND ids < {DENSITY} AND minors = 0 AND category IS NULL AND recovered = 1 AS recovered FROM closed)"""


def years(e: Duck, x: str) -> str:
    """The number that the digits of an age write; null without any."""
    return f"CAST(nullif({e.first(e.sub(x, '[^0-9]', repr('')), '^[0-9]{1,9}')}, '') AS INT)"


Groups = list[tuple[list[str], str]]
#: What says spanned: our own rules, or another detector's table with them.
Detector = Callable[[Duck], str]


def gated(e: Duck, spans: Detector = spanned) -> Groups:
    if type(e) is not Duck:
        return texts.gated(e, spans)
    return [(["screened"], f"{prompts(e)}, {spans(e)}, {judged(e)}, {categories(e)}, {screened(e)}")]


def base(e: Duck, spans: Detector = spanned) -> str:
    """screened, which everything after the gates begins with."""
    return e.steps(gated(e, spans))


def region(e: Duck, x: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({x}) IN {e.any_of(cities)} THEN {e.text(name)}" for name, cities in G.CITIES.items()) + " END"


def name_key(e: Duck, x: str) -> str:
    return f"trim({e.sub(f'lower({x})', P.WS + '+', chr(39) + ' ' + chr(39))})"


def line_at(e: Duck, at: str) -> str:
    """The sentence that a place is in, or the last one."""
    inside = e.those("lines", "y", f"{at} >= y.a AND {at} < y.b")
    first = e.item(inside, "1") if type(e) is Duck else f"try_element_at({inside}, 1)"
    return f"coalesce({first}, {e.item('lines', e.size('lines'))})"


def acts(e: Duck) -> str:
    """acts: spans of records that no gate stopped, each with whom it speaks of; numbers: of each conversation's names."""
    kind = "CASE rule " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    here = line_at(e, start(e, "o.k"))
    said = f"substr(l.text, CAST({here}.a + 1 AS INT), CAST({here}.b - {here}.a AS INT))"
    employs = f"CASE WHEN {is_kind('o.k', 'ORG')} THEN {e.matches(said, L.EMPLOYER)} AND o.b IN ('self', 'ambiguous') ELSE false END"
    return f"""loose AS (SELECT conv_id, turn, record_id, text, lines, {e.each('spans')} AS o FROM screened WHERE reason = 'none' AND {e.size('spans')} > 0),
        acts AS (SELECT l.conv_id, l.turn, l.record_id, {start(e, 'o.k')} AS begins, {start(e, 'o.k')} + {length(e, 'o.k')} AS ends, o.k % {RULES} AS rule, {value(e, 'o.k').replace('text', 'l.text')} AS value, o.b AS bucket, {employs} AS employs FROM loose l),
        named AS (SELECT conv_id, turn, record_id, begins, {name_key(e, 'value')} AS name FROM acts WHERE rule = {PERSON} AND (bucket = 'third_party' OR {name_key(e, 'value')} NOT IN {e.any_of(list(G.FIGURES))})),
        firsts AS (SELECT conv_id, name, min(CAST(turn AS BIGINT) * {LONG} + begins) AS first_at FROM named GROUP BY conv_id, name),
        numbers AS (SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY first_at) AS n FROM firsts)""", kind


ATTRIBUTED = "bucket IN ('self', 'third_party', 'ambiguous')"
#: What takes the place of a quasi-identifier.
QI_MARKS = {"exact_age": "[AGE]", "occupation": "[OCCUPATION]", "employer": "[EMPLOYER]", "family_structure": "[FAMILY]", "gender": "[GENDER]", "geo": "[LOCATION]"}
QI_PATTERNS = {"occupation": P.OCCUPATION, "family_structure": P.FAMILY, "gender": P.GENDER, "exact_age": P.AGE_ADJECTIVE}
CITIES = [c for cities in G.CITIES.values() for c in cities]


def edits(e: Duck) -> str:
    """edits(record_id, begins, ends, new): what takes a span's place."""
    rows, kind = acts(e)
    new = renewed(e, f"CASE WHEN n.n IS NOT NULL THEN concat('[PERSON_', CAST(n.n AS {e.string}), ']') END")
    return f"""{rows}, kinds AS (SELECT conv_id, turn, record_id, begins, ends, {kind} AS kind, value, bucket, employs FROM acts),
        edits AS (SELECT k.record_id, k.begins, k.ends, {new} AS new
            FROM kinds k LEFT JOIN numbers n ON n.conv_id = k.conv_id AND kind = 'PERSON' AND n.name = {named_key(e)})"""


def named_key(e: Duck) -> str:
    """The name of a person that gets a number."""
    return f"CASE WHEN kind = 'PERSON' AND (bucket = 'third_party' OR {name_key(e, 'value')} NOT IN {e.any_of(list(G.FIGURES))}) THEN {name_key(e, 'value')} END"


def renewed(e: Duck, person: str) -> str:
    """What takes a span's place, a person's name being given."""
    date = e.first("value", G.YEAR)
    age = f"CASE WHEN kind = 'AGE' THEN {years(e, 'value')} END"
    marks = "CASE kind " + " ".join(f"WHEN '{k}' THEN '[{v}]'" for k, v in L.PLACEHOLDERS.items()) + " END"
    return f"""CASE WHEN kind IN ({', '.join(repr(i) for i in IDENTIFIERS)}) THEN {marks} WHEN kind = 'UNKNOWN' THEN '[REDACTED]' WHEN employs THEN '[EMPLOYER]' WHEN kind = 'PERSON' THEN {person}
            WHEN NOT {ATTRIBUTED} THEN NULL WHEN kind IN ('GPE', 'LOC', 'FAC') THEN CASE WHEN lower(value) IN {e.any_of(G.COUNTRIES + G.REGIONS)} THEN NULL ELSE coalesce({region(e, 'value')}, '[LOCATION]') END
            WHEN kind = 'DATE' THEN CASE WHEN length({date}) > 0 THEN {date} ELSE '[DATE]' END WHEN {age} >= 90 THEN '90+' END"""


def quasi(e: Duck) -> str:
    """quasi(conv_id, turn, record_id, kind, place, begins, ends): quasi-identifiers of records that no gate stopped; place is
    the kind's distinctiveness. Ages under 90, regions and known cities are spans that speak of someone. Occupation, family,
    gender and, where no span tells an age, an age before a noun are the first match of a pattern, if its sentence speaks of
    its author or of a third party. quasi_kinds ranks the kinds of each record; its first n - 3 are suppressed."""
    found = {k: f"CASE WHEN {e.matches('text', p)} THEN length({e.item(e.split('text', p), '1')}) END" for k, p in QI_PATTERNS.items()}
    size = {k: f"length({e.first('text', p)})" for k, p in QI_PATTERNS.items()}
    hit = [e.struct({"kind": f"'{k}'", "begins": f"CAST(at_{k} AS BIGINT)", "ends": f"CAST(at_{k} + {size[k]} AS BIGINT)"}) for k in QI_PATTERNS]
    here = line_at(e, "q.begins")
    place = "CASE kind " + " ".join(f"WHEN '{k}' THEN {P.QI_ORDER.index(k)}" for k in QI_MARKS) + " END"
    geo = f"lower(value) IN {e.any_of(G.REGIONS + CITIES)} AND lower(value) NOT IN {e.any_of(G.COUNTRIES)}"
    told = f"CASE WHEN kind = 'AGE' THEN CASE WHEN {years(e, 'value')} < 90 THEN 'exact_age' END WHEN employs THEN 'employer' WHEN kind IN ('GPE', 'LOC', 'FAC') AND {geo} THEN 'geo' END"
    return f"""told AS (SELECT conv_id, turn, record_id, {told} AS kind, begins, ends FROM kinds WHERE {ATTRIBUTED} AND kind IN ('AGE', 'ORG', 'GPE', 'LOC', 'FAC')),
        tried AS (SELECT conv_id, turn, record_id, text, lines, {e.made({f'at_{k}': x for k, x in found.items()})} FROM screened WHERE reason = 'none'),
        tries AS (SELECT conv_id, turn, record_id, lines, {e.each(e.items(hit))} AS q FROM tried),
        placed AS (SELECT conv_id, turn, record_id, q.kind AS kind, q.begins AS begins, q.ends AS ends, {here}.bucket AS bucket FROM tries WHERE q.begins IS NOT NULL),
        every AS (SELECT conv_id, turn, record_id, kind, begins, ends FROM told WHERE kind IS NOT NULL
            UNION ALL SELECT conv_id, turn, record_id, kind, begins, ends FROM placed p WHERE bucket IN ('self', 'third_party') AND NOT (kind = 'exact_age' AND EXISTS (SELECT 1 FROM told t WHERE t.record_id = p.record_id AND t.kind = 'exact_age'))),
        quasi AS (SELECT conv_id, turn, record_id, kind, {place} AS place, begins, ends FROM every)"""


def quasi_kinds(e: Duck) -> str:
    return f"""one_each AS (SELECT DISTINCT conv_id, record_id, kind, place FROM quasi),
        quasi_kinds AS (SELECT conv_id, record_id, kind, place, row_number() OVER (PARTITION BY record_id ORDER BY place) <= count(*) OVER (PARTITION BY record_id) - {P.RECORD_QI} AS suppressed FROM one_each)"""


def mark(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in QI_MARKS.items()) + " END"


def edited(e: Duck, a: str, b: str) -> str:
    """The text from a to b with the edits that begin there; what an earlier edit took is gone."""
    pieces = e.each_item(e.those("ed", "d", f"d.begins >= {a} AND d.begins < {b}"), "d", f"concat(substr(text, CAST(greatest(d.was, {a}) + 1 AS INT), CAST(d.begins - greatest(d.was, {a}) AS INT)), d.new)")
    last = f"greatest({a}, coalesce({e.most(e.each_item(e.those('ed', 'd', f'd.begins < {b}'), 'd', 'd.ends'))}, 0))"
    return f"concat({e.join(pieces, '')}, substr(text, CAST({last} + 1 AS INT), CAST(greatest({b} - {last}, 0) AS INT)))"


def rebuilt(e: Duck, out: str, changes: str, rows: str) -> str:
    """out(conv_id, turn, record_id, reason, final_text): the texts of rows after changes(record_id, begins, ends, new, late).
    Of changes within one another the outermost holds, of two to the same span the later. Sentences go by where they are in
    the text as it was."""
    trimmed = lambda x: e.sub(x, rf"\A{P.WS}+|{P.WS}+\z", "''")
    keep = e.those("lines", "y", "NOT y.gone AND y.b > y.a")
    parts = e.those(e.each_item(keep, "y", trimmed(edited(e, "y.a", "y.b"))), "w", e.matches("w", r"[^.!?\s]"))
    edit = e.struct({"was": "was", "begins": "begins", "ends": "ends", "new": "new"})
    empty = e.those(e.items([e.struct({"was": "CAST(0 AS BIGINT)", "begins": "CAST(0 AS BIGINT)", "ends": "CAST(0 AS BIGINT)", "new": "''"})]), "d", "false")
    before = "OVER (PARTITION BY record_id ORDER BY begins, ends DESC, late DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{out}_outer AS (SELECT record_id, begins, ends, new, begins >= coalesce(max(ends) {before}, 0) AS outermost FROM {changes} WHERE new IS NOT NULL),
        {out}_chain AS (SELECT record_id, begins, ends, new, coalesce(lag(ends) OVER (PARTITION BY record_id ORDER BY begins), 0) AS was FROM {out}_outer WHERE outermost),
        {out}_lists AS (SELECT record_id, {e.ordered(edit, 'begins')} AS ed FROM {out}_chain GROUP BY record_id),
        {out}_rows AS (SELECT s.conv_id, s.turn, s.record_id, s.text, s.reason, s.lines, s.cuts, coalesce(c.ed, {empty}) AS ed FROM {rows} s LEFT JOIN {out}_lists c ON c.record_id = s.record_id),
        {out} AS (SELECT conv_id, turn, record_id, reason, CASE WHEN reason <> 'none' THEN '' WHEN cuts = 1 THEN {e.join(parts, ' ')} ELSE {trimmed(edited(e, '0', 'length(text)'))} END AS final_text FROM {out}_rows)"""


def marked(e: Duck, spans: Detector = spanned) -> Groups:
    """edits, quasi and quasi_kinds; and changes(record_id, begins, ends, new, late), those of each record by itself."""
    if type(e) is not Duck:
        return texts.marked(e, spans)
    changes = f"""changes AS (SELECT record_id, begins, ends, new, 0 AS late FROM edits
            UNION ALL SELECT q.record_id, q.begins, q.ends, {mark('q.kind')}, 1 FROM quasi q JOIN quasi_kinds k ON k.record_id = q.record_id AND k.kind = q.kind WHERE k.suppressed)"""
    return [*gated(e, spans), (["edits", "quasi"], f"{edits(e)}, {quasi(e)}"), ([], f"{quasi_kinds(e)}, {changes}")]


def finals(e: Duck) -> Groups:
    """finals(conv_id, turn, record_id, reason, final_text): the text of each record by itself."""
    if type(e) is not Duck:
        return texts.first(e, spanned)
    return [*marked(e), ([], rebuilt(e, "finals", "changes", "screened"))]


def span_dedupe(e: Duck) -> str:
    return f"""WITH {prompts(e)}, {spanned(e)}, s AS (SELECT record_id, text, {e.each('kept')} AS k FROM spanned)
        SELECT record_id, {start(e, 'k')} AS span_start, {start(e, 'k')} + {length(e, 'k')} AS span_end, CAST(k % {RULES} AS BIGINT) AS rule, {value(e, 'k')} AS value FROM s"""


def detect_person_place(e: Duck) -> str:
    return f"SELECT record_id, span_start, CASE WHEN rule = {PERSON} THEN 'PERSON' ELSE 'GPE' END AS kind, value FROM ({span_dedupe(e)}) s WHERE rule >= {PERSON}"


def category_detections(e: Duck) -> str:
    if type(e) is not Duck:
        groups = [*texts.own_texts(e)[:1], (["found_of"], f"{texts.OWN}, {spanned(e)}, {judged(e)}, {categories(e)}, found_of AS (SELECT record_id AS text_id, CAST(idx - 1 AS BIGINT) AS sentence_index, bucket, explode(hit) AS found FROM hits)")]
        return f"WITH {e.steps([*groups, ([], texts.own_records(e))])} SELECT r.record_id, f.sentence_index, f.bucket, f.found FROM records r JOIN found_of f ON f.text_id = r.text_id"
    return f"WITH {prompts(e)}, {spanned(e)}, {judged(e)}, {categories(e)}, c AS (SELECT record_id, CAST(idx - 1 AS BIGINT) AS sentence_index, bucket, {e.each('hit')} AS found FROM hits) SELECT record_id, sentence_index, bucket, found FROM c"


def exclusion_reasons(e: Duck) -> str:
    return f"WITH {base(e)} SELECT record_id, reason, minor, recovered FROM screened"


def redacted_text(e: Duck) -> str:
    return f"WITH {e.steps(finals(e))} SELECT record_id, final_text FROM finals WHERE reason = 'none'"


def pseudonyms(e: Duck) -> str:
    """Number of each name in its conversation, by where it comes first in a record that no gate stopped."""
    if type(e) is not Duck:
        return f"WITH {e.steps(marked(e))} SELECT DISTINCT conv_id, name, concat('[PERSON_', CAST(n AS STRING), ']') AS pseudonym FROM called"
    return f"WITH {base(e)}, {acts(e)[0]} SELECT conv_id, name, concat('[PERSON_', CAST(n AS {e.string}), ']') AS pseudonym FROM numbers"


def qi_edits(e: Duck) -> str:
    """Every quasi-identifier: where it is, and what takes its place if its record has more than three kinds."""
    return f"""WITH {e.steps(marked(e))} SELECT q.record_id, q.kind, q.begins AS span_start, q.ends AS span_end, CASE WHEN k.suppressed THEN {mark('q.kind')} END AS new
        FROM quasi q JOIN quasi_kinds k ON k.record_id = q.record_id AND k.kind = q.kind"""


DEFINITIONS = {f.__name__: f for f in (span_dedupe, detect_person_place, category_detections, exclusion_reasons, redacted_text, pseudonyms, qi_edits)}

from . import texts  # noqa: E402
