"""Briefs, keywords, the quality gate on bundles, and duplicates across contributors."""

import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..plans.dialect import Duck, Spark
from ..plans.fixtures import BRIEFS, briefs, buyers, contribution_parts, contributions
from ..plans.scratch import stored
from . import screening

AS_OF = "2026-01-01"
# They must equal the service's for equal results.
#: Buyer categories and their names.
CATEGORIES = {"ai_lab_commercial": "Commercial AI developer", "ai_research_nonprofit": "Nonprofit AI research organisation", "academic": "Academic / university research", "enterprise_internal": "Company training models for internal use", "data_broker_reseller": "Data platform / licensed reseller"}
#: Jurisdictions that are confirmed; share of prompts that must collide; bits in which near sketches may differ.
CONFIRMED, DUPLICATE_SHARE, NEAR_BITS = ("US", "CA"), 0.5, 3
SCHEDULE, SALTS = "0.1", 64


def phrases() -> list[str]:
    """The distinct keywords of all briefs, of which texts are asked once each; a blank one is never there."""
    return sorted({k for b in BRIEFS for part in ("kw_any", "kw_all", "kw_none") for k in b[part] if k.strip()})


def keywords_in(e: Duck, text: str) -> str:
    """Those of the briefs' keywords that the text has: case-insensitive, between characters that are no letters or digits."""
    special = set(".*+?^${}()|[]\\")
    edge = r"[^\p{L}\p{N}]"
    escaped = {k: r"\s+".join("".join(f"\\{c}" if c in special else c for c in word) for word in k.split()) for k in phrases()}
    there = {k: e.matches(text, f"(?i)(?:^|{edge})(?:{p})(?:$|{edge})") for k, p in escaped.items()}
    if type(e) is Spark:
        there = {k: x.replace("(?i)", "(?iu)") for k, x in there.items()}
    return e.those(e.items([f"CASE WHEN {x} THEN {e.text(k)} END" for k, x in there.items()]), "k", "k IS NOT NULL")


def asked(e: Duck, found: str) -> dict[str, str]:
    """Whether a brief's keywords any, all and none are met; an empty list is."""
    return {
        "any_hit": f"({e.size('b.kw_any')} = 0 OR {e.overlap('b.kw_any', found)})",
        "all_hit": f"({e.size(e.less('b.kw_all', found))} = 0)",
        "none_hit": f"NOT {e.overlap('b.kw_none', found)}",
    }


#: A letter or digit run or one other character, with the blank before it; what follows no blank is glued.
TOKEN = r" ?(?:[\p{L}\p{N}]+|[^\p{L}\p{N} ])"


def tokens(x: str) -> str:
    """Spark SQL: the tokens of a text in lower case, each behind two letters: g if it is glued to the one before, else a blank; w for a
    word, s for another character."""
    told = f'regexp_extract_all(regexp_replace(lower(trim({x})), r"\\s+", " "), r"{TOKEN}", 0)'
    return f"""transform({told}, (t, i) -> concat(CASE WHEN i > 0 AND substr(t, 1, 1) <> ' ' THEN 'g' ELSE ' ' END, CASE WHEN ltrim(t) rlike r"^[\\p{{L}}\\p{{N}}]" THEN 'w' ELSE 's' END, ltrim(t)))"""


def gram(t: str, i: str, k: str) -> str:
    """Spark SQL: k tokens from the i-th on as one text; marked where it begins or ends in the middle of a word, which no phrase does: a
    first or last character that is none of a word must not touch one."""
    begins = f"CASE WHEN substr({t}[{i} - 1], 2, 1) = 's' AND substr({t}[{i} - 1], 1, 1) = 'g' AND substr({t}[{i} - 2], 2, 1) = 'w' THEN '!' ELSE '' END"
    ends = f"CASE WHEN substr({t}[{i} + {k} - 2], 2, 1) = 's' AND {i} + {k} - 1 < size({t}) AND substr({t}[{i} + {k} - 1], 1, 2) = 'gw' THEN '!' ELSE '' END"
    first = lambda x, n, low: x.replace(f"{t}[{n}]", f"get({t}, {low})")
    begins = first(first(begins, f"{i} - 1", f"{i} - 1"), f"{i} - 2", f"{i} - 2")
    ends = first(first(ends, f"{i} + {k} - 2", f"{i} + {k} - 2"), f"{i} + {k} - 1", f"{i} + {k} - 1")
    return f"concat({begins}, substr(array_join(slice({t}, {i}, {k}), ''), 2), {ends})"


def phrase_grams(rows: str) -> str:
    """phrase_grams(phrase, k, gram) of a relation (phrase): each distinct phrase that is not blank as the gram that texts have of it."""
    return f"""phrase_tokens AS (SELECT phrase, inline(array(named_struct('t', {tokens("phrase")}))) FROM (SELECT DISTINCT phrase FROM {rows} WHERE trim(phrase) <> '') p),
        phrase_grams AS (SELECT phrase, size(t) AS k, {gram("t", "1", "size(t)")} AS gram FROM phrase_tokens)"""


def text_grams(rows: str, lengths: list[int]) -> str:
    """text_grams(doc_id, gram) of a relation (doc_id, text): the distinct grams of the lengths that phrases have."""
    each = lambda k: f"CASE WHEN size(t) >= {k} THEN transform(sequence(1, size(t) - {k - 1}), i -> {gram('t', 'i', str(k))}) ELSE array() END"
    return f"""text_tokens AS (SELECT doc_id, inline(array(named_struct('t', {tokens("text")}))) FROM {rows}),
        text_grams AS (SELECT doc_id, explode(array_distinct(concat({', '.join(map(each, lengths))}))) AS gram FROM text_tokens)"""


def phrase_hits(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, phrase): the phrases (phrase) of a table that texts (doc_id, text) have: without regard to case, between characters that are no
    letters or digits, any white space between their words. A blank phrase is never there; a null text has none.

    Phrases are an index of token grams, and texts' grams of the same lengths meet them by equality: no pattern is made from data, no
    text meets a phrase that it does not have, and the work is the texts' tokens whatever the number of phrases."""
    spark = texts.sparkSession
    wanted.select("phrase").createOrReplaceTempView("wanted_phrases")
    grams = stored(spark.sql(f"WITH {phrase_grams('wanted_phrases')} SELECT * FROM phrase_grams"))
    lengths = sorted(r[0] for r in grams.select("k").distinct().collect())  # as many as a keyword of bounded length has tokens
    if not lengths:
        return texts.select("doc_id", F.lit("").alias("phrase")).limit(0)
    texts.where("text IS NOT NULL").select("doc_id", "text").createOrReplaceTempView("searched_texts")
    return spark.sql(f"WITH {text_grams('searched_texts', lengths)} SELECT doc_id, gram FROM text_grams").join(grams, "gram").select("doc_id", "phrase").distinct()


def heard(e: Duck, rows: str) -> str:
    """heard(doc_id, found): the briefs' keywords that the texts of a relation (doc_id, text) have, where there are any."""
    if type(e) is Duck:  # by a pattern for each keyword
        return f"heard AS (SELECT doc_id, {keywords_in(e, 'text')} AS found FROM {rows})"
    lengths = sorted({len(re.findall(r"[^\W_]+|[^\s]", p)) for p in phrases()})
    return f"""asked_for AS (SELECT explode(concat(kw_any, kw_all, kw_none)) AS phrase FROM briefs), {phrase_grams("asked_for")}, {text_grams(rows, lengths)},
        heard AS (SELECT x.doc_id, collect_set(p.phrase) AS found FROM text_grams x JOIN phrase_grams p ON p.gram = x.gram GROUP BY x.doc_id)"""


def keyword_any_all_none(e: Duck) -> str:
    hits = ", ".join(f"{x} AS {k}" for k, x in asked(e, "d.found").items())
    return f"""WITH {briefs(e)}, reached AS (SELECT brief_ref, kw_any, kw_all, kw_none, {e.each("reach")} AS lang FROM briefs),
        texts AS (SELECT doc_id, lang, text FROM {e.table("documents")} WHERE text IS NOT NULL), {heard(e, "texts")},
        d AS (SELECT t.doc_id, t.lang, coalesce(h.found, {e.words([])}) AS found FROM texts t LEFT JOIN heard h ON h.doc_id = t.doc_id)
        SELECT d.doc_id, b.brief_ref, {hits} FROM d JOIN reached b ON b.lang = d.lang"""


def live() -> str:
    return f"status = 'live' AND escrow AND expires > '{AS_OF}' AND category IN ({', '.join(repr(c) for c in CATEGORIES)})"


def paid(e: Duck) -> str:
    """payments_of(brief_ref, payment_status, has_intent): the payment of each brief, as the order of its number says."""
    number = f"CAST(substr(brief_ref, 2) AS BIGINT)"
    return f"payments_of AS (SELECT b.brief_ref, CASE WHEN o.o_orderstatus = 'P' THEN 'pending' ELSE 'paid' END AS payment_status, o.o_totalprice > 50000 AS has_intent FROM briefs b JOIN {e.table('orders')} o ON o.o_orderkey = {number})"


def pushable_briefs(e: Duck) -> str:
    """What a device is sent of live briefs whose payment is verified: reference, category, what is asked for, density, in order."""
    words = ", ".join(f"{e.join(c, '|')} AS {c}" for c in ("languages", "domains", "kw_any", "kw_all", "kw_none"))
    return f"""WITH {briefs(e)}, {paid(e)} SELECT b.brief_ref, b.category, b.min_prompts, b.density, {words} FROM briefs b JOIN payments_of p ON p.brief_ref = b.brief_ref
        WHERE {live().replace("status =", "b.status =")} AND p.payment_status = 'paid' AND p.has_intent ORDER BY b.brief_ref"""


def match_eligibility(e: Duck) -> str:
    """Of each contributor's reported matches those that are let in: to a brief that is live, in escrow, paid and not expired."""
    return f"""WITH {briefs(e)}, {paid(e)}, {contributions(e)} SELECT m.user_id, count(*) AS reported, count(o.brief_ref) AS accepted FROM matches m
        LEFT JOIN (SELECT b.brief_ref FROM briefs b JOIN payments_of p ON p.brief_ref = b.brief_ref WHERE {live().replace("status =", "b.status =")} AND p.payment_status = 'paid' AND p.has_intent) o ON o.brief_ref = m.brief_ref GROUP BY m.user_id"""


def brief_transitions(e: Duck) -> str:
    """Whether each brief may go live: one that is open, not expired, and funded by a payment that is made and has an intent."""
    return f"""WITH {briefs(e)}, {paid(e)} SELECT b.brief_ref, CASE WHEN b.status NOT IN ('draft', 'paused', 'live') THEN 'closed' WHEN b.escrow AND b.expires > '{AS_OF}' AND p.payment_status = 'paid' AND p.has_intent THEN 'may_go_live' ELSE 'blocked' END AS verdict
        FROM briefs b LEFT JOIN payments_of p ON p.brief_ref = b.brief_ref"""


def category_names(e: Duck) -> str:
    """The categories that receipts consent to by their names, with how many receipts each has; null names are none of the list."""
    rows = e.rows("t", ["id", "label"], [f"({e.text(k)}, {e.text(v)})" for k, v in CATEGORIES.items()])
    return f"""WITH {briefs(e)}, {contributions(e)}, each_category AS (SELECT {e.each("categories")} AS category FROM receipts), counted AS (SELECT category, count(*) AS receipts FROM each_category GROUP BY category)
        SELECT c.category, t.label, t.id IS NOT NULL AS known, c.receipts FROM counted c LEFT JOIN {rows} t ON t.id = c.category"""


def briefs_of_buyer(e: Duck) -> str:
    """The newest hundred briefs of one buyer, who sees no others', with how many matches each has."""
    return f"""WITH {briefs(e)}, {contributions(e)} SELECT b.brief_ref, b.status, count(m.doc_id) AS matches FROM briefs b LEFT JOIN matches m ON m.brief_ref = b.brief_ref
        WHERE b.category IN ('ai_lab_commercial', 'enterprise_internal') GROUP BY b.brief_ref, b.status ORDER BY b.brief_ref DESC LIMIT 100"""


def domain_language_filter(e: Duck) -> str:
    """Matches whose bundle is in a language and has a tag that the brief asks for; an empty list asks for none."""
    return f"""WITH {briefs(e)}, {contributions(e)} SELECT m.doc_id, m.brief_ref FROM matches m JOIN briefs b ON b.brief_ref = m.brief_ref JOIN bundles d ON d.doc_id = m.doc_id
        WHERE ({e.size("b.languages")} = 0 OR {e.overlap("b.languages", e.items(["d.language"]))}) AND ({e.size("b.domains")} = 0 OR {e.overlap("d.tags", "b.domains")})"""


#: Three of six blocks of a sketch's bits, (high half, low half): sketches within three bits agree in one of the twenty.
BLOCKS = [(0x7FF << 21, 0), (0x7FF << 10, 0), (0x3FF, 0), (0, 0x7FF << 21), (0, 0x7FF << 10), (0, 0x3FF)]
MASKS = [(a[0] | b[0] | c[0], a[1] | b[1] | c[1]) for a, b, c in combinations(BLOCKS, 3)]


def sketches(e: Duck, texts: str) -> str:
    """sims(exact, hi, lo): the SimHash of each text of a relation (exact, text), in two halves: each bit as most of its
    distinct words' hashes have it. Two counts of 32 bits go into each sum, and sums are partial before they are shuffled."""
    half = {h: e.hex32(f"substr(word_hash, {at}, 8)") for h, at in (("hi", 1), ("lo", 9))}
    sums = ", ".join(f"CAST(sum(((hi >> {j}) & 1) * 4294967296 + ((lo >> {j}) & 1)) AS BIGINT) AS s{j}" for j in range(32))
    bit = lambda part: " + ".join(f"CASE WHEN 2 * ({part.format(s=f's{j}')}) > n THEN {1 << j} ELSE 0 END" for j in range(32))
    words = e.where(e.split("lower(text)", r"\s+"), "x <> ''")
    return f"""tokens AS (SELECT exact, md5(word) AS word_hash FROM (SELECT exact, {e.each(e.distinct(words))} AS word FROM {texts}) w),
        halves AS (SELECT exact, {half["hi"]} AS hi, {half["lo"]} AS lo FROM tokens),
        weighed AS (SELECT exact, count(*) AS n, {sums} FROM halves GROUP BY exact),
        sims AS (SELECT exact, CAST({bit(e.div("{s}", "4294967296"))} AS BIGINT) AS hi, CAST({bit("{s} % 4294967296")} AS BIGINT) AS lo FROM weighed)"""


def near(e: Duck) -> str:
    """nears(user_id, exact): prompts that nobody else had first, but another contributor one like it. Equal sketches are one class
    with its two first contributors; classes meet where they agree in three of six blocks, so buckets stay small at any size."""
    apart = f"bit_count({e.xor('a.hi', 'b.hi')}) + bit_count({e.xor('a.lo', 'b.lo')}) <= {NEAR_BITS}"
    once = f"texts AS (SELECT {e.sha('lower(trim(prompt))')} AS exact, min(lower(trim(prompt))) AS text FROM lines GROUP BY {e.sha('lower(trim(prompt))')})"
    known = f"{once}, {sketches(e, 'texts')}, sketched AS (SELECT p.user_id, p.exact, p.first_at, p.taken, s.hi, s.lo FROM exacts p JOIN sims s ON s.exact = p.exact)"
    if type(e) is Duck:  # every pair
        return f"{known}, nears AS (SELECT DISTINCT b.user_id, b.exact FROM sketched a JOIN sketched b ON a.user_id <> b.user_id AND a.first_at <= b.first_at AND {apart} WHERE NOT b.taken)"
    masks = "array(" + ", ".join(f"named_struct('h', {h}L, 'l', {lo}L)" for h, lo in MASKS) + ")"
    return f"""{known}, ranks AS (SELECT hi, lo, user_id, first_at, row_number() OVER (PARTITION BY hi, lo ORDER BY first_at, user_id) AS k FROM (SELECT hi, lo, user_id, min(first_at) AS first_at FROM sketched GROUP BY hi, lo, user_id) u),
        classes AS (SELECT hi, lo, min(first_at) AS at, min(CASE WHEN k = 1 THEN user_id END) AS by_user, min(CASE WHEN k = 2 THEN first_at END) AS next_at FROM ranks WHERE k <= 2 GROUP BY hi, lo),
        keyed AS (SELECT hi, lo, at, by_user, next_at, inline(transform({masks}, (m, i) -> named_struct('mask', i, 'kh', hi & m.h, 'kl', lo & m.l))) FROM classes),
        close AS (SELECT DISTINCT b.hi, b.lo, a.at, a.by_user, a.next_at FROM keyed a JOIN keyed b ON a.mask = b.mask AND a.kh = b.kh AND a.kl = b.kl AND {apart}),
        nears AS (SELECT DISTINCT p.user_id, p.exact FROM sketched p JOIN close c ON c.hi = p.hi AND c.lo = p.lo WHERE NOT p.taken AND CASE WHEN c.by_user <> p.user_id THEN c.at ELSE c.next_at END <= p.first_at)"""


def near_dups_simhash(e: Duck) -> str:
    """Documents that are another source's but for some words, each source's documents as its prompts: sketches of 64 bits that differ
    in three at the most. What another source had first word for word is no near copy."""
    whole = f"SELECT doc_id, source AS user_id, text AS prompt FROM {e.table('documents')} WHERE text IS NOT NULL"
    return f"WITH {e.steps(print_groups(e, whole))}, {near(e)} SELECT user_id, exact FROM nears"


def simhash_of_documents(e: Duck) -> str:
    return f"WITH whole AS (SELECT {e.sha('text')} AS exact, min(text) AS text FROM {e.table('documents')} WHERE text IS NOT NULL GROUP BY {e.sha('text')}), {sketches(e, 'whole')} SELECT exact, hi, lo FROM sims"


IDENTIFIER = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def prints(e: Duck, lines: str) -> str:
    """Of lines(doc_id, user_id, prompt): prints(user_id, exact, first_at): the first arrival of each prompt from a contributor; own(doc_id, user_id, exact): a bundle's."""
    return ", ".join(text for _, text in print_groups(e, lines))


def print_groups(e: Duck, lines: str) -> screening.Groups:
    """lines, own and exacts, each made from those before it."""
    return [
        (["lines"], f"lines AS ({lines})"),
        (["own"], f"own AS (SELECT DISTINCT doc_id, user_id, {e.sha('lower(trim(prompt))')} AS exact FROM lines)"),
        (["exacts"], """prints AS (SELECT user_id, exact, min(doc_id) AS first_at FROM own GROUP BY user_id, exact),
        firsts AS (SELECT exact, user_id, first_at, row_number() OVER (PARTITION BY exact ORDER BY first_at, user_id) AS k FROM prints),
        earliest AS (SELECT exact, min(first_at) AS at, min(CASE WHEN k = 1 THEN user_id END) AS by_user, min(CASE WHEN k = 2 THEN first_at END) AS next_at FROM firsts WHERE k <= 2 GROUP BY exact),
        exacts AS (SELECT p.user_id, p.exact, p.first_at, coalesce(CASE WHEN e.by_user <> p.user_id THEN e.at ELSE e.next_at END <= p.first_at, false) AS taken FROM prints p JOIN earliest e ON e.exact = p.exact)"""),
    ]


def printed(e: Duck, gate: bool = False) -> screening.Groups:
    """bundles, lines, own and exacts; for the gate receipts, matches, briefs and their buyers too."""
    parts = contribution_parts(e)
    more = [(["briefs"], briefs(e)), (["buyers"], buyers(e)), (["receipts"], parts["receipts"]), (["matches"], parts["matches"])] if gate else []
    return [*more, (["bundles"], parts["bundles"]), *print_groups(e, f"SELECT doc_id, user_id, {e.each('prompts')} AS prompt FROM bundles")]


def judged(e: Duck, gate: bool = False) -> screening.Groups:
    """verdicts(doc_id, own, exact, near): a bundle's distinct prompts, those that another contributor had first, and those that are
    near one that another had first."""
    told = """verdicts AS (SELECT o.doc_id, count(*) AS own, CAST(sum(CASE WHEN x.taken THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN n.exact IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS near
        FROM own o JOIN exacts x ON x.user_id = o.user_id AND x.exact = o.exact LEFT JOIN nears n ON n.user_id = o.user_id AND n.exact = o.exact GROUP BY o.doc_id)"""
    return [*printed(e, gate), (["verdicts"], f"{near(e)}, {told}")]


def exact_dups_cross_source(e: Duck) -> str:
    """A contributor's prompts that another contributor had first, or at the same time. The two first arrivals of a text decide,
    so no text's arrivals meet each other."""
    return f"WITH {e.steps(printed(e))} SELECT user_id, exact, first_at FROM exacts WHERE taken"


def gate_rows(e: Duck) -> str:
    """gate: each match with its brief's buyer, its bundle, the bundle's receipt, duplicate verdict and all codes that it fails, in fixed
    order, joined.

    A match is of (contributor, conversation) and so is its bundle; the receipt is the one that the bundle names. A bundle that is sold is
    not asked again; one that is withdrawn gives no prompts, and neither does a conversation that is not packaged. Without a receipt the
    consent codes after the first are not asked, and no prints are known, so nothing is a duplicate. A brief without a buyer has no gate."""
    masked = e.sub("d.whole", IDENTIFIER, "' [EMAIL] '")
    tokens = e.where(e.split("d.masked", r"\s+"), "x <> ''")
    marks = e.where(tokens, e.matches("x", r"\A\[[A-Z_0-9]+\]\z"))
    hit = asked(e, f"coalesce(d.found, {e.words([])})")  # no text has no keyword
    there = "r.receipt_ref IS NOT NULL"
    codes = [
        ("QA_BRIEF_NOT_LIVE", f"NOT (b.status = 'live' AND b.escrow AND b.expires > '{AS_OF}')"), ("QA_NOT_PACKAGED", "coalesce(d.n_prompts, 0) = 0"), ("QA_NO_CONSENT", "r.receipt_ref IS NULL"), ("QA_CONSENT_REVOKED", f"{there} AND r.revoked"),
        ("QA_CATEGORY_NOT_CONSENTED", f"{there} AND NOT {e.overlap('r.categories', e.items(['b.category']))}"), ("QA_JURISDICTION", f"{there} AND coalesce(r.jurisdiction, '') NOT IN {e.any_of(list(CONFIRMED))}"),
        ("QA_LANGUAGE", f"{e.size('b.languages')} > 0 AND NOT {e.overlap('b.languages', e.items(['coalesce(d.language, ' + repr('und') + ')']))}"),
        ("QA_DOMAIN", f"{e.size('b.domains')} > 0 AND NOT coalesce({e.overlap('d.tags', 'b.domains')}, false)"), ("QA_MIN_PROMPTS", "coalesce(d.n_prompts, 0) < b.min_prompts"),
        ("QA_REDACTION_DENSITY", "coalesce(d.density, 1.0) > b.density"), ("QA_KEYWORDS_ANY", f"NOT {hit['any_hit']}"), ("QA_KEYWORDS_ALL", f"NOT {hit['all_hit']}"),
        ("QA_KEYWORDS_NONE", f"NOT ({hit['none_hit']})"), ("QA_DUPLICATE", "{duplicate}"),
    ]
    failures = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in codes) + ")"
    duplicate = f"{there} AND d.own > 0 AND (d.exact > {DUPLICATE_SHARE} * d.own OR (b.guarantee = 'exact+near' AND d.exact + d.near > {DUPLICATE_SHARE} * d.own))"
    failures = failures.replace("{duplicate}", duplicate)
    kept = "doc_id, user_id, conv_id, record_ref, receipt_ref, language, tags, status, chain_hash, n_prompts, own, exact, near"
    return f"""{e.steps(judged(e, gate=True))},
        joined AS (SELECT b.doc_id, b.user_id, b.conv_id, b.record_ref, b.receipt_ref, b.language, b.tags, b.status, b.chain_hash, CASE WHEN b.status = 'available' THEN {e.size("b.prompts")} ELSE 0 END AS n_prompts,
            CASE WHEN b.status = 'available' THEN {e.join("b.prompts", " ")} ELSE '' END AS whole, v.own, v.exact, v.near FROM bundles b JOIN verdicts v ON v.doc_id = b.doc_id),
        wholes AS (SELECT doc_id, whole AS text FROM joined), {heard(e, "wholes")},
        told AS (SELECT {kept.replace("doc_id", "d.doc_id", 1)}, coalesce(h.found, {e.words([])}) AS found, {e.made({"masked": masked})} FROM joined d LEFT JOIN heard h ON h.doc_id = d.doc_id),
        counted AS (SELECT {kept}, found, {e.made({"n": e.size(tokens), "marks": e.size(marks)})} FROM told d),
        dense AS (SELECT {kept}, found, CASE WHEN n = 0 THEN 1.0 ELSE CAST(marks AS DOUBLE) / n END AS density FROM counted),
        gate AS (SELECT m.doc_id, m.brief_ref, w.legal_name AS buyer, m.user_id, d.record_ref, d.chain_hash, d.n_prompts, round(coalesce(d.density, 1.0), 6) AS density, {failures} AS failures
            FROM matches m JOIN briefs b ON b.brief_ref = m.brief_ref JOIN buyers w ON w.brief_ref = b.brief_ref
            LEFT JOIN dense d ON d.user_id = m.user_id AND d.conv_id = m.conv_id LEFT JOIN receipts r ON r.receipt_ref = d.receipt_ref WHERE coalesce(d.status, '') <> 'sold')"""


def qa_gate(e: Duck) -> str:
    return f"WITH {gate_rows(e)} SELECT doc_id, brief_ref, buyer, density, failures, failures = '' AS passed FROM gate"


def qa_failure_histogram(e: Duck) -> str:
    one = e.each("split(failures, ',')" if type(e) is Spark else "string_split(failures, ',')")
    return f"SELECT code, count(*) AS n FROM (WITH {gate_rows(e)} SELECT {one} AS code FROM gate) c GROUP BY code"


def dedup_status(e: Duck) -> str:
    """The verdict of each bundle. Exact outranks near: more than half of its prompts were another contributor's first, or they and
    those near another's were."""
    return f"""WITH {e.steps(judged(e))} SELECT doc_id, own, exact, near, CASE WHEN exact > {DUPLICATE_SHARE} * own THEN 'exact_duplicate' WHEN exact + near > {DUPLICATE_SHARE} * own THEN 'near_duplicate' ELSE 'new' END AS status FROM verdicts"""


def qa_valuation(e: Duck) -> str:
    """What a bundle is worth to the briefs whose gate it passes: its prompts by length tier, and their cents."""
    n = e.size(e.where(e.split("prompt", P.WS + "+"), "x <> ''"))
    tiers = ", ".join(f"CAST(sum(CASE WHEN tier = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{t}" for t in P.CENTS)
    cents = " + ".join(f"n_{t} * {c}" for t, c in P.CENTS.items())
    return f"""WITH {gate_rows(e)}, passed AS (SELECT doc_id, brief_ref, record_ref, chain_hash FROM gate WHERE failures = ''),
        tiers AS (SELECT doc_id, CASE WHEN n < 10 THEN 'short' WHEN n <= 50 THEN 'medium' ELSE 'long' END AS tier FROM (SELECT doc_id, {n} AS n FROM lines) w),
        worth AS (SELECT doc_id, {tiers} FROM tiers GROUP BY doc_id)
        SELECT p.doc_id, p.brief_ref, p.record_ref, p.chain_hash, {", ".join(f"n_{t}" for t in P.CENTS)}, CAST({cents} AS BIGINT) AS cents, '{SCHEDULE}' AS schedule FROM passed p JOIN worth w ON w.doc_id = p.doc_id"""


def brief_fill(e: Duck) -> str:
    """Of each brief how many bundles pass its gate, by arrival within the brief's target and its cap for one contributor.

    Both tops are taken in two phases: of each of SALTS parts of a contributor's, or a brief's, bundles those that could be within the bound,
    and then of these. So a brief that most bundles pass is ranked by as many tasks as there are, and the last phase gets a bounded number."""
    salt = f"doc_id % {SALTS}"
    top = lambda rows, keys, bound, out: f"{out}_part AS (SELECT *, row_number() OVER (PARTITION BY {keys}, {salt} ORDER BY doc_id) AS in_part FROM {rows}), {out} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id) AS k FROM {out}_part WHERE in_part <= {bound})"
    return f"""WITH {gate_rows(e)}, passed AS (SELECT g.brief_ref, g.user_id, g.doc_id, b.target, b.per_user FROM gate g JOIN briefs b ON b.brief_ref = g.brief_ref WHERE g.failures = ''),
        limited AS (SELECT brief_ref, user_id, doc_id, target, per_user FROM passed WHERE per_user IS NOT NULL), {top("limited", "brief_ref, user_id", "per_user", "own_top")},
        capped AS (SELECT brief_ref, doc_id, target FROM own_top WHERE k <= per_user UNION ALL SELECT brief_ref, doc_id, target FROM passed WHERE per_user IS NULL), {top("capped", "brief_ref", "target", "all_top")},
        counts AS (SELECT brief_ref, count(*) AS eligible FROM capped GROUP BY brief_ref), filled AS (SELECT brief_ref, count(*) AS taken FROM all_top WHERE k <= target GROUP BY brief_ref)
        SELECT c.brief_ref, coalesce(f.taken, 0) AS taken, c.eligible FROM counts c LEFT JOIN filled f ON f.brief_ref = c.brief_ref"""


DEFINITIONS = {f.__name__: f for f in (keyword_any_all_none, pushable_briefs, match_eligibility, brief_transitions, category_names, briefs_of_buyer, domain_language_filter, qa_gate, qa_failure_histogram)}
DEFINITIONS |= {f.__name__: f for f in (qa_valuation, brief_fill, exact_dups_cross_source, near_dups_simhash, simhash_of_documents, dedup_status)}
