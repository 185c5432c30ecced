"""Every query against DuckDB over the smallest tables, and the vectors of the semantics."""

import duckdb
import pytest

from parley import catalogue
from parley.operators import market, valuation
from parley.plans.dialect import TABLES, Duck, Spark

DIR = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, DIR).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def literal(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@pytest.mark.parametrize(("text", "n"), [("", 0), ("   ", 0), ("one", 1), ("a\tb\n c", 3), ("[EMAIL] and [PERSON_1]", 3), ("don't stop", 2), ("déjà vu", 2), ("a b", 2)])
def test_word_count(spark, text, n):
    assert spark.sql(f"SELECT {valuation.words(Spark('x'), literal(text))}").first()[0] == n


def test_briefs_ask_for_keywords(spark):
    """Any, all and none by literal phrases: whole words, special characters, and runs of white space."""
    e = Spark("x")
    text = "The  Apache\nLicense and C++ of der Hund"
    found = spark.sql(f"SELECT {market.keywords_in(e, 't')} FROM (SELECT {literal(text)} AS t)").first()[0]
    assert sorted(found) == ["Apache License", "C++", "and", "der", "the"]


def test_near_duplicates_by_hand(spark):
    """Exact outranks near, the first that comes keeps, one's own prompts are no duplicates, and what is near nobody else's is new."""
    long = [f"word{k}" for k in range(400)]
    other = [f"term{k}" for k in range(400)]
    near_, far = [*long[:-1], "changed"], [*other[:200], *long[:200]]
    rows = [(1, "a", long), (2, "b", long), (3, "c", near_), (4, "a", near_), (5, "a", other), (6, "a", [*other[:-1], "new"]), (7, "b", far)]
    spark.createDataFrame([(i, u, " ".join(w)) for i, u, w in rows], "doc_id long, user_id string, prompt string").createOrReplaceTempView("seven")
    e = Spark("x")
    parts = f"{market.prints(e, 'SELECT * FROM seven')}, {market.near(e)}"
    text = {(u, " ".join(w)): i for i, u, w in rows}
    import hashlib

    name = lambda r: text[next(k for k in text if k[0] == r.user_id and hashlib.sha256(k[1].encode()).hexdigest() == r.exact)]
    taken = {name(r) for r in spark.sql(f"WITH {parts} SELECT user_id, exact FROM exacts WHERE taken").collect()}
    near = {name(r) for r in spark.sql(f"WITH {parts} SELECT user_id, exact FROM nears").collect()}
    assert taken == {2, 4} and near == {3}


def test_gate_by_hand(spark, tmp_path):
    """A match meets its brief's buyer, the bundle of its contributor and conversation, and the receipt that the bundle names."""
    texts = {11: "the token and more", 12: "the token and others", 13: None, 14: "the token and sold", 15: "the token and withdrawn", 16: "the token and more", 17: "the token and more", 18: "the token and abroad", 19: "the token and returned", 20: "the token and cats"}
    source = {16: "b", 17: "c"}
    tables = {
        "documents": ([(i, source.get(i, "a"), "en", t) for i, t in texts.items()], "doc_id long, source string, lang string, text string"),
        "orders": ([(1, 5, "O", "1-URGENT"), (11, 1, "O", "1-URGENT"), (14, 1, "P", "1-URGENT"), (15, 1, "F", "5-LOW"), (16, 1, "O", "1-URGENT"), (18, 2, "O", "2-HIGH"), (19, 1, "O", "3-MEDIUM"), (20, 1, "O", "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "customer": ([(1, "one", 0), (2, "two", 1), (5, "buyer", 1)], "c_custkey long, c_name string, c_nationkey long"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey long, n_regionkey long"),
        "region": ([(0, "AMERICA"), (1, "ASIA")], "r_regionkey long, r_name string"),
        "lineitem": ([(19, "R"), (11, "R"), (11, "N")], "l_orderkey long, l_returnflag string"),
    }
    for name, (of, schema) in tables.items():
        spark.createDataFrame(of, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = catalogue.queries()["qa_gate"](spark, str(tmp_path)).collect()
    nothing = ["QA_MIN_PROMPTS", "QA_REDACTION_DENSITY", "QA_KEYWORDS_ANY", "QA_KEYWORDS_ALL"]
    assert {(r.brief_ref, r.buyer) for r in found} == {("b1", "buyer")}  # no other brief has a buyer
    assert {r.doc_id: [c for c in r.failures.split(",") if c] for r in found} == {
        11: [], 12: ["QA_NO_CONSENT"], 13: ["QA_NOT_PACKAGED", "QA_NO_CONSENT", "QA_LANGUAGE", "QA_DOMAIN", *nothing], 15: ["QA_NOT_PACKAGED", "QA_CATEGORY_NOT_CONSENTED", *nothing],
        16: ["QA_DUPLICATE"], 17: ["QA_NO_CONSENT"], 18: ["QA_JURISDICTION"], 19: ["QA_CONSENT_REVOKED"], 20: ["QA_CATEGORY_NOT_CONSENTED"],
    }


def test_dashboard_by_hand(spark):
    """Each payment's allocations and entries as the whole ledger has them."""
    found = {r.payment_id: r for r in catalogue.queries()["funding_dashboard"](spark, DIR).collect()}
    orders = {r.o_orderkey: r for r in spark.read.parquet(f"{DIR}/orders.parquet").collect()}
    newest = sorted(orders.values(), key=lambda r: (r.o_orderdate, r.o_orderkey), reverse=True)[:100]
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{DIR}/customer.parquet").collect()}
    assert {i: r.buyer for i, r in found.items()} == {r.o_orderkey: names[r.o_custkey] for r in newest}
    entries = {}
    for r in catalogue.queries()["ledger_top20_of_payment"](spark, DIR).collect():
        entries.setdefault(r.payment_id, []).append(f"{r.kind}:{r.cents}")
    for i, r in found.items():
        assert sorted(r.entries.split(",") if r.entries else []) == sorted(entries.get(i, []))
        own = [x.split(":") for x in r.allocations.split(",") if x]
        assert sum(int(c) for s, c in own if s in ("reserved", "transferring", "review")) == r.reserved and sum(int(c) for s, c in own if s in ("transferred", "reversing")) == r.transferred
    assert any(r.entries for r in found.values()) and any(r.allocations for r in found.values())


def test_simhash_is_a_majority_of_words(spark, duck):
    import hashlib

    texts = ["a b c", "the quick brown fox jumps over the lazy dog", "x"]
    e = Spark("x")
    rel = " UNION ALL ".join(f"SELECT {literal(t)} AS exact, {literal(t)} AS text" for t in texts)
    for r in spark.sql(f"WITH r AS ({rel}), {market.sketches(e, 'r')} SELECT exact, hi, lo FROM sims").collect():
        words = {hashlib.md5(w.encode()).hexdigest()[:16] for w in r.exact.split()}
        want = sum(1 << b for b in range(64) if 2 * sum(int(w, 16) >> b & 1 for w in words) > len(words))
        assert (r.hi << 32 | r.lo) == want


VECTORS = [("Please DEBUG it", "debug", True), ("the debugger", "debug", False), ("a  stack   trace here", "stack trace", True), ("rewrite my résumé please", "résumé", True), ("résumés", "résumé", False), ("anything", " ", False)]
VECTORS += [("uses c++ daily", "c++", True), ("c++11 is old", "c++", False), ("(C++)", "c++", True), ("c + + is not", "c++", False), ("x.y", "y", True), ("d&d night", "D&D", True), ("mad&d", "d&d", False), ("a ++ b", "++", True), ("a++ b", "++", False), ("+++", "++", True), ("end\nstack\ttrace", "STACK  TRACE ", True), ("stack-trace", "stack trace", False), ("", "x", False)]


def test_phrases_of_a_table(spark):
    """The vectors that devices and the gate share, and edges, all asked at once: each text has those phrases that are marked for it."""
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(VECTORS)] + [(99, None)], "doc_id long, text string")
    wanted = spark.createDataFrame([(w,) for _, w, _ in VECTORS] * 2, "phrase string")
    found = {(r.doc_id, r.phrase) for r in market.phrase_hits(texts, wanted).collect()}
    for i, (_, w, there) in enumerate(VECTORS):
        assert ((i, w) in found) == there, VECTORS[i]
    assert market.phrase_hits(texts, wanted.limit(0)).count() == 0


def test_ten_thousand_phrases_are_an_equi_join(spark):
    """Random phrases against texts: what a regular expression for each would find, by a plan without one, and without nested loops."""
    import random
    import re

    rnd = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("la", "mo", "né", "ti")]
    phrases = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(10_000)]
    docs = [(i, " ".join(rnd.choice(words).upper() if rnd.random() < 0.3 else rnd.choice(words) for _ in range(30)) + rnd.choice(["", "!", "x"])) for i in range(20)]
    found = market.phrase_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.doc_id, r.phrase) for r in found.collect()}
    assert got == {(i, p) for i, t in docs for p in set(phrases) if re.search(rf"(?<!\w){p}(?!\w)", t, re.IGNORECASE)}


@pytest.mark.parametrize(("n", "tier"), [(9, "short"), (10, "medium"), (50, "medium"), (51, "long")])
def test_tier_edges(spark, n, tier):
    assert spark.sql(f"SELECT {valuation.tier(str(n))}").first()[0] == tier


def test_hmac(spark):
    import hashlib
    import hmac

    assert spark.sql(f"SELECT {Spark('x').hmac('key', literal('message'))}").first()[0] == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()
    assert duckdb.sql(f"SELECT {Duck().hmac('key', literal('message'))}").fetchall()[0][0] == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()


def test_money_is_conserved(spark):
    for r in catalogue.queries()["fund_balances"](spark, DIR).where("available <> 0").collect():
        assert r.funded == r.available + r.reserved + r.transferred + r.refunded + r.refund_pending


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
