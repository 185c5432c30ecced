"""An external detector's spans through the cascade: what must come of prompts of the fixture, written down by hand."""

import hashlib

import pytest

from parley import catalogue
from parley.operators import external, screening
from parley.plans.dialect import Spark
from parley.plans.fixtures import PROMPTS

DIR = "/root/testdata/sf0.001"


def at(words):
    return next(i for i, p in enumerate(PROMPTS) if words in p)


def asked(spark, name):
    return catalogue.queries()[name](spark, DIR).collect()


@pytest.fixture(scope="module")
def outcomes(spark):
    return asked(spark, "external_outcomes")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.record_id % len(PROMPTS): r.final_text for r in asked(spark, "external_final_texts") if not r.touched}


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("I work for Northwind", "I work for [EMPLOYER] and my company closes at noon today, how long does the walk to the harbour take from there?"),
        ("44-year-old teacher", "[OCCUPATION] and I work at [EMPLOYER] in Ontario with two children, how do I plan the week so that all of it fits?"),
        ("explain a bridge", "I'm an engineer and I have to explain a [REDACTED] to a class of small children, where would you begin?"),  # a label that nobody knows
        ("The key AKIA", "The key [ID] was in the log file, should it be changed on all of the servers now?"),  # of one span the detector's label holds
        ("123-45-6789", "My number is [GOV_ID] and the office wants it on paper, is that still how it is done today?"),  # the answer's first
        ("old station", "I met my friend on [DATE] at the [LOCATION], what could we write on the card for the day we met?"),
        ("develops depression", PROMPTS[at("develops depression")]),  # a name that is not sure enough
        ("painter from Berlin", "My grandmother, a 90+-year-old painter from Berlin, keeps all of her old brushes; how are they cleaned best?"),  # a place that is not
        ("work for a bank", PROMPTS[at("work for a bank")]),  # the sentence speaks of a manager: no employer of the author's
        ("Albert Einstein", PROMPTS[at("Albert Einstein")]),
    ],
)
def test_final_texts(texts, words, want):
    assert texts[at(words)] == want


def test_outcomes_by_hand(outcomes):
    found = {}
    for r in outcomes:
        found.setdefault(r.record_id % len(PROMPTS), set()).add(r.outcome)
    assert found[at("Fix this.")] == found[at("Mail a@b.co")] == {"EXC_STAGE6_UNAVAILABLE"}
    assert found[at("Invite ann@a.org")] == {"EXC_PII_DENSITY"} and found[at("Tell ann@a.org")] == {"DROP_REDACTION_DENSITY"}
    assert found[at("A catholic choir")] == {"DROP_TOO_SHORT"}  # an unsure membership takes its sentence, which is all there is
    assert found[at("I'm 16")] == {"EXC_SPECIAL_CATEGORY"} and found[at("password is")] == {"EXC_LIVE_SECRET"}  # our own ages and secrets
    assert "EXC_SINGLING_OUT" in {r.outcome for r in outcomes}


def test_employers_are_quasi_identifiers(spark):
    rows = [r for r in asked(spark, "external_quasi") if r.record_id % len(PROMPTS) == at("44-year-old teacher")]
    kinds = {(r.kind, r.suppressed) for r in rows}
    assert kinds == {("exact_age", True), ("occupation", True), ("employer", False), ("family_structure", False), ("geo", False)}


def test_receipts_and_bundles_have_no_unanswered_text(spark, outcomes):
    kept = {}
    for r in outcomes:
        if r.outcome == "kept":
            kept[r.conv_id] = kept.get(r.conv_id, 0) + 1
    assert {r.conv_id: r.prompts for r in asked(spark, "external_receipts")} == kept
    assert {r.conv_id: r.kept for r in asked(spark, "external_bundles")} == kept
    gone = {hashlib.sha256(p.encode()).hexdigest() for p in PROMPTS if len(p) < 12}
    assert not any(g in r.body for g in gone for r in asked(spark, "external_receipts"))


def test_every_age_and_secret_is_told(spark):
    e = Spark("x")
    text = "My password is abc123 and my passcode is xyz789; I am 41, she is a 12-year-old and he is a 95-year-old."
    spark.createDataFrame([(1, 0, 1, text)], "conv_id long, turn int, record_id long, text string").createOrReplaceTempView("one_prompt")
    rows = spark.sql(f"WITH prompts AS (SELECT * FROM one_prompt), {external.spanned(e)}, s AS (SELECT explode(kept) AS k FROM spanned) SELECT k % {screening.RULES} AS rule, {screening.start(e, 'k')} AS b, {screening.length(e, 'k')} AS n FROM s").collect()
    assert sorted((screening.KINDS[r.rule], text[r.b : r.b + r.n]) for r in rows) == [("AGE", "12"), ("AGE", "41"), ("AGE", "95"), ("SECRET", "passcode is xyz789;"), ("SECRET", "password is abc123")]


@pytest.mark.parametrize(
    ("spans", "want"),
    [
        ([("PERSON", 0, 9, 0.9), ("ORGANIZATION", 0, 4, 0.9)], [("PERSON", 0, 9)]),  # the longer of one start
        ([("ORGANIZATION", 5, 20, 0.9), ("PERSON", 0, 9, 0.9)], [("PERSON", 0, 9)]),  # the earlier
        ([("ZEBRA", 3, 8, 0.9), ("PERSON", 3, 8, 0.9)], [("UNKNOWN", 3, 8)]),  # of one place the first answer
        ([("PERSON", 0, 4, 0.2), ("LOCATION", 5, 8, 0.39), ("NRP", 9, 12, 0.34), ("NRP", 13, 15, 0.74), ("NRP", 16, 18, 0.75)], [("WEAK_PERSON", 0, 4), ("BENIGN", 5, 8), ("BENIGN", 9, 12), ("WEAK_NORP", 13, 15), ("NORP", 16, 18)]),
        ([("PERSON", -1, 4, 0.9), ("PERSON", 4, 4, 0.9), ("PERSON", 5, 99, 0.9), ("AGE", 21, 23, 0.1)], [("AGE", 21, 23)]),  # outside, empty, too long; and our own age there
        ([("TIME", 0, 3, 0.9), ("ADDRESS", 4, 6, 0.0)], [("BENIGN", 0, 3), ("ADDRESS", 4, 6), ("AGE", 21, 23)]),
    ],
)
def test_spans_of_both_detectors_are_merged(spark, monkeypatch, spans, want):
    """A table of answers, in order, with the text's own age at 21."""
    text = "one two six ten, I'm 33 now"
    want = want if ("AGE", 21, 23) in want else [*want, ("AGE", 21, 23)]
    spark.createDataFrame([(1, 0, 1, text)], "conv_id long, turn int, record_id long, text string").createOrReplaceTempView("one_prompt")
    spark.createDataFrame([(1, n, *s) for n, s in enumerate(spans)], "record_id long, n long, label string, begins long, ends long, score double").createOrReplaceTempView("one_answer")
    monkeypatch.setattr(external, "answers", lambda e: "runs AS (SELECT record_id FROM prompts), analysed AS (SELECT * FROM one_answer)")
    e = Spark("x")
    rows = spark.sql(f"WITH prompts AS (SELECT * FROM one_prompt), {external.spanned(e)}, s AS (SELECT explode(kept) AS k FROM spanned) SELECT k % {screening.RULES} AS rule, {screening.start(e, 'k')} AS b, {screening.length(e, 'k')} AS n FROM s").collect()
    assert sorted((r.b, screening.KINDS[r.rule], r.b + r.n) for r in rows) == sorted((b, k, x) for k, b, x in want)
