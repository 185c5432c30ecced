"""What the policy must do with each prompt of the fixture, written down by hand: SQL of both engines has one source."""

import pytest

from parley import catalogue
from parley.plans.fixtures import PROMPTS

DIR = "/root/testdata/sf0.001"


def at(words):
    return next(i for i, p in enumerate(PROMPTS) if words in p)


@pytest.fixture(scope="module")
def reasons(spark):
    rows = catalogue.queries()["exclusion_reasons"](spark, DIR).collect()
    return {r.record_id % len(PROMPTS): (r.reason, r.minor, r.recovered) for r in rows}


@pytest.fixture(scope="module")
def texts(spark):
    rows = catalogue.queries()["redacted_text"](spark, DIR).collect()
    return {r.record_id % len(PROMPTS): r.final_text for r in rows}


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("password is", ("EXC_LIVE_SECRET", False, False)), ("AKIA", ("EXC_LIVE_SECRET", False, False)), ("a catholic", ("EXC_SPECIAL_CATEGORY", False, False)), ("diagnosed with asthma", ("EXC_SPECIAL_CATEGORY", False, False)),
        ("develops depression", ("none", False, True)), ("has cancer", ("EXC_ATTRIBUTION_AMBIGUOUS", False, False)), ("I'm 16", ("EXC_SPECIAL_CATEGORY", True, False)), ("chemotherapy", ("none", False, False)), ("treats a dragon", ("none", False, False)),
        ("My fingerprint", ("EXC_SPECIAL_CATEGORY", False, False)), ("I am gay", ("EXC_SPECIAL_CATEGORY", False, False)), ("As an Asian woman", ("EXC_SPECIAL_CATEGORY", False, False)), ("My church", ("EXC_SPECIAL_CATEGORY", False, False)),
        ("I voted for", ("EXC_SPECIAL_CATEGORY", False, False)), ("My union", ("EXC_SPECIAL_CATEGORY", False, False)), ("I took a DNA", ("EXC_SPECIAL_CATEGORY", False, False)), ("old mill road", ("none", False, False)), ("A genetic test", ("none", False, False)),
    ],
)
def test_exclusion(reasons, words, want):
    assert reasons[at(words)] == want


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("signed copy", "Please mail the signed copy to [EMAIL] before Friday so that we can start the work."),
        ("Michael Jordan", "My friend [PERSON_1] moved from Ontario to Paris, then to Canada, on 2019. What is a good gift for the new flat there?"),
        ("Albert Einstein", PROMPTS[at("Albert Einstein")]),
        ("clinic called", "My manager wants the report on Monday. How do I write a short and polite note that asks for two more days?"),
        ("jo.lee", "Which games are good for a slow hand and a quick mind?"),
        ("91-year-old", "My grandmother, a 90+-year-old painter from Berlin, keeps all of her old brushes; how are they cleaned best?"),
        ("123-45-6789", "My number is [GOV_ID] and the office wants it on paper, is that still how it is done today?"),
        ("10.20.30.40", "Our server [IP] does not answer to [IP] since 2022, what can we look at first?"),
        ("weather of Paris", PROMPTS[at("weather of Paris")]),
        ("old mill road", "Which trees grow well in the shade of a high wall and need little water?"),
        ("A genetic test", PROMPTS[at("A genetic test")]),
        ("51-year-old", "[OCCUPATION] with three kids, which school in Ontario would you look at first?"),
        ("3/4/21", "I met my friend on [DATE] at the old station, what could we write on the card for the day we met?"),
        ("an engineer", PROMPTS[at("an engineer")]),
    ],
)
def test_redaction(texts, words, want):
    assert texts[at(words)] == want


def test_excluded_texts_are_gone(texts):
    assert at("AKIA") not in texts and at("has cancer") not in texts


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ("51-year-old", {("exact_age", "51", "[AGE]"), ("occupation", "I am a 51-year-old male teacher", "[OCCUPATION]"), ("family_structure", "with three kids", None), ("gender", "I am a 51-year-old male", None), ("geo", "Ottawa", None)}),
        ("an engineer", {("occupation", "I'm an engineer", None)}), ("man who knits", {("gender", "I am a man", None)}), ("above a bakery", {("family_structure", "with three kids", None)}),
        ("Quebec", {("geo", "Quebec", None)}), ("I'm 41", {("exact_age", "41", None)}), ("weather of Paris", set()), ("91-year-old", {("exact_age", "91-year-old", None)}),  # 90 or more is no span of its own, but the pattern tells it
    ],
)
def test_quasi_identifiers(spark, words, want):
    """Ages under 90 and known places that speak of someone; patterns in sentences about their author or a third party; of more
    than three kinds the most telling go."""
    rows = catalogue.queries()["qi_edits"](spark, DIR).collect()
    one = min((r.record_id for r in rows if r.record_id % len(PROMPTS) == at(words)), default=None)
    assert {(r.kind, PROMPTS[at(words)][r.span_start : r.span_end], r.new) for r in rows if r.record_id == one} == want


def test_conversations_are_reworked(spark):
    """Every conversation's verdict from its records' own kinds and outcomes, by a plain version."""
    kinds = {(r.record_id, r.kind) for r in catalogue.queries()["qi_suppression"](spark, DIR).where("not suppressed").collect()}
    first = {r.record_id: r.outcome for r in catalogue.queries()["quality_ceiling"](spark, DIR).collect()}
    conv = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{DIR}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    order = ["rare_attribute", "exact_age", "occupation", "employer", "family_structure", "education", "gender", "geo"]
    seen = set()
    for r in catalogue.queries()["conversation_singling_out"](spark, DIR).collect():
        kept = [i for i, c in conv.items() if c == r.conv_id and first[i] == "kept"]
        bundle = {k for i, k in kinds if i in set(kept)}
        gone = [k for k in order if k in bundle][: len(bundle) - 4] if 5 <= len(bundle) < 8 else []
        touched = [i for i in kept if any((i, k) in kinds for k in gone)]
        assert (r.kinds, r.kept, r.touched) == (len(bundle), len(kept), len(touched)) and r.kept - r.touched <= r.usable <= r.kept
        assert r.verdict == ("as_is" if len(bundle) < 5 else "excluded" if 10 * len(touched) > 4 * len(kept) or r.usable < 2 else "suppressed")
        seen.add(r.verdict)
    assert {"as_is", "suppressed", "excluded"} <= seen


def test_every_outcome_occurs(spark):
    rows = catalogue.queries()["outcome_counts"](spark, DIR).collect()
    assert {"kept", "DROP_TOO_SHORT", "DROP_REDACTION_DENSITY", "EXC_PII_DENSITY", "EXC_LIVE_SECRET", "EXC_SPECIAL_CATEGORY", "EXC_ATTRIBUTION_AMBIGUOUS", "EXC_SINGLING_OUT"} <= {r.outcome for r in rows}


def test_suppressed_kinds_are_gone_from_final_texts(spark):
    texts = {r.record_id: (r.final_text, r.touched) for r in catalogue.queries()["final_texts"](spark, DIR).collect()}
    touched = [(i, t) for i, (t, was) in texts.items() if was]
    assert touched and all("[AGE]" in t for i, t in touched if i % len(PROMPTS) == at("I'm 41"))
    assert any(t.startswith("I'm [AGE] and I never") for _, t in touched)
