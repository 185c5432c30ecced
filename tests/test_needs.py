"""Pre-tests of detectors lose no match, and rows are spread without a second exchange."""

import re

from hypothesis import given
from hypothesis import strategies as st

from parley.functions import needs
from parley.functions.patterns import DETECTORS
from parley.plans.dialect import Spark

PIECES = ["a.b@c.org", "@", "+1 (416) 555-0199", "4165550111", "123-45-6789", "4111 1111-1111 1111", "10.20.30.40", "1.2", "HTTPS://x", "http://a.b", "sk_" + "a1" * 12, "pk_", "AKIA" + "B" * 16, "akia"]
PIECES += ["2021-03-04", "3/4/21", "Jan 5, 2022", "MAY\n7", "I'm\t34", "i am 9", "a 70-year-old", "5 YEAR old", "catholic", "my password is x", " ", "-", ".", "7", "x", "é", ""]


@given(st.lists(st.sampled_from(PIECES), max_size=6).map("".join))
def test_matches_contain_what_they_need(text):
    for _, _, p in DETECTORS:
        if re.search(p, text, re.ASCII):
            assert needs.LITERAL_OF.get(p, "") in text
            assert re.search(needs.PATTERN_OF.get(p, ""), text, re.ASCII)


def test_spans_are_all_matches(spark):
    e = Spark("x")
    texts = [None, *PIECES, " ".join(PIECES), "".join(PIECES)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for _, _, p in DETECTORS:
        assert frame.filter(f"NOT ({e.spans('text', p)} <=> {e.all('text', p)})").count() == 0


def test_screening_moves_rows_once(spark):
    """Prompts go to tasks by their record before they are searched, and what is gathered by record stays there."""
    from parley.operators import screening

    e = Spark("x", 3)
    spark.createDataFrame([(i // 3, i % 3, i, "Write to a@b.org. I am 16.") for i in range(9)], "conv_id long, turn int, record_id long, text string").createOrReplaceTempView("prompts")
    query = f"WITH {screening.spanned(e)}, {screening.judged(e)}, {screening.categories(e)} SELECT conv_id, turn, record_id, count(*) AS n, sum(size(owns)) AS owned FROM hits GROUP BY conv_id, turn, record_id"
    found = spark.sql(query)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    # the stop inside the address ends a sentence too; the address and the age are the spans
    assert sorted(map(tuple, found.select("record_id", "n", "owned").collect())) == [(i, 3, 2) for i in range(9)]
