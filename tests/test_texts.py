"""Each different text is searched and rewritten once, whatever the number of records; where all texts differ, results are those of SQL too."""

import duckdb
import pytest

from parley import catalogue
from parley.operators import external, policy, provenance, screening, texts
from parley.plans import fixtures
from parley.plans.dialect import TABLES, Duck, Spark, runs

DIR = "/root/testdata/sf0.001"
#: What finds, rewrites or counts in texts.
SEARCHES = ("regexp_extract_all", "regexp_replace", "rlike", "split(")


@pytest.mark.parametrize("name", ["external_bundles", "external_outcomes", "external_receipts", "redacted_text", "qi_types", "quality_ceiling", "record_identifiers", "category_detections", "external_final_texts", "external_actions", "external_quasi", "datasheet"])
def test_only_tables_of_different_texts_are_searched(name):
    """No statement that reads records searches texts; those that search read the tables of different texts, edits and versions."""
    e = Spark("x")
    last = catalogue.DEFINITIONS[name](e)
    searching = [view for view, text in e.todo.items() if any(s in text for s in SEARCHES)]
    assert {view.split("_x_")[0] for view in searching} <= {"screened_texts", "found_of", "edits_of", "quasi_of", "first_of", "second_of", "keyed"} and searching
    for view in searching:
        assert "FROM orders_x" not in e.todo[view] or view.startswith("keyed")  # keyed is the fixture's own detector
    assert not any(s in last for s in ("regexp_extract_all", "regexp_replace", "rlike"))


@pytest.mark.parametrize("name", ["external_bundles", "external_receipts", "external_actions", "final_texts", "datasheet", "pseudonyms", "attestations", "category_detections"])
def test_texts_that_all_differ(spark, monkeypatch, name):
    """Two in three texts are their record's own, the others many records'."""

    def own(e):
        many = fixtures.prompts(e).replace("prompts AS (", "many AS (", 1)
        return f"{many}, prompts AS (SELECT conv_id, turn, record_id, captured, CASE WHEN record_id % 3 = 0 THEN text ELSE concat(text, ' It is number ', CAST(record_id AS {e.string}), ' of them.') END AS text FROM many)"

    for module in (external, policy, provenance, screening, texts):
        monkeypatch.setattr(module, "prompts", own, raising=False)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    define = catalogue.DEFINITIONS[name]
    want = con.execute(define(Duck())).df()
    found = runs(define)(spark, DIR).toPandas()
    plain = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist()), key=repr)
    assert len(want) and plain(found) == plain(want)
