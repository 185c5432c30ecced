"""Each stage of the pipeline against a plain version over its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_operators import components, links, odd_docs, sets

from parley.llm import pii, queries
from parley.llm.common import saved, table
from parley.llm.mixing import mix
from parley.llm.toxicity import score_toxicity

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, DIR, "documents")]
    for _, stage in cp.STAGES:
        out.append(saved(stage(spark, out[-1], DIR)))
    return out


def rows(frame):
    return Counter(map(tuple, frame.collect()))


def test_stages(spark, steps):
    docs, clean, single, masked, mixed, encoded = steps
    assert all(s.columns == docs.columns for s in steps[:-1])
    bad = {r.doc_id for r in score_toxicity(docs, table(spark, DIR, "labels")).where("predicted = 1").collect()}
    assert rows(clean) == rows(docs.where(~F.col("doc_id").isin(*bad)) if bad else docs)
    texts = {r.doc_id: r.text for r in clean.collect()}
    first = components(texts, links(sets(texts, 5), 80))
    assert rows(single) == rows(clean.where(F.col("doc_id").isin(*{i for i, c in first.items() if i == c})))
    text = {r.doc_id: r.text for r in single.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in masked.collect()} == {i: (m := pii.masked(t, pii.spans(t)), len(m)) for i, t in text.items()}
    times = Counter({r.doc_id: r.copies for r in mix(masked).collect()})
    assert Counter(r.doc_id for r in mixed.collect()) == +times
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    own = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.ids == sp.encode(own[r.doc_id]) for r in encoded.collect()) and encoded.count() == mixed.count()


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), odd_docs(spark).where("false")):
        for _, stage in cp.STAGES[:-1]:
            out = saved(stage(spark, docs, DIR))
            assert out.columns == docs.columns
        assert cp.STAGES[-1][1](spark, docs, DIR).count() == docs.count()


def plain_near(rows_):
    """What the near-duplicate stage must leave of rows (doc_id, text, ...): rows of one id and sequence are a document, and documents
    are linked by their own words, whatever others their id has."""
    words = lambda t: tuple(re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())))
    digest = lambda w: hashlib.sha256(b" ".join(w)).hexdigest()
    documents = sorted({(i, digest(words(t)), words(t)) for i, t, *_ in rows_ if i is not None})
    text = {k: b" ".join(w).decode() for k, (_, _, w) in enumerate(documents)}
    least = components(text, links(sets(text, 5), 80))
    out = Counter((documents[k][0], documents[k][2]) for k in text if least[k] == k)
    return out + Counter((None, words(t)) for i, t, *_ in rows_ if i is None)


def test_stages_keep_contents_of_odd_tables(spark):
    """Nulls, blanks, repeats and clashing or dotted names: every stage's rows are those of a plain version."""
    docs = odd_docs(spark).withColumn("a.b", F.lit("dot")).withColumn("_score", F.lit(2.5))
    told = rows(docs)
    scored = {(r.doc_id, r._text): r.predicted for r in score_toxicity(docs, table(spark, DIR, "labels"), columns=["text"]).collect()}
    clean = rows(cp.without_toxic(spark, docs, DIR))
    assert clean == Counter({r: n for r, n in told.items() if not scored[r[0], r[1]]})
    single = cp.without_near_duplicates(spark, docs, DIR)
    words = lambda t: tuple((t or "").encode().lower().split())
    assert Counter((r.doc_id, words(r.text)) for r in single.collect()) == plain_near([tuple(r) for r in docs.collect()]) and not rows(single) - told
    at, n = docs.columns.index("text"), docs.columns.index("n_chars")
    hidden = lambda t: None if t is None else pii.masked(t, pii.spans(t))
    want = Counter()
    for r, k in told.items():
        t = hidden(r[at])
        want[tuple(t if i == at else (None if t is None else len(t)) if i == n else x for i, x in enumerate(r))] += k
    assert rows(cp.without_personal_data(spark, docs, DIR)) == want
    copies = Counter()
    for r in mix(docs, columns=["text", "a.b"]).collect():
        copies[r.doc_id, r._text] += r.copies
    assert Counter((r.doc_id, r.text) for r in cp.mixed(spark, docs, DIR).collect()) == +copies


def test_repeated_and_null_ids_keep_their_documents(spark):
    docs = [(1, "a b c d e f"), (1, "A  b c\td e f"), (1, "other words that are not linked at all"), (1, None), (1, " "), (2, "a b c d e f"), (3, "alone"), (None, "no id here"), (None, "no id here"), (None, "nor here"), (None, None)]
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, n_chars long")
    got = sorted(r.n_chars for r in cp.without_near_duplicates(spark, frame, DIR).collect())
    assert got == [1, 2, 3, 6, 7, 8, 9, 10]
    again = frame.where("doc_id = 1").union(frame.where("doc_id = 1").withColumn("n_chars", F.col("n_chars") + 100))
    assert sorted(r.n_chars for r in cp.without_near_duplicates(spark, again, DIR).collect()) == [1, 2, 3]


def test_near_copies_of_one_row_leave_other_rows_of_its_id(spark):
    base = [f"w{k}" for k in range(60)]
    t, near, u, v = " ".join(base), " ".join([*base[:-1], "x"]), "something else that nobody copies at all", " ".join(f"v{k}" for k in range(40))
    docs = [(3, t), (7, near), (7, u), (8, v), (9, u), (7, v), (-5, v)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(cp.without_near_duplicates(spark, frame, DIR)) == Counter([(3, t), (7, u), (-5, v)])
    edge = frame.withColumn("doc_id", F.col("doc_id") - F.lit((1 << 63) - 10).cast("long"))
    assert {r.text for r in cp.without_near_duplicates(spark, edge, DIR).collect()} == {t, u, v}
    assert plain_near(docs) == Counter((i, tuple(x.encode().split())) for i, x in ((3, t), (7, u), (-5, v)))


def test_mixing_gives_each_row_its_own_copies(spark):
    rows_ = [({"s1": i, "s2": 7, "s3": None}[s], f"{s} {i} " + "w " * 8, s) for i in range(300) for s in ("s1", "s2", "s3")]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = rows(cp.mixed(spark, frame, DIR))
    by = Counter(r[2] for r in got.elements())
    assert all(abs(by[s] - want) <= 1 for s, want in {"s1": 562.5, "s2": 225, "s3": 112.5}.items())
    assert set(got) <= set(rows_) and got == rows(cp.mixed(spark, frame, DIR))


def test_scoring_gets_each_text_once(spark):
    docs = odd_docs(spark)
    told = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    plan = score_toxicity(docs, told, columns=docs.columns)._jdf.queryExecution().analyzed().toString()
    sent = re.search(r"MapInArrow run\(([^)]*)\)", plan)[1].split(", ")
    assert len(sent) == len(docs.columns) + 1  # all columns, and the id as a number
    binary = docs.withColumn("text", F.col("text").cast("binary"))
    assert rows(score_toxicity(binary, told, columns=["text"]).select(F.col("_text").cast("string"))) == rows(docs.select("text"))


def test_scoring_lets_go_of_the_encoder_that_a_worker_holds(spark):
    def holding(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ == "Encoder" for x in gc.get_objects())]})

    asked = lambda: sum(r.n for r in spark.range(0, 640, 1, 64).mapInArrow(holding, "n long").collect())
    docs = table(spark, DIR, "documents").repartition(64)
    assert cp.encoded(spark, docs, DIR).where("round_trip").count() and asked()
    cp.without_toxic(spark, docs, DIR).write.format("noop").mode("overwrite").save()
    assert not asked()
