"""The corpus pipeline: documents to token ids in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); the caller writes what it returns as Parquet and
reads that as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import quoted, saved, table
from parley.llm.minhash import near_duplicates
from parley.llm.mixing import mix
from parley.llm.pieces import encode_texts
from parley.llm.pii import find_personal_data
from parley.llm.queries import MODEL_FILE
from parley.llm.toxicity import score_toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, each row by itself.

    A null text is scored as an empty one; null and repeated ids, nulls elsewhere and equal rows are scored row by row; other
    columns pass through, whatever they are named. An empty table gives an empty one.
    """
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), columns=docs.columns)
    return scored.where("predicted = 0").select(*(quoted(f"_{c}").alias(c) for c in docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of least id, then of least sequence digest.

    Rows that share an id and a word sequence are one document: the row of least text stays, then of least columns in their order.
    Rows of one id with other words are documents of their own, linked by their own words only, and so are rows with a null id, which
    stay; null, empty and blank texts are near nothing. Nulls in other columns and columns of any name stay as they are. An empty table gives an empty one.
    """
    own, inner = [quoted(c) for c in docs.columns], [f"_{k}" for k in range(len(docs.columns))]
    rows = docs.select(*(c.alias(k) for c, k in zip(own, inner, strict=True)))  # names of our own, whatever theirs are
    named = [F.col(k).alias(c) for k, c in zip(inner, docs.columns, strict=True)]
    doc_id, text = (F.col(inner[docs.columns.index(c)]) for c in ("doc_id", "text"))
    keyed = rows.withColumn("key", doc_id.cast("long"))
    again = saved(keyed.where("key is not null").groupBy("key").count().where("count > 1").select("key"))
    if again.isEmpty():
        gone = near_duplicates(keyed.select("key", text.alias("text")), doc_id="key", words=5, percent=80).where("not kept").select(F.col("doc_id").alias("key"))
        return keyed.join(saved(gone.distinct()).hint("merge"), "key", "left_anti").select(*named)
    # ids that several rows have: each of their word sequences is a document with a key of its own, below all ids or above them
    low, high = keyed.agg(F.min("key"), F.max("key")).first()
    sequence = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase), r"[\x20\x09-\x0D]+", " "))
    twice = keyed.join(again, "key", "left_semi").withColumn("sequence", F.sha2(sequence.cast("binary"), 256))
    first = F.struct(text.alias("text"), *(F.col(k).alias(f"c{k}") for k in inner))
    single = twice.groupBy(F.col("key").alias("id"), "sequence").agg(F.min(first).alias("row"))
    place = F.monotonically_increasing_id() + 1
    single = saved(single.withColumn("key", F.lit(low) - place if low > -(1 << 62) else F.lit(high) + place))
    alone = keyed.join(again, "key", "left_anti")
    found = saved(near_duplicates(alone.select("key", text.alias("text")).union(single.select("key", "row.text")), doc_id="key", words=5, percent=80).where("doc_id is not null").select(F.col("doc_id").alias("key"), "component_id"))
    whose = found.join(single.select("key", "id", "sequence"), "key", "left").select("component_id", F.struct(F.coalesce("id", "key").alias("id"), "sequence", "key").alias("of"))
    kept = saved(whose.groupBy("component_id").agg(F.min("of").alias("of")).select(F.col("of.key").alias("key")))
    out = alone.where("key is null").union(alone.join(kept.hint("merge"), "key", "left_semi").select(*alone.columns)).select(*named)
    stays = single.join(kept.hint("merge"), "key", "left_semi").select(*(F.col(f"row.c{k}").alias(c) for k, c in zip(inner, docs.columns, strict=True)))
    return out.union(stays)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind in brackets, and n_chars as they then are.

    A null text stays null, with null n_chars; every row stays, in any number; other columns pass through, whatever they are
    named. An empty table gives an empty one.
    """
    found = find_personal_data(docs, with_text=True, columns=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    new = {"doc_id": F.col("doc_id"), "text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return found.select(*(new.get(c, quoted(f"_{c}")).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn.

    A null source is a source; rows without words, of null text too, come once; each row of a repeated or null id has copies of
    its own, and of equal rows some. Other columns pass through, whatever they are named. An empty table gives an empty one.
    """
    taken = mix(docs, columns=docs.columns).where("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("time")
    return taken.select(times, *(quoted(f"_{c}") for c in docs.columns)).select(*(quoted(f"_{c}").alias(c) for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip) of every row; a document that the mix takes twice is there twice.

    A null text has null ids, an empty one none; null and repeated ids are told as they are. An empty table gives an empty one.
    """
    return encode_texts(docs, MODEL_FILE)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: No stage but masking could be said in SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
