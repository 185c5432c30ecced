"""Prompt records as JSON lines: read against a schema with rejects, written line by line, and merged into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "record_id string, conv_id string, turn int, text string, exact_hash string, sim_hash string, captured_at long"
#: The bounds of a request.
LONGEST, EXACT, SIM = 20_000, r"\A[0-9a-f]{64}\z", r"\A[0-9a-f]{16}\z"


def read_prompts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of a JSON-lines file. Rejects have the line and the first rule that it breaks: not_json, unknown_field,
    missing_field, text, turn, exact_hash, sim_hash or duplicate_id (all rows of an id that comes more than once)."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    known = F.array(*map(F.lit, names))
    lines = spark.read.text(path).withColumnRenamed("value", "line").where("trim(line) <> ''")
    keys = F.expr("json_object_keys(line)")
    parsed = lines.withColumn("r", F.from_json("line", SCHEMA)).withColumn("keys", keys)
    twice = F.count(F.lit(1)).over(Window.partitionBy("r.record_id")) > 1
    rules = [
        ("not_json", F.col("keys").isNull()),
        ("unknown_field", F.size(F.array_except("keys", known)) > 0),
        ("missing_field", F.greatest(*(F.col(f"r.{c}").isNull() for c in ("record_id", "conv_id", "turn", "text")))),
        ("text", F.length("r.text") > LONGEST),
        ("turn", F.col("r.turn") < 0),
        ("exact_hash", ~F.col("r.exact_hash").rlike(EXACT)),
        ("sim_hash", ~F.col("r.sim_hash").rlike(SIM)),
    ]
    broken = F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules))
    first = parsed.withColumn("rule", broken)
    good = first.where("rule IS NULL").withColumn("rule", F.when(twice, F.lit("duplicate_id")))
    return good.where("rule IS NULL").select("r.*"), first.where("rule IS NOT NULL").select("line", "rule").unionByName(good.where("rule IS NOT NULL").select("line", "rule"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON record per line, fields in order of the columns, nulls kept."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def insert_new(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The stored rows and those of new keys, one a key; rows of keys that are there already are skipped."""
    return stored.unionByName(rows.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*stored.columns))


def upsert(stored: DataFrame, rows: DataFrame, key: list[str], version: str, final: str = "false") -> DataFrame:
    """For each key the row of greatest version; new rows win ties, and a stored row for which final holds stays."""
    tagged = stored.withColumn("_new", F.lit(0)).withColumn("_final", F.expr(final)).unionByName(rows.select(*stored.columns).withColumn("_new", F.lit(1)).withColumn("_final", F.lit(False)))
    best = Window.partitionBy(*key).orderBy(F.desc_nulls_last("_final"), F.desc_nulls_last(version), F.desc("_new"))
    return tagged.withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*stored.columns)
