"""Briefs as JSON lines with nested bounds; updates under a condition; the rows that every store begins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prompts import insert_new

# They must equal the service's for equal results.
DOMAINS, LANGUAGES, GUARANTEES = ("coding", "writing", "business", "education", "general"), ("en",), ("exact", "exact+near")
MOST_DOMAINS, MOST_WORDS, LONGEST_WORD, MOST_PROMPTS, MOST_CONVERSATIONS = 30, 100, 120, 1000, 1_000_000
SCHEMA = """brief_ref string, spec struct<domains: array<string>, languages: array<string>, keywordsAny: array<string>, keywordsAll: array<string>, keywordsNone: array<string>, minPromptsPerConversation: int>,
    quality struct<maxRedactionDensity: double, dedupGuarantee: string>, volume struct<targetConversations: int, maxPerContributor: int>, expiresAt string"""
FIELDS = {"": ["brief_ref", "spec", "quality", "volume", "expiresAt"], "spec": ["domains", "languages", "keywordsAny", "keywordsAll", "keywordsNone", "minPromptsPerConversation"], "quality": ["maxRedactionDensity", "dedupGuarantee"], "volume": ["targetConversations", "maxPerContributor"]}


def broken_rules(as_of: str) -> list[tuple[str, Column]]:
    """The rules of a parsed brief r of line `line`, in the order in which they are asked: what is true is broken."""

    def unknown(part: str) -> Column:
        keys = F.expr("json_object_keys(line)" if not part else f"json_object_keys(get_json_object(line, '$.{part}'))")
        return F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS[part])))) > 0

    def bad_words(name: str) -> Column:
        words = F.col(f"r.spec.{name}")
        return words.isNull() | (F.size(words) > MOST_WORDS) | F.exists(words, lambda w: w.isNull() | (F.length(w) > LONGEST_WORD))

    def bad_set(name: str, most: int, known: tuple[str, ...]) -> Column:
        items = F.col(f"r.spec.{name}")
        return items.isNull() | (F.size(items) > most) | F.exists(items, lambda x: x.isNull() | ~x.isin(*known))

    within = lambda c, low, high: F.col(c).isNull() | ~F.col(c).between(low, high)
    per_user = F.col("r.volume.maxPerContributor")
    return [
        ("not_json", F.expr("json_object_keys(line)").isNull()),
        ("unknown_field", F.coalesce(unknown("") | unknown("spec") | unknown("quality") | unknown("volume"), F.lit(False))),
        ("missing_field", F.col("r.spec").isNull() | F.col("r.quality").isNull() | F.col("r.volume").isNull() | F.col("r.brief_ref").isNull()),
        ("domains", bad_set("domains", MOST_DOMAINS, DOMAINS)),
        ("languages", bad_set("languages", 1, LANGUAGES)),
        ("keywords", bad_words("keywordsAny") | bad_words("keywordsAll") | bad_words("keywordsNone")),
        ("min_prompts", within("r.spec.minPromptsPerConversation", 1, MOST_PROMPTS)),
        ("density", within("r.quality.maxRedactionDensity", 0.0, 1.0)),
        ("guarantee", F.col("r.quality.dedupGuarantee").isNull() | ~F.col("r.quality.dedupGuarantee").isin(*GUARANTEES)),
        ("volume", within("r.volume.targetConversations", 1, MOST_CONVERSATIONS) | (per_user.isNotNull() & ~per_user.between(1, MOST_CONVERSATIONS))),
        ("expires", F.expr("try_cast(r.expiresAt AS timestamp)").isNull()),
        ("expired", F.expr("try_cast(r.expiresAt AS timestamp)") <= F.lit(as_of).cast("timestamp")),
        ("empty_lists", (F.size("r.spec.domains") == 0) | (F.size("r.spec.languages") == 0)),
    ]


def checked_briefs(lines: DataFrame, as_of: str) -> DataFrame:
    """(line, r, rule) of lines of JSON: the parsed brief, and the first rule that it breaks; null where it breaks none."""
    parsed = lines.where("trim(line) <> ''").withColumn("r", F.from_json("line", SCHEMA))
    return parsed.withColumn("rule", F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in broken_rules(as_of))))


def read_briefs(spark: SparkSession, path: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of a JSON-lines file of briefs; rejects have the line and the rule."""
    told = checked_briefs(spark.read.text(path).withColumnRenamed("value", "line"), as_of)
    return told.where("rule IS NULL").select("r.*"), told.where("rule IS NOT NULL").select("line", "rule")


def update_where(stored: DataFrame, changes: DataFrame, key: list[str], condition: str) -> DataFrame:
    """The stored rows with the values of changes (key and some columns) where the condition on the stored row holds; others stay,
    and changes of keys that are not there are dropped."""
    new = [c for c in changes.columns if c not in key]
    side = changes.select(*key, *(F.col(c).alias(f"_new_{c}") for c in new), F.lit(True).alias("_there"))
    joined = stored.withColumn("_may", F.coalesce(F.expr(condition), F.lit(False))).join(side, key, "left")
    applies = F.col("_may") & F.coalesce("_there", F.lit(False))
    return joined.select(*(F.when(applies, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in stored.columns))


def seeded(users: DataFrame, briefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and briefs with an administrator, a buyer and a brief, unless they are there: to run it again changes nothing."""
    spark = users.sparkSession
    first = spark.createDataFrame([("admin@example.org", "admin"), ("buyer@example.org", "buyer")], "email string, role string")
    brief = spark.createDataFrame([("brf_seed", "buyer@example.org", "draft")], "brief_ref string, buyer string, status string")
    return insert_new(users, first, ["email"]), insert_new(briefs, brief, ["brief_ref"])


def brief_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brief a part, as JSON made of its columns, and the rule that each breaks."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    spec = F.struct(
        F.when(F.col("p_size") > 45, F.array(F.lit("cooking"))).when(F.col("p_size") > 40, F.array().cast("array<string>")).otherwise(F.array(F.lit("coding"))).alias("domains"),
        F.array(F.lit("en")).alias("languages"), F.array("p_name").alias("keywordsAny"), F.array().cast("array<string>").alias("keywordsAll"), F.array().cast("array<string>").alias("keywordsNone"),
        F.col("p_size").alias("minPromptsPerConversation"),
    )
    quality = F.struct((F.col("p_size") / 38).alias("maxRedactionDensity"), F.lit("exact").alias("dedupGuarantee"))
    volume = F.struct((F.col("p_size") - 3).alias("targetConversations"), F.lit(None).cast("int").alias("maxPerContributor"))
    line = F.to_json(F.struct(F.concat(F.lit("brf_"), F.col("p_partkey")).alias("brief_ref"), spec.alias("spec"), quality.alias("quality"), volume.alias("volume"), F.when(F.col("p_size") == 7, "2001-01-01T00:00:00Z").otherwise("2030-01-01T00:00:00Z").alias("expiresAt")))
    told = checked_briefs(part.select("p_partkey", line.alias("line")), "2026-01-01")
    return told.select("p_partkey", F.coalesce("rule", F.lit("valid")).alias("verdict"))


#: The same by the columns themselves.
BRIEF_INGEST_SQL = """SELECT p_partkey, CASE WHEN p_size > 45 THEN 'domains' WHEN p_size NOT BETWEEN 1 AND 1000 THEN 'min_prompts' WHEN p_size > 38 THEN 'density' WHEN p_size - 3 < 1 THEN 'volume'
    WHEN p_size = 7 THEN 'expired' WHEN p_size > 40 THEN 'empty_lists' ELSE 'valid' END AS verdict FROM part"""
