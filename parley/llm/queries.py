"""The queries opN_<name> over the driver's tables, with production parameters.

Benchmark phrases and clusters have SQL. The others are an index, a model, a digest of formatted text, a closure over links or
periods of whole texts that DuckDB's SQL over whole tables cannot express or not in bearable time. tests/llm holds each
against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A public BPE vocabulary for SentencePiece; a parameter of op6 and of the pipeline.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotraining import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest_chats

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return digest_chats(turns.union(more))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_texts

    out = encode_texts(table(spark, sf_dir, "documents"), MODEL_FILE)
    return out.select("doc_id", "n_pieces", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "round_trip")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"), folds=4, fold=2)


def op10_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=10)


OP11_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
    i AS (SELECT item_id, w, len(w) AS n, least(10, len(w)) AS size FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
    own AS (SELECT DISTINCT item_id, size, array_to_string(w[o:o + size - 1], ' ') AS phrase FROM (SELECT item_id, w, size, unnest(generate_series(1, n - size + 1)) AS o FROM i)),
    sizes AS (SELECT DISTINCT size FROM own),
    spot AS (SELECT row, o, size, array_to_string(w[o:o + size - 1], ' ') AS phrase FROM (SELECT row, w, size, unnest(generate_series(1, n - size + 1)) AS o FROM d, sizes WHERE n >= size)),
    met AS (SELECT row, o, spot.size, item_id FROM spot JOIN own ON own.phrase = spot.phrase AND own.size = spot.size),
    hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(o, o + size - 1)) AS p FROM met) GROUP BY row),
    items AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id FROM met) GROUP BY row)
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit ON hit.row = d.row LEFT JOIN items ON items.row = d.row"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import find_runs, rewritten, run_digests

    return run_digests(find_runs(rewritten(table(spark, sf_dir, "documents"))))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import sort_means

    return sort_means(table(spark, sf_dir, "embeddings"), dims=64, steps=256, k=40, rounds=5)


def _op13_sql(rounds: int = 5) -> str:
    """The clustering as plain k-means: every vector against every centroid in each round."""
    steps = ["""kept AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", "x AS (SELECT row, unnest(q) AS v, unnest(generate_series(1, 64)) AS p FROM kept)", """
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM kept QUALIFY c < 40)"""]
    for r in range(rounds + 1):
        steps += [f"e{r} AS (SELECT c, unnest(q) AS v, unnest(generate_series(1, 64)) AS p FROM c{r})",
                  f"n{r} AS (SELECT row, min(d * 64 + c) AS best FROM (SELECT row, c, CAST(sum((x.v - e.v) * (x.v - e.v)) AS HUGEINT) AS d FROM x JOIN e{r} e ON e.p = x.p GROUP BY row, c) GROUP BY row)",
                  f"a{r} AS (SELECT row, CAST(best % 64 AS INTEGER) AS c, CAST(best // 64 AS BIGINT) AS d FROM n{r})"]
        if r < rounds:
            steps += [f"m{r} AS (SELECT c, p, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM a{r} JOIN x ON x.row = a{r}.row GROUP BY c, p)",
                      f"c{r + 1} AS (SELECT c{r}.c, coalesce(m.q, c{r}.q) AS q FROM c{r} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS q FROM m{r} GROUP BY c) m ON m.c = c{r}.c)"]
    return f"""WITH {', '.join(steps)} SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept ON kept.row = a.row JOIN c{rounds} c ON c.c = a.c"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_additive_quantisation, op2_entropy_mixing, op3_co_training, op4_compression_toxicity, op5_chat_windows)
    every += (op6_sentencepiece, op7_minhash_near_dedup, op8_projection_forest, op9_kneser_ney_language, op10_anchor_pii)
    every += (op11_positional_index, op12_periodic_runs, op13_sort_means)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op11_positional_index": OP11_SQL, "op13_sort_means": _op13_sql()}
