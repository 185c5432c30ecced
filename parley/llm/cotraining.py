"""Quality by co-training: a text view and a metadata view teach each other, then both score every document."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_rows, held_out, quoted
from .toxicity import logistic

WORD_BUCKETS, NAME_BUCKETS = 256, 32


def text_view(text: str) -> list[float]:
    """What the whole text itself shows: lengths, repeats, character kinds, and the shares of its words by hash."""
    words, lines = text.split(), text.split("\n")
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    top = counts.most_common(3)
    letters = sum(map(len, filter(str.isalpha, words)))
    ascii_marks = sum(text.count(c) for c in "|#*{}<>=_/\\~^[]")
    out = [math.log1p(len(words)), math.log1p(chars), chars / n, len(counts) / n, math.log1p(n) * len(counts) / n]
    out += [sum(c for _, c in top) / n, len(set(lines)) / len(lines), math.log1p(len(lines)), letters / chars]
    out += [ascii_marks / chars, sum(map(text.count, "0123456789")) / chars, sum(map(text.count, ".!?")) / n, text.count(",") / n]
    out += [sum(w.isupper() for w in counts) / len(counts) if counts else 0.0, sum(w.istitle() for w in counts) / max(1, len(counts)), len(zlib.compress(text.encode("utf-8", "replace"), 1)) / chars]
    shares = [0.0] * WORD_BUCKETS
    for w, c in counts.items():
        shares[zlib.crc32(w.lower().encode("utf-8", "replace")) % WORD_BUCKETS] += c / n
    return out + shares


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What is told about the page: its source, language and stated length."""
    out = [math.log1p(max(0, n_chars or 0)), float(n_chars is None)] + [0.0] * (2 * NAME_BUCKETS)
    for k, name in enumerate((lang, source)):
        out[2 + k * NAME_BUCKETS + (zlib.crc32(name.encode("utf-8", "replace")) % NAME_BUCKETS if name is not None else 0)] = 1.0
    return out


def chances(fit: tuple, x: np.ndarray) -> np.ndarray:
    w, mean, dev = fit
    return 1 / (1 + np.exp(-np.clip((x - mean) / dev @ w[:-1] + w[-1], -30, 30)))


def logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int, share: float, sure: float) -> list[tuple]:
    """A classifier per view. In each round either view labels those of the pool that it is most sure of, at most
    `share` of it and by the classes' shares, and hands them to the other view's training set."""
    own = [(v, y) for v in views]
    left = [np.arange(len(pool[0])) for _ in views]
    fits = [logistic(x, t) for x, t in own]
    prior = float(y.mean())
    for _ in range(rounds):
        told = []
        for k in (0, 1):
            p = chances(fits[k], pool[k][left[1 - k]]) if len(left[1 - k]) else np.empty(0)
            most = max(1, int(share * len(pool[0])))
            up, down = np.argsort(-p)[: max(1, round(most * prior))], np.argsort(p)[: max(1, round(most * (1 - prior)))]
            told.append((up[p[up] >= sure], down[p[down] <= 1 - sure]))
        for k in (0, 1):
            other, (up, down) = 1 - k, told[k]
            picked = left[other][np.concatenate([up, down])]
            own[other] = (np.concatenate([own[other][0], pool[other][picked]]), np.concatenate([own[other][1], np.r_[np.ones(len(up)), np.zeros(len(down))]]))
            left[other] = np.delete(left[other], np.concatenate([up, down]))
        fits = [logistic(x, t) for x, t in own]
    return fits


class Model:
    """Both views' classifiers, and the calibration that combines their logits, learned across folds."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = 5, share: float = 0.05, sure: float = 0.9, folds: int = 3):
        self.prior = float((y.sum() + 0.5) / (len(y) + 1))
        self.fits = self.joint = None
        if len(y) < 2 * folds or y.min() == y.max():
            return
        fold, z = np.arange(len(y)) % folds, np.zeros((len(y), 2))
        for k in range(folds):
            if y[fold != k].min() < y[fold != k].max():
                fits = co_train([v[fold != k] for v in views], y[fold != k], pool, rounds, share, sure)
                z[fold == k] = np.stack([logits(chances(f, v[fold == k])) for f, v in zip(fits, views, strict=True)], axis=1)
        self.fits, self.joint = co_train(views, y, pool, rounds, share, sure), logistic(z, y)

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.fits is None:
            same = np.full(len(views[0]), self.prior)
            return same, same, same
        own = [chances(f, v) for f, v in zip(self.fits, views, strict=True)]
        return chances(self.joint, np.stack([logits(p) for p in own], axis=1)), *own


def learn(docs: DataFrame, labels: DataFrame, learn_from: F.Column, *, labelled: int = 3000, unlabelled: int = 4000) -> Model:
    """A model from a sample of at most about `labelled` rows of each label and `unlabelled` others, of every length.

    Features are taken where the texts are; only they reach the driver.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("quality"))
    most = F.when(F.col("quality").isNull(), unlabelled).otherwise(labelled)
    rows = drawn_rows(docs.where(learn_from), "quality", most, marked, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            text = [text_view(t) for t in d["text"]]
            about = [metadata_view(*x) for x in zip(d["lang"], d["source"], d["n_chars"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(text, pa.list_(pa.float64())), pa.array(about, pa.list_(pa.float64()))], ["doc_id", "quality", "text", "about"])

    told = rows.mapInArrow(run, "doc_id long, quality int, text array<double>, about array<double>").toPandas()
    told["key"] = told["text"].map(tuple)
    told = told.sort_values(["doc_id", "key"])
    sizes = {"text": len(text_view("")), "about": len(metadata_view(None, None, None))}
    parts = [[np.array(part[c].tolist(), dtype=float).reshape(len(part), sizes[c]) for c in sizes] for part in (told[told["quality"].notna()], told[told["quality"].isna()])]
    return Model(parts[0], (told["quality"].dropna().to_numpy() > 0).astype(float), parts[1]) if len(told) else Model([], np.zeros(0), [])


def score_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars", threshold: float = 0.5, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted, text_score, metadata_score) of every whole text; no text is shuffled.

    Labels (doc_id, quality) are learned from rows whose crc32(doc_id as text) % folds is not fold. A null text
    counts as empty, null metadata as a value of their own. Rows with a null id are scored and never learned
    from; ids repeated in labels are bad if any row says so. Without labels of both kinds all scores are the
    share of good labels. An empty table gives an empty result. Other columns are ignored.
    """
    own = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"), quoted(lang).cast("string").alias("lang"), quoted(source).cast("string").alias("source"), quoted(n_chars).cast("long").alias("n_chars"))
    told = docs.sparkSession.sparkContext.broadcast(learn(own, labels, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                d = part.to_pydict()
                views = [np.array([text_view(t) for t in d["text"]]), np.array([metadata_view(*x) for x in zip(d["lang"], d["source"], d["n_chars"], strict=True)])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, told.value.score(views))], ["doc_id", "score", "text_score", "metadata_score"])

    out = own.mapInArrow(run, "doc_id long, score double, text_score double, metadata_score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_score", "metadata_score")
