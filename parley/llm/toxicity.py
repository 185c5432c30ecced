"""Toxicity by compression: how much better a toxic dictionary compresses a text's windows than an ordinary one."""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import carried, drawn_rows, held_out, in_parts, quoted, saved

Lengths = Callable[[bytes], int]


def lowered(text: str) -> bytes:
    """What is compressed, in learning as in scoring: UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower()


def windows(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def passages(raw: bytes) -> list[bytes]:
    """Word-aligned windows of 24 to some 64 bytes, cut where a word's own hash says so: near copies of a text have equal ones."""
    out, held, size = [], [], 0
    for word in raw.split():
        held.append(word)
        size += len(word) + 1
        if size >= 64 or (size >= 24 and zlib.crc32(word) % 3 == 0):
            out.append(b" " + b" ".join(held) + b" ")
            held, size = [], 0
    return [*out, b" " + b" ".join(held) + b" "] if held else out


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A zstandard dictionary; samples too few to train on are one themselves."""
    try:
        return zs.train_dictionary(size, samples, k=k, d=d, level=3).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))


def lengths(dictionary: bytes) -> Lengths:
    """The compressed length of a window under a dictionary."""
    # deep searches in wide tables: a match that only one of two dictionaries is searched for long enough to find is noise
    p = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_LAZY2, window_log=17, hash_log=17, chain_log=17, search_log=8, min_match=4, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
    compress = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary or b" ", dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p).compress
    return lambda window: len(compress(window))


class Dictionaries:
    """Two dictionaries that zstandard trains, one on windows of ordinary texts and one on windows of toxic texts. The toxic one
    is used with the ordinary one behind it, so that lengths under the two differ by what toxic windows have of their own.

    Most windows of a toxic text are ordinary. So windows are reselected: dictionaries trained on the windows of the other folds
    say which ones are shorter under the toxic side than all but one in a hundred of ordinary ones are, against an equal dictionary of
    the ordinary side; then the same again among those, with the ordinary windows that came through as the other side. The toxic
    dictionary is trained on the windows left. Windows that several texts have count once. Of each side at most `most`
    windows, drawn with a fixed seed, are used, and `base` of them for the ordinary dictionary.
    """

    #: Size and segments (k, d) of the dictionaries that reselect windows, and of the one that is kept.
    SELECT, KEEP = ((8192, 24, 8), (4096, 16, 6)), (1024, 16, 6)

    def __init__(self, toxic: list[str], ordinary: list[str], *, window: int = 96, size: int = 24576, folds: int = 3, most: int = 60_000, base: int = 25_000):
        draw, self.window = random.Random(3), window
        of = lambda texts: list(dict.fromkeys(p for t in texts for p in passages(lowered(t))))
        some = lambda rows, n: rows if len(rows) <= n else draw.sample(rows, n)
        told, clean = some(of(toxic), most), some(of(ordinary), most)
        self.base = trained(some(clean, base), size, 200, 8)
        self.chosen = self._chosen(told, clean, folds, draw)
        self.parts = (self.base, trained(self.chosen * 4, *self.KEEP) + self.base)

    def _chosen(self, toxic: list[bytes], clean: list[bytes], folds: int, draw: random.Random) -> list[bytes]:
        fold = lambda p: zlib.crc32(p) % folds
        sides = (toxic, clean)
        for shape in self.SELECT:
            tools = []
            for f in range(folds):
                b, a = (lengths(self.base + trained([p for p in side if fold(p) != f], *shape)) for side in sides)
                tools.append((a, b))
            gain = lambda p, tools=tools: tools[fold(p)][0](p) - tools[fold(p)][1](p)
            asked = [(gain(p), p) for p in draw.sample(clean, min(len(clean), 10_000))]
            cut = max(2.0, float(np.quantile([g for g, _ in asked], 0.99))) if asked else 2.0
            kept = [p for p in sides[0] if gain(p) >= cut]
            if len(kept) < 20:
                break
            sides = (kept, [p for g, p in asked if g >= cut] * 2 + draw.sample(clean, min(len(clean), 3 * len(kept) + 200)))
        return sides[0]

    def compressors(self) -> list[Lengths]:
        return [lengths(d) for d in self.parts]

    def features(self, text: str, compressors: list[Lengths]) -> list[float]:
        plain, toxic = compressors
        gains = np.sort([plain(w) - toxic(w) for w in windows(lowered(text), self.window)] or [0])[::-1].astype(float)
        over = [math.log1p(int((gains >= least).sum())) for least in (2, 3, 4, 6)]
        return [min(gains[0], 12.0), gains[:3].mean(), gains[:8].mean(), gains.mean(), gains.std(), *over, (gains >= 3).mean(), (gains >= 4).mean(), math.log1p(len(gains))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the intercept) on standardised features, their means and deviations."""
    mean, dev = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z, w = np.c_[(x - mean) / dev, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge * len(x) / 100 * np.eye(len(w)), z.T @ (y - p) - ridge * len(x) / 100 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, dev


def fold_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(f"fold {doc_id}".encode()) % folds


class Model:
    """Dictionaries, and the calibration of a whole text's features, which are taken by dictionaries of other folds for it."""

    def __init__(self, texts: list[tuple[int, int, str]], folds: int = 3):
        """Of (doc_id, label, text); calibrate() has to follow."""
        two = lambda rows: ([t for _, y, t in rows if y], [t for _, y, t in rows if not y])
        self.folds, enough = folds, min(map(len, two(texts))) >= folds
        self.prior = (len(two(texts)[0]) + 0.5) / (len(texts) + 1)
        self.fit: tuple | None = None
        self.apart = [Dictionaries(*two([r for r in texts if fold_of(r[0], folds) != k])) for k in range(folds if enough else 0)]
        self.dictionaries = Dictionaries(*two(texts)) if enough else None

    def calibrate(self, features: list[list[float]], labels: list[int]) -> Model:
        self.apart = []
        if self.dictionaries and 0 < sum(labels) < len(labels):
            self.fit = logistic(np.array(features), np.array(labels, float))
        return self

    def score(self, text: str, tools: list[Lengths]) -> float:
        if self.fit is None:
            return self.prior
        w, mean, dev = self.fit
        z = float((np.array(self.dictionaries.features(text, tools)) - mean) / dev @ w[:-1] + w[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, *, toxic_docs: int = 3000, ordinary_docs: int = 6000, fit_chars: int = 8000) -> Model:
    """A model from a sample of at most about toxic_docs and ordinary_docs labelled texts of every length.

    Dictionaries are trained on the driver. Of a text of more than fit_chars they see sixteen slices of that length in
    all, spread over it, so the parameters bound what reaches the driver. Calibration sees the whole texts where they
    are: tasks tell their features under the dictionaries of the other folds.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    most = F.when(F.col("toxic") == 1, toxic_docs).otherwise(ordinary_docs)
    rows = saved(drawn_rows(docs.where(learn_from & F.col("text").isNotNull()), "toxic", most, marked).select("doc_id", "toxic", "text"))
    step, some = F.length("text") / 16, fit_chars // 16
    slices = F.concat_ws(" ", *(F.substring("text", (step * k + 1).cast("int"), F.lit(some)) for k in range(16)))
    told = rows.select("doc_id", "toxic", F.when(F.length("text") > fit_chars, slices).otherwise(F.col("text")).alias("text")).toPandas().sort_values(["doc_id", "text"])
    model = Model([(int(i), int(y), t) for i, y, t in told.itertuples(index=False)])
    if not model.apart:
        return model.calibrate([], [])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [d.compressors() for d in sent.value.apart]
        for batch in in_parts(batches):
            ids, toxic, texts = (c.to_pylist() for c in batch.columns)
            own = [fold_of(i, sent.value.folds) for i in ids]
            found = [sent.value.apart[k].features(t, tools[k]) for k, t in zip(own, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "toxic", "features"])

    told = rows.repartition(16).mapInArrow(features, "doc_id long, toxic int, features array<double>").toPandas()
    told["key"] = told["features"].map(tuple)
    told = told.sort_values(["doc_id", "key"])
    return model.calibrate(told["features"].tolist(), told["toxic"].tolist())


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7, folds: int = 3, fold: int = 1, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; no text is shuffled but those of the bounded sample.

    Labels (doc_id, toxic) are learned from rows whose crc32(doc_id as text) % folds is not fold. Scores use
    the text alone. A null text is scored as an empty one and not learned from. Rows with a null id are scored and never
    learned from; ids repeated in labels count as toxic if any row says so, texts that share an id are learned from each.
    With fewer than three labels of either kind to learn from the score is the share of toxic ones. An empty table
    gives an empty result. `columns` of docs are passed through, with _ before their names; others are ignored.
    """
    own = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    told = docs.sparkSession.sparkContext.broadcast(learn(own, labels, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)))
    # the text that is scored comes back, it isn't sent once more
    both = text in (columns or []) and docs.schema[text].dataType == StringType()
    passing, fields, inner, passed = carried(docs, [c for c in columns or [] if c != text or not both])
    if both:
        fields, inner = ["text string", *fields], ["text", *inner]
        passed.insert(columns.index(text), F.col("text").alias(f"_{text}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        tools = model.dictionaries.compressors() if model.dictionaries else []
        for batch in in_parts(batches):
            scores = [model.score(t or "", tools) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *batch.columns[1 if both else 2 :]], ["doc_id", "score", *inner])

    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"), *passing)
    out = rows.mapInArrow(run, ", ".join(["doc_id long, score double", *fields]))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", predicted, *passed)
