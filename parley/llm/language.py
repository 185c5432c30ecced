"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_rows, held_out, quoted

WORDS = re.compile(r"[^\W\d_]+")
ORDER, START, END = 4, 2, 3


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For all characters of all words, each with its end mark: the word's number, the place, and by order k the
    hash of the k characters that end at each place. Words begin with ORDER start marks, so no gram crosses them."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(size + ORDER + 1) - (size + ORDER + 1)
    codes = np.full(int((size + ORDER + 1).sum()), START, np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    codes[np.arange(len(flat)) + (owner + 1) * ORDER + owner] = flat
    codes[starts + ORDER + size] = END
    places = np.flatnonzero((np.arange(len(codes)) - np.repeat(starts, size + ORDER + 1)) >= ORDER)
    hashes, h = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64)
    for k in range(1, ORDER + 1):
        h = h + np.concatenate((np.zeros(k - 1, np.uint64), codes[: len(codes) - k + 1])) * np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64))
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes.append(x ^ (x >> np.uint64(29)) ^ np.uint64(k))
    return np.repeat(np.arange(len(words)), size + 1), places, hashes


def at_keys(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return i, (keys[i] == asked) if len(keys) else np.zeros(len(asked), bool)


def kneser_ney(words: Counter) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By order: sorted gram hashes with log probabilities, sorted context hashes with log back-off weights."""
    owner, places, hashes = grams(list(words))
    weight = np.fromiter(words.values(), np.float64, len(words))[owner]
    at, count, levels = places, weight, []
    for k in range(ORDER, 0, -1):  # counts at the top, below the numbers of distinct grams that end so
        keys, first, inverse = np.unique(hashes[k][at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, count)
        at = at[first]
        levels.append((k, keys, at, count))
        count = np.ones(len(at))
    out, below = [], None
    for k, keys, at, count in reversed(levels):
        context, inverse = np.unique(hashes[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64), return_inverse=True)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = np.bincount(inverse, count), np.bincount(inverse)
        back = discount * kinds / total
        lower = np.full(len(at), 1 / (len(keys) + 1)) if below is None else np.exp(below[1][at_keys(below[0], hashes[k - 1][at])[0]])
        p = np.maximum(count - discount, 0) / total[inverse] + back[inverse] * lower
        below = (keys, np.log(p), context, np.log(back))
        out.append(below)
    return out


class Models:
    """One table per order over the grams of all languages; a column per language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs, counted = sorted(texts), {}
        for lang in self.langs:
            counted[lang] = Counter(w for t in texts[lang] for w in WORDS.findall(t.lower()))
        self.langs = [x for x in self.langs if counted[x]]
        built = [kneser_ney(counted[x]) for x in self.langs]
        self.orders = []
        for k in range(ORDER if built else 0):
            keys, contexts = (np.unique(np.concatenate([b[k][i] for b in built])) for i in (0, 2))
            p, back = np.full((len(keys), len(built)), np.nan, np.float32), np.zeros((len(contexts), len(built)), np.float32)
            for j, b in enumerate(built):
                p[np.searchsorted(keys, b[k][0]), j], back[np.searchsorted(contexts, b[k][2]), j] = b[k][1], b[k][3]
            self.orders.append((keys, p, contexts, back))
        self.unseen = np.array([-np.log(len(b[0][0]) + 1) for b in built], np.float32)
        self.reject = {}
        for j, lang in enumerate(self.langs):  # calibration: hardly any text of the language itself is less likely
            own = [c for t in texts[lang] if (c := self.cross_entropy(t)) is not None]
            self.reject[lang] = float(np.quantile([c[0][j] for c in own], 0.999) * 1.1) if own else float("inf")

    def of_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word by language."""
        owner, places, hashes = grams(words)
        out = np.full((len(places), len(self.langs)), np.nan, np.float32)
        back = np.zeros_like(out)
        rest = np.arange(len(places))
        for k in range(ORDER, 0, -1):
            keys, p, contexts, weights = self.orders[k - 1]
            i, there = at_keys(keys, hashes[k][places[rest]])
            got = np.where(there[:, None], p[i], np.nan)
            new = np.isnan(out[rest]) & ~np.isnan(got)
            out[rest] = np.where(new, got + back[rest], out[rest])
            rest = rest[np.isnan(out[rest]).any(axis=1)]
            i, there = at_keys(contexts, hashes[k - 1][places[rest] - 1] if k > 1 else np.zeros(len(rest), np.uint64))
            back[rest] += np.where(there[:, None], weights[i], 0)
        out = np.where(np.isnan(out), back + self.unseen, out)
        sums = np.zeros((len(words), len(self.langs)))
        np.add.at(sums, owner, out)
        return sums

    def cross_entropy(self, text: str, known: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, int] | None:
        """Nats per character by language, and the number of characters; None without letters."""
        words = Counter(WORDS.findall(text.lower()))
        if not any(c.isalpha() for w in words for c in w):
            return None
        total = self.of_words(list(words)) * np.fromiter(words.values(), float)[:, None]
        n = sum((len(w) + 1) * c for w, c in words.items())
        return -total.sum(axis=0) / n, n


def learn(docs: DataFrame, learn_from: F.Column, *, fit_docs: int = 1500, fit_chars: int = 8000) -> Models:
    """Models from a sample of at most about fit_docs texts of each language, of every length.

    Of a text of more than fit_chars the models see sixteen slices of that length in all, spread over it; the parameters
    bound what reaches the driver by the number of languages.
    """
    rows = drawn_rows(docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()), "lang", F.lit(fit_docs))
    step, some = F.length("text") / 16, fit_chars // 16
    slices = F.concat_ws(" ", *(F.substring("text", (step * k + 1).cast("int"), F.lit(some)) for k in range(16)))
    told = rows.select("doc_id", "lang", F.when(F.length("text") > fit_chars, slices).otherwise(F.col("text")).alias("text"))
    told = told.toPandas().sort_values(["lang", "doc_id", "text"])
    return Models({k: g["text"].tolist() for k, g in told.groupby("lang")})


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2, reject: bool = False, undetermined: str = "und", known_words: int = 300_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every whole text; no text is shuffled.

    The language of least cross-entropy per character; characters are predicted within their word, so a
    word's log probabilities are looked up once and kept (known_words at the most, then forgotten). Learned
    from rows with a language whose crc32(doc_id as text) % folds is not fold. score is the share of the best
    in the likelihoods, tempered to at most 40 characters. rejected: even the best language finds the text
    less likely than it does hardly any text of its own; with reject the answer is then undetermined too.

    A null text, one without letters, or no language to learn gives undetermined with score 0. Rows with a
    null id are answered and never learned from. Ties go to the first language by name. An empty table gives
    an empty result. Other columns are ignored.
    """
    own = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"), quoted(lang).cast("string").alias("lang"))
    told = docs.sparkSession.sparkContext.broadcast(learn(own, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = told.value
        places: dict[str, int] = {}
        scores = np.zeros((0, len(models.langs)))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, out = batch.slice(i, 512), []
                found = [WORDS.findall(t.lower()) if t and models.langs else [] for t in part.column(1).to_pylist()]
                if len(places) > known_words:
                    places, scores = {}, scores[:0]
                new = list({w for words in found for w in words}.difference(places))
                places.update(zip(new, range(len(places), len(places) + len(new)), strict=True))
                if new:
                    scores = np.concatenate([scores, *(models.of_words(new[j : j + 20000]) for j in range(0, len(new), 20000))])
                for words in found:
                    if not any(c.isalpha() for w in words for c in w):
                        out.append((undetermined, 0.0, False))
                        continue
                    n = sum(map(len, words)) + len(words)
                    entropy = -scores[[places[w] for w in words]].sum(axis=0) / n
                    best = int(np.argmin(entropy))
                    share = 1 / np.exp(-(entropy - entropy[best]) * min(n, 40)).sum()
                    odd = entropy[best] > models.reject[models.langs[best]]
                    out.append((undetermined if odd and reject else models.langs[best], float(share), bool(odd)))
                preds, shares, odds = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(preds, pa.string()), pa.array(shares, pa.float64()), pa.array(odds)], ["doc_id", "lang_pred", "score", "rejected"])

    out = own.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score", "rejected")
