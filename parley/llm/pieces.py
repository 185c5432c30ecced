"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single Viterbi pass."""

from __future__ import annotations

import re
import weakref
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_parts, quoted, shared

SPACE = "\u2581"
#: Text between blanks: a run of blanks belongs to what follows it.
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters above which a chunk is cut before it is encoded, and not kept.
LONG = 64


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ((4 if kind == 5 else 8), at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and settings of a model file: unigram or BPE, with identity normalisation."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.bytes: dict[int, int] = {}
        self.unknown, self.normal, self.own, self.bpe, self.prefix, self.squeeze = 0, [], [], False, True, True
        for field, value in _fields(raw):
            if field == 1:
                piece, score, kind = "", 0.0, 1
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, np.float32)[0])
                    elif f == 3:
                        kind = v
                i = len(self.pieces)
                self.pieces.append(piece)
                self.scores.append(score)
                if kind == 1:
                    self.normal.append(i)
                elif kind == 4:
                    self.own.append(i)
                elif kind == 2:
                    self.unknown = i
                elif kind == 6:
                    self.bytes[int(piece[3:5], 16)] = i
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(1, b"identity") != b"identity" and spec.get(2):
                    raise ValueError("only identity normalisation is supported")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))


class Known(dict):
    """The ids of chunks met of late, found by the encoder when first asked for. When `size` are there they become the old ones
    and those before are forgotten; an old chunk that is asked for again is there anew. Very long ones are not kept."""

    def __init__(self, encoder: Encoder, before: str, size: int):
        # the encoder has this table: a proxy, so that it goes as soon as its worker drops it
        self.encoder, self.before, self.size, self.old = weakref.proxy(encoder), before, size, {}

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.old.get(chunk)) is None:
            ids = self.encoder.found_ids(self.before + chunk)
        if len(chunk) <= LONG:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes and decodes; what chunks between blanks give is kept for `known` chunks, those asked for of late."""

    def __init__(self, vocabulary: Vocabulary, known: int = 500_000):
        v = self.v = vocabulary
        self.found = ahocorasick.Automaton()
        for i in v.normal:
            if len(v.pieces[i]) > 1 or not v.bpe:  # merging starts from single characters, so they need not be found
                self.found.add_word(v.pieces[i], (i, len(v.pieces[i])))
        self.found.make_automaton()
        self.ids = {v.pieces[i]: i for i in v.normal}
        #: user-defined pieces stand for themselves wherever they are, the longest first, and nothing is merged across them
        self.own = {v.pieces[i]: i for i in v.own}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")") if self.own else None
        self.sizes, self.many = [len(p) for p in v.pieces], len(v.pieces)
        self.single = {p: i for p, i in self.ids.items() if len(p) == 1}
        #: no piece has a blank after its first other character, so chunks can be encoded apart
        self.apart = not any(SPACE in v.pieces[i].lstrip(SPACE) for i in v.normal)
        self.type = np.uint16 if len(v.pieces) <= 1 << 16 else np.int32
        self.code = np.dtype(self.type).char
        #: chunks that stand for what they are with a blank before them, and all others; twice the size with the old ones
        self.cache, self.others = Known(self, SPACE, known * 2 // 5), Known(self, "", known // 10)
        self.known, self.told = known // 2, {}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        order = sorted((i for i in v.normal if len(v.pieces[i]) > 1), key=lambda i: (-v.scores[i], i))
        #: when merging makes a piece; single characters are there from the start
        self.time = {i: 0 for i in v.normal} | {i: k + 1 for k, i in enumerate(order)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.worst = min((v.scores[i] for i in v.normal), default=0.0) - 10
        high = {i for b, i in v.bytes.items() if b > 127}
        self.high = np.array([i in high for i in range(len(v.pieces) + 1)])
        #: the last stands for every id that is no piece
        self.texts = [*(p.replace(SPACE, " ") for p in v.pieces), "\ufffd"]
        for b, i in v.bytes.items():
            self.texts[i] = chr(b)

    def normalised(self, text: str) -> str:
        if self.v.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", SPACE)
        return SPACE + text if self.v.prefix and text else text

    def encode(self, text: str) -> np.ndarray:
        text = self.normalised(text)
        if self.cut:
            parts = self.cut.split(text)
            return np.concatenate([np.array([self.own[p]], self.type) if k % 2 else self.between(p) for k, p in enumerate(parts)])
        return self.between(text)

    def between(self, text: str) -> np.ndarray:
        """The ids of a normalised text without user-defined pieces."""
        if not self.apart:
            got = [self.others[text]] if text else []
        elif text[:1] == SPACE and text[-1] != SPACE and SPACE * 2 not in text:
            got = map(self.cache.__getitem__, text[1:].split(SPACE))
        else:
            got = map(self.others.__getitem__, CHUNKS.findall(text))
        return np.frombuffer(b"".join(got), self.type)

    def found_ids(self, text: str) -> bytes:
        """The ids of a chunk. A long one is cut between two characters that no piece has side by side, and its parts are kept."""
        if len(text) > LONG:
            pairs = self.pairs
            cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in pairs]
            if cuts:
                return b"".join([self.others[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
        return array(self.code, self.viterbi(text)).tobytes()

    def unknown(self, text: str) -> list[int]:
        return [self.v.bytes[b] for b in text.encode("utf-8", "replace")] if self.v.bytes else [self.v.unknown]

    def viterbi(self, text: str) -> list[int]:
        """The path of best score, in one pass over the automaton's matches.

        The automaton's output links give all pieces that end at a place, longest first, and each relaxes the place's
        best score by that of the place where it begins and its own (`step`). Where no piece ends, a character is an
        unknown node of a score below all pieces'.

        A unigram model's piece scores its log probability. A BPE model's path scores minus the number of its borders
        that merging would not leave between the two pieces there: merging's own path is the one path of score 0, and its
        part up to any place is that of the text up to there, so one best score a place suffices for it too. As every place
        has a path of score 0, only matches that keep it at 0 are followed, up to the first; what scores less could not last.
        """
        if self.v.bpe:
            return self.path(text, self.merged(text))
        n, single = len(text), self.single
        last, best, done = [-1] * (n + 1), [0.0] + [-1e18] * n, 0
        alone = [] if single.keys() >= set(text) else [k for k, c in enumerate(text) if c not in single]
        scores = self.v.scores
        for end, (i, size) in self.found.iter(text):
            to = end + 1
            while alone and done < len(alone) and alone[done] < end:
                self.alone(alone[done], last, best)
                done += 1
            score = best[to - size] + scores[i]
            if score > best[to]:
                best[to], last[to] = score, i
        for k in alone[done:]:
            self.alone(k, last, best)
        return self.path(text, last)

    def merged(self, text: str) -> list[int]:
        """The last piece of the path of score 0 to each place of a BPE model's text; -1 at the start and behind unknown characters.
        Where no longer piece keeps it at 0, the single character does."""
        single, told, many = self.single, self.told, self.many
        last, done = [-1, *[single.get(c, -1) for c in text]], -1
        for end, (i, size) in self.found.iter(text) if len(self.found) else ():
            if end == done:
                continue
            before = last[end - size + 1]
            if before >= 0:
                if (gain := told.get(before * many + i)) is None:
                    gain = self.step(before, i)
                if gain:
                    continue
            last[end + 1], done = i, end
        return last

    def alone(self, k: int, last: list[int], best: list[float]) -> None:
        """Relaxes the place behind character k, which is no piece of its own."""
        score = best[k] + self.worst
        if score > best[k + 1]:
            best[k + 1], last[k + 1] = score, -1

    def step(self, before: int, i: int) -> float:
        """BPE models: 0 if merging leaves piece i behind the piece `before` as the two are, else -1. It is remembered."""
        if len(self.told) >= self.known:
            self.told.clear()
        fits = self.told[before * self.many + i] = 0.0 if self.joined(before, i) else -1.0
        return fits

    def path(self, text: str, last: list[int]) -> list[int]:
        out, place, sizes = [], len(text), self.sizes
        while place:
            i = last[place]
            if i >= 0:
                out.append(i)
                place -= sizes[i]
            else:
                place -= 1
                out += reversed(self.unknown(text[place]))
        out.reverse()
        return out

    def halves(self, i: int) -> tuple[int, int]:
        """The two pieces that merging joins last to make piece i."""
        if i not in self.parts:
            words = list(self.v.pieces[i])
            while len(words) > 2:  # plain merging, best first and leftmost among equals
                tries = [(self.time[self.ids[w]], k) for k in range(len(words) - 1) if (w := words[k] + words[k + 1]) in self.ids]
                if not tries:
                    break
                k = min(tries)[1]
                words[k : k + 2] = [words[k] + words[k + 1]]
            self.parts[i] = (self.ids.get(words[0], -1), self.ids.get(words[-1], -1))
        return self.parts[i]

    def joined(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a and b gives just these two.

        Undoes the merges at their border, the last first. Had the two pieces that then meet there a merge
        that comes before the one undone, it would have been made.
        """
        pieces, ids, time = self.v.pieces, self.ids, self.time
        limit = len(time) + 1
        while True:
            if a < 0 or b < 0:
                return True
            both = ids.get(pieces[a] + pieces[b])
            if both is not None and time[both] < limit:
                return False
            if time[a] > time[b]:
                limit, a = time[a], self.halves(a)[1]
            elif time[b]:
                limit, b = time[b] + 1, self.halves(b)[0]
            else:
                return True

    def decode(self, ids: np.ndarray) -> str:
        v, texts = self.v, self.texts
        if len(ids) and (ids.min() < 0 or ids.max() >= self.many):
            ids = np.where((ids < 0) | (ids >= self.many), self.many, ids)
        if len(ids) and self.high[ids].any():
            values, out, raw = {i: b for b, i in v.bytes.items()}, [], bytearray()
            for i in ids.tolist():
                if i in values:
                    raw.append(values[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw = bytearray()
                out.append(texts[i])
            out.append(raw.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join(map(texts.__getitem__, ids.tolist()))
        return text[1:] if v.prefix and text.startswith(" ") else text


def encoder_of(raw: bytes) -> Encoder:
    return Encoder(Vocabulary(raw))


def encode_texts(docs: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip): piece ids of every whole text; no shuffle.

    The ids are those of SentencePiece for the model file, unigram or BPE, with identity normalisation and user-defined pieces.
    round_trip: decoding gives the text again; it fails only for a text that has the blank mark U+2581 itself,
    or, with a model that squeezes blanks, several. A null text has null ids, an empty one none. Null and
    repeated ids are told as they are; an empty table gives an empty result. Other columns are ignored.
    The driver reads the model file, and its vocabulary, a fixed size, is broadcast.
    """
    with open(model_file, "rb") as f:
        told = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(encoder_of, told.value)
        for part in in_parts(batches, sharing=True):
            texts = part.column(1).to_pylist()
            ids = [None if t is None else encoder.encode(t) for t in texts]
            same = [None if t is None else encoder.decode(x) == t for t, x in zip(texts, ids, strict=True)]
            ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *(x for x in ids if x is not None)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in ids]))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "round_trip"])

    own = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode_ids(encoded: DataFrame, model_file: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of piece ids. Null ids give a null text, no ids an empty one; an id that is null or outside the vocabulary
    gives U+FFFD. Null and repeated doc_ids are told as they are, an empty table gives an empty result, other columns are ignored."""
    with open(model_file, "rb") as f:
        told = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(encoder_of, told.value)
        for batch in in_parts(batches, sharing=True):
            texts = [None if x is None else encoder.decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
