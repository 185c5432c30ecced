"""Benchmark passages in documents, found in a positional inverted index of the documents' words.

The index is partitioned by documents: a segment is some consecutive documents of one task, with one row per distinct word that
lists its places. Places number the words of a segment, with a gap between documents, so that a phrase is found by
lists shifted by the words' offsets, whichever document it is in, and no text and no list is shuffled to build it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, saved

#: Places between two documents; phrases and stretches that are asked for are shorter.
GAP = 256
#: Bytes of text in a segment, and in a piece that is hashed at once; chunks of places by which a place's document is looked up.
SEGMENT, PIECE, CHUNK = 16 << 20, 2 << 20, 1024
#: Rows of keys up to which they are broadcast to the index; beyond, the index is shuffled.
MOST_KEYS = 500_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words, once A-Z are in lower case: 0-9, a-z and all of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
BASE = 0x9E3779B97F4A7C15


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of texts one behind the other: 64-bit hashes of all words, and how many words each text has. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and IN_WORD[LOWER[raw[end]]] and not edge[end]:
            end += 1  # a word is not cut, whatever its length
        low = LOWER[raw[at:end]]
        inside = IN_WORD[low]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[at + 1 : end]
        begins = np.flatnonzero(first)
        if len(begins):
            letters = low[inside].astype(np.uint64)
            word = np.cumsum(first[inside]) - 1
            opens = np.flatnonzero(first[inside])
            place = np.arange(len(letters)) - opens[word]
            power = np.full(int(place.max()) + 1, BASE, np.uint64)
            power[0] = 1
            total = np.add.reduceat((letters + np.uint64(1)) * np.cumprod(power)[place], opens)
            hashes.append(_mixed(total + np.bincount(word).astype(np.uint64)))
            starts.append(begins + at)
        at = end
    every = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.diff(np.searchsorted(every, bounds))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Index:
    """postings (seg, term, n, places) and documents (seg, doc, doc_id, n_words, first: the place of its first word)."""

    postings: DataFrame
    documents: DataFrame


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all words of all whole texts, written once to the shared folder. Each row is a document, whatever its id."""
    schema = "seg long, term long, n int, places array<int>, doc int, doc_id long, n_words long, first int"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    names = ["seg", "term", "n", "places", "doc", "doc_id", "n_words", "first"]

    def segment(seg: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        terms, n = word_hashes(texts)
        first = np.cumsum(n + GAP) - (n + GAP)
        nulls = lambda kind, size: pa.nulls(size, kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), seg)), *(nulls(k, len(n)) for k in kinds[1:4]), pa.array(np.arange(len(n)), pa.int32()), ids, pa.array(n, pa.int64()), pa.array(first, pa.int32())], names)
        if len(terms):
            order = np.argsort(terms, kind="stable")
            terms, place = terms[order], (np.arange(len(terms)) + np.repeat(np.arange(len(n)) * GAP, n)).astype(np.int32)[order]
            begins = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
            for k in range(0, len(begins), 50_000):
                part = begins[k : k + 50_000]
                end = begins[k + 50_000] if k + 50_000 < len(begins) else len(terms)
                lists = pa.ListArray.from_arrays(pa.array(np.append(part, end) - part[0], pa.int32()), pa.array(place[part[0] : end], pa.int32()))
                size = np.diff(np.append(part, end))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), seg)), pa.array(terms[part].view(np.int64)), pa.array(size, pa.int32()), lists, *(nulls(kind, len(part)) for kind in kinds[4:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.columns
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SEGMENT, side="right")))
                yield from segment(seg, ids.slice(at, end - at), texts.slice(at, end - at))
                at, seg = end, seg + 1

    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    stored = saved(rows.mapInArrow(run, schema))
    return Index(stored.where("term is not null").select("seg", "term", "n", "places"), stored.where("term is null").select("seg", "doc", "doc_id", "n_words", "first"))


def _few(keys: DataFrame) -> DataFrame:
    """Keys to look up in the index: broadcast if their number, which is counted, is bounded, and else joined as Spark will."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def _passages(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences (item, terms) of items that have words, and the ids (item, item_id) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, n = word_hashes(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(terms.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "terms"])

    own = items.select(F.coalesce(quoted(item_id).cast("string"), F.lit("null")).alias("item_id"), quoted(text).cast("string").alias("text"))
    own = own.mapInArrow(run, "item_id string, terms array<long>").where("size(terms) > 0")
    own = saved(own.withColumn("item", F.sha2(F.array_join("terms", ",").cast("binary"), 256)))
    return own.select("item", "terms").dropDuplicates(["item"]), own.select("item", "item_id").distinct()


def _windows(passages: DataFrame, index: Index, words: int) -> DataFrame:
    """(item, o, len, terms: their (n, p, term), rarest first) of each window of which the index has all words."""
    placed = saved(passages.select("item", F.posexplode("terms").alias("p", "term")))
    vocabulary = placed.select("term").distinct()
    known = index.postings.select("term", "n").join(_few(vocabulary), "term").groupBy("term").agg(F.sum("n").alias("n"))
    counted = saved(placed.join(saved(known), "term", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
    whole = counted.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("p", "n", "term"))).alias("words"))  # one text's words
    length = F.least(F.size("words"), F.lit(words))
    at = whole.select("item", "words", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("o"))
    ranked = F.array_sort(F.transform(F.slice("words", F.col("o") + 1, F.col("len")), lambda w: F.struct(w["n"].alias("n"), w["p"].alias("p"), w["term"].alias("term"))))
    return saved(at.select("item", "o", "len", ranked.alias("terms")).where(F.col("terms")[0]["n"] > 0))


def _lists(index: Index, terms: DataFrame) -> DataFrame:
    return saved(index.postings.join(_few(terms.distinct()), "term").select("seg", "term", "places"))


def _in_documents(found: DataFrame, index: Index) -> DataFrame:
    """found (seg, place, ...) with the columns doc, first and n_words of the document that the place is in."""
    chunks = F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("first") + F.col("n_words") - 1) / CHUNK))).alias("chunk")
    spans = index.documents.where("n_words > 0").select("seg", "doc", "first", "n_words", chunks)
    held = found.withColumn("chunk", F.floor(F.col("place") / CHUNK)).join(spans, ["seg", "chunk"])
    return held.where("place >= first and place < first + n_words").drop("chunk")


def find_phrases(index: Index, passages: DataFrame, *, words: int = 10) -> DataFrame:
    """(seg, doc, item, start, place, length): stretches of `length` document words from `place` on, words from the passage's word `start`
    on, in which each `words` consecutive ones are a window of the passage (all of a shorter passage).

    Of each window the lists of its two rarest words, shifted by their offsets, are intersected; what is left asks the lists of the other
    words for the places that it needs. Lists of frequent words are read only where two rarer ones already agree.
    """
    windows = _windows(passages, index, words)
    two = windows.select("item", "o", "len", F.col("terms")[0].alias("a"), F.expr("try_element_at(terms, 2)").alias("b"))
    pairs = saved(two.groupBy("item", F.col("a.p").alias("p"), F.col("a.term").alias("term"), F.col("b.p").alias("p2"), F.col("b.term").alias("term2")).agg(F.min("o").alias("lo"), F.max(F.col("o") + F.col("len")).alias("hi")))
    lists = _lists(index, pairs.select("term").union(pairs.where("term2 is not null").select(F.col("term2"))))
    ones = pairs.join(lists, "term").withColumn("starts", F.transform("places", lambda x: x - F.col("p")))
    single = ones.where("p2 is null").select("seg", "item", "lo", "hi", F.explode("starts").alias("start"))
    other = lists.select("seg", F.col("term").alias("term2"), F.col("places").alias("places2"))
    both = saved(ones.where("p2 is not null").drop("places", "term")).join(other, ["seg", "term2"])
    agree = F.array_intersect("starts", F.transform("places2", lambda x: x - F.col("p2")))
    started = saved(single.union(both.select("seg", "item", "lo", "hi", F.explode(agree).alias("start"))))
    # one row for each word that a start needs: windows that share their rarest words are one stretch of the passage
    wanted = started.select("seg", "item", "start", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("p")).distinct()
    terms = passages.select("item", F.posexplode("terms").alias("p", "term"))
    wanted = saved(wanted.join(terms, ["item", "p"]).select("seg", "term", (F.col("start") + F.col("p")).alias("place"), "item", "start", "p"))
    asked = saved(wanted.select("seg", "term", "place").distinct().groupBy("seg", "term").agg(F.collect_list("place").alias("asked")))
    there = index.postings.select("seg", "term", "places").join(_few(asked.select("term").distinct()), "term").join(asked, ["seg", "term"])
    there = saved(there.select("seg", "term", F.explode(F.array_intersect("asked", "places")).alias("place")))
    held = wanted.join(there, ["seg", "term", "place"]).select("seg", "item", "start", "p")
    # islands of consecutive words; a window is a row of `words` of them
    island = F.col("p") - F.row_number().over(Window.partitionBy("seg", "item", "start").orderBy("p"))
    runs = held.withColumn("island", island).groupBy("seg", "item", "start", "island").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("length"))
    least = passages.select("item", F.least(F.size("terms"), F.lit(words)).alias("least"))
    runs = saved(runs.join(least, "item").where("length >= least").select("seg", "item", F.col("p").alias("start"), (F.col("start") + F.col("p")).alias("place"), "length"))
    return _in_documents(runs, index).select("seg", "doc", "item", "start", "place", "length")


def find_near(index: Index, passages: DataFrame, *, words: int = 10, slop: int = 5) -> DataFrame:
    """(seg, doc, item, start, place): windows of passages all of whose distinct words stand, in any order, within a stretch of at most
    `slop` words more than the window has, with the place of the first such stretch around each occurrence of its rarest word.

    Exact occurrences are among them. Places of the rarest word with one of the next rarest near by ask for the others.
    """
    if not 0 <= slop <= GAP - words:
        raise ValueError(f"words and slop are at most {GAP} together")
    windows = saved(_windows(passages, index, words).withColumn("window", F.monotonically_increasing_id()))
    once = F.aggregate("terms", F.array().cast("array<long>"), lambda s, t: F.when(F.array_contains(s, t["term"]), s).otherwise(F.concat(s, F.array(t["term"]))))
    asked = saved(windows.select("window", "item", "o", (F.col("len") + slop).cast("int").alias("span"), once.alias("terms")))
    seeds = asked.select("window", "span", F.col("terms")[0].alias("term"), F.expr("try_element_at(terms, 2)").alias("term2"))
    lists = _lists(index, seeds.select("term").union(seeds.where("term2 is not null").select("term2")))
    ones = saved(seeds.join(lists, "term"))
    other = lists.select("seg", F.col("term").alias("term2"), F.col("places").alias("places2"))
    both = ones.where("term2 is not null").join(other, ["seg", "term2"]).select("window", "seg", "span", "places", "places2")
    single = ones.where("term2 is null").select("window", "seg", "span", "places", F.col("places").alias("places2"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the first list that have one of the second within the span."""
        for batch in batches:
            rows: list[tuple] = []
            for window, seg, span, a, b in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), strict=True):
                near = a[np.searchsorted(b, a + span) > np.searchsorted(b, a - span, side="right")]
                rows.append((np.full(len(near), window), np.full(len(near), seg), near))
            cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["window", "seg", "place"])

    anchors = saved(both.union(single).mapInArrow(close, "window long, seg long, place int"))
    needed = saved(anchors.join(asked, "window").select("seg", "window", "place", "span", F.explode("terms").alias("term")))
    # buckets as wide as the widest span: what is near is in the same one or in one beside it
    wide = words + slop
    reach = needed.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("place") / wide) - 1, F.floor(F.col("place") / wide) + 1)))
    there = index.postings.join(_few(needed.select("term").distinct()), "term").join(needed.select("seg", "term").distinct(), ["seg", "term"], "left_semi")
    there = there.select("seg", "term", F.explode("places").alias("found")).withColumn("bucket", F.floor(F.col("found") / wide))
    met = saved(reach).join(there, ["seg", "term", "bucket"]).where("abs(found - place) < span")
    around = met.groupBy("seg", "window", "place", "span").agg(F.sort_array(F.collect_list(F.struct("found", "term"))).alias("around"))  # at most 2 spans
    around = around.join(asked.select("window", "item", "o", "terms"), "window")
    full = lambda s: F.forall("terms", lambda t: F.exists("around", lambda x: (x["term"] == t) & (x["found"] >= s["found"]) & (x["found"] < s["found"] + F.col("span"))))
    own = lambda s: (s["found"] <= F.col("place")) & (F.col("place") < s["found"] + F.col("span"))
    first = F.array_min(F.transform(F.filter("around", lambda s: own(s) & full(s)), lambda s: s["found"]))
    found = saved(around.select("seg", "item", F.col("o").alias("start"), first.alias("place")).where("place is not null").distinct())
    return _in_documents(found, index).select("seg", "doc", "item", "start", "place")


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (its words inside occurrences of windows), n_items and items_sha256 (the ids of items with
    occurring windows, sorted as strings, comma-joined) and contaminated (n_hit > 0).

    A window is `words` consecutive words of an item; an item of fewer is one window. A-Z are lower-cased; words are letters and digits
    and all characters beyond ASCII, compared by 64-bit hashes, so another phrase would have to agree by chance in each
    of a window's words. Null, empty and blank texts have no words, and such items no windows. Each row is a document of its own,
    with null and repeated ids too; rows of one item id are one item with the windows of each; a null item id is
    named `null`. An empty table of documents gives an empty result, an empty one of items no hits. Other columns are ignored.
    """
    index = build_index(docs, doc_id=doc_id, text=text)
    passages, ids = _passages(items, item_id, item_text)
    found = saved(find_phrases(index, saved(passages), words=words))
    # words inside any occurrence, each once: what a stretch adds behind all that begin before it
    before = Window.partitionBy("seg", "doc").orderBy("place", "end").rowsBetween(Window.unboundedPreceding, -1)
    stretches = found.withColumn("end", F.col("place") + F.col("length")).select("seg", "doc", "place", "end").distinct()
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("place", F.coalesce(F.max("end").over(before), F.col("place"))))
    hit = stretches.withColumn("new", new).groupBy("seg", "doc").agg(F.sum("new").alias("n_hit"))
    named = found.select("seg", "doc", "item").distinct().join(ids, "item").groupBy("seg", "doc").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = index.documents.join(saved(hit), ["seg", "doc"], "left").join(saved(named), ["seg", "doc"], "left")
    n_hit, own = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"), F.sha2(F.array_join(own, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
