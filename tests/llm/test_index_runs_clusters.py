"""The positional index, periodic runs and exact clusters against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from parley.llm import clusters, contamination, periodic, queries
from parley.llm.common import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


# --- benchmark decontamination


def plain_contamination(docs, items, size=10):
    """doc row -> (n_words, n_hit, item ids), every window against every place."""
    out = []
    for text in docs:
        own = words_of(text)
        hit, ids = set(), set()
        for item, t in items:
            w = words_of(t)
            k = min(size, len(w))
            for o in range(len(w) - k + 1 if w else 0):
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == w[o : o + k]:
                        hit |= set(range(p, p + k))
                        ids.add("null" if item is None else str(item))
        out.append((len(own), len(hit), sorted(ids)))
    return out


def made_docs():
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["Über", "ÉCOLE", "the", "the", "the", "of"]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passages = [some(draw.choice([3, 9, 10, 11, 25, 40])) for _ in range(12)]
    items = [(k, " ".join(p).upper() if k % 3 == 0 else ", ".join(p)) for k, p in enumerate(passages)]
    items += [(3, " ".join(passages[4])), (None, "alone"), (None, " ".join(passages[5][:12])), (99, None), (98, ""), (97, " .. - "), (96, " ".join(passages[2])), (95, "the the the the the the the the the the the")]
    docs = []
    for k in range(60):
        text = some(draw.choice([0, 1, 5, 30, 80]))
        for p in draw.sample(passages, draw.choice([0, 0, 1, 2, 3])):
            cut = draw.randrange(0, 4)
            text += p[cut:] + some(draw.choice([0, 1, 3]))
        docs.append((k % 50, " ".join(text)))
    docs += [(None, " ".join(passages[4])), (None, None), (7, ""), (7, " \n"), (8, "the " * 30), (9, "ALONE"), (9, "alone-alone"), (10, "x" * 5000 + " " + "; ".join(passages[6]))]
    docs += [(11, " ".join(passages[3][:9])), (12, " ".join(passages[3][9:]))]  # neighbours: no phrase runs from one to the next
    return docs, items


@pytest.mark.parametrize("segment", [16 << 20, 700])
def test_phrases_equal_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(contamination, "SEGMENT", segment)
    monkeypatch.setattr(contamination, "PIECE", segment // 3)
    docs, items = made_docs()
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, seg string, `item.term` string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc int")
    found = contamination.contamination(frame, asked).collect()
    told = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found)
    plain = plain_contamination([t for _, t in docs], items)
    want = sorted((str(i), n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0) for (i, _), (n, hit, ids) in zip(docs, plain, strict=True))
    assert told == want
    assert sum(w[5] for w in want) > 10


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination.contamination(docs, items).collect() == []
    some = spark.createDataFrame([(5, "a b c")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination.contamination(some, items.limit(0)).collect()] == [(3, 0, False)]
    assert [(r.n_words, r.n_hit, r.n_items) for r in contamination.contamination(some, items).collect()] == [(3, 3, 1)]


def test_beyond_the_bound_keys_are_joined(spark, monkeypatch):
    monkeypatch.setattr(contamination, "MOST_KEYS", 0)
    docs, items = made_docs()
    found = contamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plain = plain_contamination([t for _, t in docs], items)
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in found.collect()) == sorted((n, hit, len(ids)) for n, hit, ids in plain)


def test_near_windows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(contamination, "SEGMENT", 2000)
    draw = random.Random(8)
    vocabulary = [f"v{k}" for k in range(14)]
    docs = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 4, 40])))) for k in range(40)]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(n))) for k, n in enumerate([4, 5, 6, 1, 2])]
    index = contamination.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    passages, ids = contamination._passages(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    near = contamination.find_near(index, passages, words=4, slop=2).join(ids, "item").join(index.documents.select("seg", "doc", "doc_id"), ["seg", "doc"])
    found = {(r["doc_id"], r["item_id"], r["start"]) for r in near.collect()}
    want = set()
    for i, t in docs:
        own = t.split()
        for item, text in items:
            w = text.split()
            k = min(4, len(w))
            for o in range(len(w) - k + 1):
                if any(set(w[o : o + k]) <= set(own[p : p + k + 2]) for p in range(len(own))):
                    want.add((i, str(item), o))
    assert found == want and len(want) > 30


def test_word_hashes_equal_words():
    import pyarrow as pa

    texts = ["Aa aa ÄÖ äö x1", None, "", "a" * 100, "-a-b-", "€uro1 a.b", "ab cd" * 50]
    hashes, n = contamination.word_hashes(pa.array(texts)[:])
    plain = [w for t in texts for w in words_of(t)]
    assert n.tolist() == [len(words_of(t)) for t in texts]
    assert len(hashes) == len(plain) and len(set(hashes.tolist())) == len(set(plain)) == len(set(zip(hashes.tolist(), plain, strict=True)))
    assert contamination.word_hashes(pa.array(texts)[3:5])[0].tolist() == hashes[5:8].tolist()


# --- periodic runs


def plain_runs(ids, least=12):
    """By definition: for each period, stretches that keep it and no neighbour extends, unless a smaller period fits."""
    ids, out = list(ids), []
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            s, length = i, j - i + q
            if length >= max(least, 2 * q) and not any(all(ids[k] == ids[k + d] for k in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    draw = random.Random(2)
    for n in (0, 1, 11, 12, 13, 40, 90):
        for letters in (1, 2, 3, 9):
            yield [draw.randrange(letters) for _ in range(n)]
    for _ in range(60):
        out = []
        while len(out) < draw.choice([30, 120]):
            unit = [draw.randrange(3) for _ in range(draw.choice([1, 2, 5, 7, 12]))]
            out += (unit * 6)[: draw.randrange(1, 6 * len(unit))]
        yield out


def test_runs_equal_their_definition():
    n = 0
    for ids in sequences():
        found = periodic.periodic_runs(np.array(ids, np.int64))
        assert found == plain_runs(ids), ids
        n += len(found)
    assert n > 60


def test_lag_counts_of_heavy_and_light_words():
    draw = np.random.default_rng(4)
    for n, letters in ((5000, 2), (5000, 40), (3000, 3000), (700, 5), (20, 2)):
        ids = np.where(draw.random(n) < 0.4, 0, draw.integers(1, letters + 1, n))
        ids = np.unique(ids, return_inverse=True)[1]
        assert periodic.lag_counts(ids).tolist() == [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, n // 2 + 1)]


def test_long_and_uniform_texts_take_bounded_time():
    same = np.zeros(60_000, np.int64)
    assert periodic.periodic_runs(same) == [(0, 60_000, 1)]
    noise = np.random.default_rng(1).integers(0, 2, 20_000)
    assert all(n < 60 for _, n, _ in periodic.periodic_runs(noise))
    long = np.tile(np.random.default_rng(2).permutation(5_000), 3)
    assert periodic.periodic_runs(long) == [(0, 15_000, 5_000)]


def plain_query(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    number = {x: k for k, x in enumerate(dict.fromkeys(w))}
    runs = plain_runs([number[x] for x in w])
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (str(doc_id), len(runs), *told, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_equals_plain_version(spark):
    own = table(spark, SMALL, "documents").collect()
    texts = [(r["doc_id"], r["text"]) for r in own if len(r["text"] or "") < 4000]
    unit = "ö b c \x1cd e"  # blanks beyond ASCII and control characters are in words
    texts += [(None, "a b " * 20), (None, None), (3, None), (3, ""), (3, " \t\n"), (4, "la " * 40), (4, "la " * 40), (5, f"{unit} " * 9 + "x"), (6, "one"), (6, "x" * 20000)]
    frame = spark.createDataFrame([(i, t, "r", 2) for i, t in texts], "doc_id long, text string, runs string, words int").repartition(3)
    found = periodic.run_digests(periodic.find_runs(periodic.rewritten(frame))).collect()
    told = sorted((str(r["doc_id"]), *list(r)[1:]) for r in found)
    want = sorted(plain_query(i, t) for i, t in texts)
    assert sorted(map(repr, told)) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 10
    assert periodic.find_runs(frame.limit(0)).collect() == []


def test_runs_and_texts_are_real(spark):
    frame = spark.createDataFrame([(1, "go  on\n" + "na nee " * 8 + "stop")], "doc_id long, text string")
    row = periodic.find_runs(frame).first()
    assert [tuple(r) for r in row["runs"]] == [(2, 16, 2)] and row["collapsed"] == "go on na nee stop"


# --- clusters


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) < 2**27]
    digest = lambda i: (0, hashlib.sha256(f"2:{i}".encode()).hexdigest()) if i is not None else (1, "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    told = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, j in told:
        inertia[j] = inertia.get(j, 0) + d
    text = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(repr((i, j, d, inertia[j], sum(inertia.values()), text(j))) for i, d, j in told)


@pytest.mark.parametrize("grain", [1.0, 0.25])
def test_clusters_equal_plain_k_means(spark, grain):
    draw = np.random.default_rng(6)
    # a coarse grain makes many ties; a third of the rows are equal
    rows = [(i, (np.round(draw.normal(size=64) / grain) * grain / 2).astype(np.float32).tolist()) for i in range(240)] + [(i, [0.5] * 64) for i in range(240, 360)]
    bad = [None, [], [1.0] * 63, [None] + [0.0] * 63, [float("nan")] + [0.0] * 63, [float("inf")] * 64, [1e30] * 64]
    rows += [(1000 + i, v) for i, v in enumerate(bad)] + [(None, rows[0][1]), (5, rows[9][1]), (7, rows[7][1])]
    frame = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance double").repartition(3)
    found = clusters.sort_means(frame).collect()
    assert sorted(repr(tuple(r)) for r in found) == plain_clusters(rows)
    assert len({r["cluster"] for r in found}) > 5


def test_clusters_of_few_vectors(spark):
    frame = spark.createDataFrame([(i, [float(i)] * 64) for i in range(7)], "vec_id long, embedding array<double>")
    assert [r["distance"] for r in clusters.sort_means(frame).collect()] == [0] * 7
    assert clusters.sort_means(frame.limit(0)).collect() == []


def test_scan_stops_only_beyond_twice_the_distance():
    centroids = np.array([[4, 0], [0, 0], [2, 3]], np.int64)
    best, least = clusters.nearest_centroids(np.array([[2, 0], [2, 2]], np.int64), np.array([1, 0]), centroids)
    assert best.tolist() == [0, 2] and least.tolist() == [4, 1]  # [2, 0] is as far from 0 as from 1, and 0 is twice as far from 1


def test_queries_with_sql_are_registered():
    assert {"op11_positional_index", "op12_periodic_runs", "op13_sort_means"} <= queries.queries().keys()
    assert {"op11_positional_index", "op13_sort_means"} == queries.oracle_sql().keys()
