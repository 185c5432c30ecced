"""Each operator against a plain version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import re
import weakref
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.llm import chat, cotraining, language, mixing, pieces, pii, queries, toxicity, vectors
from parley.llm.common import table
from parley.llm.cotraining import score_quality
from parley.llm.language import identify
from parley.llm.minhash import near_duplicates
from parley.llm.toxicity import score_toxicity

DIR, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
WHITE = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, kept string, _text string, masked string, ids string"


def components(ids, linked):
    """Smallest id that each id reaches."""
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def sets(texts, n):
    out = {}
    for i, t in texts.items():
        w = WHITE.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def links(found, percent):
    ids = sorted(found)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = found[a], found[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                c = len(x & y)
                if 100 * c >= percent * (len(x) + len(y) - c):
                    yield a, b


def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ties, and columns of clashing names."""
    long = "word " * 60_000
    texts = [None, "", " \t\n", "one", "same text here now ok", "same text here now ok", "SAME  text\nhere now ok", long, "a@b.co", "ünï çødé " * 40, "x" * 50_000]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], None if i % 2 else 5, 1.0, "s", "k", "t", "m", "i") for i, t in enumerate(texts)]
    rows += [rows[4], rows[0], (None, "no id at all", "en", "s1", 3, 1.0, "s", "k", "t", "m", "i"), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, docs):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "minhash": lambda s, d: near_duplicates(d),
    "mix": lambda s, d: mixing.mix(d),
    "quality": lambda s, d: score_quality(d, labels(s, d)),
    "toxicity": lambda s, d: score_toxicity(d, labels(s, d)),
    "pieces": lambda s, d: pieces.encode_texts(d, queries.MODEL_FILE),
    "language": lambda s, d: identify(d),
    "pii": lambda s, d: pii.find_personal_data(d, with_text=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    docs = odd_docs(spark)
    out = OPERATORS[name](spark, docs)
    assert sorted(map(str, (r.doc_id for r in out.select("doc_id").collect()))) == sorted(map(str, (r.doc_id for r in docs.select("doc_id").collect())))
    assert OPERATORS[name](spark, docs.where("false")).count() == 0


def test_minhash_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    rnd, base = random.Random(2), [f"w{k}" for k in range(120)]
    for i in range(150):  # a group of edited copies that straddles the threshold
        words = list(base)
        for _ in range(rnd.randrange(8)):
            words[rnd.randrange(120)] = f"n{rnd.randrange(10**6)}"
        texts[10_000 + i] = " ".join(words)
    texts |= {20_000: None, 20_001: "", 20_002: "a b", 20_003: "A  B", 20_004: "a b c"}
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=4, block_shingles=4000).collect()
    found = sets(texts, 4)
    want = components(texts, links(found, 80))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(found[i]), want[i], want[i] == i) for i in texts}


def odd_vectors(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(400, 16)))]
    centre = rnd.normal(size=16)
    rows += [(1000 + i, (centre + 0.12 * rnd.normal(size=16)).tolist()) for i in range(300)]  # a tight group, larger than a block
    rows += [(2000 + i, rows[0][1]) for i in range(5)] + [(2005, [2 * x for x in rows[0][1]])]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [float("inf")] + [1.0] * 15), (3004, [None] + [1.0] * 15), (3005, [1.0]), (None, rows[1][1]), rows[2]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit("x")).withColumn("leaf", F.lit(1))


def usable(frame):
    rows = {r.vec_id: r.embedding for r in frame.collect() if r.vec_id is not None}
    good = {i: np.array(v) for i, v in rows.items() if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return rows, ids, x @ x.T


def test_near_vectors_equal_brute_force(spark):
    frame = odd_vectors(spark)
    rows, ids, cos = usable(frame)
    near = cos >= 0.95
    np.fill_diagonal(near, False)
    count = dict(zip(ids.tolist(), near.sum(axis=1).tolist(), strict=True))
    want = components(rows, [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(near), strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame, leaf_rows=64, block_rows=128).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (count.get(i, 0), want[i], want[i] == i) for i in rows}
    assert vectors.near_vectors(frame.where("false")).count() == 0


def test_large_leaves_are_split_again(spark):
    """A small sample for the forest leaves large leaves; trees of their own split them, and no link is lost."""
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(4000, 16))
    x = np.concatenate([base, base[:500] + 0.05 * rnd.normal(size=(500, 16)), rnd.normal(size=16) + 0.01 * rnd.normal(size=(1500, 16))])
    spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>").createOrReplaceTempView("leafy")
    seen, old = [], vectors.in_blocks
    vectors.in_blocks = lambda rows, *rest: (seen.append(rows.groupBy("leaf").count().agg(F.max("count"), F.count("*")).first()), old(rows, *rest))[1]
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.table("leafy"), leaf_rows=64, fit_rows=512, block_rows=512).collect()}
    finally:
        vectors.in_blocks = old
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near)), strict=True)])
    found = sum(n for n, _ in got.values())
    assert found >= 0.99 * near.sum() and all(n <= k for (n, _), k in zip((got[i] for i in range(len(x))), near.sum(axis=1), strict=True))
    assert np.mean([got[i][1] == want[i] for i in range(len(x))]) > 0.99
    assert seen[0][1] > 8 * 16  # more leaves than a forest of 512 sampled rows has


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-300, 1e-300]), (4, [1e308, 1e-300]), (5, [5e-324, 0.0]), (6, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, `a.b` array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame, embedding="a.b").collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (1, 4), 5: (1, 4)}
    near = vectors.nearest(frame, F.col("vec_id") == 6, embedding="a.b", k=3, codes=300).collect()
    assert sorted((r.vec_id, round(r.score, 12)) for r in near) == [(1, 1.0), (2, 1.0), (3, 1.0)]  # their last bits may differ


def test_nearest_equals_brute_force(spark):
    frame = odd_vectors(spark)
    _, ids, cos = usable(frame)
    np.fill_diagonal(cos, -9)
    got = {}
    for r in vectors.nearest(frame, F.col("vec_id") % 50 == 0, books=4, codes=16, query_rows=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = [k for k, i in enumerate(ids) if i % 50 == 0]
    assert set(got) == {int(ids[k]) for k in asked}
    for k in asked:
        best = np.lexsort((ids, -cos[k].round(12)))[:5]
        assert np.allclose([s for _, s in got[ids[k]]], cos[k][best]) and len({v for v, _ in got[ids[k]]}) == 5
    assert vectors.nearest(frame.where("false"), F.lit(True)).count() == 0


def test_nearest_keeps_ties_beyond_the_rerank(spark):
    """More equal and nearly equal rows than are reranked: the smaller ids of each tie are found all the same."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(1500, 16))
    mixed = rnd.permutation(1500)
    equal, tight = mixed[:500], mixed[500:900]
    x[equal] = rnd.normal(size=16)
    x[tight] = rnd.normal(size=16) + 1e-7 * rnd.normal(size=(400, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in vectors.nearest(frame, F.col("vec_id") % 10 == 0, books=4, codes=16, rerank=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 1500, 10):
        cos = unit @ unit[i]
        cos[(x == x[i]).all(axis=1)] = 1
        cos[i] = -9
        if i in tight:  # their scores differ in the last bits only
            assert len(set(got[i])) == 5 and cos[got[i]].min() > 1 - 1e-12
        else:
            assert got[i] == np.lexsort((np.arange(1500), -cos.round(14)))[:5].tolist()


def test_recall_on_table(spark):
    frame = table(spark, DIR, "embeddings")
    data = frame.toPandas()
    ids, x = data["vec_id"].to_numpy(), np.array(data["embedding"].tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    np.fill_diagonal(cos, -9)
    got = queries.op1_additive_quantisation(spark, DIR).toPandas().groupby("query_id")["vec_id"].apply(set).to_dict()
    hits = [len(got[i] & set(ids[np.lexsort((ids, -cos[k]))[:5]])) for k, i in enumerate(ids) if i % 50 == 0]
    assert sum(hits) >= 0.9 * 5 * len(hits)


def test_recall_in_whole_blocks(spark):
    """Blocks of 8,192 rows, of which 513 are reranked: a third equal, a sixth a tight group, the others at random."""
    rnd = np.random.default_rng(5)
    n, ids = 20_000, np.arange(20_000)
    x, mixed = rnd.normal(size=(n, 32)), rnd.permutation(n)
    kinds = {"equal": mixed[: n // 3], "tight": mixed[n // 3 : n // 2], "random": mixed[n // 2 :]}
    x[kinds["equal"]] = rnd.normal(size=32)
    x[kinds["tight"]] = rnd.normal(size=32) + 1e-3 * rnd.normal(size=(len(kinds["tight"]), 32))
    spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<double>").createOrReplaceTempView("whole_blocks")
    got = vectors.nearest(spark.table("whole_blocks").coalesce(1), F.col("vec_id") % 50 == 0).toPandas().groupby("query_id")["vec_id"].apply(set).to_dict()
    unit, recall = x / np.linalg.norm(x, axis=1)[:, None], {}
    for kind, own in kinds.items():
        asked = own[own % 50 == 0]
        cos = (unit[asked] @ unit.T).round(13)
        cos[np.arange(len(asked)), asked] = -9
        recall[kind] = np.mean([len(got[i] & set(np.lexsort((ids, -c))[:5])) / 5 for i, c in zip(asked, cos, strict=True)])
    print("recall", recall)
    assert min(recall.values()) >= 0.9


def reshared(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, total, capped = {s: weights[k % 3] for k, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mix(spark):
    docs = table(spark, DIR, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source"))
    docs = docs.union(spark.createDataFrame([(10**6 + i, "tiny source", "a") for i in range(3)], "doc_id long, text string, source string"))
    got, text = mixing.mix(docs).toPandas(), docs.toPandas().set_index("doc_id")
    got["source"] = text.loc[got["doc_id"], "source"].to_numpy()
    size = {i: len(WHITE.findall((t or "").encode())) for i, t in text["text"].items()}
    assert dict(zip(got["doc_id"], got["size"], strict=True)) == size
    sizes = {}
    for i, s in text["source"].items():
        sizes[s if isinstance(s, str) else None] = sizes.get(s if isinstance(s, str) else None, 0) + size[i]
    want = reshared(sizes, (5, 2, 1), 3)
    assert (got["taken"] <= 3 * got["size"]).all()
    for s, own in got.groupby(got["source"].fillna("~none")):
        s = None if s == "~none" else s
        assert math.isclose(own["target"].iloc[0], want[s], rel_tol=1e-9) and own["source_size"].iloc[0] == sizes[s]
        assert abs(own["taken"].sum() - want[s]) <= max(0.01 * want[s], own["size"].min())
    again = mixing.mix(docs).toPandas()
    assert got.drop(columns="source").sort_values("doc_id", ignore_index=True).equals(again.sort_values("doc_id", ignore_index=True))


def plain_tilt(sizes, target, most):
    """The tilt whose rates min(most, exp(tilt * size)) make the target, by bisection."""
    sizes = np.array([s for s in sizes if s], float)
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(most, np.exp(np.minimum(mid * sizes, 50))) * sizes).sum() < target else (low, mid)
    return (low + high) / 2


def test_mix_rates_are_those_of_the_dual(spark):
    docs = table(spark, DIR, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")).alias("source"))
    docs = docs.union(spark.createDataFrame([(10**6 + i, "w " * n, "a") for i, n in enumerate((1, 2, 900))] + [(10**7, None, "b")], "doc_id long, text string, source string"))
    got = mixing.mix(docs).toPandas()
    capped = 0
    for (total, target), own in got.groupby(["source_size", "target"]):
        rates = own.loc[own["size"] > 0, "rate"].to_numpy()
        sizes = own.loc[own["size"] > 0, "size"].to_numpy()
        if target >= 3 * total * (1 - 1e-12):
            assert (rates == 3).all()
            capped += 1
            continue
        assert math.isclose((rates * sizes).sum(), target, rel_tol=1e-9)  # the dual's gradient is 0
        assert np.allclose(rates, np.minimum(3, np.exp(plain_tilt(sizes, target, 3) * sizes)), rtol=1e-7, atol=1e-9)
        free = rates < 3 * (1 - 1e-9)
        tilt = np.log(rates[free]) / sizes[free]  # one tilt a source: the conditions of the optimum
        assert np.allclose(tilt, np.median(tilt), rtol=1e-6, atol=1e-9)
    assert capped and (got["copies"] <= 3).all() and got.loc[got["doc_id"] == 10**7, "taken"].item() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_pii_equals_patterns(spark):
    rnd = random.Random(1)
    for _ in range(5000):
        text = "".join(rnd.choice(["a", "1", ".", "@", "+", "-", " ", "(", "29", ".", "é", "\n", "0", "4111111111111111", "10.2.3.4"]) for _ in range(rnd.randrange(50)))
        assert [s for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == plain_spans(text)
    rows = {r.doc_id: r for r in queries.op10_anchor_pii(spark, DIR).collect()}
    for r in table(spark, DIR, "documents").select("doc_id", "text").collect():
        own = plain_spans(r.text)
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
    assert pii.masked("mail a@b.co, token = abcdef123", pii.spans("mail a@b.co, token = abcdef123")) == "mail [EMAIL], token = [SECRET]"
    assert pii.spans("1" * 100_000 + "@" * 1000) is not None


def test_chat_round_trip(spark):
    rnd = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<s>", "<<", "[", " ", "\n", "word ", "é", "[TURN]", "<<ROLE>>"]
    rows = []
    for c in range(40):
        for t in range(rnd.randrange(1, 30)):
            role = ["system", "user", "assistant", "tool", "", None, "<<ROLE>>"][rnd.randrange(7)]
            rows.append((c, t, role, None if rnd.random() < 0.1 else "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))))
    rows += [rows[0], (None, 0, "user", "x"), (7777, None, "assistant", "y " * 5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.format_chats(frame, budget=60, history=20)
    own = {}
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    assert max(r.window for r in windows.collect()) > 3
    for r in chat.digest_windows(windows).collect():
        turns, said = own[r.conv_id], "".join(t for x, t in own[r.conv_id] if x == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(own) == chat.digest_windows(windows).count() and chat.format_chats(frame.where("false")).count() == 0


def test_stored_windows_are_dealt_and_sorted(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c} {t} " + "w " * 30) for c in range(3) for t in range(60)]
    windows = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=100, history=20)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(tuple, chat.digest_chats(frame, budget=100, history=20).collect()))
    assert len(want) == 3 and sorted(map(tuple, chat.digest_windows(windows.repartition(4)).collect())) == want


def test_large_conversations_are_formatted_by_window(spark):
    """Conversations above the bound give the windows and digests that one task would give them, equal and null rows included."""
    rnd = random.Random(7)
    rows = [(None if c == 2 else c, t, ["system", "user", "assistant"][(t > 0) + (t % 2 if t else 0)], f"{c} {t} " + "w " * rnd.randrange(40)) for c in range(4) for t in range(25 * c + 5)]
    rows += [rows[-1], (3, 9, "user", None), (3, None, "assistant", "[OUT] x")]
    rows += [(c, t, role, f"again {rnd.random()}") for c in (None, 1) for t, role in ((4, "user"), (5, "assistant"), (None, "user")) for _ in range(9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = [sorted(map(str, chat.format_chats(frame, budget=90, history=30, large_turns=n).collect())) for n in (1000, 40, 1)]
    assert len(windows[0]) > 40 and windows[0] == windows[1] == windows[2]
    digests = [sorted(map(str, chat.digest_chats(frame, budget=90, history=30, large_turns=n).collect())) for n in (1000, 40)]
    assert digests[0] == digests[1]


def test_chat_windows_keep_to_budget():
    turns = [("system", "be kind")] + [("user" if k % 2 else "assistant", "w " * 10) for k in range(30)]
    windows = list(chat.spans(turns, 50, 15))
    assert all(w[0] == turns[0] for w, _ in windows) and all(sum(len(t.split()) + 2 for _, t in w) <= 50 for w, _ in windows)
    assert [t for w, k in windows for t in w[k:]] == turns


def test_pieces_equal_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    out = pieces.encode_texts(table(spark, SMALL, "documents"), queries.MODEL_FILE)
    text = {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    for r in out.collect():
        assert r.ids == sp.encode(text[r.doc_id]) and r.round_trip
    assert {r.doc_id: r.text for r in pieces.decode_ids(out, queries.MODEL_FILE).collect()} == text
    with open(queries.MODEL_FILE, "rb") as f:
        e, rnd = pieces.Encoder(pieces.Vocabulary(f.read()), known=50), random.Random(9)
    for _ in range(3000):
        t = "".join(rnd.choice(["a", "the", " ", "  ", "\n", "é", "日", "😀", "ing", "re", "er", "0", "aaaa"]) for _ in range(rnd.randrange(15)))
        assert e.encode(t).tolist() == sp.encode(t) and e.decode(e.encode(t)) == t


def test_words_asked_for_again_are_passed_over_once():
    """A frequent word stays known however many others come between, a word is one pass, and tables go with their encoder."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    with open(queries.MODEL_FILE, "rb") as f:
        e, passed = pieces.Encoder(pieces.Vocabulary(f.read()), known=50), []
    plain = e.viterbi
    e.viterbi = lambda text: passed.append(text) or plain(text)
    rnd = random.Random(5)
    rare = list(dict.fromkeys("".join(rnd.choice(["qx", "jq", "ing", "zv", "tion", "é"]) for _ in range(6)) for _ in range(300)))
    for word in rare:
        t = f"the {word} of"
        assert e.encode(t).tolist() == sp.encode(t)
    assert sorted(passed) == sorted(pieces.SPACE + w for w in ["the", "of", *rare])
    assert len(e.cache) + len(e.cache.old) + len(e.others) + len(e.others.old) <= 50
    gone = weakref.ref(e.cache)
    del e, plain
    assert gone() is None


def test_long_and_oddly_spaced_texts_equal_sentencepiece():
    """Chunks on either side of the length above which they are cut and not kept, met twice, with little kept and with much."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    with open(queries.MODEL_FILE, "rb") as f:
        vocabulary, rnd = pieces.Vocabulary(f.read()), random.Random(6)
    small, large = pieces.Encoder(vocabulary, known=10), pieces.Encoder(vocabulary)
    for n in (1, 62, 63, 64, 65, 66, 300):
        for signs in ("日本語の文", "abetion", "é😀\n.\x00a", "=-#"):
            word = "".join(rnd.choice(signs) for _ in range(n))
            for t in (word, f" {word}", f"{word} ", f"a  {word}", f"{word} {word}", f"\u2581{word}"):
                for e in (small, large, large):
                    assert e.encode(t).tolist() == sp.encode(t)


def test_user_defined_pieces_stand_alone():
    """A BPE vocabulary with pieces of its own: they are found longest first, and nothing is merged across them."""
    v = pieces.Vocabulary(b"")
    v.pieces, v.bpe, v.prefix, v.squeeze = ["<unk>", "a", "b", "ab", "aba", "<x>", "<x>y", "<", "x", ">", "y"], True, False, False
    v.scores, v.normal, v.own = [0.0, -9, -9, -1, -2, 0, 0, -9, -9, -9, -9], [1, 2, 3, 4, 7, 8, 9, 10], [5, 6]
    e = pieces.Encoder(v)
    assert e.encode("ab<x>yaba<x>ab<x").tolist() == [3, 6, 4, 5, 3, 7, 8] and e.decode(e.encode("ab<x>yaba")) == "ab<x>yaba"
    assert e.decode(np.array([3, 99, -1])) == "ab\ufffd\ufffd"


def test_viterbi_of_bpe_breaks_no_merge():
    """The pass's score of every path through a text is at most 0, and 0 for merging's own alone."""
    v = pieces.Vocabulary(b"")
    v.pieces, v.bpe, v.prefix, v.squeeze = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "cab", "aa", "aaa"], True, False, False
    v.scores, v.normal = [0.0, -50, -50, -50, -1, -2, -3, -4, -5, -6], list(range(1, 10))
    e, rnd = pieces.Encoder(v), random.Random(4)

    def plain(text):
        words = list(text)
        while True:
            tries = [(-v.scores[v.pieces.index(words[k] + words[k + 1])], k) for k in range(len(words) - 1) if words[k] + words[k + 1] in e.ids]
            if not tries:
                return [e.ids.get(w, 0) for w in words]
            k = min(tries)[1]
            words[k : k + 2] = [words[k] + words[k + 1]]

    for _ in range(500):
        text = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 14)))
        assert e.viterbi(text) == plain(text)


def test_unigram_viterbi_finds_best_path():
    v = pieces.Vocabulary(b"")
    rnd = random.Random(3)
    v.pieces = ["<unk>", *{"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5))) for _ in range(20)} | {"a"}]
    v.scores, v.normal, v.prefix, v.squeeze = [0.0] + [-rnd.random() * 9 for _ in v.pieces[1:]], list(range(1, len(v.pieces))), False, False
    e = pieces.Encoder(v)
    best = {"": 0.0}

    def score(t):
        if t not in best:
            tries = [score(t[: -len(p)]) + s for p, s in zip(v.pieces[1:], v.scores[1:], strict=True) if t.endswith(p)]
            best[t] = max([*tries, *([score(t[:-1]) + e.worst] if t[-1] not in e.single else [])], default=-1e18)
        return best[t]

    for _ in range(300):
        t = "".join(rnd.choice("abc") for _ in range(rnd.randrange(12)))
        ids = e.viterbi(t)
        assert math.isclose(sum(v.scores[i] if i else e.worst for i in ids), score(t), abs_tol=1e-6)
        assert len(t) == sum(len(v.pieces[i]) if i else 1 for i in ids)


def held(frame, folds, fold):
    return all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in frame.select("doc_id", "held_out").collect())


def test_language_held_out(spark):
    out = queries.op9_kneser_ney_language(spark, DIR)
    joined = out.where("held_out").join(table(spark, DIR, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert held(out, 4, 2) and (joined["lang"] == joined["lang_pred"]).mean() > 0.97 and joined["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, "12 34"), (3, "the and of"), (4, "")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    known = table(spark, DIR, "documents").select("doc_id", "text", "lang").where("doc_id >= 10").union(odd)
    got = {r.doc_id: r.lang_pred for r in identify(known).where("doc_id < 5").collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "und"}


@pytest.mark.parametrize(("query", "label", "least", "folder"), [(queries.op4_compression_toxicity, "toxic", 0.72, "/root/testdata/sf0.1"), (queries.op3_co_training, "quality", 0.85, DIR)])
def test_classifier_held_out(spark, query, label, least, folder):
    """Toxic windows are learned from hundreds of toxic texts; the forty of the smaller table are too few for windows to recur."""
    out = query(spark, folder)
    data = out.where("held_out").join(table(spark, folder, "labels"), "doc_id").toPandas()
    y, s = data[label].to_numpy(), data["score"].to_numpy()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert held(out, 3, 1) and auc > least and ((s >= 0) & (s <= 1)).all()
    assert out.count() == table(spark, folder, "documents").count()


def test_kneser_ney_equals_dictionaries():
    """Probabilities of the sorted hash arrays against interpolated Kneser-Ney by plain counting."""
    from collections import Counter

    words = Counter({"aba": 3, "ab": 2, "bab": 1, "abba": 4, "cab": 1, "c": 2})
    models = language.Models({"x": [" ".join(words.elements())]})
    order, start, end = language.ORDER, "\x02", "\x03"
    counts = [Counter() for _ in range(order + 1)]
    for w, n in words.items():
        padded = start * order + w + end
        for k in range(order, len(padded)):
            counts[order][padded[k - order + 1 : k + 1]] += n
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        once, twice = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        if not own:
            return p(gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p(gram[1:])

    for w in ("aba", "abc", "ccc", "b", "zb"):
        padded = start * order + w + end
        want = sum(math.log(p(padded[k - order + 1 : k + 1])) for k in range(order, len(padded)))
        assert math.isclose(models.of_words([w])[0][0], want, rel_tol=1e-4), w


def plain_dictionaries(toxic, clean):
    """Training as the docstring of Dictionaries tells it, with zstandard's own calls."""
    import zstandard as zs

    def train(samples, size, k, d):
        try:
            return zs.train_dictionary(size, samples, k=k, d=d, level=3).as_bytes()
        except zs.ZstdError:
            return b"".join(dict.fromkeys(samples))

    def length(dictionary):
        p = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_LAZY2, window_log=17, hash_log=17, chain_log=17, search_log=8, min_match=4, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        tool = zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p)
        return lambda w: len(tool.compress(w))

    def cut(text):
        out, held = [], []
        for w in text.encode().lower().split():
            held.append(w)
            n = sum(map(len, held)) + len(held)
            if n >= 64 or n >= 24 and zlib.crc32(w) % 3 == 0:
                out, held = [*out, held], []
        return [b" " + b" ".join(h) + b" " for h in ([*out, held] if held else out)]

    draw = random.Random(3)
    bad, good = (list(dict.fromkeys(w for t in texts for w in cut(t))) for texts in (toxic, clean))
    base = train(good, 24576, 200, 8)
    kept, other = bad, good
    for shape in ((8192, 24, 8), (4096, 16, 6)):
        by_fold = [(length(base + train([w for w in other if zlib.crc32(w) % 3 != f], *shape)), length(base + train([w for w in kept if zlib.crc32(w) % 3 != f], *shape))) for f in range(3)]
        gain = {w: by_fold[zlib.crc32(w) % 3][0](w) - by_fold[zlib.crc32(w) % 3][1](w) for w in {*kept, *good}}
        asked = draw.sample(good, min(len(good), 10_000))
        most = max(2, np.quantile([gain[w] for w in asked], 0.99))
        kept = [w for w in kept if gain[w] >= most]
        assert len(kept) >= 20
        other = [w for w in asked if gain[w] >= most] * 2 + draw.sample(good, min(len(good), 3 * len(kept) + 200))
    return kept, base, train(kept * 4, 1024, 16, 6) + base, length


def test_dictionaries_equal_plain_training():
    """Windows, dictionaries and features by a plain version with zstandard's own lengths; toxic windows are told from others."""
    rnd = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5)))
    bad = ["wretched", "loathsome", "vermin", "despicable"]
    clean = [" ".join(word() for _ in range(120)) for _ in range(400)] + ["z" * 500]
    toxic = [" ".join(rnd.choice(bad) if rnd.random() < 0.05 else word() for _ in range(120)) for _ in range(200)]
    d = toxicity.Dictionaries(toxic, clean)
    kept, base, told, length = plain_dictionaries(toxic, clean)
    assert d.chosen == kept and d.parts == (base, told)
    assert sum(any(b.encode() in w for b in bad) for w in kept) > 0.8 * len(kept)
    plain, both = length(base), length(told)
    for text in (toxic[0], clean[0], "ÉTÉ Wretched VERMIN", ""):
        raw = text.encode().lower()
        gains = sorted((plain(raw[i : i + 96]) - both(raw[i : i + 96]) for i in range(0, len(raw), 96)), reverse=True) or [0]
        got = d.features(text, d.compressors())
        want = [min(12, gains[0]), np.mean(gains[:3]), np.mean(gains[:8]), np.mean(gains), np.std(gains), *(math.log1p(sum(g >= n for g in gains)) for n in (2, 3, 4, 6)), np.mean([g >= 3 for g in gains]), np.mean([g >= 4 for g in gains]), math.log1p(len(gains))]
        assert np.allclose(got, want)
    score = lambda t: d.features(t, d.compressors())[1]
    assert np.mean([score(t) for t in toxic]) > np.mean([score(t) for t in clean]) + 0.3


def test_co_training_rounds_equal_plain_loop():
    """Each round each view hands its surest pool rows to the other, once each, by the classes' shares."""
    rnd = np.random.default_rng(2)
    n, m = 60, 300
    truth, pool_truth = rnd.integers(0, 2, n).astype(float), rnd.integers(0, 2, m).astype(float)
    views = [truth[:, None] * 2 + rnd.normal(size=(n, 3)) for _ in range(2)]
    pool = [pool_truth[:, None] * 2 + rnd.normal(size=(m, 3)) for _ in range(2)]
    fits = cotraining.co_train(views, truth, pool, rounds=3, share=0.05, sure=0.8)
    own = [(list(views[k]), list(truth)) for k in (0, 1)]
    left = [list(range(m)), list(range(m))]  # rows that view k has not been handed yet
    plain = [toxicity.logistic(np.array(x), np.array(y)) for x, y in own]
    prior, most = truth.mean(), max(1, int(0.05 * m))
    for _ in range(3):
        handed = []
        for k in (0, 1):
            p = cotraining.chances(plain[k], pool[k][left[1 - k]])
            ups = [left[1 - k][i] for i in np.argsort(-p)[: max(1, round(most * prior))] if p[i] >= 0.8]
            downs = [left[1 - k][i] for i in np.argsort(p)[: max(1, round(most * (1 - prior)))] if p[i] <= 1 - 0.8]
            handed.append((ups, downs))
        for k in (0, 1):
            for rows_, label in zip(handed[k], (1.0, 0.0), strict=True):
                for i in rows_:
                    own[1 - k][0].append(pool[1 - k][i])
                    own[1 - k][1].append(label)
                    left[1 - k].remove(i)
        plain = [toxicity.logistic(np.array(x), np.array(y)) for x, y in own]
    for k in (0, 1):
        assert len(own[k][1]) > n and all(np.allclose(a, b, atol=1e-9) for a, b in zip(fits[k], plain[k], strict=True))


def test_addresses_have_no_look_back_limit():
    street = "Main" * 60
    text = f"He lives at 12 {street} North East Road, and 1234567 Main Street is none, nor is a Street."
    assert [s for s in pii.spans(text) if s[0] == "address"] == [("address", 12, text.index("Road") + 4)]
