"""Vectors: additive quantisation for nearest neighbours, a random-projection forest for near duplicates."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, components, in_blocks, matrix, quoted, saved


def usable(vecs: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """A row (vec_id, embedding) per id, and of these the usable ones with their double norm.

    Of rows that repeat an id the least vector counts. Vectors that are null, zero, or hold null or non-finite components
    are not usable, nor are those with a null id, nor those of another length than most, which have no cosine with these.
    Usable ones are divided by a power of two near their largest component: that changes no cosine, makes vectors that
    differ by such a power equal, and keeps the norms of very large and very small ones finite and above 0.
    """
    rows = saved(vecs.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(embedding).cast("array<double>").alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    most = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") == (most["n"] if most else 0))).where(F.forall("embedding", finite))
    good = good.withColumn("largest", F.array_max(F.transform("embedding", F.abs))).where("largest > 0")
    half = F.pow(F.lit(2.0), F.floor(F.floor(F.log2("largest")) / 2))  # twice, for one power may be out of range
    rest = F.pow(F.lit(2.0), F.floor(F.log2("largest")) - F.floor(F.floor(F.log2("largest")) / 2))
    good = good.withColumn("embedding", F.transform("embedding", lambda x: x / half / rest)).drop("largest")
    return rows, good.withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))


def single(vecs: DataFrame, embedding: str) -> str:
    """The type in which vectors can travel without loss."""
    kind = vecs.select(quoted(embedding)).schema[0].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def sample_of(good: DataFrame, rows: int) -> np.ndarray:
    """At most so many vectors, of length 1, on the driver: those whose ids have the least hashes, so reruns agree."""
    told = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding", "norm").toPandas()
    return np.array(told["embedding"].tolist(), dtype=np.float64) / told["norm"].to_numpy()[:, None] if len(told) else np.empty((0, 1))


# Additive quantisation


def code_type(codes: int) -> type:
    return np.uint8 if codes <= 256 else np.uint16 if codes <= 65536 else np.uint32


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes of the rows of x: beam search over full-dimensional codebooks, each on what the ones before left."""
    m, k, _ = books.shape
    out = np.empty((len(x), m), code_type(k))
    sizes = (books**2).sum(axis=2)
    for at in range(0, len(x), 1024):
        rest = x[at : at + 1024, None, :]
        n, codes, cost = len(rest), np.zeros((len(rest), 1, 0), np.int64), np.zeros((len(rest), 1), np.float32)
        cost += (rest**2).sum(axis=2)
        for i in range(m):
            width = rest.shape[1]
            all_costs = (cost[:, :, None] - 2 * (rest.reshape(n * width, -1) @ books[i].T).reshape(n, width, k) + sizes[i]).reshape(n, width * k)
            keep = min(beam, width * k) if i < m - 1 else 1
            best = np.argpartition(all_costs, keep - 1, axis=1)[:, :keep]
            which, code = best // k, best % k
            cost = np.take_along_axis(all_costs, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, which[:, :, None], axis=1), code[:, :, None]], axis=2)
            rest = np.take_along_axis(rest, which[:, :, None], axis=1) - books[i][code]
        out[at : at + 1024] = codes[:, 0]
    return out


def learn_books(x: np.ndarray, books: int, codes: int, beam: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Codebooks (books, codes, dimensions): k-means on residuals, then least squares over beam-searched codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    n, d = x.shape
    codes = max(1, min(codes, n))
    out, rest = np.zeros((books, codes, d), np.float32), x.copy()
    for i in range(books):
        centre = rest[rng.choice(n, codes, replace=False)]
        for _ in range(8):
            near = np.argmin((centre**2).sum(axis=1) - 2 * rest @ centre.T, axis=1)
            count = np.bincount(near, minlength=codes)
            total = np.zeros((codes, d), np.float32)
            np.add.at(total, near, rest)
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        out[i] = centre
        rest = rest - centre[np.argmin((centre**2).sum(axis=1) - 2 * rest @ centre.T, axis=1)]
    for _ in range(rounds):
        at = encode(x, out, beam).astype(np.int64) + np.arange(books) * codes
        size = books * codes
        pairs = np.zeros((books, codes, books, codes), np.float32)
        for i in range(books):
            for j in range(books):
                pairs[i, :, j] = np.bincount((at[:, i] - i * codes) * codes + at[:, j] - j * codes, minlength=codes * codes).reshape(codes, codes)
        pairs = pairs.reshape(size, size)
        right = np.zeros((size, d))
        for i in range(books):
            np.add.at(right, at[:, i], x)
        # a little weight on the old books keeps unused codes where they were
        out = np.linalg.solve(pairs + np.float32(0.1) * np.eye(size, dtype=np.float32), (right + 0.1 * out.reshape(size, d)).astype(np.float32)).reshape(books, codes, d).astype(np.float32)
    return out


def nearest(vecs: DataFrame, is_query: F.Column, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", books: int = 16, codes: int = 256, beam: int = 4, rounds: int = 2, fit_rows: int = 8192, rerank: int = 512, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine for each row where is_query holds.

    Equal vectors are one class; classes are searched, and then give their least ids. Codebooks are fitted on a
    sample of at most fit_rows of them; every class is encoded, and every class's code is scored against every
    query by lookup tables and the stored norm of its decoded vector. Of each block of at most block_rows rows
    the best `rerank` are scored again exactly, in double precision on the original vectors. Then so is every
    other row that may still be among the k best: a row's angle to its decoded vector is stored, and the angle to
    the query is less than the decoded vector's by no more than that. So nothing is lost by the codes, however
    many rows are alike. The queries, which grow with the table, are taken in blocks of about query_rows, one
    broadcast at a time; each executor keeps k rows per query, so what is shuffled is k rows per query and partition.

    Ties go to the smaller vec_id. A query's own row is no candidate; with fewer than k candidates all are
    returned. Of rows that repeat an id the least vector counts. Vectors that are null, zero, of another
    length than most, or that hold null or non-finite components, and rows with a null id take no part. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = vecs.sparkSession
    kind = single(vecs, embedding)
    asked = vecs.where(is_query).select(quoted(vec_id).cast("long").alias("vec_id")).distinct()
    _, good = usable(vecs, vec_id, embedding)
    schema = "query_id long, vec_id long, score double"

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.chunked_array([batch.column(1)])) + 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], pa.binary())], ["vec_id", "embedding", "norm", "same"])

    members = saved(good.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), "norm").mapInArrow(digested, f"vec_id long, embedding {kind}, norm double, same binary"))
    # of a class no query needs more than its k + 1 least ids, one of which may be its own
    first = members.select("vec_id", "same").withColumn("at", F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    classes = saved(first.groupBy("same").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("same", F.col("ids")[0].alias("rep"), "ids"))
    reps = saved(members.join(classes.select(F.col("rep").alias("vec_id")), "vec_id").select("vec_id", "embedding", "norm"))
    sample = sample_of(reps, fit_rows)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    learned = learn_books(sample, books, codes, beam, rounds)
    told = spark.sparkContext.broadcast(learned)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = told.value
        lengths = np.linalg.norm(c.astype(np.float64), axis=2)
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.chunked_array([batch.column(1)])) / batch.column(2).to_numpy()[:, None]
                code = encode(x.astype(np.float32), c, beam)
                y = sum(c[i][code[:, i]].astype(np.float64) for i in range(len(c)))
                decoded = np.maximum(np.linalg.norm(y, axis=1), 1e-6)
                # the cosine of the row and its decoded vector, and what single precision may add to a guess
                turned = np.where(decoded > 1e-6, np.clip((x * y).sum(axis=1) / decoded, -1, 1), -1)
                fuzz = (x.shape[1] + len(c) + 4) * 1.2e-7 * sum(lengths[i][code[:, i]] for i in range(len(c))) / decoded
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(decoded, pa.float32()), pa.array(turned), pa.array(fuzz)], ["vec_id", "embedding", "norm", "code", "decoded", "turned", "fuzz"])

    def themselves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, norms, at = matrix(pa.chunked_array([batch.column(1)])), batch.column(2).to_numpy(), np.arange(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array(_cosines(x, norms, at, x, norms, at))], ["query_id", "vec_id", "score"])

    index = saved(reps.mapInArrow(encoded, f"vec_id long, embedding {kind}, norm double, code binary, decoded float, turned double, fuzz double"))
    asked = saved(members.select("vec_id", "same").join(asked, "vec_id").join(classes.select("same", "rep"), "same").select(F.col("vec_id").alias("query_id"), "rep"))
    queries = saved(reps.join(asked.select(F.col("rep").alias("vec_id")).distinct(), "vec_id").select("vec_id", "embedding", "norm"))
    parts = max(1, -(-queries.count() // query_rows))
    found = []
    for part in range(parts):
        block = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts)) == part).orderBy("vec_id").toPandas()
        if not len(block):
            continue
        asks = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), np.array(block["embedding"].tolist(), dtype=np.float64), block["norm"].to_numpy()))
        found.append(index.mapInArrow(_search(told, asks, k, rerank, block_rows), schema))
        if parts > 1:
            found[-1] = saved(found[-1])
    out = spark.createDataFrame([], schema)
    for x in found:
        out = out.union(x)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).drop("rank").union(queries.mapInArrow(themselves, schema))
    spread = out.join(classes.select(F.col("rep").alias("vec_id"), "ids"), "vec_id").select(F.col("query_id").alias("rep"), "score", F.explode("ids").alias("vec_id"))
    lists = spread.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))
    own = asked.join(saved(lists), "rep").withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _cosines(rows: np.ndarray, row_norms: np.ndarray, row: np.ndarray, x: np.ndarray, norms: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Cosines of pairs of a row of rows and one of x. All come from here, since a product's last bit differs with its order."""
    out = np.empty(len(row))
    for at in range(0, len(row), 16384):
        r, a = row[at : at + 16384], ask[at : at + 16384]
        out[at : at + 16384] = np.einsum("pd,pd->p", rows[r], x[a]) / (row_norms[r] * norms[a])
    return out


def _search(told, asks, k: int, rerank: int, block_rows: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = told.value
        ids, x, norms = asks.value
        units = x / norms[:, None]
        tables = np.einsum("mkd,qd->mkq", c, units.astype(np.float32)).astype(np.float32)
        best_ids, best = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf)

        def keep(i: int, ask: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
            """The k best of what the block of queries at i has and of these pairs."""
            n = len(ids[i : i + 128])
            every, both, all_scores = np.concatenate([np.repeat(np.arange(n), k), ask]), np.concatenate([best_ids[i : i + n].ravel(), found]), np.concatenate([best[i : i + n].ravel(), scores])
            order = np.lexsort((both, -all_scores, every))
            every = every[order]
            order = order[np.arange(len(order)) - np.searchsorted(every, every) < k]
            best_ids[i : i + n], best[i : i + n] = both[order].reshape(n, k), all_scores[order].reshape(n, k)

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                own = part.column(0).to_numpy()
                rows, row_norms = matrix(pa.chunked_array([part.column(1)])), part.column(2).to_numpy()
                code = np.frombuffer(b"".join(part.column(3).to_pylist()), code_type(c.shape[1])).reshape(len(own), -1)
                shrink = 1 / part.column(4).to_numpy()
                turned, fuzz = (part.column(j).to_numpy()[:, None] for j in (5, 6))
                for i in range(0, len(ids), 128):  # lookup tables of a bounded block of queries
                    guess = sum(tables[m][code[:, m], i : i + 128] for m in range(len(c))) * shrink[:, None]
                    few = min(rerank + 1, len(own))
                    near = np.argpartition(-guess, few - 1, axis=0)[:few]
                    left = own[:, None] != ids[i : i + 128]  # a query's own row is no candidate
                    first = np.zeros(guess.shape, bool)
                    np.put_along_axis(first, near, True, axis=0)
                    row, ask = np.nonzero(first & left)
                    keep(i, ask, own[row], _cosines(rows, row_norms, row, x[i : i + 128], norms[i : i + 128], ask))
                    if few == len(own):
                        continue
                    least = best[i : i + 128, -1] - 1e-9
                    g = np.clip(guess + fuzz, -1, 1)
                    most = np.where(g >= turned, 1, g * turned + np.sqrt((1 - g * g) * (1 - turned * turned)))
                    left &= ~first & (most >= least)
                    some = np.flatnonzero(left.any(axis=1))
                    row, ask = np.nonzero(left[some] & ((rows[some] / row_norms[some, None]) @ units[i : i + 128].T >= least))
                    row = some[row]
                    keep(i, ask, own[row], _cosines(rows, row_norms, row, x[i : i + 128], norms[i : i + 128], ask))
        there = best > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[there]), pa.array(best_ids[there]), pa.array(best[there])], ["query_id", "vec_id", "score"])

    return search


# Random-projection forest


class Forest:
    """Trees of random hyperplanes whose sides overlap by `spill` around each cut; leaves are numbered over all trees."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf_rows: int, spill: float, seed: int = 11):
        self.nodes: list[tuple[np.ndarray | None, float, int, int]] = []  # normal, cut, left, right; a leaf has no normal and its number as left
        self.spill, self.leaves, rng = spill, 0, np.random.default_rng(seed)
        self.roots = [self._grow(sample, np.arange(len(sample)), rows / max(1, len(sample)), leaf_rows, rng, 0) for _ in range(trees)]

    def _grow(self, x: np.ndarray, own: np.ndarray, scale: float, leaf_rows: int, rng: np.random.Generator, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append((None, 0.0, -1, -1))
        if len(own) * scale > leaf_rows and len(own) >= 16 and depth < 40:
            best = None
            for _ in range(4):
                normal = rng.normal(size=x.shape[1])
                normal /= np.linalg.norm(normal)
                at = x[own] @ normal
                for cut in np.quantile(at, rng.uniform(0.35, 0.65, 2)):
                    larger = max((at <= cut + self.spill).sum(), (at >= cut - self.spill).sum())
                    if best is None or larger < best[0]:
                        best = (larger, normal, float(cut), at)
            larger, normal, cut, at = best
            if larger < 0.9 * len(own):  # else a tight group that no cut parts: its leaf is compared in blocks
                left = self._grow(x, own[at <= cut + self.spill], scale, leaf_rows, rng, depth + 1)
                right = self._grow(x, own[at >= cut - self.spill], scale, leaf_rows, rng, depth + 1)
                self.nodes[me] = (normal, cut, left, right)
                return me
        self.nodes[me] = (None, 0.0, self.leaves, -1)
        self.leaves += 1
        return me

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row of x falls into."""
        rows, leaves = [], []
        todo = [(r, np.arange(len(x))) for r in self.roots]
        while todo:
            node, own = todo.pop()
            normal, cut, left, right = self.nodes[node]
            if not len(own):
                continue
            if normal is None:
                rows.append(own)
                leaves.append(np.full(len(own), left, np.int32))
                continue
            at = x[own] @ normal
            todo += [(left, own[at <= cut + self.spill]), (right, own[at >= cut - self.spill])]
        rows, leaves = np.concatenate(rows or [np.empty(0, int)]), np.concatenate(leaves or [np.empty(0, np.int32)])
        order = np.lexsort((leaves, rows))
        return rows[order], leaves[order]


def near_vectors(vecs: DataFrame, *, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = 8, leaf_rows: int = 512, spill: float = 0.6, fit_rows: int = 16384, block_rows: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked by a cosine of at least `cosine`, in double precision.

    Equal vectors are one class, so copies are never compared. A forest fitted on a sample of at most fit_rows
    vectors deals every class into a leaf or, near a cut, several leaves of each tree; leaves that are still large
    are split again by trees of their own (split_leaves), at every size of the table. Within a leaf all pairs
    are compared, in blocks of block_rows where a leaf is larger (a tight group may hold a third of all rows),
    and only counts and a spanning forest leave the task. A pair that meets in several leaves counts in the
    one with the least number.

    spill is told in standard deviations of the difference that two vectors at the threshold have in a random
    direction: a cut parts such a pair only if they differ by more than twice that. With 0.6 and eight trees
    no link was lost on the tables tested; a link is lost only if all trees part it.

    n_links counts other ids linked directly. Of rows that repeat an id the least vector counts and one row is
    returned. Vectors that are null, zero, of another length than most, or that hold null or non-finite
    components link with nothing; rows with a null id give one such row with a null component. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark, kind = vecs.sparkSession, single(vecs, embedding)
    rows, good = usable(vecs, vec_id, embedding)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.chunked_array([batch.column(1)])) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], pa.binary())], ["vec_id", "same"])

    members = saved(good.select("vec_id", "embedding").mapInArrow(hashed, "vec_id long, same binary"))
    classes = saved(members.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = saved(members.join(classes, "same").select("vec_id", "rep", "n"))
    reps = saved(good.join(classes.select(F.col("rep").alias("vec_id"), "n"), "vec_id").select("vec_id", "n", F.col("embedding").cast(kind).alias("embedding"), "norm"))
    sample = sample_of(reps, fit_rows)
    margin = spill * float(np.sqrt(2 * (1 - cosine) / sample.shape[1]))
    forest = spark.sparkContext.broadcast(Forest(sample, reps.count(), trees, leaf_rows, margin))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                row, leaf = forest.value.assign(matrix(pa.chunked_array([part.column(1)])) / part.column(2).to_numpy()[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(leaf, pa.int64()), pa.array(np.zeros(len(row), bool))], ["vec_id", "leaf", "last"])

    first = saved(reps.select("vec_id", "embedding", "norm").mapInArrow(dealt, "vec_id long, leaf long, last boolean"))
    leaves = split_leaves(first, reps, leaf_rows, margin, fit_rows // 4)
    lists = saved(leaves.groupBy("vec_id").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")))
    # leaves and blocks are dealt by ids alone; each vector is joined to its places, and moves once with each
    pairs = saved(in_blocks(lists.select("vec_id", F.explode("leaves").alias("leaf")), ["leaf"], "vec_id", block_rows))
    pairs = pairs.join(saved(reps.join(lists, "vec_id")), "vec_id").select("leaf", "lo", "hi", "block", "vec_id", "n", "embedding", "norm", "leaves")
    linked = saved(by_group(pairs, ["leaf", "lo", "hi"], _linked(cosine), "vec_id long, label long, links long"))
    labels = components(linked.select(F.col("vec_id").alias("a"), F.col("label").alias("b")))
    counted = linked.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    named = saved(classes.select("rep").join(counted, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left"))
    told = saved(members.join(named, "rep").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id")))
    out = rows.select("vec_id").join(told, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def split_leaves(leaves: DataFrame, vectors: DataFrame, leaf_rows: int, margin: float, fit_rows: int, part_rows: int = 8192) -> DataFrame:
    """(vec_id, leaf) in which no leaf has more than four times leaf_rows rows, but for tight groups that no cut parts.

    A forest fitted on a bounded sample has a bounded number of leaves, so those of a large table hold many rows. Each
    such leaf gets a tree of its own, grown where a bounded sample of its rows is; its rows, dealt in parts of bounded
    size with a copy of that small tree each, move into the tree's leaves. That is repeated until no leaf is too large; a
    level divides leaves by some fit_rows / 32, so the number of levels is the logarithm of the table's size.
    """
    while True:
        sizes = leaves.where("not last").groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 4 * leaf_rows)
        sizes = saved(sizes)
        if sizes.isEmpty():
            return leaves.select("vec_id", "leaf")
        own = saved(leaves.join(sizes, "leaf").join(vectors.select("vec_id", "embedding", "norm"), "vec_id").select("leaf", "size", "vec_id", "embedding", "norm"))
        place = F.pmod(F.xxhash64("vec_id", "leaf", F.lit(31)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        trees = by_group(own.where(place < F.lit(float(fit_rows)) / F.col("size")), ["leaf"], _grown(leaf_rows, margin), "leaf long, tree binary")
        parts = F.ceil(F.col("size") / part_rows).cast("int")
        copies = trees.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast(own.schema["embedding"].dataType).alias("embedding"), F.lit(None).cast("double").alias("norm"), "tree")
        rows = own.select("leaf", F.pmod(F.xxhash64("vec_id", F.lit(41)), parts).cast("int").alias("part"), "vec_id", "embedding", "norm", F.lit(None).cast("binary").alias("tree"))
        moved = by_group(rows.union(copies), ["leaf", "part"], _moved, "vec_id long, leaf long, last boolean")
        leaves = saved(leaves.join(sizes.select("leaf"), "leaf", "left_anti").select("vec_id", "leaf", "last").union(moved))


def _grown(leaf_rows: int, margin: float):
    def grow(rows: pa.Table) -> pa.Table:
        """A tree for a leaf, of the sample of its rows."""
        x, leaf = matrix(rows.column("embedding")) / rows.column("norm").to_numpy()[:, None], rows.column("leaf")[0].as_py()
        order = np.argsort(rows.column("vec_id").to_numpy())
        tree = Forest(x[order], rows.column("size")[0].as_py(), 1, leaf_rows, margin, seed=leaf % (1 << 63))
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return grow


def _moved(rows: pa.Table) -> pa.Table:
    """The new leaves of a part of a leaf's rows, of which one is the tree; a tree of one leaf leaves them for good."""
    is_row = rows.column("tree").is_null()
    leaf = rows.column("leaf")[0].as_py()
    told = rows.filter(pc.invert(is_row)).column("tree").to_pylist()
    rows = rows.filter(is_row).combine_chunks()
    ids = rows.column("vec_id").to_numpy()
    tree = pickle.loads(told[0]) if told else None
    if not len(ids) or tree is None or tree.leaves == 1:
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "leaf": pa.array(np.full(len(ids), leaf), pa.int64()), "last": pa.array(np.ones(len(ids), bool))})
    row, new = tree.assign(matrix(rows.column("embedding")) / rows.column("norm").to_numpy()[:, None])
    name = (np.uint64(leaf % 2**64) ^ np.uint64(0x9E3779B97F4A7C15)) + new.astype(np.uint64)
    name = (name ^ (name >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    name = (name ^ (name >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pa.table({"vec_id": pa.array(ids[row], pa.int64()), "leaf": pa.array((name ^ (name >> np.uint64(31))).view(np.int64)), "last": pa.array(np.zeros(len(row), bool))})


def _linked(cosine: float):
    """Of a block pair of a leaf: each row's links that count here, and the least id of its component here."""

    def find(rows: pa.Table) -> pa.Table:
        leaf, lo, hi, block, ids, n = (rows.column(c).to_numpy() for c in ("leaf", "lo", "hi", "block", "vec_id", "n"))
        raw, norms = matrix(rows.column("embedding")), rows.column("norm").to_numpy()
        x = raw / norms[:, None]
        lists = rows.column("leaves").combine_chunks()
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        earlier = flat < leaf[0]
        names, at = np.unique(flat[earlier], return_inverse=True)
        seen = np.zeros((len(ids), len(names)), np.float32)
        seen[owner[earlier], at] = 1
        near = np.zeros((len(ids), len(ids)), bool)
        for i in range(0, len(ids), 512):
            part = slice(i, i + 512)
            told = x[part] @ x.T
            close = told >= cosine
            # a product's last bits differ with its order, so pairs at the threshold are told by one formula
            a, b = np.nonzero(np.abs(told - cosine) < 1e-12)
            close[a, b] = _cosines(raw, norms, np.minimum(a + i, b), raw, norms, np.maximum(a + i, b)) >= cosine
            near[part] = close & (seen[part] @ seen.T == 0)
        if lo[0] != hi[0]:
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        links, own = near @ n, np.flatnonzero(near.any(axis=1))
        near, label = near[np.ix_(own, own)], ids[own].copy()
        while len(own):
            new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == label).all():
                break
            label = new
        return pa.table({"vec_id": pa.array(ids[own], pa.int64()), "label": pa.array(label, pa.int64()), "links": pa.array(links[own], pa.int64())})

    return find
