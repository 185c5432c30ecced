"""Centroid clustering by Sort-means, exact in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matrix, quoted, saved

#: Components of this size in steps, and more, take no part: squared distances of 64 of them would not fit a long.
LARGEST = 1 << 27


def nearest_centroids(rows: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and its squared distance.

    From the centroid that a row had before, the others are taken in order of their distance from it, up to the first that is
    strictly further than twice as far as the row is: what comes then is further from the row than its own. (One of exactly twice
    may be as near, and have the smaller number.) Rows of one centroid are scanned together, the furthest first, so that
    those still in the scan are always the first ones.
    """
    best, least = before.copy(), np.empty(len(rows), np.int64)
    for c in np.unique(before):
        own = np.flatnonzero(before == c)
        away = ((rows[own] - centroids[c]) ** 2).sum(axis=1)
        order = np.argsort(-away, kind="stable")
        own, away = own[order], away[order]
        apart = ((centroids - centroids[c]) ** 2).sum(axis=1)
        number, nearest = np.full(len(own), c), away.copy()
        for other in np.argsort(apart, kind="stable"):
            # twice the distance is four times the square: apart > 4 * away, in whole numbers
            still = int(np.searchsorted(-away, -((apart[other] + 3) >> 2), side="right"))
            if not still:
                break
            if other != c:
                d = ((rows[own[:still]] - centroids[other]) ** 2).sum(axis=1)
                better = (d < nearest[:still]) | ((d == nearest[:still]) & (other < number[:still]))
                number[:still][better], nearest[:still][better] = other, d[better]
        best[own], least[own] = number, nearest
    return best, least


def sort_means(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, steps: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance (squared, in steps), cluster_inertia, inertia, centroid_sha256.

    Components x become floor(steps * x). The k vectors with the smallest sha256 of `seed:vec_id` are the first centroids; a round
    assigns every vector to its nearest (ties: the smaller number) and replaces each centroid that has vectors by the floor of their
    mean, exactly; vectors are assigned once more at the end. Each round reads the last one's table and writes its own; tasks
    hand on one sum per centroid, and only k centroids reach the driver.

    Vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a
    component of 2**27 steps and more, whose distances do not fit a long. Null ids hash last; equal hashes (repeated ids) are told
    apart by components, and equal vectors of one id are centroids each, of which the second stays empty. Fewer than k vectors
    are as many centroids. Sums that do not
    fit a long are null. An empty table gives an empty result. Other columns are ignored.
    """
    x = quoted(vector)
    fits = F.coalesce((F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) * steps < float(LARGEST))), F.lit(False))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * steps).cast("int"))
    rows = saved(vectors.where(fits).select(quoted(vec_id).cast("long").alias("vec_id"), whole.alias("steps"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = np.array([r[0] for r in rows.orderBy(hashed.asc_nulls_last(), "steps").select("steps").limit(k).collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        rows = saved(_assigned(rows, centroids))
        centroids = _means(rows, centroids)
    rows = saved(_assigned(rows, centroids))
    each = {r["cluster"]: int(r["inertia"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    fitting = lambda n: n if n < 1 << 63 else None
    told = [(c, fitting(n), fitting(sum(each.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in each.items()]
    named = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at the most


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = pa.chunked_array([batch.column("steps")])
                best, least = nearest_centroids(matrix(own).astype(np.int64), batch.column("cluster").to_numpy(), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("steps"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "steps", "cluster", "distance"])

    return rows.select("vec_id", "steps", "cluster").mapInArrow(run, rows.schema)


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids replaced by the floor of their vectors' mean."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster").to_numpy()
                n += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, matrix(pa.chunked_array([batch.column("steps")])).astype(np.int64))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own], pa.int64()), pa.array(list(sums[own]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.select("steps", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    told = parts.select("cluster", "n", F.posexplode("sums").alias("place", "value")).groupBy("cluster", "place").agg(exact("n"), exact("value")).collect()
    out = centroids.copy()
    for r in told:
        out[r["cluster"], r["place"]] = int(r["value"]) // int(r["n"])
    return out
