"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors with multiplicities.

Vectors become integers, floor(SCALE * x) by component. Equal ones are grouped once, with their number (partial sums before the
shuffle, so copies cost nothing afterwards); every round assigns the distinct vectors and sums weight times component in whole
numbers, a row for each cluster and component from each task; at the end the assignments are joined back to the ids.

Exactness: components are whole numbers of at most 2^27 in size, so squared distances fit in 63 bits; small ones go through doubles
where every intermediate value is a whole number below 2^53. Sums are Python's whole numbers in tasks and decimals in Spark. The
driver holds the centroids: k vectors.

Defined results: vectors that are null, of another length or with a null or non-finite component are not kept; a kept vector with a
component of 2^27 or more after scaling is an error, as its distances don't fit; fewer than k kept vectors give as many centroids;
an id of null counts as the empty text in the hash that chooses the first centroids, equal ids are ordered by their vectors, and
equal rows are rows of their own; equal distances go to the smaller number; an empty cluster keeps its centroid; an inertia beyond
63 bits is null; no vectors, no rows. Other columns do not enter and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Box, cut, join_one, release

LIMIT, EXACT = 1 << 27, 1 << 22
#: Distinct vectors that are compared with all centroids at a time.
BLOCK = 8192


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """Kept vectors: id and v, the integers as 4 bytes each, most significant first (negative ones in two's complement)."""
    box = Box(vectors, id=id_col, x=vector_col)
    x = F.transform("x", lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform("x", lambda c: F.floor(c * scale))
    limit = F.forall("x", lambda c: F.abs(c * scale) < LIMIT)
    kept = box.df.select("id", x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") == dims)).filter(finite)
    told = F.when(limit, whole).otherwise(F.raise_error(F.concat(F.lit(f"clusters: a component is {LIMIT} or more after scaling, id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    packed = F.array_join(F.transform(told, lambda c: F.lpad(F.hex(c.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")
    return kept.select("id", F.unhex(packed).alias("v"))


def unpacked(v: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(v), ">i4").astype(np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smaller of equal ones) and the squared distance, both exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        dist = ((a * a).sum(1)[:, None] + (c * c).sum(1) - 2 * (a @ c.T)).astype(np.int64)
    else:
        dist = np.stack([((x - row) ** 2).sum(1) for row in centroids], 1)
    best = dist.argmin(1)
    return best, dist[np.arange(len(x)), best]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, unpacked(part.column("v").to_pylist(), dims), np.asarray(part.column("weight").to_numpy(zero_copy_only=False), np.int64)


def sums(x: np.ndarray, weight: np.ndarray, cluster: np.ndarray, k: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, weights, weighted sum by component) in exact whole numbers: weights enter by 20 bits at a time."""
    out = []
    order = np.argsort(cluster, kind="stable")
    edges = np.searchsorted(cluster[order], np.arange(k + 1))
    for c in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[c] : edges[c + 1]]
        total, w, shift = [0] * x.shape[1], weight[own], 0
        while w.any():
            low = ((w & 0xFFFFF)[:, None] * x[own]).sum(0).tolist()
            total = [t + (s << shift) for t, s in zip(total, low, strict=True)]
            w, shift = w >> 20, shift + 20
        out.append((c, sum(weight[own].tolist()), total))
    return out


def step(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the centroids that follow."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, totals = [0] * k, [[0] * dims for _ in range(k)]
        for _, x, weight in _blocks(batches, dims):
            for c, w, s in sums(x, weight, nearest(x, centroids)[0], k):
                weights[c] += w
                totals[c] = [a + b for a, b in zip(totals[c], s, strict=True)]
        own = [c for c in range(k) if weights[c]]
        rows = [(c, j, v) for c in own for j, v in enumerate([*totals[c], weights[c]])]
        release()
        if rows:
            c, j, v = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array([str(n) for n in v])], names=["cluster", "j", "total"])

    parts = distinct.select("v", "weight").mapInArrow(run, "cluster int, j int, total string")
    # k * (dims + 1) rows in all
    rows = parts.groupBy("cluster", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by = {(r["cluster"], r["j"]): int(r["total"]) for r in rows}
    return np.array([[by[c, j] // by[c, dims] for j in range(dims)] if (c, dims) in by else centroids[c].tolist() for c in range(k)], np.int64)


def first_centroids(kept: DataFrame, k: int, dims: int, salt: str) -> np.ndarray:
    """The k kept vectors whose ids have the smallest hashes, in that order."""
    told = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(told.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return unpacked([bytes(r["v"]) for r in rows], dims)


def assign(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct with cluster and distance."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, _ in _blocks(batches, dims):
            c, d = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("v", "weight")), pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["v", "weight", "cluster", "distance"])
        release()

    return distinct.select("v", "weight").mapInArrow(run, "v binary, weight long, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """A row for each kept vector: id, cluster, distance, cluster_inertia, inertia (squared distances added up), centroid (array)."""
    kept = cut(quantised(vectors, id_col, vector_col, dims, scale))
    centroids = first_centroids(kept, k, dims, salt)
    schema = "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    spark = kept.sparkSession
    distinct = cut(kept.groupBy("v").agg(F.count("*").alias("weight")))
    for _ in range(rounds if len(centroids) else 0):
        centroids = step(distinct, centroids)
    if not len(centroids):
        centroids = np.zeros((0, dims), np.int64)
        done = distinct.select("v", "weight", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        done = cut(assign(distinct, centroids))
    exact = F.sum(F.col("distance").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)"))
    by = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(exact.alias("s")).collect()}  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    told = spark.createDataFrame([(c, fits(by.get(c, 0)), fits(sum(by.values())), row.tolist()) for c, row in enumerate(centroids)], schema)
    # of one vector there may be any number of rows: they are dealt over tasks
    back = join_one(kept, done.select("v", "cluster", "distance"), ["v"], each=256)
    return back.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")

