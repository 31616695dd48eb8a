import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dims, scale=256):
    """The contract by whole numbers of Python: (id, cluster, distance, inertia of the cluster, inertia, centroid) of each kept row."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), [x % (1 << 32) for x in v], v) for i, v in kept)[:k]
    cents = [v for _, _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cents = [[sum(col) // own.count(j) for col in zip(*(v for (_, v), o in zip(kept, own) if o == j))] if j in own else c for j, c in enumerate(cents)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in last)
    return sorted(((i, j, d, sum(e for _, o, e in last if o == j), total, cents[j]) for i, j, d in last), key=repr)


def run(spark, rows, **more):
    got = clusters.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_the_contract(spark):
    rng = random.Random(12)
    some = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    rows = [(i, rng.choice(some) if i % 3 else some[0], 0) for i in range(900)]
    rows += [(None, some[1], 1), (5, some[2], 1), (5, some[2], 1), (6, None, 0), (7, [], 0), (8, [1.0, 2.0], 0), (9, [1.0, None, 2.0, 3.0], 0), (10, [float("nan"), 1.0, 1.0, 1.0], 0), (11, [float("-inf"), 1.0, 1.0, 1.0], 0), (12, [0.0, -0.0, -1e-9, 1e-9], 0)]
    got = run(spark, rows, k=12, dims=4)
    assert got == brute(rows, 12, 5, 4) and len(got) == 904


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-5e5, 5e5) for _ in range(3)], 0) for i in range(80)]
    assert run(spark, rows, k=5, dims=3) == brute(rows, 5, 5, 3)


def test_few_none_and_too_large(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [-4.0, 2.5], 0)]
    assert run(spark, rows, k=40, dims=2) == brute(rows, 40, 5, 2)  # two centroids are one place: the second stays empty
    assert run(spark, rows, k=40, dims=5) == [] and run(spark, rows[:0], k=40, dims=2) == []
    with pytest.raises(Exception, match="after scaling, id 4"):
        run(spark, [*rows, (4, [1e9, 0.0], 0)], dims=2)


def test_weights_beyond_one_step():
    x, w = np.array([[5, -(1 << 26)], [-7, 1 << 26]], np.int64), np.array([(1 << 45) + 3, 1 << 41], np.int64)
    assert clusters.sums(x, w, np.array([1, 1]), 3) == [(1, int(w.sum()), [5 * int(w[0]) - 7 * int(w[1]), (1 << 26) * (int(w[1]) - int(w[0]))])]


def test_names(spark):
    df = spark.createDataFrame([(1, [1.0], 2, "x")], "ID long, Vec array<double>, v int, weight string").withColumn("cluster", F.lit(9))
    assert clusters.cluster(df, "ID", "Vec", dims=1).first().asDict() == {"ID": 1, "cluster": 0, "distance": 0, "cluster_inertia": 0, "inertia": 0, "centroid": [256]}
