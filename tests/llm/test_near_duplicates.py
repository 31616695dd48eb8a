import random

import numpy as np
import xxhash

from scriptorium.llm import graph, simhash
from scriptorium.llm.graph import components

SCHEMA = "doc_id long, text string, fp string"


def naive(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(pairs, nodes):
    p = {n: n for n in nodes}

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_every_pair_within_the_radius_meets():
    masks = [m % (1 << 64) for m in simhash.masks()]
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & diff == 0 for m in masks)
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 36 for m in masks)


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    out = []
    for g in range(12):
        base = [word() for _ in range(120)]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return [*out, *out[:5], None, "", " \n", "one", "ONE", "x " * 5000]


def test_against_all_pairs(spark):
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in simhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    fp = {i: naive(t) for i, t, _ in rows}
    assert all(got[i]["fp"] % (1 << 64) == fp[i] for i in fp)
    ids = sorted(fp)
    want = roots([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    assert {i: got[i]["component_id"] for i in ids} == want
    assert len(set(want.values())) < 0.7 * len(ids)


def test_hot_buckets_in_slices(spark):
    """Chains and clusters of fingerprints in buckets larger than a slice."""
    rng, prints = random.Random(3), {0}
    for _ in range(400):
        prints.add(rng.choice(sorted(prints)) ^ sum(1 << b for b in rng.sample(range(40), rng.choice((1, 3, 4, 6)))))
    prints = sorted(prints)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = simhash.links(df, slice_size=16).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 4 for r in found)
    want = roots([(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 4], prints)
    assert roots([(r["a"], r["b"]) for r in found], prints) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == roots([e for e in edges if e[0] != e[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_several_tasks(spark, monkeypatch):
    """Components are the same where edges fill many tasks as where they fill one."""
    monkeypatch.setattr(graph, "EDGES", 7)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i * 7) % 31) for i in range(31)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in want:
        for x, y in edges:
            if x != y:
                want[x] = want[y] = min(want[x], want[y])
    assert got == want


def test_keep_one(spark):
    a, b, c = (" ".join(np.random.default_rng(k).choice(list("abcdefghij"), 60)) for k in range(3))
    rows = [(1, a, "x"), (2, a, "x"), (3, b, "x"), (3, b, "x"), (4, c, "x"), (None, c, "x"), (1, c, "x"), (6, a, "x")]
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    # id 1 stands for a and for c; one row of it stays, as of id 3; the row without an id stays
    assert [i for i, _ in kept] == ["1", "3", "None"]
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
