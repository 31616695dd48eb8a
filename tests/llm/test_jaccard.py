import random

import numpy as np
import xxhash

import corpus_pipeline
from scriptorium.llm import jaccard, simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(rows):
    """The smallest id of each row's component, by all pairs."""
    sets, p = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                p[max(x, y)] = min(x, y)
    return {i: root(i) for i in p}


def rows_of(seed=7, groups=10, copies=9, size=(5, 160), edits=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    out, passage = [], [word() for _ in range(30)]
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(*size))] + passage * (g % 2)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [*out[:5], None, "", " \n", "one", "ONE", "x " * 5000, "x " * 400]
    rng.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


def test_stage_against_all_pairs(spark):
    rows = rows_of()
    want = roots(rows)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == sorted(set(want.values()))
    assert 20 < len(got) < 0.7 * len(rows)


def test_frequent_shingles_are_dealt(spark, monkeypatch):
    """Also with many shards, and with most shingles counting as very frequent."""
    monkeypatch.setattr(jaccard, "SHARD", 40)
    rows = rows_of(9, 6, 12)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == roots(rows)


def test_large_group_in_slices(spark):
    rows = rows_of(3, 1, 150, (90, 91), 9)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, SCHEMA), slice_size=16).collect()}
    assert got == roots(rows)


def test_edges(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, text), (1, "other words stand here and nothing else at all"), (2, text), (None, text), (3, "z"), (3, "z")]
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert kept == ["1", "3", "None"]
    assert jaccard.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_and_covering_tables_link_first(spark, monkeypatch):
    """What the covering tables link and the sets confirm is joined without prefixes, as all pairs within the radius are; with them the classes are those of all pairs."""
    rows = rows_of(4, 8, 8, (300, 400), 4)
    sets, prints = {i: shingles(t) for i, t in rows}, {}
    for i, found in sets.items():
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in found]
        prints[i] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert jaccard.print_of(np.array(sorted(hashes), np.uint64)) == (prints[i] - (1 << 64) if prints[i] >> 63 else prints[i])
    linked = {i: min(j for j in sets if sets[i] == sets[j]) for i in sets}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((linked[a], linked[b]))
                linked = {i: low if r == high else r for i, r in linked.items()}
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs).collect()} == roots(rows)
    none = lambda members, every, slice_size: members.select("fp", "fp").toDF("a", "b").filter("false")
    monkeypatch.setattr(jaccard, "_compared", none)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs).collect()}
    assert got == linked and len(set(linked.values())) < len({frozenset(s) for s in sets.values()})
