import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import lines

SCHEMA = "doc_id long, text string, n_lines string"


def line(n, seed):
    return " ".join("".join(random.Random(f"{seed}-{k}").choices("abcdefgh", k=5)) for k in range(n))


def clean(spark, rows):
    return {(r["doc_id"], k): r for k, r in enumerate(lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect())}


def test_long_passage_stays_once(spark):
    passage = line(60, "p")
    rows = [(i, "\n".join([line(3, f"a{i}"), *([] if i % 2 else [line(9, f"x{i}")]), passage, line(4, f"b{i}")]), "x") for i in range(6)]
    got = clean(spark, rows)
    assert [k for (k, _), r in sorted(got.items()) if passage in r["text"]] == [0]
    assert all(line(3, f"a{k}") in r["text"] and line(4, f"b{k}") in r["text"] for (k, _), r in got.items())
    assert [r["n_words_removed"] for _, r in sorted(got.items())] == [0, 60, 60, 60, 60, 60]


def test_boundaries_resist_shifts():
    body = [line(5, f"s{k}").encode() for k in range(80)]
    a, b = ({x[2] for x in lines.chunks(t)} for t in (body, [b"new line", *body[:40], b"another one", *body[40:]]))
    assert len(a) > 10 and len(a - b) <= 3


def test_short_repeated_lines_stay(spark):
    rows = [(i, f"{line(10, f'q{i}')}\nAll rights reserved by us\n{line(12, f'r{i}')}", "x") for i in range(5)]
    assert all(r["n_lines_removed"] == 0 for r in clean(spark, rows).values())


def brute(rows):
    """Every chunk of every document against all earlier ones, by bytes; of equal texts only the first takes part, the others go whole if they hold a chunk."""
    docs = sorted({(-(1 << 63) if i is None else i, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t, *_ in rows})
    first, gone, texts = {}, {}, set()
    for i, k, t in docs:
        full = [x for x in t.encode().split(b"\n") if x.strip()]
        out = set()
        if k in texts:
            gone[i, t] = "" if lines.chunks(full) else b"\n".join(full).decode()
            continue
        texts.add(k)
        for a, b, _, before, after in sorted(lines.chunks(full)):
            where = first.setdefault(tuple(full[a:b]), (full[before:a], full[b:after], (i, k, a, b)))
            if where[2] != (i, k, a, b):
                x, y = 0, 0
                while x < min(a - before, len(where[0])) and full[a - 1 - x] == where[0][-1 - x]:
                    x += 1
                while y < min(after - b, len(where[1])) and full[b + y] == where[1][y]:
                    y += 1
                out |= set(range(a - x, b + y))
        gone[i, t] = b"\n".join(x for j, x in enumerate(full) if j not in out).decode()
    return {(i, t): gone[-(1 << 63) if i is None else i, t or ""] for i, t, *_ in rows}


def random_rows(seed, n=60):
    rng = random.Random(seed)
    runs = [[line(rng.randrange(1, 20), f"run{k}-{j}") for j in range(rng.randrange(1, 9))] for k in range(6)]
    out = []
    for i in range(n):
        parts = [[line(rng.randrange(1, 20), f"own{seed}-{i}-{k}")] if rng.random() < 0.6 else rng.choice(runs) for k in range(rng.randrange(1, 8))]
        out.append((rng.randrange(n), "\n".join(x for p in parts for x in p), "x"))
    return [*out, *out[:5], (None, out[7][1], "x"), (3, "\n".join(["same line again"] * 6), "x")]


@pytest.mark.parametrize(("bits", "rows"), [(64, 200_000), (3, 200_000), (0, 200_000), (64, 1)])
def test_against_brute_force(spark, bits, rows, monkeypatch):
    """Also where most chunks, or all, share their hash, and where equal texts are too many for a broadcast."""
    monkeypatch.setattr(lines, "BROADCAST_ROWS", rows)
    rows = random_rows(bits)
    want, full = brute(rows), lambda t: "\n".join(x for x in t.split("\n") if x.strip())
    got = lines.dedup(spark.createDataFrame(rows, SCHEMA).withColumn("was", F.col("text")), bits=bits).collect()
    assert len(got) == len(rows) and sum(r["n_lines_removed"] for r in got) > 50
    for r in got:
        assert full(r["text"]) == want[r["doc_id"], r["was"]]
    left = {x for r in got for x in r["text"].split("\n")}
    assert left >= {x for r in got for x in r["was"].split("\n") if x}  # no line vanishes from the corpus


def test_colliding_hashes_are_told_apart(spark):
    """A, A, B with one hash for all: B's only copy stays."""
    a, b = line(30, "a"), line(30, "b")
    rows = [(1, a, "x"), (2, a, "x"), (3, b, "x")]
    got = lines.dedup(spark.createDataFrame(rows, SCHEMA), bits=0).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [a, "", b]


def test_short_lines_in_runs(spark):
    """A run of short lines goes whole, its ends too, wherever it stands."""
    rng = random.Random(5)
    runs = [[line(9, f"r{k}-{j}") for j in range(6)] for k in range(40)]
    rows = [(2 * k + c, "\n".join([line(9, f"a{k}{c}{j}") for j in range(rng.randrange(2, 5))] + run + [line(9, f"b{k}{c}{j}") for j in range(3)]), "x") for k, run in enumerate(runs) for c in (0, 1)]
    got = {r["doc_id"]: r["n_lines_removed"] for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[2 * k] == 0 for k in range(40)) and sum(got[2 * k + 1] == 6 for k in range(40)) >= 39


def test_names_and_ids(spark):
    p = line(40, "n")
    df = spark.createDataFrame([("d1", f"{p}\nx", "mine", 5), ("d2", f"{p}\ny", "own", 6)], "_id string, Text string, _gone string, `key` int")
    got = lines.dedup(df, "_id", "text").orderBy("_id").collect()
    assert [(r["_id"], r["Text"], r["_gone"], r["key"]) for r in got] == [("d1", f"{p}\nx", "mine", 5), ("d2", "y", "own", 6)]
    df = spark.createDataFrame([(1, p, "u", "v"), (2, p, "u", "v")], "doc_id int, text string, N_Lines string, `a.b` string")
    got = lines.dedup(df)
    assert got.columns == ["doc_id", "text", "a.b", "n_lines", "n_lines_removed", "n_words_removed"] and sorted(r["text"] for r in got.collect()) == ["", p]


def test_edges(spark):
    p = line(40, "e")
    rows = [(1, None, "x"), (2, "", "x"), (3, "\n\n", "x"), (4, p, "x"), (4, p, "x"), (None, p, "x"), (5, p, "x"), (6, f"{p}\r\n", "x"), (7, "w " * 50000, "x")]
    got = lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and [r["text"] for r in got if r["doc_id"] == 1] == [None]
    assert sorted(str(r["doc_id"]) for r in got if r["text"] == "" and r["n_lines_removed"]) == ["4", "4", "5"]
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
