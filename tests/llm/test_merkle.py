import hashlib
import random
import zlib

from pyspark.sql import functions as F

from scriptorium.llm import merkle
from scriptorium.llm.queries import op13_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """Root, and for each leaf what stands beside it on the way: (side, digest) or None."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            paths[i].append(None if other >= len(nodes) else ("LR"[other > k], nodes[other]))
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def brute(rows):
    """The contract, row by row: rows of (doc_id, text, lang, source, n_chars)."""
    groups, out = {}, []
    for doc_id, text, lang, source, n in rows:
        odd = n is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, H(told(doc_id, source, lang, n, text)), H(told(doc_id, source, lang, n + 1, text)) if odd else None, doc_id))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: r[:3])
        trees[g] = tree([r[2] for r in groups[g]])
    root, tops = tree([trees[g][0] for g in order])
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            folded = r[3] or r[2]
            for step in path + top:
                folded = H(folded) if step is None else H(step[1], folded) if step[0] == "L" else H(folded, step[1])
            proof = H(*(s[1] for s in path + top if s))
            out.append((r[4], r[2], trees[g][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def check(spark, rows, tmp_path, name):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = op13_manifest(spark, f"{tmp_path}/{name}")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == (brute(rows) if rows else [])
    return got


def test_against_the_contract(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, rng.choice(["", "é", "x" * rng.randrange(50), None, "a\nb"]), rng.choice(["en", "en", "en", "dé", None, "Z"]), rng.choice(["a", None]), rng.choice([None, 5, 12])) for i in range(1500)]
    rows += [(1, "again", "en", None, 3), (1, "again", "en", None, 3), (None, "no id", "en", "s", 1), (None, None, None, None, None), (7, "long " * 200_000, "one", "s", 1_000_000)]
    got = check(spark, rows, tmp_path, "many")
    bad = {r[0] for r in got if not r[6]}
    assert bad == {r[0] for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0} and bad
    assert check(spark, [], tmp_path, "none") == []
    for n in (1, 2, 3, 5):
        check(spark, [(i, "x", "en", "s", 1) for i in range(n)], tmp_path, f"n{n}")


def test_equal_rows_over_many_ranges(spark, tmp_path):
    check(spark, [(5, "same", "en", "s", 4)] * 700 + [(i, "t", "en", "s", 1) for i in range(600)], tmp_path, "equal")


def test_rounds_of_any_height(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "LINKS", 3)
    check(spark, [(i, "x", "en" if i % 3 else "de", "s", 1) for i in range(333)], tmp_path, "low")


def test_combiner_waits_for_its_children():
    c = merkle.Combiner(5, 8)
    for at in (0, 1, 3):
        c.arrive(0, at, bytes([at]) * 32)
    assert set(c.done) == {(1, 0), (0, 3)} and set(c.partial) == {(2, 0), (1, 1)}
    c.arrive(0, 4, b"4" * 32)  # alone at the end: it climbs to the level below the root at once
    assert (2, 1) in c.done
    c.arrive(0, 2, b"2" * 32)
    assert set(c.done) == {(3, 0)} and not c.partial


def test_names(spark):
    docs = spark.createDataFrame([(1, "k", "v", 2, "n")], "ID long, grp string, val string, tree int, path string")
    got = merkle.manifest(docs, ("ID", "grp", "val"), "ID", "grp").select("id", F.lower(F.hex("leaf")).alias("leaf"), "n", F.hex("proof").alias("proof")).first()
    assert tuple(got) == (1, H(told(1, "k", "v")), 1, "")
