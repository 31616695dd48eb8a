from pyspark.sql import functions as F

from scriptorium.operators import registry as R

FILES = "file_name string, source_path string, sha1 string"
OLD = "id string, file_name string, source_path string, sha1 string, row_no long"


def test_ids_in_path_order(spark):
    """a takes its content's old id before b, which has it by name; b falls back to its content's."""
    new = spark.createDataFrame([("a.pdf", "1", "s1"), ("b.pdf", "2", "s2"), ("c.pdf", "3", "s9")], FILES)
    idmap = spark.createDataFrame([("L0007", "b.pdf", "s1", 0), ("L0009", "z.pdf", "s2", 1)], "id string, file_name string, sha1 string, row_no long")
    old = spark.createDataFrame([("L0003", "q.pdf", "0", "s0", 0)], OLD)
    got = {r["source_path"]: r["id"] for r in R.assign_ids(new, old, idmap).collect()}
    assert got == {"1": "L0007", "2": "L0009", "3": "L0010"}


def test_scan_is_idempotent(spark):
    found = spark.createDataFrame([("a.pdf", "1", "s1"), ("b.pdf", "2", "s1"), ("c.pdf", "3", "s3")], FILES)
    none = spark.createDataFrame([], OLD)
    idmap = none.select("id", "file_name", "sha1", "row_no")
    first = R.scan(found, none, idmap)
    assert sorted(r["id"] for r in first.collect()) == ["L0001", "L0002"]
    again = R.scan(found.filter("source_path <> '2'"), first.select("id", "file_name", "source_path", "sha1", F.lit(0).cast("long").alias("row_no")), idmap)
    assert again.count() == 0
    marked = R.scan(found, none, idmap, record_duplicates=True).filter("tier = '去重-重复'").collect()
    assert [(r["source_path"], r["state"]) for r in marked] == [("2", "跳过")]


def merge(spark, base, ours, theirs):
    schema = "id string, file_name string, sha1 string, note string"
    m = R.merge3(*(spark.createDataFrame(x, schema) for x in (base, ours, theirs)), ["file_name", "sha1", "note"])
    return {r["id"]: (r["file_name"], r["note"], r["conflict"]) for r in m.collect()}


def test_merge_new_rows_of_one_id(spark):
    """Ours moves above all numbers of both sides, so it meets neither our other new row nor theirs."""
    got = merge(spark, [], [("L0001", "a", "1", ""), ("L0002", "c", "3", "")], [("L0001", "b", "2", "")])
    assert got == {"L0001": ("b", "", []), "L0002": ("c", "", []), "L0003": ("a", "moved from L0001", ["id"])}


def test_merge_cells(spark):
    base = [("L0001", "a", "1", "s0"), ("L0002", "b", "2", "s0")]
    got = merge(spark, base, [("L0001", "a", "1", "s1"), ("L0002", "x", "2", "s0")], [("L0001", "a", "1", "s2"), ("L0002", "b", "2", "s9")])
    assert got == {"L0001": ("a", "s2", ["note"]), "L0002": ("x", "s9", [])}


def test_text_duplicates(spark):
    df = spark.createDataFrame([("L2", "a.pdf", "t"), ("L1", "a (1).pdf", "t"), ("L3", "b.pdf", "u")], "id string, file_name string, body string")
    assert [tuple(r) for r in R.text_duplicates(df).collect()] == [("L2", "L1")]


def by_turns(new, idmap, used):
    """Files in path order, each taking its name's id if free, else its content's."""
    first = {"name": {}, "sha": {}}
    for id_, name, sha, _ in sorted(idmap, key=lambda r: r[3]):
        if id_ not in used:
            if name:
                first["name"].setdefault(name, id_)
            if sha:
                first["sha"].setdefault(sha, id_)
    taken, out = set(), {}
    for name, path, sha in sorted(new, key=lambda r: r[1]):
        got = next((i for i in (first["name"].get(name), first["sha"].get(sha)) if i and i not in taken), None)
        taken.add(got)
        out[path] = got
    return out


def old_of(spark, new, idmap):
    rows = R.assign_ids(spark.createDataFrame(new, FILES), spark.createDataFrame([("L9000", "q.pdf", "0", "s0", 0)], OLD), spark.createDataFrame(idmap, "id string, file_name string, sha1 string, row_no long"))
    known = {r[0] for r in idmap}
    return {r["source_path"]: r["id"] if r["id"] in known else None for r in rows.collect()}


def test_long_chain_of_losses(spark, monkeypatch):
    """A thousand files, each pushed off its name's id by the one before: the rounds are few, the ids those of taking turns."""
    n, cuts, real = 1000, [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: cuts.append(1) or real(df))
    new = [("first", "p0000", "s1")] + [(f"f{i}", f"p{i:04d}", f"s{i + 1}") for i in range(1, n)]
    idmap = [(f"L{5000 + i}", f"f{i}", f"s{i}", i) for i in range(1, n + 1)]
    got = old_of(spark, new, idmap)
    assert got == by_turns(new, idmap, {"L9000"}) and got["p0500"] == "L5501"
    assert len(cuts) <= 16


def test_ids_by_turns(spark):
    import random

    rng = random.Random(8)
    for _ in range(4):
        new = [(f"f{rng.randrange(25)}", f"p{i:03d}", f"s{rng.randrange(60)}") for i in range(60)]
        idmap = [(f"L{5000 + rng.randrange(40)}", rng.choice([f"f{rng.randrange(25)}", ""]), rng.choice([f"s{rng.randrange(60)}", None]), i) for i in range(80)]
        assert old_of(spark, new, idmap) == by_turns(new, idmap, {"L9000"})


def test_tally_in_order_of_first_rows(spark):
    rows = [(0, "b", "x"), (1, "a", None), (2, "a", ""), (3, "b", "x"), (4, None, "c")]
    got = R.tally(spark.createDataFrame(rows, "row_no long, tier string, state string"), ["tier", "state"]).orderBy("field", F.col("n").desc(), "first").collect()
    assert [tuple(r) for r in got] == [("state", "x", 2, 0), ("state", "（空）", 2, 1), ("state", "c", 1, 4), ("tier", "b", 2, 0), ("tier", "a", 2, 1), ("tier", "（空）", 1, 4)]
