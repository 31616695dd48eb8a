import pytest

from scriptorium.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def words(n):
    return " ".join(["w"] * n)


def targets(sizes, weights=(5, 2, 1)):
    """By repeated sharing: sources above three times their size stop there, the rest share again."""
    w = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full = sum(sizes.values()), {}
    while True:
        rest = {s for s in sizes if s not in full}
        share = {s: (total - sum(full.values())) * w[s] / sum(w[x] for x in rest) for s in rest} if rest else {}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    largest = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] + 1e-6, (s, t, want[s])
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    return got


def test_targets(spark):
    rows = [(i, words(1 + i % 97), f"s{i % 7}" if i % 3 else "s0", "clash") for i in range(600)]
    check(spark, [*rows, (None, None, None, "x"), (-1, "", None, "x"), (700, words(50), None, "x"), (701, " \t\n", "s0", "x"), (5, words(6), "s5", "x"), (5, words(6), "s5", "x")])


def test_one_source_and_tiny(spark):
    got = check(spark, [(1, words(3), "a", "x")])
    assert got[0]["copies"] == 1
    check(spark, [(1, words(100), "a", "x"), (2, words(1), "b", "x"), (3, words(1), "c", "x")])


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["copies"] for r in mixing.mix(spark.createDataFrame([(1, None, "a", "x"), (2, "", None, "x")], SCHEMA)).collect()] == [0, 0]


def test_long_documents_are_damped(spark):
    rows = [(i, words(8), "a", "x") for i in range(400)] + [(1000 + i, words(2000), "a", "x") for i in range(20)] + [(2000 + i, words(5), "b", "x") for i in range(2000)]
    got = check(spark, rows)
    rate = lambda n: sum(r["copies"] for r in got if r["size"] == n) / sum(r["size"] == n for r in got)
    assert rate(8) > rate(2000)
