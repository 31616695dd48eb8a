import math
import random
from collections import Counter

import pytest

from scriptorium.llm import contamination as C

ITEM = "When was the old red tower built near the quiet northern harbour of our town? It was built there in the autumn of eighteen twelve."


def words(n, seed):
    rng = random.Random(seed)
    return [("".join(rng.choices("abcdefgh", k=5))) for _ in range(n)]


def test_wand_finds_all():
    rng, vocabulary = random.Random(1), words(60, 2)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 30)))) for i in range(90)]
    index = C.build(items)
    for _ in range(200):
        query = sorted(set(rng.choices(range(len(index.terms)), k=rng.randrange(1, 25))))
        score = {}
        for t in query:
            for n, s in index.postings[t]:
                score[n] = score.get(n, 0.0) + s
        for threshold in (0.1, 0.4, 0.8):
            want = {n for n, s in score.items() if s >= threshold}
            assert {n for n, _ in C.wand(index, query, threshold)} == want


def test_bounds_hide_no_passage():
    items = [(i, " ".join(words(20 + i, i))) for i in range(40)]
    index = C.build(items)
    texts = [" ".join(words(n, 1000 + n) + t.split() + words(n * 2, 2000 + n)).encode() for n, (_, t) in enumerate(items)]
    assert [[x[0] for x in r] for r in C.search(index, texts)] == [[i] for i, _ in items]


def test_documents(spark):
    fill = " ".join(words(300, 5))
    docs = [(1, f"{fill} {ITEM} {fill}", "x"), (2, fill, "x"), (3, ITEM.upper().replace("?", " ?"), "x"), (4, None, "x"), (5, "", "x"), (6, " ".join(ITEM.split()[:14]) + " " + fill, "x"), (7, "tower red old the was when", "x"), (None, ITEM, "x"), (8, fill * 50 + ITEM, "x"), (9, "alpha beta gamma and more", "x")]
    bench = [(10, ITEM, "x"), (11, None, "x"), (12, " ", "x"), (13, "alpha beta gamma", "x"), (14, ITEM, "x")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, matches string"), spark.createDataFrame(bench, "item_id long, text string, score string")
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in C.matches(d, b).collect()}
    assert got == {1: [10, 14], 2: [], 3: [10, 14], 4: [], 5: [], 6: [], 7: [], None: [10, 14], 8: [10, 14], 9: [13]}
    assert sorted(r["doc_id"] for r in C.clean(d, b).collect()) == [2, 4, 5, 6, 7]
    assert C.clean(d, b.limit(0)).count() == len(docs) and C.clean(d.limit(0), b).count() == 0


def brute(items, text):
    """{item: (score, question, answer)} by scoring every passage against every part of an item with plain BM25 and checking the overlaps."""
    bag = {i: C.normal(t.encode()) for i, t in items if t and C.normal(t.encode())}
    cuts = [(i, [x[len(x) * k // n : len(x) * (k + 1) // n] for k in range(n)]) for i, x in bag.items() for n in [-(-len(x) // C.LONG)]]
    parts = [(i, len(c) > 1, sum(map(len, c[:k])), x) for i, c in cuts for k, x in enumerate(c)]
    n, mean, width = len(parts), sum(len(p[3]) for p in parts) / len(parts), max(16, max(len(p[3]) for p in parts))
    df = Counter(w for p in parts for w in set(p[3]))
    words, out = C.normal((text or "").encode()), {}
    for a in range(0, len(words), width):
        for i, several, before, x in parts:
            passage = words[a : a + 2 * width]
            tf = Counter(x)
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * (C.K1 + 1) / (k + C.K1 * (1 - C.B + C.B * len(x) / mean)) for t, k in tf.items()}
            score = sum(v for t, v in w.items() if t in passage) / sum(w.values())
            if score < C.THRESHOLD:
                continue
            if several:
                start = (a - before) // (2 * width) * 2 * width
                passage = words[max(0, start - width) : start + 5 * width + len(bag[i])]
            have = {tuple(passage[j : j + m]) for m in range(1, 6) for j in range(len(passage) - m + 1)}
            every, q, r = (len(p & have) / len(p) if p else 1.0 for p in (C.shingles(bag[i]), *(C.shingles(C.normal(y)) for y in C.sides(dict(items)[i].encode()))))
            if every >= C.OVERLAP and q >= C.PART and r >= C.PART:
                out[i] = max(out.get(i, (0.0, 0.0, 0.0)), (score, q, r))
    return out


@pytest.mark.parametrize("sizes", [(20_000, 300_000, 512), (60, 200, 512), (20_000, 300_000, 18), (60, 200, 18)])
def test_against_brute_force(spark, sizes, monkeypatch):
    """Whole, cut into slices and groups, and with items in parts: the same items with the same scores."""
    for k, v in zip(("INDEX_WORDS", "PART_WORDS", "LONG"), sizes, strict=True):
        monkeypatch.setattr(C, k, v)
    rng, vocabulary = random.Random(3), words(200, 4)
    items = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randrange(3, 40))) + ("? " + " ".join(rng.choices(vocabulary, k=6)) if i % 3 else "")) for i in range(40)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            item = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                item[rng.randrange(len(item))] = rng.choice(vocabulary)
            parts += [*rng.choices(vocabulary, k=rng.randrange(60)), *item[: rng.choice([len(item), len(item), len(item) // 2 + 1])]]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(f"d{i}", t, "u") for i, t in enumerate(texts)], "_matches string, Text string, box string")
    bench = spark.createDataFrame([*items, (None, items[0][1]), ("none", None), ("blank", " ")], "name string, text string")
    got = {r["_matches"]: r["matches"] for r in C.matches(docs, bench, "text", "name").collect()}
    n = 0
    for i, t in enumerate(texts):
        want = brute([*items, (None, items[0][1])], t)
        assert {m["item_id"] for m in got[f"d{i}"]} == set(want)
        for m in got[f"d{i}"]:
            assert (m["score"], m["question_overlap"], m["answer_overlap"]) == pytest.approx(want[m["item_id"]])
            n += 1
    assert n > 40
    kept = C.clean(docs, bench, "text", "name")
    assert kept.columns == docs.columns and {r["_matches"] for r in kept.collect()} == {k for k, m in got.items() if not m}


def test_parts_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_WORDS", 60)
    monkeypatch.setattr(C, "INDEX_WORDS", 30)
    items = [(i, " ".join(words(25, i)), "x") for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in items], "doc_id long, text string")
    got = C.matches(docs, spark.createDataFrame(items, "item_id long, text string, x string")).collect()
    assert [[m["item_id"] for m in r["matches"]] for r in sorted(got)] == [[i] for i in range(6)]


def test_one_long_item():
    """It widens no passage, and is found whole, with words changed, at any place, cased and marked anew; half of it is not the item."""
    rng, vocabulary = random.Random(7), words(3000, 8)
    long = rng.choices(vocabulary, k=40_000)
    items = [("long", " ".join(long)), *((i, " ".join(words(20, i))) for i in range(60))]
    index = C.build(items)
    assert index.width <= C.LONG and max(index.length) == 40_000 and len(index.of) == 60 + -(-40_000 // C.LONG)
    fill = rng.choices(vocabulary, k=5_000)
    changed = [w if rng.random() > 0.02 else "other" for w in long]
    texts = [long, [*fill, *long], [*long, *fill], [*fill, *changed, *fill], [w.upper() + "," for w in long], long[:20_000], [*fill, *fill], [*fill, *items[5][1].split(), *long[300:900]]]
    got = [[x[0] for x in r] for r in C.search(index, [" ".join(t).encode() for t in texts])]
    assert got == [["long"]] * 5 + [[], [], [4]]


def test_groups_carry_rows_only(spark, monkeypatch):
    """Texts are written once however many groups the benchmark has; repeated rows and null ids keep their own results."""
    monkeypatch.setattr(C, "PART_WORDS", 60)
    items = [(i, " ".join(words(25, i))) for i in range(6)]
    docs = spark.createDataFrame([(1, items[0][1], 5), (1, items[0][1], 6), (None, items[3][1] + " " + items[4][1], 7), (2, None, 8), (3, "none", 9)], "doc_id long, text string, row long")
    written = []
    monkeypatch.setattr(C, "cut", lambda df, cut=C.cut: written.append(df.columns) or cut(df))
    got = C.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["row"]: [m["item_id"] for m in r["matches"]] for r in got} == {5: [0], 6: [0], 7: [3, 4], 8: [], 9: []}
    assert sum("text" in c for c in written) == 1 and sum(c == ["row", "found"] for c in written) > 2
