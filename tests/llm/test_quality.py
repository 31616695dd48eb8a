import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import quality

SCHEMA = "doc_id long, text string, kept string"


def naive(t):
    w = (t or "").encode().split()
    k = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    held = {j for i in range(len(w) - 4) if k[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(held)


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(600):
        bad = i % 20 == 0
        docs.append((i, " ".join(f"{word()}{'#' * (1 + i // 40)}" if bad else word() for _ in range(40 + i % 50)), "x"))
        labels.append((i, 0 if bad else 1))
    docs += [(900, None, "x"), (901, "", "x"), (902, "a b c", "x"), (903, "a b c d e f\n" * 40, "x"), (904, "z ### y " * 3000, "x"), (None, "x y z " * 9, "x"), (5, docs[5][1], "x")]
    return docs, [*labels, (900, None), (None, 1), (5, 1)]


def test_counts_and_verdict(spark):
    docs, labels = corpus()
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judge(df, quality.fit(df, known)).collect()
    assert len(got) == len(docs)
    for r in got:
        n = naive(r["text"])
        assert tuple(r[k] for k in quality.BASE) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])
    bad = dict(x for x in labels if x[1] is not None and x[0] is not None)
    kept = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] in bad}
    assert np.mean([kept[i] for i, y in bad.items() if y == 1]) > 0.97
    assert np.mean([kept[i] for i, y in bad.items() if y == 0]) < 0.4


def test_no_labels(spark):
    docs, _ = corpus()
    df, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    forest = quality.fit(df, none)
    assert forest is None
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(df, forest).collect())
    assert quality.judge(df.limit(0), forest).count() == 0


def path(f, t, row):
    """Length of a row's path, step by step."""
    node = 0
    while f.feature[t, node] >= 0:
        node = int(f.child[t, node]) + int(row[f.feature[t, node]] >= f.value[t, node])
    return float(f.path[t, node])


def test_against_brute_force(spark):
    """Every document's verdict from paths walked one by one, and every threshold from the sorted anomalies of all labelled documents."""
    docs, labels = corpus()
    df, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    forests = quality.fit(df, known, max_sample=300)
    x = {i: quality.features(np.array([quality.statistics((t or "").encode())]))[0] for i, t, _ in docs}
    ok = {i for i, t, _ in docs if not quality.failed(np.array([quality.statistics((t or "").encode())]))[0]}

    def anomaly(f, i):
        return 2.0 ** (-(sum(path(f, t, x[i]) for t in range(len(f.feature))) / len(f.feature)) / f.norm)

    y = {i: q for i, q in labels if i is not None and q is not None and i in ok}
    for f in forests:
        good, bad = (sorted((int(anomaly(f, i) * quality.BINS) for i in y if y[i] == q), reverse=True) for q in (1, 0))
        able = [s for s in {*good, *bad} if sum(g >= s for g in good) <= quality.MAX_LOSS / 3 * len(good)]
        judges = able and sum(b >= min(able) for b in bad) >= quality.LIFT * quality.MAX_LOSS / 3 * len(bad)
        assert f.step == (min(able) if judges else quality.BINS + 1)
    assert any(f.step <= quality.BINS for f in forests)
    for r in quality.judge(df, forests).collect():
        i = r["doc_id"]
        assert r["kept"] == (i in ok and all(int(anomaly(f, i) * quality.BINS) < f.step for f in forests)), i


def test_held_out_labels(spark):
    """Fitted on half of the labels: of the other half nearly all bad documents go and nearly all good ones stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality.judge(docs, quality.fit(docs, labels.filter(seen))).join(labels.filter(~seen).select("doc_id", "quality"), "doc_id").filter("not base_failed")
    r = {x["quality"]: (x["n"], x["kept"]) for x in got.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert r[1][1] >= 0.98 * r[1][0] and r[0][1] <= 0.1 * r[0][0] and r[0][0] > 5


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    f = quality.grow(x, np.array([-9.0, -9.0]), np.array([9.0, 9.0]), (0, 1), 1)
    a = f.anomaly(np.r_[x, [[8.0, 8.0]]])
    assert a.argmax() == 500
    n = np.array([90, 9, 1, 0]), np.array([0, 0, 0, 5])
    assert quality.calibrate(np.arange(4), *n, 0.02) == 2 and quality.calibrate(np.arange(4), *n, 0.001) == 3
    assert quality.calibrate(np.arange(4), n[0], np.array([5, 0, 0, 0]), 0.02) == quality.BINS + 1  # tells nothing apart


def test_names_ids_and_many_labels(spark, monkeypatch):
    """Ids may be strings, columns may be called as ours are, and labels too many for a broadcast give the same forests."""
    docs, labels = corpus()
    df = spark.createDataFrame([(str(i), t, 7, "u", 1) for i, t, _ in docs], "Name string, Text string, c0 int, Kept string, n_words int")
    known = spark.createDataFrame([(str(i), y, 3) for i, y in labels], "Name string, Quality int, y int")
    one = quality.fit(df, known, "name", "text")
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    two = quality.fit(df, known, "name", "text")
    assert [f.step for f in one] == [f.step for f in two] and all((f.value == g.value).all() for f, g in zip(one, two, strict=True))
    assert quality.judge(df, one).columns == ["Name", "Text", "c0", *quality.BASE, "base_failed", "anomaly", "kept"]
