import math
from collections import Counter, defaultdict

import pytest

from scriptorium.llm import ngrams


def naive(train):
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    uni, bi = Counter(), Counter()
    for t in train:
        x = tok(t)
        uni.update(x)
        bi.update(zip([None, *x[:-1]], x, strict=True))
    cont, total, g = Counter(v for _, v in bi), Counter(), defaultdict(float)
    d1, d0 = ([0, *ngrams._discounts([sum(c == k for c in n.values()) for k in (1, 2, 3, 4)])] for n in (bi, cont))
    for (u, _), n in bi.items():
        total[u] += n
        g[u] += d1[min(n, 3)]
    share = sum(d0[min(n, 3)] for n in cont.values()) / len(bi)

    def p(u, v):
        low = share / (len(uni) + 1) + ((cont[v] - d0[min(cont[v], 3)]) / len(bi) if v in cont else 0)
        if u not in total:
            return low
        n = bi.get((u, v), 0)
        return (n - d1[min(n, 3)]) / total[u] + g[u] / total[u] * low

    n, v = sum(uni.values()), len(uni)
    return lambda t: (sum(math.log10(p(a, b)) for a, b in zip([None, *tok(t)[:-1]], tok(t), strict=True)), sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tok(t)), len(tok(t)), sum(x in uni for x in tok(t)), n)


TEXTS = [f"a b c d{i % 5} e{i % 3} a b x{i} the the" for i in range(60)] + ["The CAT", "", None, "a b c " * 300, "a b", "a b"]


@pytest.mark.parametrize("sizes", [(2_000_000, 2_000_000, 4_000_000), (16, 10, 40)])
def test_against_dictionaries(spark, sizes, monkeypatch):
    """Also with many small shards and ranges, and most contexts spread over shards."""
    for k, v in zip(("VOCAB", "RANGE", "TOKENS"), sizes, strict=True):
        monkeypatch.setattr(ngrams, k, v)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string")
    model = ngrams.train(docs.filter("doc_id % 4 <> 1"))
    assert (len(model.pair_sizes) > 1) == (sizes[0] < 100)
    score = naive([t for i, t in enumerate(TEXTS) if i % 4 != 1])
    rows = docs.unionByName(spark.createDataFrame([(99, "unseen words", "x"), (None, "a unseen b", "x")], docs.schema))
    if sizes[0] < 100:  # workers read the module's own sizes, so small ranges are tested where they were set
        texts = [(r["text"] or "").encode() for r in rows.collect()]
        context, ids, counts, first = ngrams._contexts(model, texts)
        import numpy as np

        got = np.add.reduceat(np.log10(ngrams.probabilities(model, context, ids)), first)
        for t, x in zip(rows.collect(), got.tolist(), strict=True):
            assert x == pytest.approx(score(t["text"])[0])
        return
    for r in ngrams.score(rows, model).collect():
        want = score(r["text"])
        assert (r["score"], r["base_score"]) == (pytest.approx(want[0]), pytest.approx(want[1]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[2:]


def test_no_training_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = ngrams.train(empty)
    assert ngrams.score(empty, model).count() == 0
    assert ngrams.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first()["score"] == 0.0


def test_too_many_words_for_a_key(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    monkeypatch.setattr(ngrams, "WIDEST", 25)  # a, b, c and the end mark, and one more
    ngrams.train(docs)
    monkeypatch.setattr(ngrams, "WIDEST", 24)
    with pytest.raises(OverflowError):
        ngrams.train(docs)


def test_held_out_perplexity(spark):
    from scriptorium.llm.queries import op5_language_model

    r = op5_language_model(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert r["s"] > r["b"]
