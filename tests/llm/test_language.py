import math
import random
import re
from collections import Counter, defaultdict

import pytest

from scriptorium.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
DOCS = [(1, "the cat and the dog", "en", "x"), (2, "the house and garden", "en", "x"), (3, "der hund und die katze", "de", "x"), (4, "das haus und der garten", "de", "x"), (5, None, "de", "x"), (6, "??? 12", None, "x"), (7, "", None, "x"), (None, "und der", None, "x"), (7, "", None, "x")]


def test_prediction(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    got = langid.identify(docs.drop("lang"), langid.train(docs)).collect()
    assert len(got) == len(DOCS)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7, None)] == ["en", "en", "de", "de", "und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_unseen_words_back_off(spark):
    model = langid.train(spark.createDataFrame(DOCS, SCHEMA))
    assert [x for x, _ in langid.predict(model, ["gardener catty", "gartenhaus hunde"])] == ["en", "de"]


def test_nothing_labelled(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = langid.train(empty)
    assert langid.identify(empty, model).count() == 0
    assert langid.predict(model, ["words"]) == [("und", 0.0)]


def naive(rows):
    """A predictor by dictionaries over all labelled rows."""
    letters = lambda t: [w for w in re.findall(r"[^\W\d_]+", t.lower()) if any(map(str.isalpha, w))]
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for t, k in rows:
        if t is not None and k is not None:
            words[k].update(letters(t))
    words = {k: c for k, c in words.items() if c}
    for k, c in words.items():
        for w, n in c.items():
            for order in range(1, 6):
                x = w if order == 1 else f" {w} "
                for i in range(len(x) - order + 1):
                    grams[k][x[i : i + order]] += n
    langs = sorted(words, key=lambda k: (-sum(words[k].values()), k))
    n_all = sum(sum(c.values()) for c in words.values())
    of_order = {k: {g: (sum(n for x, n in grams[k].items() if len(x) == g), sum(len(x) == g for x in grams[k]) or (0 if any(len(x) == g for x in grams[k]) else 1)) for g in range(1, 6)} for k in langs}

    def logs(w):
        if any(w in words[k] for k in langs):
            return [math.log((words[k][w] + 0.5) / (sum(words[k].values()) + 0.5 * len(words[k]))) for k in langs]
        for order in range(5, 0, -1):
            x = w if order == 1 else f" {w} "
            have = [g for g in (x[i : i + order] for i in range(len(x) - order + 1)) if any(g in grams[k] for k in langs)]
            if have:
                return [sum(math.log((grams[k][g] + 0.5) / (of_order[k][order][0] + 0.5 * of_order[k][order][1] + 1)) for g in have) / len(have) for k in langs]
        return [0.0] * len(langs)

    def predict(t):
        bag = Counter(letters(t or ""))
        if not bag or not langs:
            return "und", 0.0
        total = [math.log(sum(words[k].values()) / n_all) for k in langs]
        for w, c in bag.items():
            total = [a + c * b for a, b in zip(total, logs(w), strict=True)]
        best = max(total)
        return langs[total.index(best)], 1 / sum(math.exp((x - best) / math.sqrt(sum(bag.values()))) for x in total)

    return predict


@pytest.mark.parametrize("shard", [2_000_000, 30])
def test_against_dictionaries(spark, shard, monkeypatch):
    """Every word and n-gram of every language counts, also of a rare one beside a frequent one, with one shard or many."""
    monkeypatch.setattr(langid, "SHARD", shard)
    rng = random.Random(4)
    alphabet = {"xx": "abcdeé", "yy": "abcdfß", "rare": "cdefgñ"}
    text = lambda k, n: " ".join("".join(rng.choices(alphabet[k], k=rng.randrange(1, 7))) + rng.choice(["", "", ",", "1", "²"]) for _ in range(n))
    rows = [(text(k, rng.randrange(30)), k) for k, n in (("xx", 300), ("yy", 100), ("rare", 3)) for _ in range(n)] + [("AB Ab", "xx"), (None, "yy"), ("x", None), ("² ³", "marks"), ("", "none")]
    model = langid.train(spark.createDataFrame([(t, k, 1) for t, k in rows], "text string, lang string, word int"))
    assert set(model.langs) == {"xx", "yy", "rare"} and (len(model.words.sizes) > 1) == (shard < 100)
    predict = naive(rows)
    asked = [t for t, _ in rows[::7]] + [text(k, 40) for k in alphabet for _ in range(5)] + [None, "", "123 !", "²", "qqqq ww", "ñandu ßeta", text("yy", 5) * 3000]
    docs = spark.createDataFrame([(i, t, "clash", "u") for i, t in enumerate(asked)], "doc_id long, Text string, Lang_Pred string, n string")
    got = langid.identify(docs, model, "text").orderBy("doc_id").collect()
    for t, r in zip(asked, got, strict=True):
        assert (r["lang_pred"], r["score"]) == (predict(t)[0], pytest.approx(predict(t)[1])), t and t[:50]
    monkeypatch.setattr(langid, "PART", 7)  # long texts in parts
    assert [x[0] for x in langid.predict(model, [t or "" for t in asked])] == [r["lang_pred"] for r in got]


def test_ties(spark):
    model = langid.train(spark.createDataFrame([("same words here", "b"), ("same words here", "a")], "text string, lang string"))
    assert langid.predict(model, ["same words", "others"]) == [("a", 0.5), ("a", 0.5)]


def test_held_out_accuracy(spark):
    from scriptorium.llm.queries import op1_language

    got = op1_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.filter("lang = lang_pred").count()
    assert right >= 0.98 * got.count() > 100
