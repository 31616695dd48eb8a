import random
import re
import time

from scriptorium.llm import licenses
from scriptorium.llm.queries import op11_licenses

SCHEMA = "doc_id long, text string, score string"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base(text):
    """The contract: words, and the places at which the words of a phrase stand one after the other."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    at = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def within(words, n):
    """All spans of whole words within the notice's bound: (first, last, errors)."""
    out = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            s = " ".join(words[i : j + 1])
            if len(s) > len(n.text) + n.errors:
                break
            if s.startswith(n.text[: n.head]) and (e := distance(s[n.head :], n.text[n.head :])) <= n.errors:
                out.append((i, j, e))
    return out


def altered(rng):
    n = rng.choice(licenses.NOTICES)
    s = list(n.text)
    for _ in range(rng.randrange(n.errors + 3)):
        k = rng.randrange(len(s))
        s[k : k + rng.randrange(2)] = rng.choice(["", *"abcdelns "])
        s = s or ["a"]
    return rng.choice(["", "a b ", "license ", "mit ", "gnu gnu "]) + "".join(s) + rng.choice(["", " x", " license", " public license", " " + n.text])


def test_fuzzy_spans_against_all_spans():
    """A span is within its bound, and every span within a bound is one of them or overlaps a better one."""
    rng, hits = random.Random(5), 0
    for _ in range(150):
        text = altered(rng)
        _, got, score = licenses.spans(text.encode())
        for n in licenses.NOTICES:
            every, mine = within(text.split(), n), [(s["first_word"], s["last_word"], s["errors"]) for s in got if s["notice"] == n.text]
            assert set(mine) <= set(every), text
            assert all(any(a <= j and i <= b and e <= f for a, b, e in mine) for i, j, f in every), (n.text, text)
            hits += bool(every)
        assert (score > 0) == bool(got) and score <= 1
    assert hits > 60


def test_base_against_the_contract(spark, tmp_path):
    rng = random.Random(6)
    parts = ["MIT", "license", "License", "GNU", "general", "public", "Apache", "CC", "BY", "cc-by", "é", "licensé", "\n", "\x00", "x", "mit-license", "cc by nc", "K", "ﬁ", "mitlicense"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "-", ".\n", ""]) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [None, "", "mit license " * 5000, "x" * 300_000, "GNU General Public License, version 3.", "cc by cc by", "no mit license", "mit license"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "mit license", "x"), (4, texts[4], "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_licenses(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = got.collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        assert tuple(by[i][1:6]) == base(t), t
        assert set(filter(None, by[i]["base_labels"].split(","))) <= set(by[i]["labels"].split(",")) and (by[i]["score"] == 1) >= (by[i]["n_base"] > 0)
    assert by[None]["labels"] == "mit"


def labels(text):
    return sorted({s["label"] for s in licenses.spans(text.encode())[1]})


def test_labels_of_its_own():
    assert labels("under the MIT licence") == ["mit"] and labels("the kit license") == [] and labels("this bit license") == []
    assert labels("Permission is herby granted, free-of-charge to any person obtaining a copy") == ["mit"]
    assert labels("GNU Lesser Genral Public License") == ["lgpl"] and labels("gnu affero general public license") == ["agpl"]
    assert labels("Creative Commons Atribution 4.0, CC BY-SA") == ["cc-by", "cc-by-sa"]
    assert labels("He asked the public for a general license to fish; apaches licensed it.") == []
    text = "Été — see, MIT  \n Licence!"
    (s,) = licenses.spans(text.encode())[1]
    assert text[s["start"] : s["end"]] == "MIT  \n Licence" and (s["first_word"], s["last_word"], s["errors"], s["base"]) == (3, 4, 1, False)


def test_pieces_cover_the_notice():
    for n in licenses.NOTICES:
        pieces = n.seeds()
        assert len(pieces) == n.errors + 1 and "".join(p for _, p in pieces) == n.text and all(n.text[a:].startswith(p) for a, p in pieces)


def test_linear_time():
    def took(n):
        start = time.perf_counter()
        licenses.spans(b"the mit license permission is hereby " * n)
        return time.perf_counter() - start

    took(100)
    assert took(20_000) < 4 * took(10_000) + 0.2


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "mit license", "x")], SCHEMA)
    assert licenses.scan(df.limit(0)).count() == 0
    row = licenses.scan(df, keep_text=True).first()
    assert row["text"] == "mit license" and row["score"] == 1.0 and row["notices"][0]["label"] == "mit"
