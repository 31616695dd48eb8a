import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scriptorium.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens string"


def texts():
    rng = random.Random(4)
    some = "abcdefghijklmnopqrstuvwxyz ABC'sßéñÜ0123456789.,!?-_\n\t ΣςİıДжш汉字かな한글éａ\x1c\x85🙂<|>"
    out = ["".join(rng.choices(some, k=rng.randrange(1, 200))) for _ in range(300)]
    return [*out, "", " ", "it's we'll I'D", "<|startoftext|>hi <|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "aaaaaaaaaa", "ΟΔΟΣ", "a" * 3000, "".join(rng.choices("abcde", k=9000)), "ab " * 20000]


def test_as_the_library(spark):
    t, rows = Tokenizer.from_file(PATH), texts()
    want = [len(e.ids) for e in t.encode_batch(rows, add_special_tokens=False)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(rows)] + [(999, None, "x"), (None, "hi", "x"), (1, rows[1], "x")], SCHEMA)
    got = tokens.token_counts(df, PATH).collect()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_tokens"] for i in range(len(rows))] == want
    assert all(by[i]["n_bytes"] == len(x.encode()) and by[i]["over_limit"] == (n > 2048) for i, (x, n) in enumerate(zip(rows, want, strict=True)))
    assert (by[999]["n_bytes"], by[999]["n_tokens"], by[None]["n_tokens"], len(got)) == (0, 0, 1, len(rows) + 3)
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


def test_long_words_either_way():
    m = tokens.Merger(json.load(open(PATH, encoding="utf-8")))
    for seed in range(20):
        w = "".join(random.Random(seed).choices("abcdeth in", k=400)).replace(" ", "e").encode()
        assert m.long(w) == m.lengths([w])[0]


def test_caches_turn_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    m, rng = tokens.Merger(json.load(open(PATH, encoding="utf-8"))), random.Random(2)
    batches = [[" ".join(rng.choices(["the", "of", "and", *(f"w{i}" for i in range(300))], k=30)).encode() for _ in range(3)] for _ in range(12)]
    got = [n for b in batches for n in m.counts(b)]
    t = Tokenizer.from_file(PATH)
    assert got == [len(t.encode(x.decode(), add_special_tokens=False).ids) for b in batches for x in b] and len(m.cache) < 150


def test_other_specifications_are_refused():
    spec = json.load(open(PATH, encoding="utf-8"))
    tokens.supported(spec)
    for part, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("model", {**spec["model"], "byte_fallback": True}), ("added_tokens", [{"content": "[X]"}])):
        with pytest.raises(ValueError, match=part):
            tokens.supported({**spec, part: value})
