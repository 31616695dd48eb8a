"""Language identification by words first, then shorter and shorter character n-grams.

Training counts, for each language, the words (runs of letters, lower-cased) of all labelled texts, and the n-grams of 1 to ORDER
code points of all words between blanks. Workers add up their texts' words before anything is shuffled. The model is all of these
counts: sorted arrays of XXH64 hashes in files of the shared checkpoint folder, which workers map into memory; shards grow in
number with the corpus, and nothing is left out. A known word scores its log frequencies; an unseen one the mean log frequency of
its longest n-grams of which any is known. A text's language has the highest sum; score is the posterior of that sum divided by
the root of the number of words, from 0 to 1.

Defined results: null text and text without a letter give `und` and score 0; so does every text if nothing is labelled. Rows
with a null language or text are not learned from; repeated rows count repeatedly. Ties go to the more frequent language, then the
smaller name. A very long text is read in parts of PART words, which add up. Rows are independent; an empty table gives an empty
result. Other columns stay unless their names are those added (in any case).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_root, cut, map_texts, texts_of
from .store import Counts, Places, write_counts

ORDER, SMOOTH = 5, 0.5
#: Entries that a worker adds up before it passes them on; aimed entries of a shard; words scored at once; bytes of word scores a worker keeps.
HELD, SHARD, PART, MEMO_BYTES = 400_000, 2_000_000, 100_000, 64 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def has_letter(word: str) -> bool:
    """False for runs of marks that count as letters by the pattern only."""
    return word.isalpha() or any(map(str.isalpha, word))


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the word between blanks; single code points without them."""
    w = word if n == 1 else f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _hashes(keys) -> np.ndarray:
    """What Spark's xxhash64() gives for the strings."""
    return np.fromiter((xxhash.xxh64_intdigest(k.encode(), 42) for k in keys), np.uint64)


def _rows_of(held: dict[str, Counter], key: str) -> pa.RecordBatch:
    size = sum(map(len, held.values()))
    lang = pa.array((k for k, c in held.items() for _ in range(len(c))), pa.string(), size=size)
    words = pa.array(chain.from_iterable(held.values()), pa.string(), size=size)
    n = pa.array(chain.from_iterable(c.values() for c in held.values()), pa.int64(), size=size)
    held.clear()
    return pa.RecordBatch.from_arrays([lang, words, n], names=["lang", key, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        for c in held.values():
            for w in [w for w in c if not has_letter(w)]:
                del c[w]
        return _rows_of(held, "word")

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for start, texts in texts_of(batch.column(1)):
            for k, t in zip(langs[start : start + len(texts)], texts, strict=True):
                held[k].update(_LETTERS.findall(t.decode().lower()))
            if sum(map(len, held.values())) > HELD:
                yield out()
    if any(held.values()):
        yield out()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for k, w, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            bag = held[k]
            for n in range(1, ORDER + 1):
                for g in grams_of(w, n):
                    bag[g] = bag.get(g, 0) + c
            if len(bag) > HELD:
                yield _rows_of(held, "gram")
    if any(held.values()):
        yield _rows_of(held, "gram")


@dataclass
class Model:
    """What workers need besides the files: languages, and what a key without a count in a language scores there."""

    langs: list[str]
    prior: np.ndarray
    words: Counts
    grams: Counts
    word_floor: np.ndarray
    gram_floor: np.ndarray  # by order and language


class Scores:
    """Scores of words seen of late, a row for each place; one for each worker."""

    def __init__(self):
        self.model, self.places, self.table = "", Places(), np.zeros((0, 0))
        self.real, self.seen = np.zeros(0, bool), np.zeros(0, np.int64)

    def _logs(self, counts: Counts, hashes: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of log frequencies for each hash, and how often it was counted in all (0: unknown)."""
        rows, cols, n = counts.get(hashes)
        logs, total = np.array(np.broadcast_to(floor, (len(hashes), floor.shape[-1]))), np.zeros(len(hashes), np.int64)
        logs[rows, cols] += np.log1p(n / SMOOTH)
        np.add.at(total, rows, n)
        return logs, total

    def _unseen(self, model: Model, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(model.langs)))
        left = list(range(len(words)))
        for n in range(ORDER, 0, -1):
            places, owner, at = Places(), [], []
            for i in left:
                found = grams_of(words[i], n)
                at += map(places.__getitem__, found)
                owner += [i] * len(found)
            if not at:
                continue
            logs, total = self._logs(model.grams, _hashes(places), model.gram_floor[n])
            at, owner = np.array(at), np.array(owner)
            known = total[at] > 0
            size = np.bincount(owner[known], minlength=len(words))
            np.add.at(out, owner[known], logs[at[known]])
            done = size > 0
            out[done] /= size[done, None]
            left = [i for i in left if not done[i]]
        return out

    def of(self, model: Model, words: list[str]) -> np.ndarray:
        """Places of the words, whose rows of the table are filled."""
        if self.model != model.words.folder:
            self.__init__()
            self.model, self.table = model.words.folder, np.zeros((0, len(model.langs)))
        limit = max(2 * PART, MEMO_BYTES // (8 * len(model.langs) + 150))
        if len(self.places) > limit:  # words that are frequent in the corpus stay
            keep = np.flatnonzero(self.seen >= max(16, np.partition(self.seen, -(limit // 4))[-(limit // 4)]))
            old = list(self.places)
            self.places = Places((old[k], i) for i, k in enumerate(keep.tolist()))
            self.table, self.real, self.seen = self.table[keep], self.real[keep], self.seen[keep]
        have = len(self.places)
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        if len(self.places) > have:
            new = list(islice(self.places, have, None))
            real = np.fromiter(map(has_letter, new), bool, len(new))
            logs, total = self._logs(model.words, _hashes(new), model.word_floor)
            unknown = np.flatnonzero((total == 0) & real)
            logs[unknown] = self._unseen(model, [new[i] for i in unknown.tolist()])
            logs[~real] = 0
            self.table, self.real, self.seen = np.concatenate([self.table, logs]), np.concatenate([self.real, real]), np.concatenate([self.seen, total])
        return at


_scores = Scores()


def predict(model: Model, texts: list[str]) -> list[tuple[str, float]]:
    total, n = np.tile(model.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    held: list[tuple[int, list[str]]] = []
    size = 0

    def add() -> None:
        at = _scores.of(model, list(chain.from_iterable(w for _, w in held)))
        first = np.cumsum([0, *(len(w) for _, w in held)])[:-1]
        of = np.array([i for i, _ in held])
        total[of] += np.add.reduceat(_scores.table[at], first)
        n[of] += np.add.reduceat(_scores.real[at].astype(np.int64), first)
        held.clear()

    for i, t in enumerate(texts):
        words = _LETTERS.findall(t.lower()) if model.langs else []
        for a in range(0, len(words), PART):
            if held and (size + len(words) - a > PART or held[-1][0] == i):
                add()
                size = 0
            held.append((i, words[a : a + PART]))
            size += len(held[-1][1])
    if held:
        add()
    out = [("und", 0.0)] * len(texts)
    for i in np.flatnonzero(n).tolist():
        x = (total[i] - total[i].max()) / math.sqrt(n[i])
        out[i] = (model.langs[int(total[i].argmax())], float(1 / np.exp(x).sum()))
    return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows with a language and a text, in the shared checkpoint folder."""
    folder = f"{checkpoint_root(labelled.sparkSession).rstrip('/')}/languages-{uuid.uuid4().hex}"
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    words = cut(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: (r["n"], r["v"]) for r in words.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    langs = sorted(totals, key=lambda k: (-totals[k][0], k))
    if not langs:
        return Model([], np.zeros(0), Counts(folder, "words", [(0, 0)]), Counts(folder, "grams", [(0, 0)]), np.zeros(0), np.zeros((ORDER + 1, 0)))
    grams = cut(words.mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = {(r["lang"], r["k"]): (r["n"], r["v"]) for r in grams.groupBy("lang", F.least(F.length("gram"), F.lit(ORDER)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}

    def stored(df: DataFrame, key: str, entries: int) -> Counts:
        name = f"{key}s"
        bits = max(0, math.ceil(math.log2(max(entries, 1) / SHARD)))

        def shard(k: tuple, table: pa.Table) -> pa.Table:
            n = write_counts(folder, f"{name}-{k[0].as_py()}", table["h"].to_numpy().view(np.uint64), table["col"].to_numpy(), table["n"].to_numpy())
            return pa.table({"shard": pa.array([k[0].as_py()], pa.int32()), "keys": pa.array([n[0]], pa.int64()), "entries": pa.array([n[1]], pa.int64())})

        col = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
        keyed = df.select(F.xxhash64(key).alias("h"), col.alias("col"), "n")
        keyed = keyed.withColumn("shard", F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0))
        got = {r["shard"]: (r["keys"], r["entries"]) for r in keyed.groupBy("shard").applyInArrow(shard, "shard int, keys long, entries long").collect()}
        return Counts(folder, name, [got.get(k, (0, 0)) for k in range(1 << bits)])

    n, v = (np.array([totals[k][j] for k in langs], np.float64) for j in (0, 1))
    gram = np.array([[sizes.get((k, g), (0, 1)) for k in langs] for g in range(ORDER + 1)], np.float64)
    return Model(
        langs, np.log(n / n.sum()), stored(words, "word", int(v.sum())), stored(grams, "gram", int(sum(x for _, x in sizes.values()))),
        np.log(SMOOTH / (n + SMOOTH * v)), np.log(SMOOTH / (gram[..., 0] + SMOOTH * gram[..., 1] + 1)),
    )


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score."""

    def compute(texts: list[bytes]) -> list:
        got = predict(model, [t.decode() for t in texts])
        return [[x for x, _ in got], [s for _, s in got]]

    return map_texts(docs, text_col, [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")], compute, drop=() if keep_text else (text_col,))
