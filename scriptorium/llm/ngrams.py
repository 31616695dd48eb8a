"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays that workers map into memory.

Files, in a folder of the shared checkpoint folder: shards of the vocabulary (sorted XXH64 hashes of words, and their counts; a
word's id is its place among all), ranges of ids (bigram types that follow the word once, twice, more often; distinct words
before it), and shards of bigrams (sorted keys context * base + word, and counts). (See store.py.)

Counting: workers add up sorted arrays of keys before they pass them on, a row for each shard; a shard's task merges its rows.
Bigrams are sharded by context, those of contexts with over 1/HOT of a shard's tokens by the pair, so no context fills a task. Shards
grow in number with the corpus, not in size.

Probability: max(c(uv) - D, 0) / c(u) + g(u) * p(v), where p is the continuation probability: (n(.v) - D') / n(..) plus the
discounts' share spread evenly over the vocabulary and one unknown word; D and D' come from the counts of counts. After an
unknown word p(v) alone holds. A text starts after a start mark and ends with an end mark.

Defined results: null text is empty (only the end mark); without training texts every token has probability 1; repeated rows count
repeatedly; there are no ties; over 3.0 billion distinct words, whose pairs have no key in 63 bits, are an error. Other columns stay unless their names are those added.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_root, cut, map_texts, texts_of
from .store import Places, columns, find_sorted, forget, mapped, write

#: Aimed entries of a vocabulary shard, ids of a range, tokens of a bigram shard; entries a worker adds up; words whose ids it keeps.
VOCAB, RANGE, TOKENS, HELD, MEMO, HOT = 2_000_000, 2_000_000, 4_000_000, 3_000_000, 200_000, 8
WIDEST = 1 << 63  # keys of two ids are below this
_END = b"\n"  # no word holds a line feed


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(_END)
    return words


def _least(*columns: np.ndarray) -> list[np.ndarray]:
    """Counts in 4 bytes each if all fit, else in 8; a file's size tells which."""
    wide = any(len(c) and int(c.max()) >> 32 for c in columns)
    return [c.astype(np.uint64 if wide else np.uint32) for c in columns]


def _width(raw: np.ndarray, n: int, fixed: int, columns: int) -> type:
    return np.uint64 if len(raw) > n * (fixed + 4 * columns) else np.uint32


@dataclass
class Model:
    """What tasks need besides the files: sizes, totals and discounts."""

    folder: str
    vocab_sizes: list[int]
    n_tokens: int
    n_docs: int
    pair_sizes: list[int]
    hot: np.ndarray
    discounts: tuple[float, float, float]
    low: tuple[float, float, float]
    n_types: int
    low_share: float

    @property
    def size(self) -> int:
        return sum(self.vocab_sizes)

    def starts(self) -> np.ndarray:
        return np.r_[0, np.cumsum(self.vocab_sizes)].astype(np.int64)

    def vocab(self, k: int) -> list[np.ndarray]:
        n = self.vocab_sizes[k]
        return columns(mapped(self.folder, f"vocab-{k}"), (n, np.uint64), (n, np.int64)) if n else [np.zeros(0, np.uint64), np.zeros(0, np.int64)]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by hash, -1 for unknown ones."""
        found = find_sorted(hashes, len(self.vocab_sizes), lambda k: self.vocab(k)[0])
        return np.where(found < 0, -1, (found & ((1 << 40) - 1)) + self.starts()[found >> 40])

    def by_id(self, ids: np.ndarray, column: int) -> np.ndarray:
        """A column of the ranges' files (0 to 2: types after it once, twice, more often; 3: types before it) for ids."""
        out = np.zeros(len(ids), np.int64)
        part = ids // RANGE
        for k in np.unique(part).tolist():
            rows = np.flatnonzero(part == k)
            size = min(RANGE, self.size + 1 - k * RANGE)
            raw = mapped(self.folder, f"ids-{k}")
            out[rows] = columns(raw, *[(size, _width(raw, size, 0, 4))] * 4)[column][ids[rows] - k * RANGE]
        return out

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        out, starts = np.zeros(len(ids), np.int64), self.starts()
        shard = np.searchsorted(starts, ids, "right") - 1
        for k in np.unique(shard).tolist():
            rows = np.flatnonzero(shard == k)
            out[rows] = self.vocab(k)[1][ids[rows] - starts[k]]
        return out

    def shard_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        own = np.where(np.isin(context, self.hot), context * np.int64(1_000_003) + word, context)
        return ((own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % max(len(self.pair_sizes), 1)

    def pair_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often word followed context. Each pair is looked up once, the pairs of a shard in the order of its keys."""
        keys, back = np.unique((context * np.int64(self.size + 1) + word).astype(np.uint64), return_inverse=True)
        base, found = np.uint64(self.size + 1), np.zeros(len(keys), np.int64)
        shard = self.shard_of((keys // base).astype(np.int64), (keys % base).astype(np.int64))
        order = np.argsort(shard.astype(np.int16) if len(self.pair_sizes) < 1 << 15 else shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(len(self.pair_sizes) + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            rows = order[edges[k] : edges[k + 1]]
            raw, n = mapped(self.folder, f"pairs-{k}"), self.pair_sizes[k]
            have, counts = columns(raw, (n, np.uint64), (n, _width(raw, n, 8, 1)))
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
                found[rows] = np.where(have[at] == keys[rows], counts[at].astype(np.int64), 0)
        return found[back]


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


class _Memo:
    """Ids and counts of words seen of late, as arrays by place; a dictionary gives the place. One for each worker."""

    def __init__(self):
        self.folder, self.places = "", Places()
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def known(self, model: Model, each: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of the n words of all lists in order; of unknown ones -1 and 0."""
        if self.folder != model.folder:
            self.__init__()
            self.folder = model.folder
        if len(self.places) > MEMO:  # words that are frequent in the corpus stay
            keep = np.flatnonzero(self.counts >= max(16, np.partition(self.counts, -(MEMO // 4))[-(MEMO // 4)]))
            words = list(self.places)
            self.places = Places((words[k], i) for i, k in enumerate(keep.tolist()))
            self.ids, self.counts = self.ids[keep], self.counts[keep]
        old = len(self.places)
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(each)), np.int32, n)
        if len(self.places) > old:
            hashes = np.fromiter(map(_hash, islice(self.places, old, None)), np.uint64, len(self.places) - old)
            ids = model.find(hashes) if model.size else np.full(len(hashes), -1)
            counts, have = np.zeros(len(ids), np.int64), ids >= 0
            counts[have] = model.count_of(ids[have])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        return self.ids[at], self.counts[at]


_memo = _Memo()


def _contexts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of the texts: context id (the start mark's is the vocabulary's size), id, count, and the texts' first tokens."""
    each = [tokens(t) for t in texts]
    first = np.cumsum([0, *map(len, each)])
    ids, counts = _memo.known(model, each, int(first[-1]))
    first = first[:-1]
    context = np.r_[0, ids[:-1]]
    context[first] = model.size
    return context, ids, counts, first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        h = np.fromiter(map(_hash, held), np.uint64, len(held)).view(np.int64)
        n = np.fromiter(held.values(), np.int64, len(held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    for batch in batches:
        for _, texts in texts_of(batch.column(0)):
            for t in texts:
                held.update(t.lower().split())
            held[_END] += len(texts)
            if len(held) > HELD // 6:
                yield out()
    if held:
        yield out()


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[at], np.add.reduceat(counts, at)

        def out() -> pa.RecordBatch:
            keys, counts = merged()
            held.clear()
            base = np.uint64(model.size + 1)
            shard = model.shard_of((keys // base).astype(np.int64), (keys % base).astype(np.int64))
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order].astype(np.uint32), shard[order]
            at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist()
            ends = [*at[1:], len(keys)]
            return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a in at], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], names=["shard", "keys", "counts"])

        size, total = 0, 0
        for batch in batches:
            for _, texts in texts_of(batch.column(0)):
                context, ids, _, _ = _contexts(model, texts)
                keys, counts = np.unique((context * np.int64(model.size + 1) + ids).astype(np.uint64), return_counts=True)
                if total + len(ids) >> 32:  # a row's counts have 4 bytes
                    yield out()
                    size, total = 0, 0
                held.append((keys, counts))
                size, total = size + len(keys), total + len(ids)
                if size > HELD:
                    yield out()
                    size, total = 0, 0
        if held:
            yield out()

    return run


def _shards(n: int, each: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(n, 1) / each)))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all texts of docs, in the shared checkpoint folder."""
    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    text = docs.select(F.col(text_col).alias("text"))
    words = cut(text.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not size:
        return Model(folder, [], 0, 0, [], np.zeros(0, np.int64), (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 0, 1.0)
    if (size + 1) ** 2 > WIDEST:
        raise OverflowError(f"{size} distinct words: keys of two ids don't fit in 63 bits")
    shards = _shards(size, VOCAB)
    bits = shards.bit_length() - 1

    def vocab(key: tuple, table: pa.Table) -> pa.Table:
        h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
        order = np.argsort(h)
        write(folder, f"vocab-{key[0].as_py()}", h[order], n[order])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    top = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    sizes = dict(words.withColumn("shard", top).groupBy("shard").applyInArrow(vocab, "shard int, n long").collect())
    model = Model(folder, [sizes.get(k, 0) for k in range(shards)], total, 0, [0] * _shards(total, TOKENS), np.zeros(0, np.int64), (0, 0, 0), (0, 0, 0), 0, 0.0)
    end = model.find(np.array([_hash(_END)], np.uint64))
    model.n_docs = int(model.count_of(end)[0])
    # contexts so frequent that their bigrams are spread over the shards: fewer than HOT times the shards
    limit = total / len(model.pair_sizes) / HOT
    hot = np.array([r["h"] for r in words.filter(F.col("n") > limit).select("h").collect()], np.int64).view(np.uint64)
    model.hot = np.r_[model.find(hot), model.size] if model.n_docs > limit else model.find(hot)
    forget(folder)

    ranges, base = math.ceil((model.size + 1) / RANGE), np.uint64(model.size + 1)

    def by_range(ids: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple]:
        part = ids // RANGE
        edges = np.searchsorted(part, np.arange(ranges + 1))
        return [(kind, k, (ids[a:b] - k * RANGE).astype(np.uint32).tobytes(), np.stack([c[a:b] for c in columns]).astype(np.int64).tobytes()) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]

    made = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("columns", pa.binary()), ("stats", pa.list_(pa.int64()))])

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[at], np.add.reduceat(counts, at)
        write(folder, f"pairs-{shard}", keys, *_least(counts))
        u = (keys // base).astype(np.int64)
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        rows = by_range(u[first], 0, *(np.add.reduceat(x.astype(np.int64), first) for x in (counts == 1, counts == 2, counts > 2)))
        v, before = np.unique((keys % base).astype(np.int64), return_counts=True)
        rows += by_range(v, 1, before)
        stats = [len(keys), *(int((counts == k).sum()) for k in range(1, 5))]
        rows = [(*r, None) for r in rows] + [(2, shard, None, None, stats)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), made.types, strict=True)], schema=made)

    counted = text.mapInArrow(_count_pairs(model), "shard int, keys binary, counts binary")
    counted = cut(counted.groupBy("shard").applyInArrow(pairs, "kind int, part int, ids binary, columns binary, stats array<bigint>"))
    stats = {r["part"]: r["stats"] for r in counted.filter("kind = 2").select("part", "stats").collect()}
    model.pair_sizes = [stats[k][0] if k in stats else 0 for k in range(len(model.pair_sizes))]

    def ranged(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        n = min(RANGE, model.size + 1 - part * RANGE)
        out = np.zeros((4, n), np.int64)
        for kind, ids, columns in zip(table["kind"].to_pylist(), table["ids"].to_pylist(), table["columns"].to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.uint32)
            values = np.frombuffer(columns, np.int64).reshape(-1, len(ids))
            for k, x in enumerate(values):
                out[k + 3 * kind][ids] += x
        write(folder, f"ids-{part}", *_least(*out))
        low = out[3]
        return pa.table({"stats": pa.array([[int(low.sum()), *(int((low == k).sum()) for k in range(1, 5)), int((low > 2).sum())]], pa.list_(pa.int64()))})

    low = np.array([r["stats"] for r in counted.filter("kind < 2").groupBy("part").applyInArrow(ranged, "stats array<bigint>").collect()], np.int64).sum(axis=0)
    high = np.array(list(stats.values()), np.int64).sum(axis=0)
    model.discounts, model.low, model.n_types = _discounts(high[1:5]), _discounts(low[1:5]), int(low[0])
    model.low_share = float(np.dot(model.low, [low[1], low[2], low[5]]) / max(low[0], 1))
    return model


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries counted once to four times; fixed ones where these are too few."""
    n1, n2, n3, n4 = map(float, n)
    if min(n1, n2, n3) <= 0:
        return (0.5, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def probabilities(model: Model, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The model's probability of each token after its context."""
    known, p = ids >= 0, np.full(len(ids), model.low_share / (model.size + 1))
    before = model.by_id(ids[known], 3)
    p[known] += (before - _discount(before, model.low)) / max(model.n_types, 1)
    rows = np.flatnonzero(context >= 0)
    u = context[rows]
    at, back = np.unique(u, return_inverse=True)
    total = np.full(len(at), model.n_docs, np.float64)
    inner = at < model.size
    total[inner] = model.count_of(at[inner])
    gamma = sum(d * model.by_id(at, k) for k, d in enumerate(model.discounts))
    seen = total > 0  # the end mark is no context
    gamma, total = np.where(seen, gamma / np.maximum(total, 1), 1.0), np.maximum(total, 1)
    c = np.zeros(len(rows), np.int64)
    have = ids[rows] >= 0
    c[have] = model.pair_counts(u[have], ids[rows][have])
    p[rows] = (c - _discount(c, model.discounts)) / total[back] + gamma[back] * p[rows]
    return p


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score (unigrams, half a count added) and score, sums of log10; perplexity is 10 ** (-score / n_tokens)."""

    def compute(texts: list[bytes]) -> list:
        context, ids, counts, first = _contexts(model, texts)
        n = np.diff(np.r_[first, len(ids)])
        base = np.log10((counts + 0.5) / (model.n_tokens + 0.5 * (model.size + 1)))
        p = np.log10(probabilities(model, context, ids)) if model.size else np.zeros(len(ids))
        known = np.add.reduceat((counts > 0).astype(np.int64), first)
        return [n, known, np.full(len(n), model.n_tokens), np.add.reduceat(base, first), np.add.reduceat(p, first)]

    fields = [("n_tokens", pa.int64(), "long"), ("n_known", pa.int64(), "long"), ("train_tokens", pa.int64(), "long"), ("base_score", pa.float64(), "double"), ("score", pa.float64(), "double")]
    return map_texts(docs, text_col, fields, compute, drop=() if keep_text else (text_col,))
