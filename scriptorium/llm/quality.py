"""Quality rules: statistics of each document, judged by isolation forests.

One pass over the words of a text gives counts (word_chars, n_symbols, n_dup_lines, n_repeat_words and others). Documents that
break a fixed rule fail. The others are judged over ten ratios of these counts, in FAMILIES that belong together: one forest
each, so that what is odd in one family is not drowned by the spread of others. A tree splits the box of all labelled rows at
random and keeps SUBSAMPLE good rows: where few of them live, paths are short, and 2 to the minus (mean path length / that of a
random tree) is a document's anomaly.

The trees are grown from at most MAX_SAMPLE good labelled documents (those with the smallest hashes of their id). Boxes and
thresholds come from all labelled documents that pass the fixed rules: a family's threshold is the lowest that costs at most an
equal share of MAX_LOSS of the good ones, in steps of 1/BINS. A family that does not reject LIFT times that share of the bad ones
judges nothing. Without labels of both kinds only the fixed rules hold.

Defined results: null text is empty; an empty text has no words and fails. Labels with null are ignored; of a document's labels
the lowest counts, and of its rows, where an id repeats, the lowest of each ratio. Ties in a threshold's step go together. Rows are
judged independently. An empty table gives an empty result. Other columns stay unless their names are those added (in any case).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Box, cut, map_texts

MAX_SAMPLE, TREES, SUBSAMPLE, DEPTH, MAX_LOSS, LIFT, BINS, SEED = 6_000, 128, 256, 8, 0.002, 10, 1 << 16, 11
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct", "n_long", "n_ends")
RATIOS = ("length", "symbols", "variety", "dup_lines", "repeated", "upper", "marks", "digits", "long", "ends")
#: Ratios that are judged together: what words are made of, what comes again, how it is written.
FAMILIES = ((0, 1, 2), (3, 4), (5, 6, 7, 8, 9))
_SPACE, _SYMBOLS, _MARKS, _DIGITS, _UPPER = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"!?;:=_/\\^~@{}[]()\"+", b"0123456789", bytes(range(65, 91))


def _without(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def _rank(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of so many words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(29)))
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():  # windows with different hashes differ
        return 0
    known: dict[bytes, int] = {}
    exact = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    window = exact[:n]
    for k in range(1, width):
        window = _rank(window * len(known) + exact[k : k + n])
    count = np.bincount(window)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(count[window] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(b: bytes) -> tuple[int, ...]:
    """COUNTS of a text."""
    words, lines = b.split(), [x for x in b.split(b"\n") if x.strip(_SPACE)]
    chars, distinct = len(b.decode()) if not b.isascii() else len(b), set(words)
    return (
        len(words),
        chars - _without(b, _SPACE),
        _without(b, _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        _without(b, _UPPER),
        _without(b, _MARKS),
        _without(b, _DIGITS),
        len(distinct),
        sum(len(w) > 24 for w in distinct),
        _without(b, b".,"),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """RATIOS of COUNTS, a column each; roots where small values matter."""
    c = {k: counts[:, i].astype(np.float64) for i, k in enumerate(COUNTS)}
    n, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        c["word_chars"] / n, np.sqrt(c["n_symbols"] / n), np.log(np.maximum(c["n_distinct"], 1)) / np.log(n + 1),
        c["n_dup_lines"] / lines, c["n_repeat_words"] / n,
        np.sqrt(c["n_upper"] / chars), np.sqrt(c["n_marks"] / n), np.sqrt(c["n_digits"] / n), c["n_long"] / n, c["n_ends"] / n,
    ], axis=1)


@dataclass
class Forest:
    """Trees as arrays: split ratio (-1: leaf), split value, first child (the second follows), and a leaf's path length."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    norm: float
    #: Rows whose anomaly falls into this step of 1 / BINS or a higher one are rejected.
    step: int = BINS + 1

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, v, c, p in zip(self.feature, self.value, self.child, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while (f[at] >= 0).any():
                split = f[at]
                at = np.where(split < 0, at, c[at] + (x[rows, np.maximum(split, 0)] >= v[at]))
            total += p[at]
        return 2.0 ** (-(total / len(self.feature)) / self.norm)

    def steps(self, x: np.ndarray) -> np.ndarray:
        return (self.anomaly(x) * BINS).astype(np.int64)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n random keys."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(good: np.ndarray, low: np.ndarray, high: np.ndarray, columns: tuple[int, ...], seed: int, trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest:
    """A forest of good rows that splits the box from low to high in the given columns."""
    rng, size, nodes = np.random.default_rng(seed), min(subsample, len(good)), 2 << DEPTH
    f, v, c, p = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes), np.float32)
    for t in range(trees):
        used, todo = 1, [(0, rng.choice(len(good), size, replace=False), 0, low.copy(), high.copy())]
        while todo:
            node, rows, level, a, b = todo.pop()
            able = [k for k in columns if b[k] > a[k]]
            if level == DEPTH or len(rows) <= 1 or not able:
                p[t, node] = level + _expected(len(rows))
                continue
            k = able[rng.integers(len(able))]
            cut_at = rng.uniform(a[k], b[k])
            f[t, node], v[t, node], c[t, node] = k, cut_at, used
            right, below, above = good[rows, k] >= cut_at, b.copy(), a.copy()
            below[k] = above[k] = cut_at
            todo += [(used, rows[~right], level + 1, a, below), (used + 1, rows[right], level + 1, above, b)]
            used += 2
    return Forest(f, v, c, p, max(_expected(size), 1e-9))


def calibrate(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, max_loss: float) -> int:
    """The lowest step from which on at most max_loss of the good rows lie, or none if LIFT times that share of the bad ones do not. steps: distinct ones that have rows, with their counts."""
    order = np.argsort(-steps)
    steps, lost, won = steps[order], np.cumsum(good[order]), np.cumsum(bad[order])
    able = np.flatnonzero(lost <= max_loss * good.sum())
    if not len(able) or won[able[-1]] < LIFT * max_loss * bad.sum():
        return BINS + 1
    return int(steps[able[-1]])


def _measured(docs: DataFrame) -> DataFrame:
    """docs (text and others) with COUNTS as c0, c1, ... instead of the text."""
    names = [f"c{i}" for i in range(len(COUNTS))]
    return map_texts(docs, "text", [(n, pa.int64(), "long") for n in names], lambda texts: list(zip(*map(statistics, texts), strict=True)), drop=("text",))


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, COUNTS) to (y, RATIOS) of the rows that pass the fixed rules."""
    for batch in batches:
        counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1).reshape(-1, len(COUNTS))
        ok = ~failed(counts)
        x = features(counts[ok])
        yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(pa.array(ok)) for i in (0, 1)), *(pa.array(c) for c in x.T)], names=["id", "y", *RATIOS])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_sample: int = MAX_SAMPLE, max_loss: float = MAX_LOSS) -> list[Forest] | None:
    """The calibrated forests, one for each family, or None if no labelled document that passes the fixed rules is good, or none is bad."""
    known = Box(labels, id=id_col, y=label_col).df.select("id", F.col("y").cast("double").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    rows = Box(docs, id=id_col, text=text_col).df.select("id", "text")
    known = cut(known)
    # few labels: only their texts are measured; many: all texts are, and numbers are joined instead of texts
    counted = _measured(rows.join(F.broadcast(known), "id")) if known.count() <= BROADCAST_ROWS else _measured(rows).join(known, "id")
    kind = known.schema["id"].dataType.simpleString()
    x = counted.select("id", "y", *(f"c{i}" for i in range(len(COUNTS)))).mapInArrow(_ratios, f"id {kind}, y double, " + ", ".join(f"{r} double" for r in RATIOS))
    x = cut(x.groupBy("id").agg(F.min("y").alias("y"), *(F.min(r).alias(r) for r in RATIOS)))
    box = x.filter("y in (0, 1)").agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0), *(f(r) for f in (F.min, F.max) for r in RATIOS)).first()
    if not box[0] or not box[1]:
        return None
    low, high = np.array(box[2 : 2 + len(RATIOS)], np.float64), np.array(box[2 + len(RATIOS) :], np.float64)
    sample = x.filter("y = 1").orderBy(F.xxhash64("id"), "id").limit(max_sample).select(*RATIOS).collect()  # at most max_sample rows
    good = np.array([tuple(r) for r in sample], np.float64)
    forests = [grow(good, low, high, columns, SEED + k) for k, columns in enumerate(FAMILIES)]

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f.steps(m)) for f in forests)], names=["y", *(f"s{k}" for k in range(len(forests)))])

    names = [f"s{k}" for k in range(len(forests))]
    steps = x.filter("y in (0, 1)").select("y", *RATIOS).mapInArrow(stepped, "y double, " + ", ".join(f"{n} long" for n in names))
    each = steps.select("y", F.posexplode(F.array(*names)).alias("family", "step")).groupBy("family", "step").agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0))
    counts = np.array([tuple(r) for r in each.collect()], np.int64)  # at most BINS rows for each family
    for k, f in enumerate(forests):
        own = counts[counts[:, 0] == k]
        f.step = calibrate(own[:, 1], own[:, 2], own[:, 3], max_loss / len(forests))
    return forests


def failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rules: under 10 words, or over a fifth of them in repeated windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def judge(docs: DataFrame, forests: list[Forest] | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the base counts, base_failed, anomaly (the highest of the families') and kept."""
    shipped = docs.sparkSession.sparkContext.broadcast(forests or [])

    def compute(texts: list[bytes]) -> list:
        c = np.array(list(map(statistics, texts)), np.int64).reshape(-1, len(COUNTS))
        bad, x, odd = failed(c), features(c), np.zeros(len(c))
        kept = ~bad
        for f in shipped.value:
            a = f.anomaly(x)
            odd = np.maximum(odd, a)
            kept &= (a * BINS).astype(np.int64) < f.step
        return [*(c[:, i] for i in range(len(BASE))), bad, odd, kept]

    fields = [(n, pa.int64(), "long") for n in BASE] + [("base_failed", pa.bool_(), "boolean"), ("anomaly", pa.float64(), "double"), ("kept", pa.bool_(), "boolean")]
    return map_texts(docs, text_col, fields, compute, drop=() if keep_text else (text_col,))
