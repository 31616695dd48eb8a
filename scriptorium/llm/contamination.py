"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND by every training passage.

Items of over LONG words are searched by parts of that length at most, each as if it were an item; so one long item doesn't widen the
passages of all. Training texts are cut into passages of two blocks of words each, every block starting one; a block is as long as
the longest part, so that any copy of a part lies inside a passage. A part's BM25 score for a passage is divided by its score for itself:
a share from 0 to 1 (more if a term repeats). All items of which a part is at or above THRESHOLD are retrieved (the score is the best part's). First the sums of the terms' block maxima bound all
passages at once (numpy); a passage that some block's bound lets through is searched by WAND over postings, skipping blocks by
their maxima. A retrieved item must then overlap: its question and its answer (its last sentence; a single sentence is halved)
are cut into shingles of 5 words, and OVERLAP of all shingles and PART of each side's must stand in the passage, for items of several parts in the stretch of the text that can hold
a copy with that part in that passage (rounded outwards).

The numbers of BM25 (parts that hold a word, mean length) and the passages' width are those of the whole benchmark. A large one is
cut into slices of about INDEX_WORDS words, so that their tables of block maxima stay sharp and small; what is collected, broadcast
and held by workers at once is a group of slices of about PART_WORDS words, and each group is a pass over the texts. Several groups
read texts that were numbered and written once, and leave only numbers of rows and what these hold. So slices and groups change no
score and no result. Documents are shuffled only where there are several groups and too many rows hold an item to be broadcast.

Defined results: null texts are empty and match nothing; null item texts and such without a word are not searched; items without an
id are searched, and reported with none; ids are of any type; items of fewer than 5 words are one shingle; items may be of any length; equal items are all
reported, in the order of the benchmark's ids; rows are independent; no items or no documents give an empty result. Ties do not
arise (all items above the threshold are taken). Other columns stay in clean(), whatever their names are; matches() replaces a
column of its own name.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Box, cut, map_texts, small

K1, B, THRESHOLD, OVERLAP, PART, SHINGLE = 1.2, 0.75, 0.55, 0.8, 0.5, 5
#: Words of an item that are searched as one.
LONG = 512
#: Items in a block of postings; floats of the table of block maxima that bounds all passages; words of items in one slice, and in one broadcast; words a worker keeps ids of.
BLOCK, TABLE, INDEX_WORDS, PART_WORDS, MEMO = 4, 4_000_000, 20_000, 300_000, 200_000
_EDGES = b".,;:!?\"'()[]{}<>*#|%$&"


def normal(text: bytes) -> list[bytes]:
    """Lower-cased words without marks at their edges."""
    return [w for x in text.lower().split() if (w := x.strip(_EDGES))]


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def sides(text: bytes) -> tuple[bytes, bytes]:
    """Question and answer: the last sentence or line is the answer; a single one is halved by words."""
    body = text.strip()
    at = max(body.rfind(m, 0, max(len(body) - 1, 0)) for m in (b". ", b"? ", b"! ", b"\n", b".\n"))
    if at > 0 and normal(body[:at]) and len(normal(body[at + 1 :])) >= SHINGLE:
        return body[: at + 1], body[at + 1 :]
    words = body.split()
    return b" ".join(words[: (len(words) + 1) // 2]), b" ".join(words[(len(words) + 1) // 2 :])


def parts_of(words: list[bytes], long: int) -> list[list[bytes]]:
    """The words in order, in as few parts of at most so many as will do, of about one length."""
    n = -(-len(words) // long)
    edges = [len(words) * k // n for k in range(n + 1)] if n else [0]
    return [words[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@dataclass
class Numbers:
    """Of the whole benchmark: parts of items, their mean length in words and the longest one's, and in how many a word stands."""

    items: int
    mean: float
    longest: int
    df: dict[bytes, int]


def numbers(texts: list[bytes]) -> Numbers:
    words, df = [w for t in texts for w in parts_of(normal(t), LONG)], Counter()
    for w in words:
        df.update(set(w))
    return Numbers(len(words), sum(map(len, words)) / max(len(words), 1), max(map(len, words), default=0), df)


@dataclass
class Index:
    ids: list
    terms: dict[bytes, int]
    postings: list[list[tuple[int, float]]]  # by term: (part, share of the part's own score), parts ascending
    block_max: list[dict[int, float]]
    coarse: np.ndarray  # term by coarse block: the highest share
    top: list[float]
    of: list[tuple[int, int]]  # by part: its item, and the words before it in the item
    items: list[tuple[set, set, set]]
    length: list[int]  # by item: its words if it has several parts, else 0
    width: int
    n_memo: int = MEMO
    memo: dict[bytes, int] = field(default_factory=dict)


def build(items: list[tuple[object, str]], whole: Numbers | None = None) -> Index | None:
    """The index of a slice of items; whole: the numbers of the benchmark that it is a slice of."""
    kept = [(i, w, t.encode()) for i, t in items if t is not None and (w := normal(t.encode()))]
    if not kept:
        return None
    whole = whole or numbers([t for _, _, t in kept])
    docs, of, length = [], [], []
    for n, (_, words, _) in enumerate(kept):
        cuts, before = parts_of(words, LONG), 0
        length.append(len(words) if len(cuts) > 1 else 0)
        for w in cuts:
            docs.append(w)
            of.append((n, before))
            before += len(w)
    mean, df = whole.mean, {t: whole.df[t] for w in docs for t in w}
    terms = {t: i for i, t in enumerate(sorted(df))}
    idf = {t: math.log(1 + (whole.items - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    postings: list[list[tuple[int, float]]] = [[] for _ in terms]
    block_max: list[dict[int, float]] = [{} for _ in terms]
    per = max(2, math.ceil(len(docs) * len(terms) / TABLE))
    coarse = np.zeros((len(terms) + 1, math.ceil(len(docs) / per)), np.float32)
    for n, w in enumerate(docs):
        tf = Counter(w)
        weight = {t: idf[t] * k * (K1 + 1) / (k + K1 * (1 - B + B * len(w) / mean)) for t, k in tf.items()}
        total = sum(weight.values())
        for t, x in weight.items():
            at, share = terms[t], x / total
            postings[at].append((n, share))
            block_max[at][n // BLOCK] = max(block_max[at].get(n // BLOCK, 0.0), share)
            coarse[at, n // per] = max(coarse[at, n // per], share)
    sets = [tuple(map(shingles, (words, *map(normal, sides(text))))) for _, words, text in kept]
    # rounded up, so that float sums stay bounds
    coarse *= np.float32(1.0001)
    return Index([i for i, _, _ in kept], terms, postings, block_max, coarse, [max(s for _, s in p) for p in postings], of, sets, length, max(16, whole.longest))


def wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All parts of at least the threshold for a query of distinct terms, by block-max WAND."""
    lists = [[index.postings[t], 0, index.top[t], index.block_max[t]] for t in query]
    out = []
    while lists:
        lists.sort(key=lambda x: x[0][x[1]][0])
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += x[2]
            if bound >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        item = lists[pivot][0][lists[pivot][1]][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == item:
            pivot += 1
        block = item // BLOCK
        if sum(x[3].get(block, 0.0) for x in lists[: pivot + 1]) < threshold:
            # nothing in this block can reach the threshold with these terms; another term's next item may come first
            nxt = (block + 1) * BLOCK
            if pivot + 1 < len(lists):
                nxt = min(nxt, lists[pivot + 1][0][lists[pivot + 1][1]][0])
            nxt = max(nxt, item + 1)
            moved = lists[: pivot + 1]
        elif lists[0][0][lists[0][1]][0] == item:
            score = sum(x[0][x[1]][1] for x in lists[: pivot + 1])
            if score >= threshold:
                out.append((item, score))
            nxt, moved = item + 1, lists[: pivot + 1]
        else:
            nxt, moved = item, [x for x in lists[:pivot] if x[0][x[1]][0] < item]
        for x in moved:
            post, at = x[0], x[1]
            while at < len(post) and post[at][0] < nxt:
                at += 1
            x[1] = at
        lists = [x for x in lists if x[1] < len(x[0])]
    return out


def _passage(words: list[bytes], sets: list[tuple[set, set, set]]) -> set[tuple[bytes, ...]]:
    """The shingles of a passage, of each length that the items' have."""
    words = [w.strip(_EDGES) for w in words]
    out = shingles(words)
    if any(len(x) < SHINGLE for every in sets for s in every for x in s):
        out |= {tuple(words[j : j + n]) for n in range(1, SHINGLE) for j in range(len(words) - n + 1)}
    return out


def _ids(index: Index, words: list[bytes]) -> np.ndarray:
    memo = index.memo
    try:
        return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
    except KeyError:
        if len(memo) > index.n_memo:
            memo.clear()
        get, none = index.terms.get, len(index.terms)
        for w in set(words).difference(memo):
            k = w.strip(_EDGES)
            memo[w] = get(k, none) if k else -1
        return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))


def search(index: Index, texts: list[bytes], threshold: float = THRESHOLD) -> list[list[tuple[object, float, float, float]]]:
    """For each text its items as (item id, score, question overlap, answer overlap), the best passage of each."""
    none, width = len(index.terms), index.width
    rows, owner, first, blocks = [], [], [], 0
    kept_words: list[list[bytes]] = []
    for t in texts:
        words = t.lower().split()
        ids = _ids(index, words) if words else np.zeros(0, np.int32)
        if (ids < 0).any():
            words = [w for w, k in zip(words, (ids >= 0).tolist(), strict=True) if k]
            ids = ids[ids >= 0]
        kept_words.append(words)
        n = max(1, -(-len(ids) // width))
        rows.append(ids + (np.arange(len(ids)) // width + blocks).astype(np.int64) * (none + 1))
        first.append(blocks)
        owner += [len(first) - 1] * n
        blocks += n
    out: list[list[tuple[object, float, float, float]]] = [[] for _ in texts]
    pairs = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    pairs = pairs[pairs % (none + 1) != none]
    if not len(pairs):
        return out
    block, term = pairs // (none + 1), (pairs % (none + 1)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    bound = np.zeros((blocks + 1, index.coarse.shape[1]), np.float32)
    step = max(1, 200_000 // index.coarse.shape[1])
    for a in range(0, len(starts), step):
        stop = starts[a + step] if a + step < len(starts) else len(pairs)
        bound[block[starts[a : a + step]]] = np.add.reduceat(index.coarse[term[starts[a] : stop]], starts[a : a + step] - starts[a], axis=0)
    own = np.array([*owner, -1])
    both = bound[:-1] + np.where((own[1:] == own[:-1])[:, None], bound[1:], 0)
    edges = np.searchsorted(block, np.arange(blocks + 1))
    seen: dict[tuple[int, int, int], tuple[float, float, float]] = {}
    best: list[dict[int, tuple[float, float, float]]] = [defaultdict(lambda: (0.0, 0.0, 0.0)) for _ in texts]
    for b in np.flatnonzero((both >= threshold).any(axis=1)).tolist():
        d, two = owner[b], own[b + 1] == own[b]
        query = np.unique(term[edges[b] : edges[b + 2 if two else b + 1]]).tolist()
        hits = wand(index, query, threshold)
        if not hits:
            continue
        at = (b - first[d]) * width
        passage = _passage(kept_words[d][at : at + 2 * width], [index.items[index.of[i][0]] for i, _ in hits])
        for i, score in hits:
            item, before = index.of[i]
            sets = index.items[item]
            if index.length[item]:  # a copy starts in the four blocks from this place on
                start = (at - before) // (2 * width) * 2 * width
                if (d, item, start) not in seen:
                    long = _passage(kept_words[d][max(0, start - width) : start + 5 * width + index.length[item]], [sets])
                    seen[d, item, start] = tuple(len(s & long) / len(s) if s else 1.0 for s in sets)
                every, q, a = seen[d, item, start]
            else:
                every, q, a = (len(s & passage) / len(s) if s else 1.0 for s in sets)
            if every >= OVERLAP and q >= PART and a >= PART:
                best[d][item] = max(best[d][item], (score, q, a))
    for d, found in enumerate(best):
        out[d] = [(index.ids[i], *x) for i, x in sorted(found.items())]
    return out


def _words(long: int):
    """(text) to (number of words, distinct words) of the parts of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for t in batch.column(0).to_pylist() for w in parts_of(normal(t.encode()), long)]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, words), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], names=["n", "words"])

    return run


def _groups(benchmark: DataFrame) -> Iterator[tuple[bool, list[Index]]]:
    """Groups of indexes of a benchmark (id, text), one at a time, and whether there are several: about INDEX_WORDS words in an index, about PART_WORDS in a group."""
    rows = benchmark.filter("text is not null")
    counted = cut(rows.select("text").mapInArrow(_words(LONG), "n long, words array<binary>"))
    parts, total, longest = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n = max(1, math.ceil(total / PART_WORDS))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    df = counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")) if n > 1 else None
    df = cut(df) if n > 1 else None
    for k in range(n if parts else 0):
        own = rows.filter(part == k)
        group = own.orderBy("id", "text").collect()  # about PART_WORDS words
        texts = [r["text"].encode() for r in group]
        whole = numbers(texts)
        if n > 1:
            mine = own.select("text").mapInArrow(_words(LONG), "n long, words array<binary>").select(F.explode("words").alias("word")).distinct()
            whole = Numbers(parts, total / parts, longest, {bytes(r["word"]): r["df"] for r in df.join(mine, "word").collect()})
        each = max(1, math.ceil(len(group) / max(1, math.ceil(sum(len(t.split()) for t in texts) / INDEX_WORDS))))
        made = [x for a in range(0, len(group), each) if (x := build([(r["id"], r["text"]) for r in group[a : a + each]], whole))]
        for x in made:
            x.n_memo = MEMO // len(made)
        if made:
            yield n > 1, made


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", into: str = "matches", drop_text: bool = False, max_bytes: int = 2 << 20) -> DataFrame:
    """docs and an array of the items that the text holds: item_id, score, question_overlap, answer_overlap. max_bytes: of texts that are searched at once."""
    items = Box(benchmark, id=item_col, text=item_text).df.select("id", "text")
    id_type = items.schema["id"].dataType
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
    spark = f"array<struct<item_id:{id_type.simpleString()},score:double,question_overlap:double,answer_overlap:double>>"
    names = ("item_id", "score", "question_overlap", "answer_overlap")
    box = Box(docs, text=text_col)
    out, held, hits = box.df, None, None
    for several, group in _groups(items):
        if held is None and several:
            out = cut(out.select(F.monotonically_increasing_id().alias("row"), "box", "text"))
        if held is not None:  # the group before has been searched for; its indexes go before the next come
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(group)

        def compute(texts: list[bytes], held=held) -> list:
            each = [search(index, texts) for index in held.value]
            return [[[dict(zip(names, x, strict=True)) for found in every for x in found] for every in zip(*each, strict=True)]]

        if several:
            more = cut(map_texts(out.select("row", "text"), "text", [("found", kind, spark)], compute, drop=("text",), max_bytes=max_bytes).filter("size(found) > 0"))
            hits = more if hits is None else hits.unionByName(more)
        else:
            out = map_texts(out, "text", [("found", kind, spark)], compute, max_bytes=max_bytes)
    if hits is not None:
        hits = cut(hits.groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found")))  # at most the items that one text holds
        out = (out.drop("text") if drop_text else out).join(small(hits), "row", "left")
    found = F.coalesce("found", F.array().cast(spark)) if held is not None else F.array().cast(spark)
    text = () if drop_text else ("text",)
    out = out.select("box", *text, F.array_sort(found).alias("found"))
    return box.open(out, "found", called=(into,), drop=("text",) if drop_text else ())


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold an item."""
    box = Box(docs, text=text_col)
    found = matches(box.df, benchmark, "text", item_col, item_text, into="found", max_bytes=1 << 19)
    return box.open(found.filter(F.size("found") == 0).drop("found"))
