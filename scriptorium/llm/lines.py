"""Line dedup by content-defined chunks of lines.

Every line with a word has a hash (XXH64); a rolling hash over the last WINDOW of them ends a segment behind a line unless it is 0
modulo DIVISOR, so that boundaries depend on the lines around them alone and an inserted line shifts none but its neighbours'. A
chunk begins at a boundary (or the text's start) and ends at the first one (or the text's end) with two lines or more between
them; chunks may overlap. A line of LONG words or more is a chunk of its own besides: a passage in one line is found wherever it
stands. Chunks are compared over the whole corpus: first by hash, then the bytes of all chunks whose hash repeats. Of equal chunks
the one with the smallest (id, text's digest, place) stays; the lines of the others go, and with them the lines before (of two
segments) and behind (of one) that are equal (by 128 bits of hash) to those around the chunk that stays. So a repeated run of lines
goes whole, its ends too, if it holds a chunk. Every line that goes has an equal one earlier in that order: no line vanishes.

Texts that are equal as a whole (by SHA-256) are told apart first: only the one with the smallest id takes part, and the others
lose all lines if they hold a chunk, being repeated runs. Per chunk a row of a hash, a digest and a place is shuffled,
pre-aggregated by hash; bytes are shuffled only for repeated hashes, and chunks with very many copies are dealt over tasks.
Documents meet their decisions by a broadcast of bounded, counted size or a join.

Defined results: null text stays null; ids are of any type with an order; rows with equal id and text are one document; a null id
counts as the smallest; lines without a word belong to the chunk around them; a text whose lines all go becomes empty; chunks that
overlap copies of themselves count as copies (of a line that repeats without a break one stays); an empty table gives an empty
result. Other columns stay, whatever their names are, unless these are those added (in any case).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Box, cut, join_one, release, small, texts_of

WINDOW, DIVISOR, LONG = 2, 8, 16
#: Line ranges that go up to which documents' decisions are broadcast (some bytes each); more are joined by a shuffle.
BROADCAST_RANGES = 2_000_000
_K = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line)


def filled(text: bytes) -> tuple[list[bytes], list[int]]:
    """The text's lines, and the places of those with a word."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def boundaries(hashes: list[int]) -> list[int]:
    """Places between lines where segments meet, with both ends."""
    out = [0]
    for i in range(len(hashes) - 1):
        rolled = 0
        for x in hashes[max(0, i + 1 - WINDOW) : i + 1]:
            rolled = (rolled * _K + x + 1) & _ALL
        if (rolled >> 32) % DIVISOR:
            out.append(i + 1)
    return [*out, len(hashes)] if hashes else out


def chunks(lines: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(first line, line behind the last, signed hash, first line before, line behind the last after) of the chunks of lines that all have a word."""
    hashes = [line_hash(x) for x in lines]
    ends = boundaries(hashes)
    spans, k = [], 0
    for i, a in enumerate(ends):
        k = max(k, i)
        while k < len(ends) and ends[k] < a + 2:
            k += 1
        if k < len(ends):
            spans.append((a, ends[k], ends[max(i - 2, 0)], ends[min(k + 1, len(ends) - 1)]))
    at = 0
    for i, x in enumerate(lines):
        while ends[at + 1] <= i:
            at += 1
        if len(x.split()) >= LONG:
            spans.append((i, i + 1, ends[max(at - 1, 0)], ends[min(at + 2, len(ends) - 1)]))
    out = []
    for a, b, before, after in spans:
        total = b - a
        for h in hashes[a:b]:
            total = (total * _K + h) & _ALL
        out.append((a, b, total - (1 << 64) if total >> 63 else total, before, after))
    return out


def alike(mine: bytes, other: bytes) -> int:
    """How many lines are equal from the start on; of each 16 bytes of hash."""
    n = min(len(mine), len(other))
    if mine[:n] == other[:n]:
        return n // 16
    return next(i for i in range(n // 16) if mine[16 * i : 16 * i + 16] != other[16 * i : 16 * i + 16])


def _rows(with_text: bool, bits: int):
    """(id, key, text) to a row for each chunk; with_text: with its bytes and the hashes of the lines around it, from the chunk outwards. Of chunk hashes so many bits count."""
    kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * (3 * with_text)
    names = ["a", "b", "h", "body", "before", "after"][: len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch.column(2)):
                rows, of = [], []
                for i, t in enumerate(texts):
                    lines, at = filled(t)
                    full = [lines[j] for j in at]
                    digest = [xxhash.xxh3_128_digest(x) for x in full] if with_text else []
                    for a, b, h, first, last in chunks(full):
                        h = h & ((1 << bits) - 1) if bits < 64 else h
                        rows.append((a, b, h, b"\n".join(full[a:b]), b"".join(digest[first:a][::-1]), b"".join(digest[b:last])) if with_text else (a, b, h))
                        of.append(start + i)
                if rows:
                    own = pa.array(of)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["id", "key", *names])
        release()

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that go, as ranges with the lines around them that go too."""
    for batch in batches:
        key, a, b, before, after, other, behind = batch.columns
        first = [x - alike(m, o) for x, m, o in zip(a.to_pylist(), before.to_pylist(), other.to_pylist(), strict=True)]
        last = [x + alike(m, o) for x, m, o in zip(b.to_pylist(), after.to_pylist(), behind.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([key, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["key", "a", "b"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs (id, text and others) with key, the text's digest."""
    return docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))


def _one_each(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """rows (id, key and others) of the texts that take part: of equal ones the one with the smallest id."""
    names = rows.columns
    return rows.join(copies, "key", "left").filter(F.col("rep").isNull() | F.col("id").eqNullSafe(F.col("rep.id"))).select(*names)


def repeats(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(key, rep, gone) by digests of docs' texts (id, text): rep.id of texts that several ids have is the one that takes part; gone are the ranges that it loses among its lines with a word.

    bits: of chunk hashes; fewer make more chunks meet whose bytes differ, the result is the same.
    """
    kind = docs.schema["id"].dataType.simpleString()
    slim = keyed(docs.select("id", "text")).select("id", "key", "text")
    ids = slim.groupBy("key").agg(F.min(F.struct("id")).alias("rep"), F.max(F.struct("id")).alias("last"))
    copies = cut(ids.filter("rep.id is distinct from last.id").select("key", "rep"))
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then other texts need not be read, else their chunks are left out
    at = F.struct("id", "key", "a", "b")

    def rows(with_text: bool, more: str = "") -> DataFrame:
        source = _one_each(slim, F.broadcast(copies)) if few else slim
        made = source.mapInArrow(_rows(with_text, bits), f"id {kind}, key string, a int, b int, h long{more}")
        return made if few else _one_each(made, copies)

    twice = cut(rows(False).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    bodies = cut(rows(True, ", body binary, before binary, after binary").join(small(twice, 500_000), "h", "left_semi"))
    # equal bytes, not equal hashes, make a copy: bodies that share a hash by chance are different groups
    same = bodies.groupBy("h", "body").agg(F.min(at).alias("first"), F.min_by(F.struct("before", "after"), at).alias("around"), F.count("*").alias("n")).filter("n > 1")
    same = same.select("h", F.xxhash64("body").alias("h2"), "body", "first", F.col("around.before").alias("first_before"), F.col("around.after").alias("first_after"))
    others = join_one(bodies.withColumn("h2", F.xxhash64("body")), cut(same), ["h", "h2", "body"], ["h", "h2"]).filter(at != F.col("first"))
    others = others.select("key", "a", "b", "before", "after", "first_before", "first_after")
    gone = others.mapInArrow(_extend, "key string, a int, b int").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("gone"))
    return copies.join(gone, "key", "full").select("key", "rep", "gone")


def without(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int, int]:
    """The text without the ranges of its lines with a word (and blank lines inside them); lines, lines that went and words that went."""
    lines, at = filled(text)
    drop = {i for a, b in ranges for i in range(at[a], at[b - 1] + 1)}
    if len(drop.intersection(at)) == len(at):
        drop = set(range(len(lines)))
    return b"\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop), sum(len(lines[i].split()) for i in drop)


def ranges_of(text: bytes, copy: bool, gone: list[dict] | None) -> list[tuple[int, int]]:
    """What a text loses: all if it is a copy that holds a chunk, else its ranges."""
    if not copy:
        return [(r["a"], r["b"]) for r in gone or ()]
    lines, at = filled(text)
    return [(0, len(at))] if chunks([lines[i] for i in at]) else []


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """docs with the text without repeated chunks, n_lines, n_lines_removed and n_words_removed."""
    box = Box(docs, id=id_col, text=text_col)
    gone = cut(repeats(box.df, bits))
    added = ("n_lines", "n_lines_removed", "n_words_removed")
    if gone.agg(F.coalesce(F.sum(F.size(F.coalesce("gone", F.array())) + 8), F.lit(0))).first()[0] <= BROADCAST_RANGES:
        gone = F.broadcast(gone)
    copy = F.col("rep").isNotNull() & ~F.col("id").eqNullSafe(F.col("rep.id"))
    joined = keyed(box.df).join(gone, "key", "left").select("box", "id", "text", copy.alias("copy"), "gone")
    schema = T.StructType([*box.df.schema.fields, *T.StructType.fromDDL("n_lines int, n_lines_removed int, n_words_removed long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, copies, lists = batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for start, texts in texts_of(text):
                new, made = [], []
                part = slice(start, start + len(texts))
                for t, c, ranges, null in zip(texts, copies[part], lists[part], text.slice(start, len(texts)).is_null().to_pylist(), strict=True):
                    ranges = ranges_of(t, c, ranges)
                    if not ranges:
                        new.append(None if null else t)
                        made.append((t.count(b"\n") + 1, 0, 0))
                        continue
                    left, *counts = without(t, ranges)
                    new.append(left)
                    made.append(counts)
                cols = [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array(new, pa.binary()).cast(text.type)]
                counts = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, *counts], names=["box", "id", "text", *added])
        release()

    return box.open(joined.mapInArrow(run, schema), *added)
