"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: XXH64 (seed 42) of every 4-word shingle of the lower-cased text, repeats included; a bit is 1 if it is set in over
half of them. Candidates: every bit position i has a vector m(i) of RADIUS + 1 bits, none of them zero; for each of the
2^(RADIUS+1) - 1 non-zero vectors v there is a table whose mask holds the positions with an odd number of common bits of m(i) and
v. The vectors of up to RADIUS differing positions leave some v at right angles to all of them, so that v's mask holds none of
these positions: every pair within the radius meets in some table. No pair is missed, whatever the data are.

Only distinct fingerprints go into the tables; a table's bucket of one fingerprint goes no further. Larger buckets are cut into
slices of at most SLICE fingerprints by their hash, and every pair of slices is compared as two arrays, in a task of its own if
need be; a pair of slices returns a forest that links what its links connect, not all its links. So a bucket that holds a third
of all rows is spread over many tasks, and what it returns grows with its fingerprints, not their square.

Defined results: null or blank text has fingerprint zero and links like any other; rows with equal text have equal components;
rows with a null id get a component but give none (null if no member has an id); an empty table gives an empty result. Other
columns stay unless their names are those added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Box, cut, few, join_one, map_texts, small
from .graph import components

RADIUS, WIDTH, SLICE = 4, 4, 2048
#: Fingerprints of a task, where few() deals them; each is in all tables.
PRINTS = 20_000


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, 42)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start = (end - size)[: len(words) - width + 1].tolist()
    ones, total = np.zeros(64, np.int64), len(start)
    stop = (end[width - 1 :] - 1).tolist()
    for k in range(0, total, 1 << 16):
        h = np.array([digest(line[a:b], 42) for a, b in zip(start[k : k + (1 << 16)], stop[k : k + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with fp, the fingerprint as a signed long."""

    def compute(texts: list[bytes]) -> list:
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, text_col, [("fp", pa.int64(), "long")], compute, drop=() if keep_text else (text_col,))


def masks(radius: int = RADIUS) -> list[int]:
    """The tables' masks as signed longs: position i has the vector i mod (2^(radius+1) - 1) + 1."""
    n = (2 << radius) - 1
    out = []
    for v in range(1, n + 1):
        x = sum(1 << i for i in range(64) if bin((i % n + 1) & v).count("1") % 2)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def forest(x: np.ndarray, y: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a forest that joins all that links of up to radius bits between x and y join. x is y for the pairs inside a slice."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    at_x, at_y = at[: len(x)], at[len(x) :]
    part, out = np.arange(len(nodes)), []
    for i, value in zip(at_x.tolist(), x, strict=True):
        near = at_y[np.bitwise_count(np.bitwise_xor(y, value)) <= radius]
        near = near[part[near] != part[i]]
        while len(near):
            j = near[0]
            out.append((int(nodes[i].view(np.int64)), int(nodes[j].view(np.int64))))
            part[part == part[j]] = part[i]
            near = near[part[near] != part[i]]
    return out


def _compare(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = (np.asarray(z.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for z in (x, y))
                out += forest(x, y, radius)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out, strict=True)], schema=schema)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, slice_size: int = SLICE, rows: int | None = None) -> DataFrame:
    """Pairs (a, b) of the fingerprints in column fp that connect all which links within the radius connect. rows: about how many there are, if known; what is found goes on in as many tasks as they fill."""
    fewer = (lambda df: df) if rows is None else lambda df: few(df, rows, PRINTS)
    table = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius)))))
    keyed = distinct.select("fp", table.alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    several = fewer(cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key", F.ceil(F.col("n") / slice_size).cast("int").alias("slices"))))
    # a large bucket is dealt by slice before it is joined; there is at most one for each slice_size rows
    dealt = keyed.join(small(several.filter("slices > 1")), ["t", "key"], "left").select("t", "key", "fp", F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"))
    each = several.select("t", "key", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    members = dealt.join(small(each), ["t", "key", "slice"])
    slices = fewer(cut(members.groupBy("t", "key", "slices", "slice").agg(F.collect_list("fp").alias("fps"))))
    alone = slices.filter("slices = 1").select(F.col("fps").alias("x"), F.col("fps").alias("y"))
    left = slices.filter("slices > 1").select("t", "key", "slice", F.col("fps").alias("x"), F.explode(F.sequence(F.col("slice"), F.col("slices") - 1)).alias("other"))
    pairs = left.join(slices.filter("slices > 1").select("t", "key", F.col("slice").alias("other"), F.col("fps").alias("y")), ["t", "key", "other"]).select("x", "y")
    return alone.unionByName(pairs).mapInArrow(_compare(radius), "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row; the component is the smallest id of the rows that links reach."""
    prints = cut(fingerprints(Box(docs, id=id_col, text=text_col).df.select("id", "text"), "text", keep_text=False))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    return named(prints, distinct, components(links(distinct, radius)), id_col)


def named(prints: DataFrame, distinct: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """(id, fp, component_id) of prints (id, fp) by the components found (node, component) of distinct fingerprints (fp, first)."""
    joined = cut(distinct.select("fp", "first").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of = join_one(joined, lowest, ["component"], each=1000).select("fp", "component_id")
    return join_one(prints.select("id", "fp"), of, ["fp"], each=1000).select("id", "fp", "component_id").toDF(id_col, "fp", "component_id")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without near-duplicates: of every component the row with the smallest id stays; rows without an id stay.

    Where an id repeats, its rows are told apart by their fingerprints, and of equal ones that with the smallest text, then the smallest other columns (as JSON), stays.
    """
    return keep_first(docs, cut(classes(docs, id_col, text_col, radius)), fingerprints, id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, prints, id_col: str, text_col: str) -> DataFrame:
    """What keep_one() returns, by found, the classes (id, fp, component_id) of docs; prints adds a text's fp."""
    box, found = Box(docs, id=id_col, text=text_col), found.toDF("id", "fp", "component_id")
    repeated = cut(found.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"))
    gone = found.filter("id <> component_id").select("id").distinct()
    single = gone.join(repeated, "id", "left_anti").unionByName(repeated)
    out = box.df.join(small(cut(single)), "id", "left_anti").select("box", "id", "text")
    if repeated.isEmpty():
        return box.open(out)
    rows = prints(box.df.join(small(repeated), "id", "left_semi").select("box", "id", "text"), "text")
    kept = found.filter("id = component_id").select("id", "fp").distinct()
    rows = rows.join(kept, ["id", "fp"], "left_semi").groupBy("id").agg(F.min_by(F.struct("box", "id", "text"), F.struct("text", F.to_json("box"))).alias("row"))
    return box.open(out.unionByName(rows.select("row.*")))
