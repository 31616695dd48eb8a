"""Near-duplicates by Jaccard similarity of word shingles: every pair of SIMILAR or more is linked, none is missed.

A text is the set of XXH64 hashes (seed 42) of its WIDTH-word shingles, lower-cased; rows of equal sets are one node.

First comes SimHash: sets with fingerprints that differ in up to simhash.RADIUS bits meet in its covering tables, are compared by
the sets themselves, and what is similar is joined in components. It finds the closest copies, not all of the similarity, so the
rest is found in an exact way, which looks only between these components:

Candidates come by prefix filtering: in one order of all hashes two sets of the similarity share one of the first n - ceil(0.8 n) + 1 hashes of
each. The order is by a sketch of how often hashes occur, then by hash: any order is right, rare hashes first keep buckets small.

Prefixes go through one shuffle, as arrays by shard; a shard's task passes on the hashes that several sets share. Hashes that the
sketch says are very frequent are dealt by set instead, and all passed on, so none fills a task.

In a bucket, sets whose parity bits (BITS) differ in more than a similar pair can differ are passed over; that bound is exact too.
Of buckets that hold the same sets one is looked at.
A first round compares a spanning forest of what is left in each bucket by the sets themselves, a second one all pairs between
different components of what is linked by then. Buckets of many sets are compared in slices, as in simhash.

The tables between these steps are small beside the texts; they go on in as many tasks as their rows fill (few), whatever the shuffle's are.

Defined results: as in simhash; null or blank text is the empty set, alike to itself only; fewer words than WIDTH are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import simhash
from .common import Box, cut, few, join_one, map_texts, release, small, texts_of
from .graph import components

#: SIMILAR is a fraction in whole numbers, 4 / 5.
WIDTH, SIMILAR, BITS, WIDE, SLICE = 5, (4, 5), 512, 1 << 14, 1024
#: Counters of the sketch, and the blocks in which they are added up; aimed entries of a shard of prefixes, and entries that a worker holds.
COUNTERS, BLOCKS, SHARD, HELD = 1 << 18, 16, 250_000, 250_000
#: Of tables of entries (token, node, at most its parity bits) and of tables of texts, the rows of a task.
ENTRIES, TEXTS = 100_000, 2_000


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start, stop = (end - size)[: len(words) - width + 1].tolist(), (end[width - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(start, stop, strict=True)), np.uint64, len(start)))


def node_of(hashes: np.ndarray) -> int:
    """The set's own hash as a signed long; the empty set has 0."""
    x = xxhash.xxh64_intdigest(hashes.tobytes(), 42) if len(hashes) else 0
    return x - (1 << 64) if x >> 63 else x


def parity(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """For each of so many buckets of hashes whether it holds an odd number of the set: sets that differ in d hashes differ in at most d bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8).tobytes()


def wide_parity(hashes: np.ndarray) -> bytes:
    """parity() of as many bits as the set has hashes (a power of two, BITS to WIDE); halves of one fold into the next smaller."""
    return parity(hashes, min(max(BITS, 1 << max(len(hashes) - 1, 0).bit_length()), WIDE))


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two wide parities differ."""
    x, y = sorted((np.frombuffer(z, np.uint64) for z in (x, y)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def print_of(hashes: np.ndarray) -> int:
    """The set's SimHash as a signed long: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes by which the set is found."""
    n, (a, b) = len(hashes), SIMILAR
    order = np.lexsort((hashes, counts[(hashes % np.uint64(len(counts))).astype(np.int64)]))
    return hashes[order[: n - -(-a * n // b) + 1]]


def prints(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with fp, the node of the text's set."""
    return map_texts(docs, text_col, [("fp", pa.int64(), "long")], lambda texts: [[node_of(shingles(t)) for t in texts]], drop=() if keep_text else (text_col,))


def _read(id_type: pa.DataType):
    """(id, key, text) to a row for each text, and at the end BLOCKS rows of the sketch."""
    schema = pa.schema([("id", id_type), ("key", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("bits", pa.binary()), ("wide", pa.binary()), ("print", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n_held = np.zeros(COUNTERS, np.int64), [], 0

        def add() -> None:
            nonlocal counts, n_held
            if held:
                counts += np.bincount((np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            held.clear()
            n_held = 0

        for batch in batches:
            for start, texts in texts_of(batch.column(2), 1 << 20):
                fps, sizes, bits, wide, prints = [], [], [], [], []
                for t in texts:
                    s = shingles(t)
                    fps.append(node_of(s))
                    sizes.append(len(s))
                    bits.append(parity(s))
                    wide.append(wide_parity(s))
                    prints.append(print_of(s))
                    held.append(s)
                    n_held += len(s)
                    if n_held > HELD:
                        add()
                own = [batch.column(k).slice(start, len(texts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip((fps, sizes, bits, wide, prints, [None] * len(texts), [None] * len(texts)), schema.types[2:], strict=True))], schema=schema)
        add()
        if counts.any():
            none, blocks = [None] * BLOCKS, [x.tobytes() for x in np.split(counts, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, none, none, none, none, range(BLOCKS), blocks), schema.types, strict=True)], schema=schema)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // BLOCKS, np.int64)
    for x in table["counts"].to_pylist():
        total += np.frombuffer(x, np.int64)
    return pa.table({"block": table["block"][:1].combine_chunks(), "counts": pa.array([total.tobytes()], pa.binary())})


def _candidates(every: bool):
    """Pairs of nodes in arrays (fp, size, bits, component) that may be similar and have different components; a forest of them, or every one."""
    schema, (a, b) = pa.schema([("a", pa.int64()), ("b", pa.int64())]), SIMILAR

    def arrays(z) -> tuple[np.ndarray, ...]:
        z = z.values
        fp, size, part = (np.asarray(z.field(k).to_numpy(zero_copy_only=False), np.int64) for k in ("fp", "size", "part"))
        return fp, size, part, np.frombuffer(b"".join(z.field("bits").to_pylist()), np.uint64).reshape(len(fp), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                (fx, sx, px, bx), (fy, sy, py, by) = arrays(x), arrays(y)
                _, part = np.unique(np.concatenate([px, py]), return_inverse=True)
                px, py = part[: len(fx)].copy(), part[len(fx) :].copy()
                left, right, n = [], [], 0
                for i in range(len(fx)):
                    differ = np.bitwise_count(by ^ bx[i]).sum(axis=1, dtype=np.int64)
                    near = np.flatnonzero(((a + b) * differ <= (b - a) * (sy + sx[i])) & (b * np.minimum(sy, sx[i]) >= a * np.maximum(sy, sx[i])) & (py != px[i]))
                    if not every:
                        picked, near = [], near[np.argsort(differ[near], kind="stable")]
                        while len(near):
                            picked.append(near[0])
                            old, new = py[near[0]], px[i]
                            px[px == old] = new
                            py[py == old] = new
                            near = near[py[near] != new]
                        near = np.array(picked, np.int64)
                    left.append(np.minimum(fy[near], fx[i]))
                    right.append(np.maximum(fy[near], fx[i]))
                    n += len(near)
                    if n > 1 << 16 or i + 1 == len(fx):
                        if n:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (left, right)], schema=schema)
                        left, right, n = [], [], 0
            release()

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, size_a, size_b, wide_a, wide_b) the pairs whose parities differ in no more bits than those of similar sets."""
    a, b = SIMILAR
    for batch in batches:
        sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        wide = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
        good = [(a + b) * apart(*w) <= (b - a) * (x + y) for (x, y), w in zip(sizes, wide, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _prefixes(nodes: DataFrame) -> int:
    """The number of all nodes' prefix hashes."""
    a, b = SIMILAR
    return int(nodes.agg(F.coalesce(F.sum(F.col("size") - F.ceil(F.col("size") * a / b) + 1), F.lit(0))).first()[0])


def _shared(texts: DataFrame, shipped, shards: int, total: int) -> DataFrame:
    """(token, fp): the prefix hashes that several nodes share, with each of these nodes, once. shipped: the sketch; total: the sum of its counts."""
    hot = 2 * total // COUNTERS + SHARD

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size, counts = 0, shipped.value

        def out() -> pa.RecordBatch:
            token = np.concatenate(list(held.values()))
            fp = np.repeat(np.fromiter(held, np.int64, len(held)), [len(x) for x in held.values()])
            held.clear()
            mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            often = counts[(token % np.uint64(COUNTERS)).astype(np.int64)] > hot
            shard = np.where(often, -1 - (mix(fp.view(np.uint64)) % np.uint64(shards)).astype(np.int64), (mix(token) % np.uint64(shards)).astype(np.int64))
            order = np.argsort(shard, kind="stable")
            token, fp, shard = token[order], fp[order], shard[order]
            at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist()
            parts = list(zip(at, [*at[1:], len(shard)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a in at], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (token, fp))], names=["shard", "tokens", "fps"])

        for batch in batches:
            for _, some in texts_of(batch.column(0), 1 << 20):
                for s in map(shingles, some):
                    if len(s) and (k := node_of(s)) not in held:
                        held[k] = prefix(s, counts)
                        size += len(held[k])
                        if size > HELD:
                            yield out()
                            size = 0
        if held:
            yield out()
        release()

    def several(key: tuple, table: pa.Table) -> pa.Table:
        token, fp = (np.concatenate([np.frombuffer(x, np.int64) for x in table[c].to_pylist()]) for c in ("tokens", "fps"))
        order = np.lexsort((fp, token))
        token, fp = token[order], fp[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])]
        token, fp = token[new], fp[new]
        if key[0].as_py() >= 0:
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[first, len(token)])
            keep = np.repeat(size > 1, size)
            token, fp = token[keep], fp[keep]
        return pa.table({"token": token, "fp": fp})

    return texts.mapInArrow(arrays, "shard int, tokens binary, fps binary").groupBy("shard").applyInArrow(several, "token long, fp long")


def _dealt(members: DataFrame, tokens: DataFrame, slice_size: int) -> DataFrame:
    """Members (token, fp, ...) of the tokens (token, n: their members), with slices and slice; a token of many is dealt by fp before it is joined."""
    tokens = tokens.select("token", F.ceil(F.col("n") / slice_size).cast("int").alias("slices"))
    large = small(tokens.filter("slices > 1"))  # at most one for each slice_size members
    slice_of = F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int")
    each = tokens.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return members.join(large, "token", "left").withColumn("slice", slice_of).drop("slices").join(each, ["token", "slice"])


def _told_apart(found: DataFrame, entries: int) -> DataFrame:
    """Rows (token, fp) of one token of those that the same nodes have; 128 bits of hashes stand for the nodes. entries: about the rows of found."""
    by = found.groupBy("token").agg(F.expr("bit_xor(xxhash64(fp))").alias("x"), F.expr("bit_xor(xxhash64(fp, 1))").alias("y"), F.count("*").alias("n"))
    one = few(by, entries, ENTRIES).groupBy("x", "y", "n").agg(F.min("token").alias("token"))
    return few(_dealt(found, cut(few(one, entries, ENTRIES)), SLICE).select("token", "fp"), entries, ENTRIES)


def _compared(members: DataFrame, every: bool, slice_size: int) -> DataFrame:
    """Candidates (a, b) of buckets' members (token, fp, size, bits, part), each once."""
    several = members.groupBy("token").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    tokens = cut(several.select("token", "n"))
    entries = int(tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    dealt = _dealt(members, few(tokens, entries, ENTRIES), slice_size)
    slices = few(cut(dealt.groupBy("token", "slices", "slice").agg(F.collect_list(F.struct("fp", "size", "part", "bits")).alias("x"))), entries, ENTRIES)
    alone = slices.filter("slices = 1").select("x", F.col("x").alias("y"))
    left = slices.filter("slices > 1").select("token", "slice", "x", F.explode(F.sequence(F.col("slice"), F.col("slices") - 1)).alias("other"))
    pairs = left.join(slices.filter("slices > 1").select("token", F.col("slice").alias("other"), F.col("x").alias("y")), ["token", "other"]).select("x", "y")
    return few(alone.unionByName(pairs).mapInArrow(_candidates(every), "a long, b long").distinct(), entries, ENTRIES)


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. docs: key, text; nodes: fp, key of one of its texts; n: about the rows of either."""
    x, y = (nodes.select(F.col("fp").alias(k), F.col("size").alias(f"size_{k}"), F.col("wide").alias(f"wide_{k}")) for k in ("a", "b"))
    both = few(few(pairs.join(x, "a"), n).join(y, "b").select("a", "b", "size_a", "size_b", "wide_a", "wide_b"), n)
    pairs = cut(both.mapInArrow(_near, "a long, b long"))
    wanted = few(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), n)
    wanted = cut(few(nodes.join(small(wanted), "fp", "left_semi").select("fp", "key"), n))
    keys = few(wanted.select("key").distinct(), n)
    texts = few(docs.join(small(keys), "key", "left_semi").dropDuplicates(["key", "text"]).select("text"), n, TEXTS)

    def compute(texts: list[bytes]) -> list:
        sets = [shingles(t) for t in texts]
        return [[node_of(s) for s in sets], [s.view(np.int64) for s in sets]]

    sets = map_texts(texts, "text", [("fp", pa.int64(), "long"), ("hashes", pa.list_(pa.int64()), "array<bigint>")], compute, drop=("text",))
    sets = cut(few(sets.join(small(wanted.select("fp")), "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes")), n, TEXTS))
    x, y = (sets.select(F.col("fp").alias(k), F.col("hashes").alias(f"set_{k}")) for k in ("a", "b"))
    common, (a, b) = F.size(F.array_intersect("set_a", "set_b")), SIMILAR
    return few(few(pairs.join(x, "a"), n, TEXTS).join(y, "b").filter(common * b >= (F.size("set_a") + F.size("set_b") - common) * a).select("a", "b"), n, TEXTS)


def _printed(nodes: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of nodes by SimHash: those of one fingerprint with the first of them, and the first ones of fingerprints that its covering tables link. n: about the number of nodes."""
    filled = nodes.filter("size > 0").select("fp", "print")
    heads = cut(few(filled.groupBy("print").agg(F.min("fp").alias("head")), n))
    same = join_one(filled, heads, ["print"], each=1000).filter("fp <> head").select(F.col("head").alias("x"), F.col("fp").alias("y"))
    near = cut(few(simhash.links(heads.select(F.col("print").alias("fp")), rows=n).distinct(), n))
    x, y = (heads.select(F.col("print").alias(k), F.col("head").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    near = few(near.join(x, "a"), n).join(y, "b").select("x", "y")
    pairs = few(same.unionByName(near), n).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return cut(few(pairs.distinct(), n))


def _parted(members: DataFrame, part: DataFrame, entries: int) -> DataFrame:
    """members, about so many entries, with part, the component that their node has in part, or else the node."""
    part = part.select(F.col("node").alias("fp"), "component")
    return few(members.join(part, "fp", "left").withColumn("part", F.coalesce("component", "fp")).drop("component"), entries, ENTRIES)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_size: int = SLICE) -> DataFrame:
    """(id, fp, component_id) of every row; the component is the smallest id of the rows that links reach."""
    slim = Box(docs, id=id_col, text=text_col).df.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = slim.schema["id"].dataType
    read = cut(slim.mapInArrow(_read(to_arrow_type(id_type)), f"id {id_type.simpleString()}, key long, fp long, size int, bits binary, wide binary, print long, block int, counts binary"))
    rows = read.filter("block is null").select("id", "key", "fp", "size", "bits", "wide", "print")
    n = rows.count()
    nodes = cut(few(rows.groupBy("fp").agg(F.min("id").alias("first"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.first("print").alias("print")), n))
    sketch = read.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(_add_up, "block int, counts binary")
    counts = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for r in sketch.collect():  # BLOCKS rows
        counts[r["block"]] = np.frombuffer(r["counts"], np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast(counts.ravel())
    entries = _prefixes(nodes)
    found = few(cut(_shared(slim.select("text"), shipped, max(1, -(-entries // SHARD)), int(counts.sum()))), entries, ENTRIES)
    members = cut(few(_told_apart(found, entries).join(nodes.select("fp", "size", "bits"), "fp"), entries, ENTRIES))
    printed = _printed(nodes, n)
    links = cut(_similar(slim.select("key", "text"), nodes, printed, n))
    first = _compared(_parted(members, cut(components(links)), entries), False, slice_size)
    first = cut(few(first.join(printed, ["a", "b"], "left_anti"), entries, ENTRIES))
    links = cut(few(links.unionByName(_similar(slim.select("key", "text"), nodes, first, n)), n))
    part = cut(components(links))
    tried = first.unionByName(printed)
    second = _compared(_parted(members, part, entries), True, slice_size)
    second = cut(few(second.join(tried, ["a", "b"], "left_anti"), entries, ENTRIES))
    more = cut(_similar(slim.select("key", "text"), nodes, second, n))
    if not more.isEmpty():
        part = components(links.unionByName(more))
    return simhash.named(rows, nodes, part, id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates, by the rules of simhash.keep_one."""
    return simhash.keep_first(docs, cut(classes(docs, id_col, text_col)), prints, id_col, text_col)
