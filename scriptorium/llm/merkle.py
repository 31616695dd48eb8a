"""A Merkle manifest of a table: a leaf for each row, a binary tree for each group of rows, and a tree over the groups' roots.

Nodes are combined by the key of their parent, driven by their arrival. A task holds partial parents: each gathers the digests of
its children by index until it has as many as the size of its group says (two, or one at the end of a level), then it is hashed and
arrives at its own parent. What a task can't complete is its frontier: only that is shuffled, by aligned blocks of 2^8, 2^16, ...
leaves, so no task gets more than a few hundred nodes of a block, however large a group is. Every round leaves links from the nodes
that came in to the frontier node above them, with the siblings met on the way; read backwards, from the root to the leaves, the
links give each leaf its proof.

H is SHA-256; digests enter as lowercase hex text. A leaf is H of the row's fields, each "-" if null, else its length in UTF-8 bytes,
":" and the value. Leaves are numbered within their group by id (null first) by range partitions, without a window.

Defined results: equal ids are ordered by their leaves, and equal rows are leaves of their own; a null group is a group, the first
one; texts may be empty or of any length (they are hashed once and not shuffled); an empty table has no rows and no root; other
columns do not enter and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Box, checkpoint_root, cut, release, small

#: Levels that a round of the tree climbs: a block of 2^STEP nodes is combined in one task.
STEP = 8
#: Rows of links up to which they are broadcast; a row holds at most 64 digests, so these are 40 MB at most.
LINKS = 20_000


def digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(n - 1, 0).bit_length()


@dataclass
class Combiner:
    """Partial parents of one block of one tree of n leaves, up to level `top` or the root."""

    n: int
    top: int
    partial: dict[tuple[int, int], dict[int, bytes]] = field(default_factory=dict)
    parent: dict[tuple[int, int], list[bytes]] = field(default_factory=dict)  # reverse links: children by completed parent
    done: dict[tuple[int, int], bytes] = field(default_factory=dict)  # nodes that no completed parent holds: the frontier

    def __post_init__(self):
        self.top = min(self.top, height(self.n))

    def arity(self, level: int, index: int) -> int:
        """Children of a node: two, or what is left at the end of the level below."""
        below = -(-self.n >> (level - 1)) if level > 1 else self.n
        return min(2, below - 2 * index)

    def arrive(self, level: int, index: int, value: bytes) -> None:
        while True:
            self.done[level, index] = value
            if level >= self.top:
                return
            up = (level + 1, index >> 1)
            children = self.partial.setdefault(up, {})
            children[index & 1] = value
            if len(children) < self.arity(*up):
                return
            del self.partial[up]
            for side in children:
                del self.done[level, 2 * up[1] + side]
            self.parent[up] = [children[side] for side in sorted(children)]
            level, index, value = *up, digest(self.parent[up])

    def link(self, level: int, index: int) -> tuple[int, int, bytes]:
        """The frontier node above a node that arrived, and the siblings on the way, in order."""
        path = []
        while (up := (level + 1, index >> 1)) in self.parent:
            children = self.parent[up]
            path += [children[1 - (index & 1)]] if len(children) == 2 else []
            level, index = up
        return level, index, b"".join(path)



def _combine(batches: Iterator[pa.RecordBatch], levels: int, extra: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of nodes, sorted by tree and first leaf, with their links up to level `levels`. A block at a time is in memory."""
    rows: list[tuple] = []
    block, combiner, names = None, None, ["tree", "n", "level", "at", "value"]

    def linked() -> pa.RecordBatch:
        found = [combiner.link(r[2], r[3]) for r in rows]
        arrays = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows, strict=True))]
        more = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([combiner.done[f[:2]] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())]
        return pa.RecordBatch.from_arrays([*arrays, *more], names=[*names, *extra, "to_level", "to_at", "to_value", "path"])

    for batch in batches:
        schema = pa.schema([batch.schema.field(n) for n in (*names, *extra)])
        for r in zip(*(batch.column(n).to_pylist() for n in schema.names), strict=True):
            own = (r[0], (r[3] << r[2]) >> levels)
            if own != block:
                if rows:
                    yield linked()
                block, combiner, rows = own, Combiner(r[1], levels), []
            combiner.arrive(r[2], r[3], r[4])
            rows.append(r)
    if rows:
        yield linked()
    release()


def _round(nodes: DataFrame, levels: int, extra: list[str]) -> DataFrame:
    ordered = nodes.select("tree", "n", "level", "at", "value", *extra)
    schema = ", ".join([*(f"{n} {t}" for n, t in ordered.dtypes), "to_level int, to_at long, to_value binary, path binary"])
    return cut(ordered.mapInArrow(lambda batches: _combine(batches, levels, extra), schema))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df (tree, ...) sorted by tree and order in range partitions, with at (the place in its tree, from 0) and n (the tree's size).

    Rows that are equal in all of order are told apart by where they stood, so any number of them is spread over the ranges.
    """
    spark = df.sparkSession
    df = cut(df.withColumn("salt", F.monotonically_increasing_id()))
    keys = [F.col(c) for c in ("tree", *order, "salt")]
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).drop("salt")
    ranged = cut(ranged.withColumn("row", F.monotonically_increasing_id()))  # a partition's number above 33 bits of places
    part = F.shiftright("row", 33)
    sizes = ranged.groupBy("tree", part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    # a row for each partition and tree in it: partitions + trees at most
    whole = W.partitionBy("tree")
    before = F.sum("rows").over(whole.orderBy("part")) - F.col("rows")
    sizes = sizes.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return ranged.withColumn("part", part).join(F.broadcast(sizes) if sizes.limit(200_001).count() <= 200_000 else sizes, ["tree", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def climb(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The trees of leaves (tree, value, and any others): the leaves with their proof below the tree's root (path), and roots (tree, value)."""
    extra = [c for c in leaves.columns if c not in ("tree", "value")]
    nodes = numbered(leaves, order).withColumn("level", F.lit(0))
    tallest = height(nodes.agg(F.max("n")).first()[0] or 1)
    nodes = nodes.sortWithinPartitions("tree", "at")  # stays where it is: a block that two ranges share is combined in the next round
    rounds, levels = [_round(nodes, STEP, extra)], STEP

    def frontier() -> DataFrame:
        first = [F.first(c).alias(a) for c, a in (("n", "n"), ("to_value", "value"))]
        return rounds[-1].groupBy("tree", F.col("to_level").alias("level"), F.col("to_at").alias("at")).agg(*first)

    while True:
        start = F.expr("shiftleft(at, level)")
        dealt = frontier().withColumn("start", start).repartition("tree", F.shiftright("start", levels)).sortWithinPartitions("tree", "start")
        rounds.append(_round(dealt, levels, []))
        if levels >= tallest:
            break
        levels += STEP
    roots = frontier().select("tree", "value")
    # backwards: the proof of a node is its path to the frontier and the proof of the frontier node
    up = rounds[-1].select("tree", "level", "at", F.col("path").alias("rest"))
    for links in (*rounds[-2:0:-1], rounds[0]):
        above = small(up.toDF("tree", "to_level", "to_at", "rest"), LINKS)
        joined = links.join(above, ["tree", "to_level", "to_at"])
        proof = F.concat("path", "rest")
        up = joined.select("tree", "level", "at", proof.alias("rest")) if links is not rounds[0] else joined.select("tree", "n", "at", "value", *extra, proof.alias("path"))
    return up, roots


def _told(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column | str) -> Column:
    """The digest of a row of fields, in binary."""
    told = [_told(F.col(f) if isinstance(f, str) else f) for f in fields]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def fold(value: bytes, path: bytes, sizes: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its proof give. sizes: place and number of leaves in each tree from the leaf to the root."""
    used = 0
    for at, n in sizes:
        while n > 1:
            if at & 1 or at + 1 < n:
                other = path[used : used + 32]
                used += 32
                value = digest([other, value] if at & 1 else [value, other])
            else:
                value = digest([value])
            at, n = at >> 1, (n + 1) >> 1
    return value


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group: str = "lang") -> DataFrame:
    """A row for each row of docs: id, leaf, group's place and size, root of the group, root of all, and the proof (all digests binary)."""
    box = Box(docs, **{f"f{i}": f for i, f in enumerate(fields)})
    at = {f: F.col(f"f{i}") for i, f in enumerate(fields)}
    return proofs(box.df.select(at[id_col].alias("id"), tree_key(at[group]).alias("tree"), leaf(*at.values()).alias("value")))


def tree_key(group: Column) -> Column:
    """Groups in the order of their UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def proofs(leaves: DataFrame) -> DataFrame:
    """Leaves (id, tree, value, and any others) with at, n, subroot, top_at, top_n, root and proof, the siblings from leaf to root."""
    checkpoint_root(leaves.sparkSession)
    paths, subroots = climb(leaves, ["id", "value"])
    tops, roots = climb(subroots.select(F.lit("").alias("tree"), "value", F.col("tree").alias("key")), ["key"])
    root = F.broadcast(roots.select(F.col("value").alias("root")))  # one row
    tops = tops.select(F.col("key").alias("tree"), F.col("value").alias("subroot"), F.col("at").alias("top_at"), F.col("n").alias("top_n"), F.col("path").alias("top_path")).join(root)
    others = [c for c in leaves.columns if c not in ("id", "tree", "value")]
    return paths.join(small(tops, LINKS), "tree").select("id", *others, F.col("value").alias("leaf"), "at", "n", "subroot", "top_at", "top_n", "root", F.concat("path", "top_path").alias("proof"))


def verify(proved: DataFrame, value: str = "leaf") -> DataFrame:
    """Rows of proofs() with folded_root, the root that column `value` and the proof give, and verified."""
    names = proved.columns
    schema = f"{', '.join(f'`{n}` {t}' for n, t in proved.dtypes)}, folded_root binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = (batch.column(c).to_pylist() for c in (value, "proof", "at", "n", "top_at", "top_n"))
            roots = [fold(v, p, [(at, n), (top, of)]) for v, p, at, n, top, of in zip(*read, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*names, "folded_root"])
        release()

    return proved.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
