"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows up to which a table of a known row width is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a task in a table that few() deals with.
FEW_ROWS = 20_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's setting, or a folder of our own where none is set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scriptorium-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: nothing above is computed again, and a lost executor loses nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, rows: int, each: int = FEW_ROWS, least: int | None = None) -> DataFrame:
    """df in as many tasks as rows, about its number of rows, fill with each, or in fewer if it has fewer; at least in least (two for each core).

    Every task of a shuffle writes files of its own, so a small table over hundreds of tasks takes more disk for these than for its rows.
    """
    return df.coalesce(max(1, -(-rows // each), 2 * df.sparkSession.sparkContext.defaultParallelism if least is None else least))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def bucket_of(key: Column, n: int) -> Column:
    """key's remainder of CRC-32 of its decimal text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release() -> None:
    """Hands memory that a task no longer needs back to the system: Python workers outlive tasks, and idle ones share an executor's memory with the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column: pa.ChunkedArray | pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a string column as bytes (null: empty): the first row's index and the rows, about max_bytes at a time."""
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = data.cast(pa.large_binary())
    sizes = np.fromiter((0 if x is None else x for x in pa.compute.binary_length(data).to_pylist()), np.int64, len(data))
    ends, start = np.cumsum(sizes), 0
    while start < len(data):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + max_bytes, "right")))
        yield start, [b"" if x is None else x for x in data.slice(start, stop - start).to_pylist()]
        start = stop


def index_of(df: DataFrame, name: str) -> int:
    """The place of a column: of that very name, else of that name in another case."""
    names = df.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


class Box:
    """The columns of a table that an operator works on, under the operator's names, and all others in one struct.

    Inside there are no names but the operator's, so whatever the table's columns are called, nothing clashes.
    """

    def __init__(self, docs: DataFrame, **roles: str):
        self.names = docs.columns
        self.role = {index_of(docs, name): role for role, name in reversed(roles.items())}
        flat = docs.toDF(*(f"c{i}" for i in range(len(self.names))))
        others = (f"c{i}" for i in range(len(self.names)) if i not in self.role)
        self.df = flat.select(F.struct(F.lit(0).cast("byte").alias("none"), *others).alias("box"), *(F.col(f"c{index_of(docs, name)}").alias(role) for role, name in roles.items()))

    def open(self, df: DataFrame, *added: str, called: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
        """The table's own columns again, from a df that has box and the roles' columns, and added ones under the names called (their own).

        An added column replaces one of its name in any case. Roles in drop do not come back.
        """
        called = called or added
        gone = {n.lower() for n in called}
        own = [(i, n) for i, n in enumerate(self.names) if n.lower() not in gone and self.role.get(i) not in drop]
        out = df.select(*(F.col(self.role.get(i, f"box.c{i}")).alias(f"c{i}") for i, _ in own), *added)
        return out.toDF(*(n for _, n in own), *called)


def join_one(many: DataFrame, one: DataFrame, on: list[str], by: list[str] | None = None, each: int = 4096) -> DataFrame:
    """The inner join of many with one, which has a row for each value of on. Values with over each rows of many are dealt over several tasks.

    by: the columns of on that tell values apart well enough to count them (all of them). many must come from a checkpoint or a
    file, so that a repeated task deals as the first did.
    """
    by = by or on
    hot = cut(many.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > each).select(*by, F.ceil(F.col("n") / each).cast("int").alias("salts")))
    if hot.isEmpty():
        return many.join(one, on)
    # at most a row of hot for each `each` rows of many
    dealt = many.join(small(hot), by, "left").withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    copies = one.join(small(hot), by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [*on, "salt"]).drop("salt")


def map_texts(df: DataFrame, column: str, fields: list[tuple[str, pa.DataType, str]], compute: Callable[[list[bytes]], list], drop: tuple[str, ...] = (), max_bytes: int = 2 << 20) -> DataFrame:
    """df and new columns that compute() makes from lists of whole texts as bytes, about max_bytes at a time. Columns of df with the new names (in any case) are replaced, those in drop go.

    fields: name, Arrow type and Spark type of each; compute returns one sequence for each field.
    """
    names, gone = df.columns, {n.lower() for n, _, _ in fields} | {n.lower() for n in drop}
    keep, text = [i for i, n in enumerate(names) if n.lower() not in gone], f"c{index_of(df, column)}"
    kept = [f"c{i}" for i in keep]
    old = df.toDF(*(f"c{i}" for i in range(len(names)))).select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*old.select(*kept).schema.fields, *(T.StructField(f"n{j}", T.StructType.fromDDL(f"x {s}")["x"].dataType) for j, (_, _, s) in enumerate(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start, texts in texts_of(batch.column(at), max_bytes):
                got = compute(texts)
                arrays = [batch.column(batch.schema.get_field_index(c)).slice(start, len(texts)) for c in kept]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(g, type=t) for g, (_, t, _) in zip(got, fields, strict=True))], names=schema.names)
        release()

    return old.mapInArrow(run, schema).toDF(*(names[i] for i in keep), *(n for n, _, _ in fields))
