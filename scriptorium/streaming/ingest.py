"""Incremental ingestion: files that arrive are scanned once, and what they add is appended to the registry's snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.functions import text as T
from scriptorium.operators.registry import scan
from scriptorium.sources import files
from scriptorium.sources.snapshots import Snapshots

CELLS = ["file_name", "title", "first_author", "source_type", "sha1", "source_path", "tier", "verdict", "state", "note"]
SCHEMA = ", ".join(f"{c} string" for c in ["id", *CELLS])


def old_ids(store: Snapshots) -> DataFrame:
    """The map of old ids (id, file_name, sha1, row_no), the youngest first and by id."""
    ids = store.id_map()
    if ids is None:
        return store.spark.createDataFrame([], "id string, file_name string, sha1 string, row_no string")
    return ids.select("id", "file_name", "sha1", F.format_string("%010d%s", F.lit(1 << 30) - F.col("age"), F.col("id")).alias("row_no"))


def append(found: DataFrame, store: Snapshots, record_duplicates: bool = False, batch: tuple[str, int] | None = None) -> int:
    """Appends what a scan of files (file_name, source_path, sha1) adds; returns how many rows. Scanning the same files again adds none.

    batch: a stream and the number of its batch, saved with the rows.
    """
    spark = found.sparkSession
    base = store.version()
    old = store.load(base) if base else spark.createDataFrame([], SCHEMA)
    rows = scan(found, old.withColumn("row_no", F.lit(0)), old_ids(store), record_duplicates).select("id", *CELLS)
    rows = rows.cache()
    try:
        n = rows.count()
        if n or base is None:
            store.save(old.unionByName(rows, allowMissingColumns=True), base, CELLS, batch=batch)
        elif batch:
            store.done(*batch)
        return n
    finally:
        rows.unpersist()


def ingest(spark: SparkSession, folder: str, registry: str, checkpoint: str) -> StreamingQuery:
    """A stream over the files of a folder that ends when all present ones are done.

    The number of a batch is saved in the head of the snapshot that holds its rows. A batch that comes again, as its end was not
    noted by the stream, is known by it and refused before any file is read.
    """
    files_ = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    listed = files_.select("path", F.col("length").alias("size"))
    store = Snapshots(spark, registry)

    def take(batch: DataFrame, number: int) -> None:
        if number <= store.batches().get(checkpoint, -1):
            return
        hashed = files.hashed(batch).select(F.col("path").alias("source_path"), T.basename(F.col("path")).alias("file_name"), "sha1")
        append(hashed, store, batch=(checkpoint, number))

    return listed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
