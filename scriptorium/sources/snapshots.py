"""The registry as Parquet snapshots: every save is a new version; numbered heads name them, and the highest is the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.session import cut
from scriptorium.operators.registry import merge3


class Taken(Exception):
    """Another writer has saved the version that was to be this one."""


class Snapshots:
    """Versions in a folder of any file system that Spark writes to. A head is written aside and moved to its number, which never replaces one that is there: of two writers one sees Taken. That rests on a rename that does not overwrite, as HDFS and local folders have it; on an object store whose rename copies, two writers at one moment need a lock of their own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("x").getFileSystem(conf)
        self._fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._keep[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")

    def _heads(self, prefix: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.globStatus(self._path(f"{prefix}-*")) or ())

    def _head(self) -> list[str]:
        """The lines of the current head: the version's name, then a stream and its last batch each."""
        heads = self._heads("head")
        return self.spark.read.text(f"{self.folder}/{heads[-1]}", wholetext=True).first()[0].split("\n") if heads else []

    def version(self) -> str | None:
        return next(iter(self._head()), None)

    def batches(self) -> dict[str, int]:
        """The last batch of each stream that the current version holds."""
        return {stream: int(n) for stream, _, n in (x.rpartition("\t") for x in self._head()[1:])}

    def load(self, version: str | None = None) -> DataFrame | None:
        name = version or self.version()
        return self.spark.read.parquet(f"{self.folder}/{name}") if name else None

    def save(self, table: DataFrame, base: str | None, cells: list[str], tries: int = 20, batch: tuple[str, int] | None = None) -> str:
        """Saves a table made from version base; if another version has come meanwhile, cell by cell merged with it. Returns the new version.

        A table that has an id twice is refused: no operator makes one from a registry that is whole.
        """
        again = table.groupBy("id").count().filter("count > 1").select("id").limit(3).collect()
        if again:
            raise ValueError(f"an id has several rows: {', '.join(str(r['id']) for r in again)}")
        for _ in range(tries):
            heads, now = self._heads("head"), self.version()
            merged = table
            if now != base and now is not None:
                before = self.load(base) if base else self.load(now).limit(0)
                merged = cut(merge3(before, table, self.load(now), cells).drop("conflict"))
            try:
                return self.replace(merged, int(heads[-1].split("-")[1]) if heads else 0, *([batch] if batch else []))
            except Taken:
                continue
        raise Taken(f"{tries} other saves came first")

    def replace(self, table: DataFrame, after: int | None = None, batch: tuple[str, int] | None = None) -> str:
        """Saves a table as the version behind number after (the current one); old versions stay. Raises Taken if there is one already."""
        name = f"v-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.folder}/{name}")
        self._point(name, after, batch)
        return name

    def done(self, stream: str, n: int, tries: int = 20) -> None:
        """Notes a batch that changed nothing: the same version under a new head."""
        for _ in range(tries):
            heads = self._heads("head")
            try:
                return self._point(self.version(), int(heads[-1].split("-")[1]), (stream, n))
            except Taken:
                continue
        raise Taken(f"{tries} other saves came first")

    def _point(self, name: str, after: int | None, batch: tuple[str, int] | None) -> None:
        """A head with the version's name, and the streams' last batches in the same file: both are there or neither."""
        if after is None:
            heads = self._heads("head")
            after = int(heads[-1].split("-")[1]) if heads else 0
        batches = self.batches() | ({batch[0]: batch[1]} if batch else {})
        self._move("\n".join([name, *(f"{s}\t{n}" for s, n in sorted(batches.items()))]), f"head-{after + 1:012d}")

    def _move(self, content: str, to: str) -> None:
        aside = self._path(f".{to}-{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            self._fc.rename(aside, self._path(to), self._keep)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(self._path(to)):
                raise Taken(to) from e
            raise

    def keep_ids(self, table: DataFrame) -> None:
        """Adds a table's ids to the map of old ids, which a registry made anew inherits from."""
        name, heads = f"ids-{uuid.uuid4().hex}", self._heads("idmap")
        n = int(heads[-1].split("-")[1]) if heads else 0
        rows = table.select("id", "file_name", "sha1", F.lit(n).alias("age"))
        old = self.id_map()
        (rows if old is None else rows.unionByName(old.withColumn("age", F.col("age")))).write.parquet(f"{self.folder}/{name}")
        self._move(name, f"idmap-{n + 1:012d}")

    def id_map(self) -> DataFrame | None:
        """(id, file_name, sha1, age) of rows of earlier registries, or None."""
        heads = self._heads("idmap")
        return self.spark.read.parquet(f"{self.folder}/{self.spark.read.text(f'{self.folder}/{heads[-1]}').first()[0]}") if heads else None
