"""What operators need from the session: the shared checkpoint folder, and numbering without a single partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder (the cluster's setting; a temporary one only on a local master) and read from there."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="scriptorium-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work on texts that takes long: rows of fewer splits than cores are dealt out; a table of as many stays where it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def numbered(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """df with a number from 1 in this order, without gathering it: ranges are numbered apart and shifted by what stands before them."""
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count().withColumn("_before", F.sum("count").over(W.orderBy("_part")) - F.col("count"))
    out = ranged.join(F.broadcast(sizes.select("_part", "_before")), "_part")  # a row for each partition
    return out.withColumn(into, F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(*order))).drop("_part", "_before")


def placed(df: DataFrame, group: str, order: list[Column], into: str) -> DataFrame:
    """df with each row's place from 1 in its group, in this order, without gathering a group: sorted ranges are numbered by row and shifted by what the group has before them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order]
    ranged = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_row", 33))  # a partition's number above 33 bits of places
    sizes = ranged.groupBy(F.col(group).alias("_group"), "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy("_group").orderBy("_part")) - F.col("_rows")
    sizes = sizes.select("_group", F.col("_part").alias("_of"), (before - F.col("_first") + 1).alias("_shift"))
    few = sizes.limit(200_001).count() <= 200_000  # a row for each partition and group in it
    out = ranged.join(F.broadcast(sizes) if few else sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return out.withColumn(into, F.col("_row") + F.col("_shift")).drop("_row", "_part", "_group", "_of", "_shift")
