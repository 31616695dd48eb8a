"""From raw documents to a training mix: STAGES in order, each on all that the one before kept.

Every stage takes a table of documents (doc_id, text and any other columns, whatever they are called) and returns the rows that it
keeps with the same columns; the last one adds copy. Null texts count as empty, null ids are ids of their own, repeated rows are
rows of their own until near-duplicates go; an empty table gives an empty one. Each operator's docstring says what its ties and
edge cases give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import contamination, jaccard, lines, mixing, quality
from scriptorium.llm.common import Box, checkpoint_root


#: Bytes of rows that go to a Python worker at once (Spark's default: 64 MB, in practice a task's whole split); an executor and its workers hold such batches several times.
ARROW_BYTES = 4 << 20


def _slim(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ARROW_BYTES; it stays set, as what a stage returns runs later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the isolation forests keep; empty and null texts go (they have under 10 words)."""
    _slim(spark)
    box = Box(docs, id="doc_id", text="text")
    return box.open(quality.judge(box.df, quality.fit(docs, _table(spark, sf_dir, "labels"))).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that an earlier document holds; documents of which nothing is left go. n_chars follows the text."""
    _slim(spark)
    box = Box(docs, id="doc_id", text="text")
    out = lines.dedup(box.df, "id", "text").filter((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = box.open(out)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more (sets of 5-word shingles) connect: the one with the smallest id. By SimHash and its covering tables first, the links that these miss by prefixes."""
    _slim(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    _slim(spark)
    return contamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that it takes a document, numbered by copy; texts without a word are never taken."""
    box = Box(docs, id="doc_id", text="text", source="source")
    taken = mixing.mix(box.df, id_col="id").filter("copies > 0")
    return box.open(taken.select("box", "id", "text", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), "copy")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture)]

#: SQL cannot express isolation forests, content-defined chunks or the components; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; what a stage returns is written to the shared checkpoint folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
