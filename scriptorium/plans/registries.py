"""Queries of the registry, over one made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import registry as R
from scriptorium.plans.scalars import _ext, _stem
from scriptorium.functions.text import WS

# A registry row for every document, in SQL that Spark and DuckDB read alike.
ROW = [
    "doc_id",
    "doc_id AS row_no",
    "printf('L%04d', CAST(doc_id + 1 AS INT)) AS id",
    "concat(source, '_doc', CAST(doc_id % 400 AS STRING), CASE doc_id % 5 WHEN 0 THEN '_副本' WHEN 1 THEN ' (1)' ELSE '' END, CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' WHEN 4 THEN '.doc' ELSE '.md' END) AS file_name",
    "concat('in/', source, '/', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' WHEN 4 THEN '.doc' ELSE '.md' END) AS source_path",
    "text AS body",
    "sha1(text) AS sha1",
    "CASE doc_id % 7 WHEN 0 THEN 'T1 核心' WHEN 1 THEN 'T2重要' WHEN 2 THEN '去重-重复' WHEN 3 THEN '' ELSE '待分流' END AS tier",
    "CASE doc_id % 4 WHEN 0 THEN '待核查' WHEN 1 THEN '去重' ELSE '纳入（核心）' END AS verdict",
    "CASE doc_id % 9 WHEN 0 THEN '已解码' WHEN 1 THEN '跳过' WHEN 2 THEN '已抽文本' WHEN 3 THEN '' ELSE '未处理' END AS state",
    "CASE doc_id % 3 WHEN 0 THEN '' ELSE 'out.md' END AS output_file",
    "CASE doc_id % 8 WHEN 0 THEN '重复' WHEN 1 THEN 'checked' ELSE '' END AS note",
    "'' AS text_path",
    "CAST(n_chars AS INT) AS n_chars",
]
REG = f"reg AS (SELECT {', '.join(ROW)} FROM documents)"
OLD, NEW = "doc_id % 10 < 7", "doc_id % 10 >= 5"
CELLS = ["file_name", "sha1", "tier", "note"]


def _reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*ROW)


def scan_new_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reg(spark, sf_dir)
    return R.new_paths(r.filter(NEW), r.filter(OLD)).select("source_path")


def scan_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reg(spark, sf_dir)
    return R.by_content(r.filter("doc_id % 10 >= 7"), r.filter(OLD)).select("source_path", "first_of")


def same_title_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.same_titles(_reg(spark, sf_dir), T.title_key(F.col("file_name")), ["doc_id"]).select("id", "same_title_as")


# Files of which many share a name or a content, and a map of old ids that leads from both to ids that others want too.
NEW_FILES = ["concat('f', CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING)) AS file_name", "source_path", "concat('s', CAST(doc_id * 7 % 1013 AS STRING)) AS sha1"]
OLD_IDS = ["printf('L%04d', CAST(doc_id + 50001 AS INT)) AS id", "concat('f', CAST(CAST(floor(doc_id / 20) AS BIGINT) + doc_id % 3 AS STRING)) AS file_name", "CASE WHEN doc_id % 4 > 0 THEN concat('s', CAST((doc_id + 10) * 7 % 1013 AS STRING)) END AS sha1", "row_no"]


def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reg(spark, sf_dir)
    late = r.filter("doc_id % 10 >= 7")
    return R.assign_ids(late.selectExpr(*NEW_FILES), r.filter(OLD), late.selectExpr(*OLD_IDS)).select("source_path", "id")


def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reg(spark, sf_dir)
    none = r.filter("false").select("id", "file_name", "sha1", "row_no")
    return R.scan(r.filter(NEW).select("file_name", "source_path", "sha1"), r.filter(OLD), none, record_duplicates=True).select("id", "source_path", "source_type", "tier", "verdict", "state", "note")


def _three(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = r.filter("doc_id % 10 < 8").select("id", *CELLS)
    ours = r.filter("doc_id % 10 < 9 and doc_id % 13 <> 0").select("id", *(F.when(F.expr("doc_id % 5 = 0"), "ours").otherwise(F.col(c)).alias(c) if c in ("tier", "note") else F.col(c) for c in CELLS))
    theirs = r.filter("doc_id % 10 <> 7 and doc_id % 17 <> 0").select("id", *(F.when(F.expr("doc_id % 10 = 8"), F.concat(c, F.lit("x"))).otherwise(F.col(c)).alias(c) if c in ("file_name", "sha1") else F.when(F.expr("doc_id % 7 = 0"), "theirs").otherwise(F.col(c)).alias(c) for c in CELLS))
    return base, ours, theirs


def merge3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge3(*_three(_reg(spark, sf_dir)), CELLS).select("id", *CELLS)


def merge3_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.merge3(*_three(_reg(spark, sf_dir)), CELLS)
    return m.select("id", F.explode("conflict").alias("cell"))


def attach_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reg(spark, sf_dir)
    texts = r.filter("doc_id % 4 = 0").select("id", F.concat(F.lit("ocr/"), "id").alias("text_path"), F.when(F.expr("doc_id % 8 = 0"), F.lit(" a b \n")).otherwise(F.col("body")).alias("text"))
    return R.attach(r, texts).select("id", "text_path", "n_chars", "state", "note")


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reg(spark, sf_dir)
    results = r.filter("doc_id % 3 < 2").select("id", F.when(F.expr("doc_id % 3 = 0"), "ok").otherwise("打不开").alias("status"), F.concat("id", F.lit(".txt")).alias("path"))
    return R.backfill(r, results).select("id", "text_path", "state")


def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tally(_reg(spark, sf_dir), ["tier", "verdict", "state"])


def status_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit(_reg(spark, sf_dir))


def extract_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extract_queue(_reg(spark, sf_dir), F.expr("doc_id % 11 <> 0")).select("id", "queue", "new_state")


def already_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues of a second run, by what it is told to do again: rows that keep their text have none."""
    r = _reg(spark, sf_dir).withColumn("state", F.when(F.expr("doc_id % 5 = 0"), "已OCR").otherwise("已抽文本")).withColumn("text_path", F.when(F.expr("doc_id % 4 < 3"), F.concat("id", F.lit(".txt"))).otherwise(""))
    there = F.expr("doc_id % 4 < 2")
    runs = [R.extract_queue(r, F.lit(True), there, force, redo).select("id", F.lit(name).alias("run"), "queue") for name, force, redo in (("plain", False, False), ("force", True, False), ("redo", False, True))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def queue_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.extract_queue(_reg(spark, sf_dir), F.lit(True)).filter("queue is not null")
    return q.orderBy("row_no").limit(25).select("id", "queue")


def extract_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.extract_queue(_reg(spark, sf_dir), F.expr("doc_id % 11 <> 0"))
    return q.groupBy(F.coalesce("queue", "new_state").alias("status")).agg(F.count("*").alias("n"))


def text_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text another has too, each with the one that stays."""
    return R.text_duplicates(_reg(spark, sf_dir))


def changed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered paths whose content has changed since: an audit, as a scan skips known paths."""
    r = _reg(spark, sf_dir)
    now = r.select("source_path", F.when(F.expr("doc_id % 6 = 0"), F.sha1(F.concat("body", F.lit("!")))).otherwise(F.col("sha1")).alias("now"))
    return r.filter(OLD).join(now, "source_path").filter("now <> sha1").select("id", "source_path")


QUERIES = {f.__name__: f for f in (scan_new_paths, scan_dedup, same_title_flag, assign_ids, scan_full, merge3, merge3_conflicts, attach_text, backfill, status_tally, status_audit, extract_queue, already_extracted, queue_limit, extract_rollup, text_duplicates, changed_content)}

_KEY = f"lower(regexp_replace({_stem('file_name')}, '[{WS}]+', '', 'g'))"
_COPY = "(contains(tier, '重复') OR verdict = '去重' OR state = '跳过')"
_QUEUE = f"CASE WHEN NOT there OR {_COPY} THEN NULL WHEN e IN ('.md', '.txt') THEN 'text' WHEN e = '.pdf' THEN 'pdf' WHEN e = '.docx' THEN 'docx' END"
_STATE = f"CASE WHEN NOT there THEN '源文件缺失' WHEN {_COPY} OR e IN ('.md', '.txt', '.pdf', '.docx') OR state NOT IN ('', '未处理') THEN state WHEN e = '.png' THEN '需OCR' ELSE '待其它提取器' END"
_Q = f"q AS (SELECT *, {_ext('source_path')} AS e, doc_id % 11 <> 0 AS there FROM reg)"
_TYPE = f"CASE WHEN {_ext('file_name')} = '.png' THEN '图片' WHEN {_ext('file_name')} IN ('.docx', '.doc') THEN '文档' WHEN {_ext('file_name')} = '.md' THEN '笔记' WHEN {_ext('file_name')} = '.pdf' THEN '期刊论文' ELSE '待核' END"
_M = f"""WITH {REG}, b AS (SELECT * FROM reg WHERE doc_id % 10 < 8),
 o AS (SELECT id, file_name, sha1, CASE WHEN doc_id % 5 = 0 THEN 'ours' ELSE tier END AS tier, CASE WHEN doc_id % 5 = 0 THEN 'ours' ELSE note END AS note FROM reg WHERE doc_id % 10 < 9 AND doc_id % 13 <> 0),
 t AS (SELECT id, CASE WHEN doc_id % 10 = 8 THEN file_name || 'x' ELSE file_name END AS file_name, CASE WHEN doc_id % 10 = 8 THEN sha1 || 'x' ELSE sha1 END AS sha1, CASE WHEN doc_id % 7 = 0 THEN 'theirs' ELSE tier END AS tier, CASE WHEN doc_id % 7 = 0 THEN 'theirs' ELSE note END AS note FROM reg WHERE doc_id % 10 <> 7 AND doc_id % 17 <> 0),
 clash AS (SELECT o.*, row_number() OVER (ORDER BY o.id) AS n FROM o JOIN t USING (id) WHERE o.id NOT IN (SELECT id FROM b) AND o.file_name <> t.file_name AND o.sha1 <> t.sha1),
 top AS (SELECT max(CAST(substr(id, 2) AS BIGINT)) AS top FROM (SELECT id FROM o UNION ALL SELECT id FROM t))"""


def _cell(c: str) -> str:
    return f"CASE WHEN o.id IS NULL THEN t.{c} WHEN t.id IS NULL THEN o.{c} WHEN b.id IS NULL THEN t.{c} WHEN o.{c} = b.{c} THEN t.{c} WHEN t.{c} = b.{c} THEN o.{c} ELSE t.{c} END AS {c}"


_FREE = "CASE WHEN c1 IS NOT NULL AND NOT list_contains(taken, c1) THEN c1 WHEN c2 IS NOT NULL AND NOT list_contains(taken, c2) THEN c2 END"

ORACLES = {
    "assign_ids": f"""WITH RECURSIVE {REG}, n AS (SELECT {', '.join(NEW_FILES)} FROM reg WHERE doc_id % 10 >= 7), im AS (SELECT {', '.join(OLD_IDS)} FROM reg WHERE doc_id % 10 >= 7),
 b1 AS (SELECT file_name, arg_min(id, row_no) AS c1 FROM im GROUP BY 1), b2 AS (SELECT sha1, arg_min(id, row_no) AS c2 FROM im WHERE sha1 IS NOT NULL GROUP BY 1),
 f AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source_path) AS k, source_path, c1, c2 FROM n LEFT JOIN b1 USING (file_name) LEFT JOIN b2 USING (sha1)),
 t AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS source_path, CAST(NULL AS VARCHAR) AS old, CAST([] AS VARCHAR[]) AS taken UNION ALL SELECT f.k, f.source_path, {_FREE}, CASE WHEN {_FREE} IS NULL THEN taken ELSE list_append(taken, {_FREE}) END FROM t JOIN f ON f.k = t.k + 1),
 top AS (SELECT max(CAST(substr(id, 2) AS BIGINT)) AS top FROM (SELECT id FROM reg WHERE {OLD} UNION ALL SELECT old FROM t WHERE old IS NOT NULL))
 SELECT source_path, old AS id FROM t WHERE old IS NOT NULL UNION ALL SELECT source_path, printf('L%04d', CAST(top + row_number() OVER (ORDER BY source_path) AS INT)) FROM t, top WHERE old IS NULL AND k > 0""",
    "scan_new_paths": f"WITH {REG} SELECT source_path FROM reg WHERE {NEW} AND source_path NOT IN (SELECT source_path FROM reg WHERE {OLD})",
    "scan_dedup": f"WITH {REG}, f AS (SELECT sha1, source_path, first_value(source_path) OVER (PARTITION BY sha1 ORDER BY CASE WHEN {OLD} THEN 0 ELSE 1 END, source_path) AS first, doc_id FROM reg) SELECT source_path, CASE WHEN first <> source_path THEN first END AS first_of FROM f WHERE doc_id % 10 >= 7",
    "same_title_flag": f"WITH {REG}, k AS (SELECT id, first_value(id) OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS first FROM reg) SELECT id, CASE WHEN first <> id THEN first END AS same_title_as FROM k",
    "scan_full": f"""WITH {REG}, f AS (SELECT *, first_value(source_path) OVER (PARTITION BY sha1 ORDER BY CASE WHEN {OLD} THEN 0 ELSE 1 END, source_path) AS first FROM reg),
 n AS (SELECT *, first <> source_path AS dup, printf('L%04d', CAST((SELECT max(doc_id) + 1 FROM reg WHERE {OLD}) + row_number() OVER (ORDER BY source_path) AS INT)) AS new_id FROM f WHERE doc_id % 10 >= 7),
 k AS (SELECT id AS new_id, file_name, 0 AS fresh, source_path FROM reg WHERE {OLD} UNION ALL SELECT new_id, file_name, 1, source_path FROM n WHERE NOT dup),
 s AS (SELECT new_id, first_value(new_id) OVER (PARTITION BY {_KEY} ORDER BY fresh, source_path) AS same FROM k)
 SELECT n.new_id AS id, n.source_path, {_TYPE} AS source_type, CASE WHEN dup THEN '去重-重复' ELSE '待分流' END AS tier, CASE WHEN dup THEN '去重' ELSE '待核查' END AS verdict, CASE WHEN dup THEN '跳过' ELSE '未处理' END AS state,
 CASE WHEN dup THEN 'same content as ' || first WHEN s.same <> n.new_id THEN 'same title as ' || s.same ELSE '' END AS note FROM n LEFT JOIN s ON n.new_id = s.new_id""",
    "merge3": f"{_M} SELECT coalesce(o.id, t.id) AS id, {', '.join(map(_cell, CELLS))} FROM o FULL JOIN t ON o.id = t.id LEFT JOIN b ON b.id = coalesce(o.id, t.id) UNION ALL SELECT printf('L%04d', CAST(top + n AS INT)), file_name, sha1, tier, CASE WHEN note = '' THEN 'moved from ' || id ELSE note || '；moved from ' || id END FROM clash, top",
    "merge3_conflicts": f"{_M}, c AS (SELECT o.id, unnest(['tier', 'note']) AS cell, unnest([o.tier <> b.tier AND t.tier <> b.tier AND o.tier <> t.tier, o.note <> b.note AND t.note <> b.note AND o.note <> t.note]) AS hit FROM o JOIN b ON o.id = b.id JOIN t ON o.id = t.id) SELECT id, cell FROM c WHERE hit UNION ALL SELECT printf('L%04d', CAST(top + n AS INT)), 'id' FROM clash, top",
    "attach_text": f"WITH {REG} SELECT id, CASE WHEN h THEN 'ocr/' || id ELSE text_path END AS text_path, CASE WHEN h THEN length(body) ELSE n_chars END AS n_chars, CASE WHEN h THEN '已OCR' ELSE state END AS state, CASE WHEN h THEN CASE WHEN note = '' THEN 'text attached' ELSE note || '；text attached' END ELSE note END AS note FROM (SELECT *, doc_id % 8 = 4 AND length(regexp_replace(body, '[{WS}]+', '', 'g')) >= 10 AS h FROM reg)",
    "backfill": f"WITH {REG} SELECT id, CASE doc_id % 3 WHEN 0 THEN id || '.txt' WHEN 1 THEN '' ELSE text_path END AS text_path, CASE doc_id % 3 WHEN 0 THEN '已抽文本' WHEN 1 THEN '打不开' ELSE state END AS state FROM reg",
    "status_tally": f"WITH {REG}, u AS (SELECT row_no, unnest(['tier', 'verdict', 'state']) AS field, unnest([tier, verdict, state]) AS v FROM reg) SELECT field, coalesce(nullif(v, ''), '（空）') AS value, count(*) AS n, min(row_no) AS first FROM u GROUP BY 1, 2",
    "status_audit": f"""WITH {REG} SELECT id, 'tier without decoding' AS problem FROM reg WHERE replace(tier, ' ', '') IN ('T1核心', 'T2重要', '专著章节') AND state NOT IN ('已解码', '已入RCOS', '已入综述')
 UNION ALL SELECT id, 'decoded without output' FROM reg WHERE state = '已解码' AND output_file = '' UNION ALL SELECT id, 'skipped without reason' FROM reg WHERE state = '跳过' AND NOT contains(tier, '重复') AND NOT contains(note, '重复')
 UNION ALL SELECT id, 'copy not skipped' FROM reg WHERE contains(tier, '重复') AND state <> '跳过' UNION ALL SELECT id, 'verdict pending' FROM reg WHERE verdict = '待核查'""",
    "extract_queue": f"WITH {REG}, {_Q} SELECT id, {_QUEUE} AS queue, {_STATE} AS new_state FROM q",
    "already_extracted": f"WITH {REG}, q AS (SELECT *, {_ext('source_path')} AS e, true AS there FROM reg), z AS (SELECT id, doc_id, CASE WHEN contains(tier, '重复') OR verdict = '去重' THEN NULL WHEN e IN ('.md', '.txt') THEN 'text' WHEN e = '.pdf' THEN 'pdf' WHEN e = '.docx' THEN 'docx' END AS queue, unnest(['plain', 'force', 'redo']) AS run FROM q) SELECT id, run, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN run = 'redo' THEN queue END WHEN doc_id % 4 < 2 AND run <> 'force' THEN NULL ELSE queue END AS queue FROM z",
    "queue_limit": f"WITH {REG}, {_Q.replace('doc_id % 11 <> 0', 'true')}, z AS (SELECT id, row_no, {_QUEUE} AS queue FROM q) SELECT id, queue FROM z WHERE queue IS NOT NULL ORDER BY row_no LIMIT 25",
    "extract_rollup": f"WITH {REG}, {_Q} SELECT coalesce({_QUEUE}, {_STATE}) AS status, count(*) AS n FROM q GROUP BY 1",
    "text_duplicates": f"WITH {REG}, m AS (SELECT id, first_value(id) OVER (PARTITION BY sha1 ORDER BY len(regexp_extract_all(file_name, '(?i)副本|拷贝|复件|copy|[（(][0-9]+[）)]|[ _\\-][0-9]+$')), id) AS keep_id FROM reg) SELECT keep_id, id AS dup_id FROM m WHERE id <> keep_id",
    "changed_content": f"WITH {REG} SELECT id, source_path FROM reg WHERE {OLD} AND doc_id % 6 = 0",
}
