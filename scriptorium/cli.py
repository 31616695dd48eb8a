"""Command line: init, scan, status, attach, extract, pages, docx, matrix, template, lint, compare, name. Exit codes are part of the contract.

0 nothing to do or all well, 1 an error or findings, 2 OCR needed or wrong usage, 3 rows were added.
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.session import cut
from scriptorium.operators import lint as L
from scriptorium.operators import pages as P
from scriptorium.operators import registry as R
from scriptorium.operators import reports
from scriptorium.sources import files
from scriptorium.sources.snapshots import Snapshots
from scriptorium.streaming.ingest import CELLS, SCHEMA, append, old_ids

#: The columns of an evidence matrix, in order.
TEMPLATE = ("编号", "作者", "年份", "标题", "来源", "现有文献综述", "作者对现有文献的批评", "现有文献研究空白", "理论依据（研究的必要性）", "作者要做什么", "研究结果（作者发现了什么）", "与现有文献观点一致的研究发现", "与现有文献观点相反的研究发现", "作者实际做了什么", "作者对未来研究的建议", "批评点", "待探讨的相关问题", "明显的遗漏点", "逻辑能否走通（能否自圆其说）", "主题分类", "一句话定位")
EXTRA = [c for c in R.COLUMNS if c not in ("id", *CELLS)]


def _whole(df):
    """df with every column of a registry."""
    blank = lambda c: F.lit(None).cast("int") if c in ("n_pages", "n_chars") else F.lit("")
    return df.select("*", *(blank(c).alias(c) for c in R.COLUMNS if c not in df.columns))


def init(spark, a) -> int:
    store = Snapshots(spark, a.registry)
    if store.version() and not a.force:
        print("the registry exists; --force replaces it", file=sys.stderr)
        return 1
    if store.version():
        store.keep_ids(_whole(store.load()))
    store.replace(spark.createDataFrame([], SCHEMA))
    return 0


def _report(spark, path: str, lines: list[str]) -> None:
    """A short Markdown file, written in place of an older one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, True)
    out.write(bytearray("\n".join([*lines, ""]).encode()))
    out.close()


def scan(spark, a) -> int:
    store = Snapshots(spark, a.registry)
    there = [s for s in a.source if files.exists(spark, s)]
    for s in a.source:
        if s not in there:
            print(f"no such source, left out: {s}", file=sys.stderr)
    each = [files.scan_folder(spark, s, tuple(e.lower() for e in a.ext) if a.ext else files.EXTENSIONS) for s in there]
    found = reduce(DataFrame.unionByName, each, spark.createDataFrame([], "source_path string, file_name string, sha1 string"))
    found = found.dropDuplicates(["source_path"])
    if a.dry_run:
        base = store.load()
        old = (base if base is not None else spark.createDataFrame([], SCHEMA)).withColumn("row_no", F.lit(0))
        n = R.scan(found, old, old_ids(store), a.record_duplicates).count()
    else:
        before = store.version()
        n = append(found, store, a.record_duplicates)
        if a.report:
            rows = store.load() if n else spark.createDataFrame([], SCHEMA)
            added = rows.join(store.load(before).select("id"), "id", "left_anti") if before and n else rows
            listed = added.orderBy("id").limit(reports.SHOWN).collect()
            same = added.filter(F.contains(T.or_blank(F.col("note")), F.lit("same title as"))).count()
            lines = ["# Scan", "", f"- files: {found.count()}", f"- added: {n}", f"- same title, other content: {same}", ""]
            lines += ["| id | file | type | note |", "|---|---|---|---|", *(f"| {r['id']} | {r['file_name']} | {r['source_type']} | {r['note']} |" for r in listed)]
            _report(spark, a.report, [*lines, *([f"... {n - len(listed)} more"] if n > len(listed) else [])])
    print(f"added {n}")
    return 3 if n else 0


def status(spark, a) -> int:
    registry = Snapshots(spark, a.registry).load()
    if registry is None or registry.isEmpty():
        print("the registry has no rows; scan first", file=sys.stderr)
        return 1
    print("\n".join(reports.status(_whole(registry).withColumn("row_no", R.number_of(F.col("id"))))))
    return 0


def attach(spark, a) -> int:
    store = Snapshots(spark, a.registry)
    version = store.version()
    registry = _whole(store.load())
    own = registry.filter((F.col("id") == a.key) | (F.col("file_name") == a.key)).select("id")
    text = spark.read.text(a.text, wholetext=True).select(F.lit(a.text).alias("text_path"), F.col("value").alias("text"))
    rows = own.crossJoin(F.broadcast(text)).filter(T.nonspace_len(F.col("text")) >= 10)  # one text
    if rows.isEmpty():
        print("no such row, or hardly any text", file=sys.stderr)
        return 1
    done = R.attach(registry, rows)
    done = done.withColumn("note", F.when((F.col("id") == own.first()["id"]) & F.lit(bool(a.note)), T.append_note(F.col("note"), F.lit(a.note or ""))).otherwise(F.col("note")))
    store.save(done.select("id", *CELLS, *(c for c in EXTRA if c in done.columns)), version, CELLS)
    return 0


def _bodies(rows, a):
    """(id, status, body, message) of files from the rows that they gave."""
    broken = rows.filter("level < 0").groupBy("id").agg(F.first("text").alias("message")).select("id", F.lit("打不开").alias("status"), F.lit("").alias("body"), "message")
    good = rows.join(broken.select("id"), "id", "left_anti")
    lines = files.docx_lines(good.filter("kind <> 'pdf'"), a.docx_para_numbers)
    line = F.when(F.col("kind") == "docx", F.col("line")).otherwise(F.col("text"))
    text = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))).alias("x")).select("id", F.lit("ok").alias("status"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("body"), F.lit("").alias("message"))
    pages = good.filter("kind = 'pdf'").select(F.col("id").alias("doc_id"), F.col("no").alias("page_no"), F.col("text").alias("raw"), "needs_pass", "repaired")
    state = P.triage(pages, F.col("needs_pass"), F.col("repaired")).select("doc_id", "status")
    books = P.assemble(pages, a.printed_labels).join(state, "doc_id").select(F.col("doc_id").alias("id"), "status", F.col("content").alias("body"), F.lit("").alias("message"))
    return broken.unionByName(text).unionByName(books)


def extract(spark, a) -> int:
    """Texts of text, DOCX and (where the library is there) PDF files into a folder, paths and states into the registry, a report beside the texts."""
    store = Snapshots(spark, a.registry)
    base = store.version()
    registry = _whole(store.load()).withColumn("row_no", R.number_of(F.col("id")))
    rows = files.sized(registry, "source_path", "text_path")
    queue = R.extract_queue(rows, F.col("source_path_size").isNotNull(), F.col("text_path_size").isNotNull(), a.force, a.redo_ocr)
    queue = cut(queue.drop("text_path_size"))
    for r in queue.groupBy(F.coalesce("queue", "new_state").alias("status")).count().orderBy("status").collect():
        print(r["status"], r["count"])
    images = queue.filter("new_state = '需OCR' and state <> new_state").count()
    if a.dry_run:
        return 2 if images else 0
    todo = queue.filter("queue is not null").orderBy("row_no")
    todo = cut(todo.limit(a.limit) if a.limit else todo)
    if importlib.util.find_spec("fitz") is None and not todo.filter("queue = 'pdf'").isEmpty():
        print("no PDF library: PDF files stay in the queue", file=sys.stderr)
        todo = todo.filter("queue <> 'pdf'")
    bodies = _bodies(cut(files.read_files(files.dealt(todo, "source_path_size").select("id", F.col("source_path").alias("path"), F.col("queue").alias("kind")))), a)
    mine = cut(todo.select("id", "file_name", F.col("source_path").alias("path")).join(bodies, "id"))
    head = F.concat(F.lit("# "), "id", F.lit(" "), "file_name", F.lit("\n\n"))
    named = mine.filter("status = 'ok'").select("id", F.concat("id", F.lit("_"), T.safe_filename(T.stem(F.col("path"))), F.lit(".txt")).alias("name"), F.concat(head, "body").alias("body"))
    paths = cut(files.write_texts(named, a.outdir))
    results = mine.select("id", "status", "message", F.length("body").alias("_chars")).join(paths, "id", "left")
    done = R.backfill(queue.withColumn("state", F.col("new_state")).drop("queue", "new_state", "source_path_size"), results)
    notes = results.filter("message <> ''").select("id", F.col("message").alias("_note"))
    done = done.join(notes, "id", "left").withColumn("note", F.when(F.col("_note").isNotNull(), T.append_note(F.col("note"), F.col("_note"))).otherwise(F.col("note"))).drop("_note")
    store.save(cut(done.select("id", *CELLS, *(c for c in EXTRA if c in done.columns))), base, [*CELLS, *(c for c in EXTRA if c in done.columns)])
    counts = {r["status"]: r["count"] for r in results.groupBy("status").count().collect()}
    same = R.text_duplicates(mine.filter("status = 'ok'")) if not a.no_dup_check else None
    n_same = same.count() if same is not None else 0
    pairs = same.orderBy("keep_id", "dup_id").limit(reports.SHOWN).collect() if n_same else []
    lines = ["# Extraction", "", f"- files: {todo.count()}", f"- ok: {counts.get('ok', 0)}", f"- OCR needed: {counts.get('需OCR', 0) + images} (images: {images})", f"- not opened: {counts.get('打不开', 0)}", f"- equal texts: {n_same}", ""]
    lines += [f"- {r['keep_id']} stays, {r['dup_id']} is the same text" for r in pairs] + ([f"- ... {n_same - len(pairs)} more"] if n_same > len(pairs) else []) + [f"- {r['id']}: {r['_note']}" for r in notes.orderBy("id").limit(reports.SHOWN).collect()]
    _report(spark, a.report or f"{a.outdir.rstrip('/')}/_report.md", lines)
    return 2 if counts.get("需OCR", 0) + images else 0


def pages(spark, a) -> int:
    """Cleaned pages of a table of pages (doc_id, page_no, raw) or of the PDF files of a folder; --pages-only prints their numbers."""
    table = spark.read.parquet(a.pages) if a.pages else files.read_pdf(spark, a.source)
    table = table.filter(F.col("page_no").between(a.start, a.end)) if a.end else table
    if a.pages_only:
        for r in table.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.nonspace_len(F.col("raw")) == 0).alias("empty")).orderBy("doc_id").toLocalIterator():
            print(r["doc_id"], r["n"], "empty", r["empty"])
        return 0
    flags = [F.col(c) if c in table.columns else F.lit(False) for c in ("needs_pass", "repaired")]
    if not P.triage(table, *flags).filter("status <> 'ok'").isEmpty():
        return 2
    P.assemble(table).write.mode("overwrite").parquet(a.out)
    return 0


def docx(spark, a) -> int:
    """Texts of the DOCX files below a folder into text files."""
    rows = files.read_docx(spark, a.source, a.keep_toc, a.para_numbers, a.heading_from_numbering)
    each = cut(rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("para", "level", "line", "text"))).alias("x")))
    broken = F.element_at("x", 1)["level"] < 0
    text = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    files.write_texts(each.filter(~broken).select(F.col("path").alias("id"), F.concat(T.safe_filename(T.stem(F.col("path"))), F.lit(".txt")).alias("name"), text.alias("body")), a.out).count()
    bad = each.filter(broken).select("path", F.element_at("x", 1)["text"].alias("why")).collect()
    for r in bad:
        print(r["path"], r["why"], file=sys.stderr)
    return 1 if bad else 0


def template(spark, a) -> int:
    """An empty evidence matrix with its columns."""
    _report(spark, a.path, ["\ufeff" + ",".join(TEMPLATE)])
    return 0


def matrix(spark, a) -> int:
    rows, unknown, again = files.load_matrix(spark, a.matrix)
    words = lambda p: tuple(r["word"] for r in files.read_words(spark, p).collect()) if p else ()
    from scriptorium.operators.topics import STOPWORDS

    problems, report = reports.matrix(rows, unknown, again, stopwords=(*STOPWORDS, *words(a.stopwords)), keep=words(a.keep))
    print("\n".join(problems if a.check_only else [*problems, *report]))
    return 1 if problems else 0


def lint(spark, a) -> int:
    docs = files.read_texts(spark, a.path).select("path", F.col("body").alias("text"))
    found = L.findings(docs, tuple(a.skip), tuple(a.allow_abbr), None if a.form == "auto" else a.form, a.min, a.max).cache()
    try:
        total = L.rollup(found, a.strict).first()
        if a.json:
            for r in found.groupBy("path").agg(F.to_json(F.collect_list(F.struct("rule", "severity", "n"))).alias("j")).toLocalIterator():
                print(json.dumps({"file": r["path"], "findings": json.loads(r["j"])}, ensure_ascii=False))
        else:
            for r in found.orderBy("path", "rule").toLocalIterator():
                print(r["path"], r["severity"], r["rule"], r["n"])
        return 1 if total["failed"] else 0
    finally:
        found.unpersist()


def compare(spark, a) -> int:
    cards = files.read_texts(spark, a.path).select(F.col("path").alias("card"), F.col("body").alias("text"))
    if cards.count() < 2:
        print("two cards at least", file=sys.stderr)
        return 2
    agreed, matched = reports.compare(cards, a.overlap)
    if a.json:
        values = reports.card_values(cards).groupBy("card").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))).alias("j"))
        for r in values.orderBy("card").toLocalIterator():
            print(json.dumps({"card": r["card"], "values": json.loads(r["j"])}, ensure_ascii=False))
        return 0
    rows = agreed.orderBy("field").collect()
    for r in rows:
        print(r["field"], "same" if r["agree"] else f"{r['n_values']} values", "hard" if r["hard"] else "soft")
    print("items matched", matched.count())
    return 1 if any(r["hard"] and not r["agree"] for r in rows) else 0


def name(spark, a) -> int:
    if a.form not in T.FORM_SUFFIX:
        print(f"forms: {', '.join(T.FORM_SUFFIX)}", file=sys.stderr)
        return 2
    df = spark.createDataFrame([(a.title, a.author)], "t string, a string")
    print(df.select(T.output_name(F.col("t"), F.col("a"), F.lit(a.form), F.lit(a.part or ""))).first()[0])
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scriptorium")
    sub = p.add_subparsers(required=True)

    def command(function, *options):
        c = sub.add_parser(function.__name__)
        for names, kw in options:
            c.add_argument(*names.split(), **kw)
        c.set_defaults(run=function)

    flag, reg = {"action": "store_true"}, ("--registry", {"required": True})
    command(init, reg, ("--force", flag))
    command(scan, reg, ("--source", {"nargs": "+", "required": True}), ("--ext", {"nargs": "*"}), ("--record-duplicates", flag), ("--dry-run", flag), ("--report", {}))
    command(status, reg)
    command(attach, reg, ("key", {}), ("--text", {"required": True}), ("--note", {}))
    command(extract, reg, ("--outdir", {"required": True}), ("--limit", {"type": int}), ("--dry-run", flag), ("--force", flag), ("--redo-ocr", flag), ("--docx-para-numbers", flag), ("--printed-labels", flag), ("--no-dup-check", flag), ("--report", {}))
    command(pages, ("--pages", {}), ("--source", {}), ("--out", {}), ("--start", {"type": int, "default": 1}), ("--end", {"type": int}), ("--pages-only", flag))
    command(docx, ("--source", {"required": True}), ("--out", {"required": True}), ("--keep-toc", flag), ("--para-numbers", flag), ("--heading-from-numbering", flag))
    command(template, ("path", {}))
    command(matrix, ("matrix", {}), ("--check-only", flag), ("--stopwords", {}), ("--keep", {}))
    command(lint, ("path", {}), ("--skip", {"nargs": "*", "default": []}), ("--allow-abbr", {"nargs": "*", "default": []}), ("--strict", flag), ("--json", flag), ("--form", {"default": "auto", "choices": ["auto", *L.FORM_RANGES]}), ("--min", {"type": int}), ("--max", {"type": int}))
    command(compare, ("path", {}), ("--json", flag), ("--overlap", {"type": float, "default": 0.34}))
    command(name, ("--title", {"required": True}), ("--author", {"default": ""}), ("--form", {"default": "A"}), ("--part", {}))
    a = p.parse_args(argv)
    return a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
