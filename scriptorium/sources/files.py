"""Files as tables: scans of folders, registry and matrix CSVs, text and DOCX bodies, pages of PDFs."""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from scriptorium.functions import text as T
from scriptorium.operators.matrix import resolve
from scriptorium.operators.registry import COLUMNS

#: What a scan takes, and header names that a registry's columns go by besides their own.
EXTENSIONS = (".pdf", ".docx", ".doc", ".md", ".txt", ".pptx", ".xlsx", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp")
HEADERS = {"序号": "编号", "no": "编号", "id": "编号", "作者": "第一作者", "题名": "标题", "题目": "标题", "篇名": "标题", "路径": "源路径", "文件路径": "源路径", "绝对路径": "源路径", "txt路径": "文本路径", "提取路径": "文本路径", "主题": "主题分类", "分类": "主题分类", "判定": "纳入判定", "相关性": "相关度", "状态": "解码状态", "处理状态": "解码状态", "产出": "产出文件", "输出文件": "产出文件"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: Bytes of a file that a task holds at a time when it only hashes it; bytes of files that a task reads.
CHUNK, TASK_BYTES = 1 << 20, 128 << 20


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def listed(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path and size of the files below folder (or of one file), without hidden files and folders and lock files. Spark lists them; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    name = T.basename(F.col("path"))
    below = F.replace(F.regexp_replace("path", r"\A\w+:/*", "/"), F.lit("/" + folder.split(":", 1)[-1].strip("/")), F.lit(""))
    return files.filter(T.extension(F.col("path")).isin(*extensions) & ~name.startswith("~$") & ~below.rlike(r"/\."))


@cache
def _store(root: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(root)[0] if root else pafs.LocalFileSystem()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return _store(""), "/" + path[5:].lstrip("/") if path.startswith("file:") else os.path.abspath(path)
    scheme, _, rest = path.partition("://")
    host, _, below = rest.partition("/")
    return _store(f"{scheme}://{host}/"), f"/{below}" if "hdfs" in scheme else f"{host}/{below}"


def dealt(files: DataFrame, size: str = "size") -> DataFrame:
    """files over as many tasks as their bytes need, one for TASK_BYTES."""
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return files.repartition(max(1, min(n, -(-total // TASK_BYTES))))


def sized(df: DataFrame, *columns: str) -> DataFrame:
    """df with the size of the file that each of these columns names, as <column>_size; null where there is none. Tasks look, whatever the folders are."""
    schema = T_.StructType([*df.schema.fields, *(T_.StructField(f"{c}_size", T_.LongType()) for c in columns)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for c in columns:
                found = []
                for path in batch.column(batch.schema.get_field_index(c)).to_pylist():
                    info = None
                    if path:
                        fs, at = opened(path)
                        info = fs.get_file_info(at)
                    found.append(info.size if info is not None and info.type == pafs.FileType.File else None)
                more.append(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return df.mapInArrow(look, schema)


def hashed(files: DataFrame) -> DataFrame:
    """files (path, size) with sha1, read CHUNK bytes at a time, so a file may be of any size. A file that has gone since it was listed is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sums = [], []
            for path in batch.column(0).to_pylist():
                fs, at = opened(path)
                digest = hashlib.sha1()
                try:
                    with fs.open_input_stream(at) as f:
                        while chunk := f.read(CHUNK):
                            digest.update(chunk)
                except FileNotFoundError:
                    continue
                paths.append(path)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sums, pa.string())], names=["path", "sha1"])

    return dealt(files).select("path").mapInArrow(run, "path string, sha1 string")


def scan_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """source_path, file_name, sha1 of the files below folder, without hidden files and folders and lock files."""
    return hashed(listed(spark, folder, extensions)).select(F.col("path").alias("source_path"), T.basename(F.col("path")).alias("file_name"), "sha1")


def read_csv(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header and rows (row_no, cells as an array of stripped strings, blank where missing) of a CSV whatever its header is; a BOM goes, blank rows go."""
    raw = spark.read.option("multiLine", "true").option("header", "false").option("quote", '"').option("escape", '"').csv(path)
    cells = F.array(*(T.strip(F.regexp_replace(T.or_blank(F.col(c)), "\ufeff", "")) for c in raw.columns))
    rows = raw.select(F.monotonically_increasing_id().alias("row_no"), cells.alias("cells"))
    first = rows.orderBy("row_no").limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no header")
    body = rows.filter((F.col("row_no") > first[0]["row_no"]) & F.exists("cells", lambda c: c != ""))
    return [h for h in first[0]["cells"]], body


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry CSV with English column names; columns by their names or known others, missing ones blank, unknown ones kept."""
    header, rows = read_csv(spark, path)
    own, at, extra = {v: k for k, v in COLUMNS.items()}, {}, {}
    for i, h in enumerate(header):
        k = own.get(HEADERS.get(h.lower(), h), own.get(h))
        if k is None:
            extra.setdefault(h or f"column_{i}", i)
        else:
            at.setdefault(k, i)
    cell = lambda i: T.or_blank(F.get("cells", F.lit(i)))
    return rows.select("row_no", *((cell(at[k]) if k in at else F.lit("")).alias(k) for k in COLUMNS), *(cell(i).alias(h) for h, i in extra.items()))


def save_registry(registry: DataFrame, path: str) -> None:
    """A registry as one CSV folder with its own column names, in order; for exchange, not for storage."""
    named = registry.select(*(T.or_blank(F.col(k).cast("string")).alias(v) for k, v in COLUMNS.items()), *(c for c in registry.columns if c not in COLUMNS and c != "row_no"))
    named.coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """An evidence matrix CSV: rows under canonical column names (the first of two that share one), unknown headers, repeated ones."""
    header, rows = read_csv(spark, path)
    at, unknown, again = resolve(header)
    return rows.select("row_no", *(T.or_blank(F.get("cells", F.lit(i))).alias(k) for k, i in at.items())), unknown, again


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a list file, one on a line; # begins a comment."""
    return spark.read.text(path).select(T.strip(F.regexp_replace("value", "#.*", "")).alias("word")).filter("word <> ''").distinct()


#: What a file gives: one row of a text, a row for each paragraph or page; a file that can't be opened one row of no 0, level -1 and the reason as text.
ROWS = "id string, kind string, no int, level int, text string, toc_dropped boolean, needs_pass boolean, repaired boolean"
#: Rows that go to Spark together.
BATCH = 256


class Seekable(io.RawIOBase):
    """A file of a store that fails as files do when sought outside, which the archive reader relies on."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, to: int, whence: int = 0) -> int:
        try:
            return self.file.seek(to, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def readinto(self, into) -> int:
        return self.file.readinto(into)


def read_files(files: DataFrame, keep_toc: bool = False) -> DataFrame:
    """ROWS of files (id, path, kind: text, docx or pdf), each opened by a task by its own path, in order of no."""
    def rows(id_: str, path: str, kind: str) -> Iterator[tuple]:
        try:
            fs, at = opened(path)
            if kind == "text":
                with fs.open_input_stream(at) as f:
                    yield id_, kind, 1, 0, f.read().decode("utf-8", "replace"), False, False, False
            elif kind == "docx":
                with fs.open_input_file(at) as f:
                    empty = True
                    for no, level, text, toc in docx_paragraphs(io.BufferedReader(Seekable(f)), keep_toc):
                        empty = empty and toc
                        yield id_, kind, no, level, text, toc, False, False
                    if empty:
                        yield id_, kind, 0, -1, "no text in the document", False, False, False
            else:
                with fs.open_input_stream(at) as f:
                    for no, text, locked, repaired, error in pdf_pages(f.read()):
                        yield id_, kind, no, -1 if error else 0, error or text, False, locked, repaired
        except OSError as e:
            yield id_, kind, 0, -1, f"{type(e).__name__}: {e}", False, False, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = (r for file in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(*file))
            while some := list(islice(every, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _TYPES, strict=True)], names=_NAMES)

    return files.select("id", "path", "kind").mapInArrow(run, ROWS)


_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]


def _folder(spark: SparkSession, folder: str, kind: str, *extensions: str) -> DataFrame:
    return dealt(listed(spark, folder, extensions)).select(F.col("path").alias("id"), "path", F.lit(kind).alias("kind"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and body of plain text files; bytes that are no UTF-8 become replacement characters."""
    return read_files(_folder(spark, folder, "text", ".md", ".txt")).filter("level = 0").select(F.col("id").alias("path"), F.col("text").alias("body"))


def _level(p: ET.Element) -> int:
    """A paragraph's heading level: its outline level, else its style's number; 0 for text."""
    props = p.find(f"{_W}pPr")
    if props is None:
        return 0
    outline = props.find(f"{_W}outlineLvl")
    if outline is not None and (outline.get(f"{_W}val") or "").isdigit():
        return int(outline.get(f"{_W}val")) + 1
    style = props.find(f"{_W}pStyle")
    name = ((style.get(f"{_W}val") or "") if style is not None else "").strip().lower()
    for prefix in ("heading", "head", "标题"):
        rest = name.removeprefix(prefix).strip()
        if rest != name and len(rest) == 1 and rest.isdigit():
            return int(rest)
    return 0


def docx_paragraphs(file, keep_toc: bool = False) -> Iterator[tuple[int, int, str, bool]]:
    """(number, level, text, toc) of paragraphs with text. Field codes are no text; the result of a TOC field is left out unless wanted. A file that can't be opened ends with a row of number 0, level -1 and the reason.

    The archive's member is parsed as it is read, and every element goes when it has ended outside a paragraph: memory is that of
    one paragraph. Paragraphs inside another one (in a text box) come behind it, and their text is part of its text too.
    """
    try:
        with zipfile.ZipFile(file) as z, z.open("word/document.xml") as member:
            yield from _paragraphs(ET.iterparse(member, ("start", "end")), keep_toc)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        yield 0, -1, f"{type(e).__name__}: {e}", False


def _paragraphs(events: Iterator[tuple[str, ET.Element]], keep_toc: bool) -> Iterator[tuple[int, int, str, bool]]:
    fields: list[list[bool]] = []  # of open fields: whether it is a table of contents, whether its result has begun
    path: list[ET.Element] = []
    open_: list[tuple[list[str], list[bool], int]] = []  # of paragraphs: parts, whether some were left out, place among those begun
    begun: list[tuple[str, int, bool] | None] = []  # paragraphs of the outermost open one, in order of their begin
    n = 0
    for event, x in events:
        kind = x.tag.removeprefix(_W)
        if event == "start":
            path.append(x)
            if kind == "p":
                open_.append(([], [], len(begun)))
                begun.append(None)
            continue
        path.pop()
        if kind == "fldChar":
            state = x.get(f"{_W}fldCharType")
            if state == "begin":
                fields.append([False, False])
            elif state == "separate" and fields:
                fields[-1][1] = True
            elif state == "end" and fields:
                fields.pop()
        elif kind == "instrText":
            if fields and not fields[-1][1] and (x.text or "").strip().upper().startswith("TOC"):
                fields[-1][0] = True
        elif kind in ("t", "tab", "br", "cr"):
            left_out = any(toc for toc, _ in fields) and not keep_toc
            for parts, skipped, _ in open_:
                (skipped if left_out else parts).append((x.text or "") if kind == "t" else "\t" if kind == "tab" else "\n")
        elif kind == "p":
            parts, skipped, at = open_.pop()
            begun[at] = ("".join(parts).strip(), _level(x), bool(skipped))
            if not open_:
                for text, level, gone in begun:
                    if text:
                        n += 1
                        yield n, level, text, False
                    elif gone:
                        yield n, 0, "", True
                begun.clear()
        if not open_ and path:
            path[-1].remove(x)


def read_docx(spark: SparkSession, folder: str, keep_toc: bool = False, para_numbers: bool = False, heading_from_numbering: bool = False) -> DataFrame:
    """path, para, level, text, toc_dropped, line of the DOCX files below a folder, or of one file; see docx_lines()."""
    rows = read_files(_folder(spark, folder, "docx", ".docx"), keep_toc)
    return docx_lines(rows, para_numbers, heading_from_numbering).select(F.col("id").alias("path"), F.col("no").alias("para"), "level", "text", "toc_dropped", "line")


def docx_lines(rows: DataFrame, para_numbers: bool = False, heading_from_numbering: bool = False) -> DataFrame:
    """Paragraphs (no, level, text, ...) with line: # marks for headings, and with para_numbers the paragraph's number before its text; none for a file that can't be opened."""
    if heading_from_numbering:
        rows = rows.withColumn("level", F.when((F.col("level") == 0) & (F.col("text") != ""), T.numbered_level(F.col("text"))).otherwise(F.col("level")))
    mark = F.when(F.lit(para_numbers) & (F.col("text") != ""), F.concat(F.lit("[¶"), "no", F.lit("] "))).otherwise("")
    return rows.withColumn("line", F.when(F.col("level") >= 0, T.heading_render(F.col("level"), F.concat(mark, "text"))))


def pdf_pages(content: bytes) -> list[tuple[int, str, bool, bool, str | None]]:
    """(number, text, locked, repaired, error) of a PDF file's pages; needs the optional PDF library. A file that can't be opened is one row of page 0 with the reason as error."""
    import fitz

    try:
        with fitz.open(stream=content, filetype="pdf") as doc:
            locked, repaired = bool(doc.needs_pass), bool(doc.is_repaired)
            return [(i + 1, doc[i].get_text(), locked, repaired, None) for i in range(0 if locked else doc.page_count)] or [(1, "", locked, repaired, None)]
    except (RuntimeError, ValueError) as e:  # the library's own errors are RuntimeErrors
        return [(0, "", False, False, f"{type(e).__name__}: {e}")]


def read_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the path), page_no, raw, needs_pass, repaired, error of the pages of the PDF files below a folder; needs the optional PDF library on the workers."""
    rows = read_files(_folder(spark, folder, "pdf", ".pdf"))
    broken = F.col("level") < 0
    return rows.select(F.col("id").alias("doc_id"), F.col("no").alias("page_no"), F.when(broken, "").otherwise(F.col("text")).alias("raw"), "needs_pass", "repaired", F.when(broken, F.col("text")).alias("error"))


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Writes rows (id, name, body) as text files below a folder, in the tasks; returns (id, path). A file is moved into place whole, so a repeated task does no harm."""
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for name, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = f"{root}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write((body or "").encode())
                fs.move(own, f"{root}/{name}")
                paths.append(f"{folder.rstrip('/')}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["id", "path"])

    return texts.select("id", "name", "body").mapInArrow(write, "id string, path string")
