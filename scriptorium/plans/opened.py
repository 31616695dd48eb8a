"""Queries of files that are opened: texts are packed as DOCX files, paragraph by paragraph, and read back."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import WS
from scriptorium.sources import files

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
#: Of every seven lines the properties of three; what some of every eleven lines are: in a table of contents that ends in the next line, behind a field's code.
_PROPS = {1: '<w:outlineLvl w:val="0"/>', 2: '<w:pStyle w:val="Heading 2"/>', 3: '<w:pStyle w:val="标题3"/><w:outlineLvl w:val="3"/>'}


def _mark(kind: str) -> str:
    return f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'


def _line(i: int, text: str) -> str:
    props = f"<w:pPr>{_PROPS[i % 7]}</w:pPr>" if i % 7 in _PROPS else ""
    parts = [f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in re.split("([\t\r])", _BAD.sub(" ", text))]
    parts[1::2] = ["<w:tab/>" if x == "\t" else "<w:cr/>" for x in re.findall("[\t\r]", text)]
    run = f"<w:r>{''.join(parts)}</w:r>"
    if i % 11 == 5:
        run = f"{_mark('begin')}<w:r><w:instrText> TOC x </w:instrText></w:r>{_mark('separate')}{run}"
    elif i % 11 == 6:
        run += _mark("end")
    elif i % 11 == 8:
        run = f"{_mark('begin')}<w:r><w:instrText>REF {i}</w:instrText></w:r>{_mark('separate')}{run}{_mark('end')}"
    return f"<w:p>{props}{run}</w:p>"


def packed(text: str) -> bytes:
    """A DOCX file of a text's lines."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("word/document.xml", "w") as f:
        f.write(f"<w:document {_W}><w:body>".encode())
        for i, line in enumerate(text.split("\n"), 1):
            f.write(_line(i, line).encode())
        f.write(b"</w:body></w:document>")
    return out.getvalue()


def docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents' texts that were DOCX files in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(doc_id, no, level, t, toc) for no, level, t, toc in files.docx_paragraphs(io.BytesIO(packed(text or "")))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=["doc_id", "no", "level", "text", "toc_dropped"])

    rows = docs.mapInArrow(run, "doc_id long, no int, level int, text string, toc_dropped boolean")
    return files.docx_lines(rows, para_numbers=True).filter("not toc_dropped").select("doc_id", F.col("no").alias("para"), "level", "line")


QUERIES = {"docx_paragraphs": docx_paragraphs}

#: The lines of a text as a DOCX file keeps them: without those of the table of contents, without what XML can't hold, stripped.
ORACLES = {
    "docx_paragraphs": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
 p AS (SELECT doc_id, i, regexp_replace(replace(regexp_replace(x, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{fffe}}\x{{ffff}}]', ' ', 'g'), chr(13), chr(10)), '\A[{WS}]+|[{WS}]+\z', '', 'g') AS t FROM l WHERE i % 11 NOT IN (5, 6)),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS para, CASE i % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS level FROM p WHERE t <> '')
 SELECT doc_id, CAST(para AS INTEGER) AS para, CAST(level AS INTEGER) AS level, CASE WHEN level > 0 THEN repeat('#', level) || ' ' ELSE '' END || '[¶' || para || '] ' || t AS line FROM n""",
}
