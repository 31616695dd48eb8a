import io
import zipfile

from scriptorium.sources import files
from scriptorium.sources.snapshots import Snapshots
from scriptorium.streaming.ingest import CELLS, append, ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def field(code, result):
    kind = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    return f"{kind('begin')}<w:r><w:instrText>{code}</w:instrText></w:r>{kind('separate')}<w:r><w:t>{result}</w:t></w:r>{kind('end')}"


def test_docx(spark, tmp_path):
    body = f'<w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:r><w:t>Title &amp; more</w:t></w:r></w:p><w:p>{field("TOC x", "1 a")}</w:p><w:p><w:pPr><w:pStyle w:val="2"/></w:pPr>{field("REF y", "seen")}</w:p>'
    (tmp_path / "a.docx").write_bytes(docx(body))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = [(r["level"], r["text"], r["toc_dropped"], r["line"]) for r in files.read_docx(spark, str(tmp_path)).orderBy("para").collect()]
    assert (1, "Title & more", False, "# Title & more") in rows and (0, "seen", False, "seen") in rows
    assert any(dropped for _, _, dropped, _ in rows) and not any("1 a" in t for _, t, _, _ in rows)


def test_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name in ("x/a.pdf", "x/b.PNG", "x/~$c.docx", "x/.d.md", ".hidden/e.md", "x/f.bin"):
        (tmp_path / name).write_text(name)
    assert sorted(r["file_name"] for r in files.scan_folder(spark, str(tmp_path)).collect()) == ["a.pdf", "b.PNG"]


def test_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿序号,文件名,自定\nL0001, a.pdf ,x\n\n,,\n", encoding="utf-8")
    rows = files.load_registry(spark, str(tmp_path / "r.csv")).collect()
    assert [(r["id"], r["file_name"], r["note"], r["自定"]) for r in rows] == [("L0001", "a.pdf", "", "x")]
    (tmp_path / "m.csv").write_text("作者,author,spl,?\nA,B,s,q\n", encoding="utf-8")
    table, unknown, again = files.load_matrix(spark, str(tmp_path / "m.csv"))
    assert table.select("author", "spl").collect()[0] == ("A", "s") and unknown == ["?"] and again == ["author"]


def test_snapshots_merge(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "reg"))
    schema = ", ".join(f"{c} string" for c in ["id", *CELLS])
    row = lambda i, note: tuple([i, f"{i}.pdf", "", "", "", i, i, "", "", "", note])
    base = store.save(spark.createDataFrame([row("L0001", ""), row("L0002", "")], schema), None, CELLS)
    store.save(spark.createDataFrame([row("L0001", "theirs"), row("L0002", "")], schema), base, CELLS)
    store.save(spark.createDataFrame([row("L0001", ""), row("L0002", "ours")], schema), base, CELLS)
    assert {r["id"]: r["note"] for r in store.load().collect()} == {"L0001": "theirs", "L0002": "ours"}


def test_ingestion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.pdf", "1"), ("b.pdf", "1"), ("c.pdf", "2")):
        (tmp_path / "in" / name).write_text(body)
    store = Snapshots(spark, str(tmp_path / "reg"))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "reg"), str(tmp_path / "cp")).awaitTermination(120)
    assert store.load().count() == 2
    (tmp_path / "in" / "d.pdf").write_text("3")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "reg"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["id"] for r in store.load().collect()) == ["L0001", "L0002", "L0003"]
    assert append(files.scan_folder(spark, str(tmp_path / "in")), store) == 0


def test_docx_text_box_and_fields():
    """A paragraph in a text box belongs to the one around it and comes again behind it; a table of contents may run over paragraphs."""
    kind = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    body = "<w:p><w:r><w:t>out </w:t><w:txbxContent><w:p><w:r><w:t>in</w:t></w:r></w:p></w:txbxContent><w:t> er</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t><w:br/><w:t>two</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body += f"<w:p>{kind('begin')}<w:r><w:instrText>TOC</w:instrText></w:r>{kind('separate')}<w:r><w:t>1 a</w:t></w:r></w:p><w:p><w:r><w:t>2 b</w:t></w:r>{kind('end')}<w:r><w:t>rest</w:t></w:r></w:p>"
    rows = [(n, text) for n, _, text, toc in files.docx_paragraphs(io.BytesIO(docx(body))) if not toc]
    assert rows == [(1, "out in er"), (2, "in"), (3, "cell\ntwo"), (4, "rest")]
    assert [t for _, _, t, _ in files.docx_paragraphs(io.BytesIO(docx(body)), True)][3:] == ["1 a", "2 brest"]


def test_docx_keeps_no_tree():
    """Elements go as they end: parsing ten times the paragraphs takes no more memory at once."""
    import tracemalloc

    def peak(n):
        content = docx("<w:p><w:r><w:t>some text here</w:t></w:r></w:p>" * n)
        tracemalloc.start()
        assert sum(1 for _ in files.docx_paragraphs(io.BytesIO(content))) == n
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    assert peak(40_000) < 1.5 * peak(4_000)


def test_files_of_any_size(spark, tmp_path, monkeypatch):
    """Beyond the two gigabytes that a binary value holds, and at chunks of any size."""
    import hashlib

    with open(tmp_path / "big.pdf", "wb") as f:
        f.truncate(2200 << 20)
    (tmp_path / "small.md").write_text("x" * 5000)
    whole = hashlib.sha1()
    for _ in range(2200):
        whole.update(bytes(1 << 20))
    got = {r["file_name"]: r["sha1"] for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"big.pdf": whole.hexdigest(), "small.md": hashlib.sha1(b"x" * 5000).hexdigest()}
    gone = files.listed(spark, str(tmp_path)).collect()
    (tmp_path / "small.md").unlink()
    left = files.hashed(spark.createDataFrame([r for r in gone if "small" in r["path"]], "path string, size long"))
    assert left.count() == 0


def test_batch_that_ends_before_it_is_noted(spark, tmp_path, monkeypatch):
    """Killed between its save and the stream's commit, a batch comes again with its number and is refused without reading a file."""
    from scriptorium.streaming import ingest as I

    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / "in" / name).write_text(name)
    where = [str(tmp_path / x) for x in ("in", "reg", "cp")]
    real, calls = I.append, []

    def killed(*args, **kw):
        calls.append(real(*args, **kw))
        raise RuntimeError("killed")

    monkeypatch.setattr(I, "append", killed)
    query = ingest(spark, *where)
    try:
        query.awaitTermination(120)
    except Exception:  # noqa: S110  the stream tells that its batch failed
        pass
    store = Snapshots(spark, where[1])
    before = store.version()
    assert calls == [2] and store.batches() == {where[2]: 0}
    monkeypatch.setattr(I, "append", lambda *args, **kw: calls.append("again") or real(*args, **kw))
    ingest(spark, *where).awaitTermination(120)
    assert calls == [2] and store.version() == before and store.load().count() == 2
    (tmp_path / "in" / "c.pdf").write_text("b.pdf")
    ingest(spark, *where).awaitTermination(120)  # nothing new in it, but it is noted too
    assert calls == [2, "again"] and store.batches() == {where[2]: 1} and store.version() == before
