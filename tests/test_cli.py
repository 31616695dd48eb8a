import pytest
from test_sources import docx

from scriptorium.cli import main
from scriptorium.sources.snapshots import Snapshots, Taken


def test_registry_commands(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, body in (("a.md", "text of a document\n"), ("b.md", "text of a document\n"), ("c.png", "x")):
        (tmp_path / "in" / n).write_text(body)
    reg, src = ["--registry", str(tmp_path / "reg")], ["--source", str(tmp_path / "in")]
    assert main(["init", *reg]) == 0 and main(["init", *reg]) == 1
    assert main(["status", *reg]) == 1
    assert main(["scan", *reg, *src, "--dry-run"]) == 3
    assert main(["scan", *reg, *src]) == 3 and main(["scan", *reg, *src, "--ext", ".png"]) == 0
    assert main(["status", *reg]) == 0
    assert main(["extract", *reg, "--outdir", str(tmp_path / "out")]) == 2
    made = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("L")]
    assert [p.read_text() for p in made] == ["# L0001 a.md\n\ntext of a document\n"]
    (tmp_path / "ocr.txt").write_text("recognised text of the picture")
    assert main(["attach", *reg, "c.png", "--text", str(tmp_path / "ocr.txt"), "--note", "seen"]) == 0
    assert main(["attach", *reg, "none", "--text", str(tmp_path / "ocr.txt")]) == 1


def test_document_commands(spark, tmp_path, capsys):
    (tmp_path / "m.csv").write_text("作者,年份,spl,rof\nA,2020,课堂互动与教师,课堂互动\nB,2021,课堂互动,课堂互动模式\n", encoding="utf-8")
    assert main(["matrix", str(tmp_path / "m.csv")]) == 0 and "课堂互动" in capsys.readouterr().out
    for n, tier in (("x", "T1"), ("y", "T2")):
        (tmp_path / n).mkdir()
        (tmp_path / n / "c.md").write_text(f"档位：{tier}\n| 批评点 | 样本过小 |\n", encoding="utf-8")
    assert main(["compare", str(tmp_path)]) == 1
    assert main(["compare", str(tmp_path / "x")]) == 2
    assert main(["lint", str(tmp_path / "x"), "--json"]) in (0, 1)
    assert main(["name", "--title", "深度学习：x", "--author", "王明"]) == 0 and "深度学习_x_王明-导读.md" in capsys.readouterr().out
    assert main(["name", "--title", "x", "--form", "nope"]) == 2
    with pytest.raises(ValueError, match="unknown rules"):
        main(["lint", str(tmp_path / "x"), "--skip", "nope"])


def registry(spark, tmp_path):
    return {r["file_name"]: r for r in Snapshots(spark, str(tmp_path / "reg")).load().collect()}


def test_extraction_completes(spark, tmp_path, capsys):
    """Texts and states reach the registry; a second run leaves texts alone unless forced; what can't be opened is told."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("first text\n")
    (tmp_path / "in" / "b.txt").write_text("first text\n")
    (tmp_path / "in" / "c.docx").write_bytes(docx("<w:p><w:r><w:t>Para one</w:t></w:r></w:p>"))
    (tmp_path / "in" / "broken.docx").write_bytes(b"no archive")
    reg, out = ["--registry", str(tmp_path / "reg")], ["--outdir", str(tmp_path / "out")]
    assert main(["init", *reg]) == 0 and main(["scan", *reg, "--source", str(tmp_path / "in"), "--report", str(tmp_path / "scan.md"), "--record-duplicates"]) == 3
    assert "- added: 4" in (tmp_path / "scan.md").read_text()
    assert main(["extract", *reg, *out, "--docx-para-numbers"]) == 0
    rows = registry(spark, tmp_path)
    assert [rows[n]["state"] for n in ("a.md", "c.docx", "broken.docx")] == ["已抽文本", "已抽文本", "打不开"] and "BadZipFile" in rows["broken.docx"]["note"]
    text = next((tmp_path / "out").glob("*_c.txt"))
    assert "[¶1] Para one" in text.read_text() and rows["broken.docx"]["text_path"] == "" and "- not opened: 1" in (tmp_path / "out" / "_report.md").read_text()
    text.write_text("corrected by hand")
    assert main(["extract", *reg, *out]) == 0 and text.read_text() == "corrected by hand"
    assert main(["extract", *reg, *out, "--force"]) == 0 and "Para one" in text.read_text()


def test_ids_are_inherited(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "bcd":
        (tmp_path / "in" / f"{n}.md").write_text(f"text {n}\n")
    reg, src = ["--registry", str(tmp_path / "reg")], ["--source", str(tmp_path / "in")]
    assert main(["init", *reg]) == 0 and main(["scan", *reg, *src]) == 3
    before = {n: r["id"] for n, r in registry(spark, tmp_path).items()}
    (tmp_path / "in" / "a.md").write_text("text a\n")
    (tmp_path / "in" / "d.md").rename(tmp_path / "in" / "renamed.md")
    assert main(["init", *reg, "--force"]) == 0 and main(["scan", *reg, *src]) == 3
    after = {n: r["id"] for n, r in registry(spark, tmp_path).items()}
    assert (after["b.md"], after["c.md"], after["renamed.md"], after["a.md"]) == (before["b.md"], before["c.md"], before["d.md"], "L0004")


def test_two_writers(spark, tmp_path, monkeypatch):
    """A save that another one overtakes is merged with it and comes next; no save is lost."""
    store = Snapshots(spark, str(tmp_path / "reg"))
    table = lambda **cells: spark.createDataFrame([("L0001", "a", "s", cells.get("tier", "x"), cells.get("note", ""))], "id string, file_name string, sha1 string, tier string, note string")
    base, cells = store.replace(table()), ["file_name", "sha1", "tier", "note"]
    real, other = Snapshots.replace, []

    def overtaken(self, t, after=None):
        if not other:
            other.append(real(self, table(note="theirs")))
        return real(self, t, after)

    monkeypatch.setattr(Snapshots, "replace", overtaken)
    store.save(table(tier="ours"), base, cells)
    r = store.load().first()
    assert (r["tier"], r["note"]) == ("ours", "theirs")
    with pytest.raises(Taken):
        real(store, table(), 0)


def test_options(spark, tmp_path, capsys):
    (tmp_path / "c.md").write_text("档位：T1\n| 批评点 | 样本过小 |\n", encoding="utf-8")
    (tmp_path / "d.md").write_text("档位：T1\n| 批评点 | 样本过小，且更长 |\n按章节名", encoding="utf-8")
    assert main(["compare", str(tmp_path)]) == 1 and main(["compare", str(tmp_path), "--json"]) == 0  # the basis is hard, the length soft
    assert '"tier": "T1核心"' in capsys.readouterr().out
    assert main(["lint", str(tmp_path), "--form", "doc"]) == 0 and main(["lint", str(tmp_path), "--form", "report", "--skip", "codes", "locator"]) == 1
    assert main(["lint", str(tmp_path), "--form", "report", "--min", "1", "--skip", "codes", "locator"]) == 0
    assert main(["template", str(tmp_path / "m.csv")]) == 0 and (tmp_path / "m.csv").read_text().startswith("\ufeff编号,作者")
    (tmp_path / "x.docx").write_bytes(b"no")
    assert main(["docx", "--source", str(tmp_path), "--out", str(tmp_path / "t")]) == 1
    spark.createDataFrame([("p", 1, "text"), ("p", 2, " ")], "doc_id string, page_no int, raw string").write.parquet(str(tmp_path / "pages"))
    assert main(["pages", "--pages", str(tmp_path / "pages"), "--pages-only"]) == 0 and "p 2 empty 1" in capsys.readouterr().out


def test_nested_folders(spark, tmp_path):
    """A row for each id after two runs, whatever folders lie below one another; the plan does not grow with the folders."""
    for i in range(200):
        at = tmp_path / "in" / f"f{i}" / "sub" if i % 2 else tmp_path / "in" / f"f{i - i % 4}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"d{i}.md").write_text(f"text {i % 150}\n")
    (tmp_path / "in" / "a.md").write_text("top\n")
    reg, out = ["--registry", str(tmp_path / "reg")], ["--outdir", str(tmp_path / "out")]
    assert main(["init", *reg]) == 0 and main(["scan", *reg, "--source", str(tmp_path / "in"), str(tmp_path / "in" / "f1"), str(tmp_path / "none"), "--record-duplicates"]) == 3
    assert main(["extract", *reg, *out, "--limit", "3"]) == 0
    first = Snapshots(spark, str(tmp_path / "reg")).load()
    assert first.filter("state = '已抽文本'").count() == 3
    for _ in range(2):
        assert main(["extract", *reg, *out]) == 0
        rows = Snapshots(spark, str(tmp_path / "reg")).load().collect()
        assert len(rows) == len({r["id"] for r in rows}) == 201
    assert sum(r["state"] == "已抽文本" for r in rows) == 151  # copies are skipped
    gone = next(r for r in rows if r["file_name"] == "a.md")
    (tmp_path / "in" / "a.md").unlink()
    assert main(["extract", *reg, *out, "--force"]) == 0
    assert registry(spark, tmp_path)["a.md"]["state"] == "源文件缺失" and gone["state"] == "已抽文本"


def test_repeated_ids_are_refused(spark, tmp_path):
    table = spark.createDataFrame([("L0001", "a"), ("L0001", "b")], "id string, note string")
    with pytest.raises(ValueError, match="L0001"):
        Snapshots(spark, str(tmp_path / "reg")).save(table, None, ["note"])


FITZ = """
class _Page:
    def __init__(self, text): self.text = text
    def get_text(self): return self.text


class _Doc:
    def __init__(self, stream):
        if not stream.startswith(b'%PDF'): raise RuntimeError('no PDF')
        self.pages = [p for p in stream.decode().split('|')[1:]]
        self.needs_pass, self.is_repaired, self.page_count = b'LOCKED' in stream, False, len(self.pages)
    def __enter__(self): return self
    def __exit__(self, *a): pass
    def __getitem__(self, i): return _Page(self.pages[i])


def open(stream, filetype): return _Doc(stream)
"""


def test_pages_of_pdf_files(spark, tmp_path, monkeypatch, capsys):
    """The branch of PDF files, with a stand-in for the library: pages, printed labels, locked, empty and broken files."""
    import importlib.util
    import sys
    import types

    from scriptorium.sources import files

    fake = types.ModuleType("fitz")
    exec(FITZ, fake.__dict__)
    monkeypatch.setitem(sys.modules, "fitz", fake)
    book = "%PDF|" + "|".join(f"page {i} of many words\n— {i + 40} —" for i in range(1, 5))
    for n, body in (("good.pdf", book), ("locked.pdf", "%PDF LOCKED|x"), ("scan.pdf", "%PDF| | "), ("bad.pdf", "nothing")):
        (tmp_path / n).write_text(body)
    assert files.pdf_pages(book.encode())[0] == (1, "page 1 of many words\n— 41 —", False, False, None)
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: types.SimpleNamespace() if name == "fitz" else None)
    # workers have no such library: what they would have given is made here, from the same function
    monkeypatch.setattr(files, "read_files", lambda todo, keep_toc=False: spark.createDataFrame([(r["id"], "pdf", no, -1 if e else 0, e or t, False, lock, rep) for r in todo.collect() for no, t, lock, rep, e in files.pdf_pages(open(r["path"].removeprefix("file:"), "rb").read())], files.ROWS))
    reg, out = ["--registry", str(tmp_path / "reg")], ["--outdir", str(tmp_path / "out")]
    assert main(["init", *reg]) == 0 and main(["scan", *reg, "--source", str(tmp_path)]) == 3
    assert main(["extract", *reg, *out, "--printed-labels"]) == 2
    rows = registry(spark, tmp_path)
    assert {n: r["state"] for n, r in rows.items()} == {"good.pdf": "已抽文本", "locked.pdf": "打不开", "scan.pdf": "需OCR", "bad.pdf": "打不开"} and "no PDF" in rows["bad.pdf"]["note"]
    text = next((tmp_path / "out").glob("*_good.txt")).read_text()
    assert "===== PAGE 2 ===== [印刷页码 p.42]\npage 2 of many words\n" in text and "— 42" not in text
