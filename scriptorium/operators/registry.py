"""The registry of documents: a row each, appended to, merged cell by cell, audited. A blank cell is a missing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.session import cut, numbered

#: The registry's columns, and their names in CSV files.
COLUMNS = {
    "id": "编号", "file_name": "文件名", "title": "标题", "first_author": "第一作者", "year": "年份", "source_type": "来源类型", "n_pages": "页数", "n_chars": "字符数", "sha1": "sha1", "source_path": "源路径", "text_path": "文本路径",
    "topic": "主题分类", "tier": "档位", "verdict": "纳入判定", "relevance": "相关度", "state": "解码状态", "output_file": "产出文件", "note": "备注",
}
#: What a new row starts with; states, tiers and verdicts that rules name.
DEFAULTS = {"tier": "待分流", "verdict": "待核查", "state": "未处理"}
DUP_TIER, DUP_VERDICT, SKIPPED = "去重-重复", "去重", "跳过"
CORE_TIERS, DONE_STATES = ("T1核心", "T2重要", "专著章节"), ("已解码", "已入RCOS", "已入综述")
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp")
EMPTY = "（空）"
#: Marks in a file's name that tell copies.
COPY_MARKS = r"(?i)副本|拷贝|复件|copy|[（(][0-9]+[）)]|[ _\-][0-9]+$"


def blank(c: Column) -> Column:
    return T.or_blank(c) == ""


def number_of(id_: Column) -> Column:
    return F.regexp_extract(T.or_blank(id_), r"\AL([0-9]+)\z", 1).try_cast("long")


def ordered(registry: DataFrame) -> DataFrame:
    """L-numbers first and by number, then the others, both in table order."""
    n = number_of(F.col("id"))
    return registry.orderBy(F.when(n.isNull(), 1).otherwise(0), n, "row_no")


def new_paths(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose path is not registered, whatever their content is."""
    return found.join(registry.select("source_path"), "source_path", "left_anti")


def by_content(found: DataFrame, registry: DataFrame) -> DataFrame:
    """found with first_of: the path (registered ones first, then in order) that had the same content before; null for the first."""
    every = found.select("source_path", "sha1", F.lit(1).alias("_new")).unionByName(registry.filter(~blank(F.col("sha1"))).select("source_path", "sha1", F.lit(0).alias("_new")))
    # the first of a content is an aggregate with partial sums, so copies in any number are no load
    first = every.groupBy("sha1").agg(F.min(F.struct("_new", "source_path")).alias("_first"))
    out = found.join(first, "sha1", "left")
    return out.withColumn("first_of", F.when((F.col("_first._new") == 0) | (F.col("_first.source_path") != F.col("source_path")), F.col("_first.source_path"))).drop("_first")


def same_titles(rows: DataFrame, key: Column, order: list[str], id_col: str = "id") -> DataFrame:
    """rows with same_title_as: the first row's id among those with the same key, null in that row."""
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min_by(id_col, F.struct(*order)).alias("_id"))
    out = keyed.join(first, "_key", "left")
    return out.withColumn("same_title_as", F.when(F.col("_id") != F.col(id_col), F.col("_id"))).drop("_key", "_id")


def assign_ids(new: DataFrame, registry: DataFrame, idmap: DataFrame) -> DataFrame:
    """new with id: an old one by file name, else by content, unless used; the rest are numbered on in path order.

    Files take turns in path order, each preferring its name's old id to its content's. Of all whose names lead to an id only the
    first by path can have it by name: its candidate. A candidate loses it if an earlier file comes to it by content: one that is
    no candidate anywhere, or a candidate that lost its own. So losses run along edges from a candidate's id to the id of its
    content, where they only count if the next candidate has a later path; paths grow along them, so there are no cycles. What is
    reached is found by doubling the edges: the rounds grow with the logarithm of the longest run of losses.
    """
    free = idmap.join(registry.select("id"), "id", "left_anti")
    by_name = free.filter(~blank(F.col("file_name"))).groupBy("file_name").agg(F.min_by("id", "row_no").alias("_c1"))
    by_sha = free.filter(~blank(F.col("sha1"))).groupBy("sha1").agg(F.min_by("id", "row_no").alias("_c2"))
    rows = new.join(by_name, "file_name", "left").join(by_sha, "sha1", "left")
    first = rows.filter(F.col("_c1").isNotNull()).groupBy("_c1").agg(F.min("source_path").alias("_first"))
    rows = cut(rows.join(first, "_c1", "left").withColumn("_candidate", F.coalesce(F.col("_first") == F.col("source_path"), F.lit(False))).drop("_first"))
    lost = _lost(rows).select(F.col("node").alias("_c1"), F.lit(True).alias("_lost"))
    rows = rows.join(lost, "_c1", "left")
    rows = rows.withColumn("_want", F.when(F.col("_candidate") & F.col("_lost").isNull(), F.col("_c1")).otherwise(F.col("_c2")))
    holder = rows.filter(F.col("_want").isNotNull()).groupBy("_want").agg(F.min("source_path").alias("_holder"))
    rows = cut(rows.join(holder, "_want", "left").withColumn("_old", F.when(F.col("_holder") == F.col("source_path"), F.col("_want"))))
    kept = rows.select(*new.columns, "_old")
    top = registry.select("id").unionByName(kept.select(F.col("_old").alias("id"))).agg(F.coalesce(F.max(number_of(F.col("id"))), F.lit(0)).alias("_top"))
    fresh = numbered(kept.filter(F.col("_old").isNull()), [F.col("source_path")], "_n").crossJoin(F.broadcast(top)).withColumn("id", F.format_string("L%04d", F.col("_top") + F.col("_n")))  # top is one row
    return kept.filter(F.col("_old").isNotNull()).withColumn("id", F.col("_old")).select(*new.columns, "id").unionByName(fresh.select(*new.columns, "id"))


def _lost(rows: DataFrame) -> DataFrame:
    """(node): ids whose candidate (see assign_ids) finds them taken."""
    nodes = rows.filter("_candidate").select(F.col("_c1").alias("node"), F.col("source_path").alias("path"), F.col("_c2").alias("next"))
    sure = rows.filter(~F.col("_candidate") & F.col("_c2").isNotNull()).groupBy(F.col("_c2").alias("node")).agg(F.min("source_path").alias("taker"))
    later = nodes.select(F.col("node").alias("next"), F.col("path").alias("after"))
    edges = nodes.join(later, "next", "left").join(sure, "node", "left")
    state = cut(edges.select("node", F.when(F.col("after") > F.col("path"), F.col("next")).alias("next"), F.coalesce(F.col("taker") < F.col("path"), F.lit(False)).alias("lost")))
    while not state.filter("next is not null").isEmpty():
        reached = state.filter("lost and next is not null").select(F.col("next").alias("node"), F.lit(True).alias("hit")).distinct()
        further = state.select(F.col("node").alias("next"), F.col("next").alias("far"))
        state = state.join(reached, "node", "left").join(further, "next", "left")
        state = cut(state.select("node", F.col("far").alias("next"), (F.col("lost") | F.col("hit").isNotNull()).alias("lost")))
    return state.filter("lost").select("node")


def scan(found: DataFrame, registry: DataFrame, idmap: DataFrame, record_duplicates: bool = False) -> DataFrame:
    """The rows that a scan of files (file_name, source_path, sha1) appends: new paths with new content, with ids, defaults and notes.

    Copies are left out, or with record_duplicates come too, marked and with a note of their original.
    """
    seen = by_content(new_paths(found, registry), registry)
    new = seen if record_duplicates else seen.filter(F.col("first_of").isNull())
    rows = assign_ids(new, registry, idmap)
    at = T.author_title(F.col("file_name"))
    dup = F.col("first_of").isNotNull()
    rows = rows.select("id", "file_name", at.title.alias("title"), at.author.alias("first_author"), T.source_type(F.col("file_name")).alias("source_type"), "sha1", "source_path", "first_of",
                       *(F.when(dup, d).otherwise(v).alias(k) for (k, v), d in zip(DEFAULTS.items(), (DUP_TIER, DUP_VERDICT, SKIPPED), strict=True)))
    known = registry.select("id", "file_name", F.lit(0).alias("_new"), "source_path").unionByName(rows.filter(~dup).select("id", "file_name", F.lit(1).alias("_new"), "source_path"))
    flags = same_titles(known, T.title_key(F.col("file_name")), ["_new", "source_path"]).filter("_new = 1 and same_title_as is not null").select("id", "same_title_as")
    out = rows.join(flags, "id", "left")
    return out.withColumn("note", F.when(dup, F.concat(F.lit("same content as "), "first_of")).when(F.col("same_title_as").isNotNull(), F.concat(F.lit("same title as "), "same_title_as")).otherwise("")).drop("first_of", "same_title_as")


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame, cells: list[str], key: str = "id") -> DataFrame:
    """The three-way merge of tables with key, file_name, sha1 and cells: a row for each id with the cells and conflict, the names of cells that both changed.

    A cell that one side changed takes that side's value; one that both changed differently keeps theirs. Rows never vanish
    except those that both sides dropped. Two new rows of one id but different files: ours moves to a number above all of both
    sides' (in order of the old ids) and gets a note in the cell note.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col(key), *(T.or_blank(F.col(c)).alias(f"{p}_{c}") for c in cells), F.lit(True).alias(f"{p}_in"))

    j = side(ours, "o").join(side(base, "b"), key, "full").join(side(theirs, "t"), key, "full")
    o, b, t = (F.col(f"{p}_in").isNotNull() for p in "obt")
    same = (F.col("o_file_name") == F.col("t_file_name")) | ((F.col("o_sha1") != "") & (F.col("o_sha1") == F.col("t_sha1")))
    clash, three = o & t & ~b & ~same, o & b & t

    def cell(c: str) -> Column:
        mine, old, other = F.col(f"o_{c}"), F.col(f"b_{c}"), F.col(f"t_{c}")
        return F.when(three, F.when((mine != old) & ((other == old) | (other == mine)), mine).otherwise(other)).when(t, other).otherwise(mine).alias(c)

    both = F.array_compact(F.array(*(F.when(three & (F.col(f"o_{c}") != F.col(f"b_{c}")) & (F.col(f"t_{c}") != F.col(f"b_{c}")) & (F.col(f"t_{c}") != F.col(f"o_{c}")), F.lit(c)) for c in cells)))
    kept = j.filter(o | t).select(F.col(key), *(cell(c) for c in cells), both.alias("conflict"))
    top = ours.select(key).unionByName(theirs.select(key)).agg(F.coalesce(F.max(number_of(F.col(key))), F.lit(0)).alias("_top"))
    moved = numbered(j.filter(clash), [F.col(key)], "_n").crossJoin(F.broadcast(top)).withColumn("_new", F.format_string("L%04d", F.col("_top") + F.col("_n")))  # top is one row
    note = T.append_note(F.col("o_note"), F.concat(F.lit("moved from "), F.col(key)))
    moved = moved.select(F.col("_new").alias(key), *((note if c == "note" else F.col(f"o_{c}")).alias(c) for c in cells), F.array(F.lit(key)).alias("conflict"))
    return kept.unionByName(moved)


def attach(registry: DataFrame, texts: DataFrame) -> DataFrame:
    """registry with texts (id, text_path, text) from elsewhere attached; texts of under 10 visible characters are refused."""
    n = T.nonspace_len(F.col("text"))
    good = texts.select("id", F.col("text_path").alias("_path"), F.length("text").alias("_chars"), n.alias("_n")).filter("_n >= 10")
    j, have = registry.join(good, "id", "left"), F.col("_n").isNotNull()
    cells = {"text_path": F.col("_path"), "n_chars": F.col("_chars"), "state": F.lit("已OCR"), "note": T.append_note(F.col("note"), F.lit("text attached"))}
    return j.select(*((F.when(have, cells[c]).otherwise(F.col(c)) if c in cells else F.col(c)).alias(c) for c in registry.columns))


def backfill(registry: DataFrame, results: DataFrame) -> DataFrame:
    """registry after extraction: results (id, status, path); ok sets the path and 已抽文本, anything else clears the path and is the state."""
    j = registry.join(results.select("id", F.col("status").alias("_s"), F.col("path").alias("_p")), "id", "left")
    cells = {"text_path": F.when(F.col("_s") == "ok", F.col("_p")).otherwise(""), "state": F.when(F.col("_s") == "ok", "已抽文本").otherwise(F.col("_s"))}
    return j.select(*((F.when(F.col("_s").isNotNull(), cells[c]).otherwise(F.col(c)) if c in cells else F.col(c)).alias(c) for c in registry.columns))


def tally(registry: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n, first) of all columns by one grouping; blank counts as （空）; first is the first row_no, by which equal numbers are ordered."""
    shown = registry.select("row_no", *(F.when(blank(F.col(c)), EMPTY).otherwise(F.col(c)).alias(c) for c in columns))
    each = shown.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.min("row_no").alias("first"), *(F.grouping(c).alias(f"_{c}") for c in columns))
    own = lambda what: F.coalesce(*(F.when(F.col(f"_{c}") == 0, what(c)) for c in columns))
    return each.select(own(F.lit).alias("field"), own(F.col).alias("value"), "n", "first")


def audit(registry: DataFrame) -> DataFrame:
    """(id, problem): rows that break a rule, once for each."""
    tier, state, note = T.or_blank(F.col("tier")), T.or_blank(F.col("state")), T.or_blank(F.col("note"))
    dup = F.contains(tier, F.lit("重复"))
    rules = {
        "tier without decoding": T.norm_tier(tier).isin(*CORE_TIERS) & ~state.isin(*DONE_STATES),
        "decoded without output": (state == "已解码") & blank(F.col("output_file")),
        "skipped without reason": (state == SKIPPED) & ~dup & ~F.contains(note, F.lit("重复")),
        "copy not skipped": dup & (state != SKIPPED),
        "verdict pending": T.or_blank(F.col("verdict")) == "待核查",
    }
    return registry.select("id", F.explode(F.array_compact(F.array(*(F.when(r, F.lit(k)) for k, r in rules.items())))).alias("problem"))


def extracted(has_text: Column, force: bool = False, redo_ocr: bool = False) -> Column:
    """Whether a row keeps the text that it has: one from elsewhere (已OCR) unless redo_ocr, one of our own that is there unless force."""
    return F.when(T.or_blank(F.col("state")) == "已OCR", F.lit(not redo_ocr)).otherwise(~blank(F.col("text_path")) & has_text & F.lit(not force))


def extract_queue(registry: DataFrame, exists: Column, has_text: Column | None = None, force: bool = False, redo_ocr: bool = False) -> DataFrame:
    """registry with queue (pdf, docx, text or null) and new_state: what extraction does with each row.

    exists: whether the source is there; has_text: whether the file at text_path is (rows that keep their text have no queue).
    """
    ext, state = T.extension(F.col("source_path")), T.or_blank(F.col("state"))
    copy = F.contains(T.or_blank(F.col("tier")), F.lit("重复")) | (T.or_blank(F.col("verdict")) == DUP_VERDICT) | (state == SKIPPED)
    gone, open_ = blank(F.col("source_path")) | ~exists, state.isin("", "未处理")
    queue = F.when(gone | copy, None).when(ext.isin(".md", ".txt"), "text").when(ext == ".pdf", "pdf").when(ext == ".docx", "docx")
    if has_text is not None:
        queue = F.when(~extracted(has_text, force, redo_ocr), queue)
    after = F.when(blank(F.col("source_path")), state).when(~exists, "源文件缺失").when(copy | ext.isin(".md", ".txt", ".pdf", ".docx") | ~open_, state).when(ext.isin(*IMAGES), "需OCR").otherwise("待其它提取器")
    return registry.withColumn("queue", queue).withColumn("new_state", after)


def text_duplicates(texts: DataFrame) -> DataFrame:
    """(keep_id, dup_id) of rows (id, file_name, body) with equal bodies: the name with the fewest copy marks, then the smallest id stays."""
    marks = F.regexp_count(F.col("file_name"), F.lit(COPY_MARKS))
    rows = texts.select("id", marks.alias("_marks"), F.sha1("body").alias("_sha"))
    first = rows.groupBy("_sha").agg(F.min(F.struct("_marks", "id")).alias("_first"))
    return rows.join(first, "_sha").filter(F.col("_first.id") != F.col("id")).select(F.col("_first.id").alias("keep_id"), F.col("id").alias("dup_id"))
