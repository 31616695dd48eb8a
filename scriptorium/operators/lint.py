"""Rules for Markdown documents. Rules are Columns over (path, text, form); nothing is shuffled before the rollup."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.text import HTML_ENTITY

#: The fields' names and abbreviations; length ranges by form; rules that explanatory documents skip.
FIELD_NAMES = ("作者要做什么", "现有文献综述", "作者对现有文献的批评", "现有文献研究空白", "理论依据（研究的必要性）", "研究结果（作者发现了什么）", "与现有文献观点一致的研究发现", "与现有文献观点相反的研究发现", "作者实际做了什么", "作者对未来研究的建议", "批评点", "明显的遗漏点", "待探讨的相关问题", "逻辑能否走通（能否自圆其说）")
ABBREVIATIONS = ("WTD", "SPL", "CPL", "GAP", "RAT", "ROF", "RCL", "RTC", "WTDD", "RFW", "POC", "MOP", "RPP", "WIL")
FORM_RANGES = {"A": (1500, 16000), "quick": (300, 4000), "B": (800, 20000), "C": (800, 20000), "card": (200, 3200), "chapter-card": (400, 5000), "report": (1200, 10**9), "doc": (0, 10**9)}
RULES = ("abbr", "chars", "banned", "gap-rat", "laundry", "locator", "codes", "merged", "limits", "hygiene")
DOC_SKIPS = ("chars", "banned", "gap-rat", "laundry", "locator", "codes", "merged", "limits")
#: Phrases not to be used, words before them that only mention them, words that attribute a limitation, and how near.
BANNED = ("有一定参考价值", "有一定借鉴意义", "方法有待加强", "方法有待改进", "建议进一步查阅", "建议未来进一步", "有待进一步研究", "具有重要的理论意义和现实意义")
MENTIONS = ("禁止", "不写", "不要写", "避免", "勿", "不得", "严禁", "不应", "不能写", "忌", "杜绝", "禁用")
ATTRIBUTIONS = ("本文评述", "评述认为", "作者自陈", "自陈", "作者未", "未提出", "作者指出的", "作者承认", "作者提到")
NEAR = 12
#: Headings that tell the form, with how many are needed, and parts of file names; in order of precedence.
FORM_HEADINGS = (
    ("chapter-card", ("章节级解码卡", "本卡所解的章"), 1), ("card", ("## 0. 题录", "## 1. 结构性密码", "## 2. 策略性密码", "## 3. 与本课题的接口"), 2), ("report", ("覆盖与精读声明", "一致性三查结果", "# 总报告"), 1),
    ("quick", ("一句话结论", "三条要点", "一个批评点"), 2), ("C", ("对比矩阵", "共识与分歧", "对比综述"), 2), ("B", ("综述摘要", "文献范围与筛选说明", "现有文献的主题格局"), 2), ("A", ("导读摘要", "研究定位", "读后总评"), 1),
)
FORM_FILES = (("chapter-card", "章节.*(卡|解码)|(卡|解码).*章节"), ("card", "解码卡"), ("report", "总报告"), ("quick", "速览"), ("C", "对比|评述"), ("B", "综述"), ("A", "导读"))
#: References to pages and sections; findings run into one sentence; an author with a year at a paragraph's front; a year in brackets; a heading's line; a reference to a group that was never replaced.
LOCATOR = r"p\.\s*[0-9]+|第\s*[0-9]+\s*[页节]|第\s*[一二三四五六七八九十]+\s*节|[「“\"][^」”\"]{2,24}[」”\"]\s*(?:一节|节|部分)"
MERGED = r"(?:研究|分析|探讨)了?.{2,40}(?:并|且|同时)发现"
AUTHOR_LEAD = r"\A\s*[\x{4e00}-\x{9fff}]{2,4}等?\s*[（(]\s*[0-9]{4}\s*[）)]"
YEAR_CITE = r"[（(]\s*[0-9]{4}[a-z]?\s*[）)]"
HEADING = r"(?m)^[ \t]{0,3}#{1,6}[ \t]*[^ \t\n#].*$"
BACK_REFERENCE = r"(?<![A-Za-z0-9_\\])\\[1-9](?![A-Za-z0-9_])"
#: The section that form A's length leaves out, up to the next heading of two levels; what a section on gaps is called and what gives its reasons.
SOURCES = r"(?m)^[ \t]{0,3}#{1,6}[ \t]*八、[ \t]*[^\n]{0,20}?(?:引用信息|参考文献|文献表)[^\n]*[\s\S]*?(?=\n[ \t]{0,3}#{1,2}[ \t]+\S|\z)"
GAP, REASONS = "空白", "理论依据|因此可开展的研究是"
#: Brackets that open and close.
OPENING, CLOSING = "（(〔【", "）)〕】"


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HEADING), F.lit(0))


def guess_form(path: Column, text: Column) -> Column:
    """Folder and report names first, then headings, then the file's name, then a mark in the text."""
    name = T.basename(F.translate(path, "\\", "/"))
    out = F.when(F.contains(text, F.lit("作者要做什么")), "A").otherwise("B")
    for form, pattern in reversed(FORM_FILES):
        out = F.when(name.rlike(pattern), form).otherwise(out)

    def by_headings(heads: Column) -> Column:
        found = F.lit(None).cast("string")
        for form, marks, need in reversed(FORM_HEADINGS):
            hits = sum((F.contains(heads, F.lit(m)).cast("int") for m in marks), F.lit(0))
            found = F.when(hits >= need, form).otherwise(found)
        return found

    out = F.coalesce(T.bind(F.array_join(headings(text), "\n"), by_headings), out)
    folder = F.translate(path, "\\", "/").rlike(r"(\A|/)(references|assets)(/|\z)")
    return F.when(folder | F.startswith(name, F.lit("_提取报告")) | F.contains(F.left(text, F.lit(200)), F.lit("批量抽文本报告")), "doc").otherwise(out)


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?s)```.*?```", ""), "`[^`\\n]*`", "")


def budget(text: Column, form: Column) -> Column:
    """The text that length and references count: in form A without the section of the source's own bibliography."""
    cut = F.regexp_replace(text, SOURCES, "")
    return F.when(form == "A", cut).otherwise(text)


def _before(words: tuple[str, ...]) -> str:
    """The words, and as a group the NEAR characters in front of the one that is found. The words lead, so that only their places look back."""
    some = "|".join(words)
    return rf"(?:{some})(?<=(\A[\s\S]{{0,{NEAR - 1}}}|[\s\S]{{{NEAR}}})(?:{some}))"


def unprepared(text: Column, words: tuple[str, ...], before: tuple[str, ...]) -> Column:
    """The places of words, in order, in front of which none of the words before stands wholly inside NEAR characters. One pass finds all."""
    pattern = F.lit(_before(words))
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("word"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("near"))
    return F.transform(F.filter(found, lambda x: ~x.near.rlike("|".join(before))), lambda x: x.word)


def hygiene(text: Column) -> Column:
    """Entities left over, and references like \\1 that were never replaced."""
    body = without_code(text)
    return F.regexp_count(body, F.lit(HTML_ENTITY)) + F.regexp_count(body, F.lit(BACK_REFERENCE))


def banned(text: Column) -> Column:
    """The phrases used (not only mentioned)."""
    used = unprepared(without_comments(text), BANNED, MENTIONS)
    return T.bind(used, lambda found: F.filter(F.array(*map(F.lit, BANNED)), lambda w: F.array_contains(found, w)))


def unattributed_limits(text: Column) -> Column:
    return (F.size(unprepared(text, ("局限",), ATTRIBUTIONS)) > 0) & ~F.contains(text, F.lit("本文评述"))


def without_fences(text: Column) -> Column:
    """Without fenced blocks: from a line that begins with a fence to the next such line, or the end."""
    return F.regexp_replace(text, r"(?m)^ *```[\s\S]*?(?:\n *```[^\n]*$|\z)", "")


def abbreviations(text: Column) -> Column:
    """Abbreviations outside fences and comments as structs of name and place: bare, table or paren (inside brackets opened on the line)."""
    names = r"(?<![A-Za-z])(?:" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + r")(?![A-Za-z])"
    lines = F.filter(F.split(without_fences(without_comments(text)), "\n"), lambda x: x.rlike(names))

    def in_line(x: Column) -> Column:
        tokens = F.regexp_extract_all(x, F.lit(rf"[{OPENING}{CLOSING}]|{names}"), F.lit(0))
        steps = F.transform(tokens, lambda t: F.when(t.isin(*OPENING), 1).when(t.isin(*CLOSING), -1).otherwise(0).cast("long"))
        # brackets that close take one that is open, if any is: depth is the sum so far, above its lowest so far
        return T.bind(T.before(steps, lambda a, b: a + b), lambda sums: T.bind(T.before(F.transform(sums, lambda s, i: s + F.get(steps, i)), lambda a, b: F.least(a, b)), lambda lows: placed(x, tokens, sums, lows)))

    def placed(x: Column, tokens: Column, sums: Column, lows: Column) -> Column:
        bare = F.when(F.startswith(F.ltrim(x), F.lit("|")), "table").otherwise("bare")
        each = F.transform(tokens, lambda t, i: F.when(t.isin(*OPENING, *CLOSING), None).otherwise(F.struct(t.alias("name"), F.when(F.get(sums, i) > F.get(lows, i), "paren").otherwise(bare).alias("place"))))
        return F.filter(each, lambda e: e.isNotNull())

    return F.flatten(F.transform(lines, in_line))


def sections(text: Column) -> Column:
    """Sections in order as structs level, title, body; text before the first heading has level 0."""
    pieces = F.filter(F.split(text, r"(?m)(?=^[ \t]{0,3}#{1,6}[ \t]*[^ \t\n#])"), lambda p: p != "")

    def parse(p: Column) -> Column:
        marks = F.regexp_extract(p, r"\A[ \t]{0,3}(#{1,6})[ \t]*[^ \t\n#]", 1)
        title = T.strip(F.regexp_extract(p, r"\A[ \t]{0,3}#{1,6}[ \t]*([^\n]*)", 1))
        return F.struct(F.length(marks).alias("level"), F.when(marks != "", title).otherwise("").alias("title"), F.when(marks != "", F.regexp_replace(p, r"\A[^\n]*\n?", "")).otherwise(p).alias("body"))

    return F.transform(pieces, parse)


def gaps_without_reasons(text: Column) -> Column:
    """Titles of sections on gaps whose subtree and next section give no rationale."""
    return T.bind(sections(text), _lacking)


#: A letter for each kind of section: its level (0 to 6), whether it is on a gap, whether its body and its title or body give reasons.
_LETTERS = string.ascii_letters + string.digits


def _kinds(levels, gap=(0, 1), body=(0, 1), whole=(0, 1)) -> str:
    return "[" + "".join(_LETTERS[8 * k + 4 * g + 2 * b + w] for k in levels for g in gap for b in body for w in whole) + "]"


#: A section on a gap without reasons in its body, none in the next section, and none below it: up to the next of its level or the end.
_LACKING = "|".join(f"{_kinds([k], (1,), (0,))}(?={_kinds(range(7), whole=(0,))}|$)(?={_kinds(range(k + 1, 7), body=(0,)) + '*+' if k < 6 else ''}(?:{_kinds(range(k + 1))}|$))" for k in range(7))


def _lacking(s: Column) -> Column:
    """One letter for each section; a pattern over the letters marks those that lack reasons, in one pass."""
    bit = lambda c, n: F.when(c, n).otherwise(0)
    kind = lambda x: x.level * 8 + bit(F.contains(x.title, F.lit(GAP)), 4) + bit(x.body.rlike(REASONS), 2) + bit(F.concat(x.title, x.body).rlike(REASONS), 1)
    letters = F.array_join(F.transform(s, lambda x: F.substr(F.lit(_LETTERS), kind(x) + 1, F.lit(1))), "")
    marked = F.split(F.regexp_replace(letters, _LACKING, "-"), "")
    return T.bind(marked, lambda m: F.array_compact(F.transform(s, lambda x, i: F.when(F.get(m, i) == "-", x.title))))


def paragraphs(text: Column, chars: Column, split: str = r"\n\s*\n") -> tuple[Column, Column, Column]:
    """Paragraphs, those that an author with a year leads, and year citations for every 300 characters."""
    paras = F.filter(F.transform(F.split(text, split), T.strip), lambda p: p != "")
    return F.size(paras), F.size(F.filter(paras, lambda p: p.rlike(AUTHOR_LEAD))), F.regexp_count(text, F.lit(YEAR_CITE)) / F.greatest(F.lit(1.0), chars / 300)


def missing_fields(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(~F.contains(text, F.lit(n)), F.lit(n)) for n in FIELD_NAMES)))


def findings(docs: DataFrame, skip: tuple[str, ...] = (), allow: tuple[str, ...] = (), form: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """(path, form, rule, severity, n): what the rules find in documents (path, text). An unknown rule to skip is an error. form, least, most: instead of the guessed form and its range of lengths."""
    if unknown := set(skip) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    if form is not None and form not in FORM_RANGES:
        raise ValueError(f"unknown form: {form}")
    d = docs.withColumn("form", guess_form(F.col("path"), F.col("text")) if form is None else F.lit(form))
    d = d.withColumn("budget", budget(F.col("text"), F.col("form"))).withColumn("chars", T.word_count(F.col("budget")))
    d = d.withColumn("abbr", F.filter(abbreviations(F.col("text")), lambda a: ~a["name"].isin(*allow)) if allow else abbreviations(F.col("text")))
    low, high = (F.element_at(F.create_map(*(F.lit(x) for f, r in FORM_RANGES.items() for x in (f, r[i]))), F.col("form")) for i in (0, 1))
    low, high = low if least is None else F.lit(least), high if most is None else F.lit(most)
    n_paras, led, density = paragraphs(F.col("text"), F.col("chars"))
    lacking, locators = F.size(missing_fields(F.col("text"))), F.regexp_count(F.col("budget"), F.lit(LOCATOR))

    def placed(place: str) -> Column:
        return F.size(F.filter("abbr", lambda a: a["place"] == place))

    checks = [
        ("hygiene", "error", hygiene(F.col("text"))), ("chars", "error", F.when(F.col("chars") < low, F.col("chars"))), ("chars", "warning", F.when(F.col("chars") > high, F.col("chars"))),
        ("abbr", "error", placed("bare")), ("abbr", "warning", placed("table")), ("abbr", "info", placed("paren")), ("banned", "error", F.size(banned(F.col("text")))), ("gap-rat", "error", F.size(gaps_without_reasons(F.col("text")))),
        ("laundry", "warning", F.when((n_paras >= 6) & (led / n_paras > 0.5) & (led >= 4), led)), ("laundry", "warning", F.when(density > 6, F.ceil(density))),
        ("locator", "warning", F.when(locators < F.greatest(F.lit(3), F.floor(F.col("chars") / 800)), locators + 1)),
        ("codes", "warning", F.when((F.col("form") == "C") & ~F.contains(F.col("text"), F.lit("对比矩阵")), 1)), ("codes", "error", F.when(F.col("form") == "A", lacking)), ("codes", "warning", F.when(F.col("form").isin("card", "chapter-card"), lacking)),
        ("merged", "warning", F.col("text").rlike(MERGED).cast("int")), ("limits", "warning", unattributed_limits(F.col("text")).cast("int")),
    ]
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), n.cast("long").alias("n")) for r, s, n in checks if r not in skip))
    out = d.select("path", "form", F.explode(rows).alias("f")).select("path", "form", "f.*").filter("n > 0")
    return out.filter((F.col("form") != "doc") | ~F.col("rule").isin(*DOC_SKIPS))


def rollup(found: DataFrame, strict: bool = False) -> DataFrame:
    """(errors, warnings, failed): findings by severity and documents that fail; strict: warnings fail too."""
    by = found.groupBy("path").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    return by.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.count_if((F.col("e") > 0) | (F.lit(strict) & (F.col("w") > 0))).alias("failed"))
