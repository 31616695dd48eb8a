"""Queries of the scalar functions: each over an input made from every document, with SQL of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.text import HTML_ENTITY, KEPT, WS

# Inputs, in SQL that Spark and DuckDB read alike.
TAIL = "CASE doc_id % 7 WHEN 0 THEN '_副本' WHEN 1 THEN ' (1)' WHEN 2 THEN '（2）' WHEN 3 THEN ' 2' WHEN 4 THEN '-copy 3' WHEN 5 THEN '_副本 (1)' ELSE '' END"
EXT = "CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.md' WHEN 3 THEN '.png' WHEN 4 THEN '' ELSE '.txt' END"
WHO = "CASE doc_id % 5 WHEN 0 THEN '_Li' WHEN 1 THEN '_Johnson' WHEN 2 THEN '_王明' WHEN 3 THEN '_A B' ELSE '' END"
KIND = "CASE doc_id % 9 WHEN 0 THEN '硕士学位论文' WHEN 1 THEN '课程标准' WHEN 2 THEN '年鉴' ELSE '' END"
FILE = f"concat('a/b.c/', replace(text, '/', ''), {KIND}, {WHO}, {TAIL}, {EXT})"
TITLE = "concat(' ', text, CASE doc_id % 4 WHEN 0 THEN ': a part' WHEN 1 THEN ' - sub title' WHEN 2 THEN '——副题' ELSE '：深度学习' END)"
LINE = "CASE doc_id % 8 WHEN 0 THEN concat('— ', doc_id) WHEN 1 THEN concat('[', doc_id % 900, ']') WHEN 2 THEN concat('第 ', doc_id % 99, ' 页') WHEN 3 THEN 'Page 12 of 17' WHEN 4 THEN '2020.12' WHEN 5 THEN concat('·', doc_id % 50, '.') WHEN 6 THEN text ELSE '1.2.3' END"
MARKUP = "concat(text, '```code', chr(10), text, '```', ' `x` <!-- ', text, ' -->', text)"
HEAD = "concat(CASE doc_id % 6 WHEN 0 THEN '第三章 ' WHEN 1 THEN '二、' WHEN 2 THEN '（四）' WHEN 3 THEN '2.1 ' WHEN 4 THEN '3、' ELSE '' END, text)"
CARD = "concat('**', text, '**  `', lang, '`')"
TIER = "CASE doc_id % 5 WHEN 0 THEN concat('| 档位 | T1核心／T2重要／T3背景 T', 1 + doc_id % 3, ' |') WHEN 1 THEN concat('档位：T', 1 + doc_id % 3) WHEN 2 THEN concat('## 档位 T ', 1 + doc_id % 3, chr(10), 'T1') WHEN 3 THEN concat('x T', 1 + doc_id % 3) ELSE 'none' END"
BASIS = "CASE doc_id % 5 WHEN 0 THEN concat('K = +', doc_id % 90) WHEN 1 THEN concat('PAGE ', 1 + doc_id % 9, ' = p.', doc_id % 60) WHEN 2 THEN concat('裸数字依次为 ', doc_id, '/', doc_id + 1, '/', doc_id + 2) WHEN 3 THEN '按章节名' ELSE text END"
ITEMS = "CASE doc_id % 3 WHEN 0 THEN concat('1. ', text, chr(10), '2. ', text) WHEN 1 THEN concat('1. ', replace(text, chr(10), ' '), ' 2. ', replace(text, chr(10), ' ')) ELSE concat('①', replace(text, chr(10), ' '), '②', replace(text, chr(10), ' ')) END"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def _stem(x: str) -> str:
    base = f"regexp_replace({x}, '(?s)\\A.*/', '')"
    cut = f"left({base}, length({base}) - length({_ext(x)}))"
    out = f"translate({cut}, '（）', '()')"
    for _ in range(2):
        out = _strip(f"regexp_replace({out}, '{T.COPY_MARK}', '', 'g')")
    return out


def _ext(x: str) -> str:
    return rf"lower(regexp_extract(regexp_replace({x}, '(?s)\A.*/', ''), '(?s)\A\.*[^.].*?(\.[^.]*)\z', 1))"


def _main(x: str) -> str:
    joined = f"regexp_replace({_strip(x)}, '[:：]', '_', 'g')"
    cut = rf"regexp_replace({joined}, '(?s)(?:—|[{WS}]+[-–—][{WS}]+).*\z', '')"
    return f"regexp_replace({_strip(cut)}, '[{WS}]+', '_', 'g')"


def _sane(x: str) -> str:
    return f"regexp_replace({x}, '[^{KEPT}]', '', 'g')"


def _short(x: str) -> str:
    lim = f"(CASE WHEN regexp_matches({x}, '[A-Za-z]') THEN 60 ELSE 30 END)"
    head = f"left({x}, {lim})"
    at = rf"length(regexp_extract({head}, '(?s)\A(.*)_', 1))"
    return rf"CASE WHEN length({x}) <= {lim} THEN {x} WHEN {at} > 0 THEN regexp_replace(left({head}, {at}), '_+\z', '') ELSE regexp_replace({head}, '_+\z', '') END"


def _tidy(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '_+', '_', 'g'), '\A_|_\z', '', 'g')"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace({x}, '**', ''), '`', ''), '[{WS}]+', ' ', 'g'), ' ')"


_AUTHOR = r"regexp_extract(s, '(?s)\A(.+)_([^_]+)\z', 2)"
_TITLE = r"regexp_extract(s, '(?s)\A(.+)_([^_]+)\z', 1)"
_FITS = f"({_TITLE} <> '' AND {_AUTHOR} <> '' AND length({_AUTHOR}) <= 4 AND NOT contains({_strip(_AUTHOR)}, ' '))"
_MENU = rf"T[{WS}]*[123](?:[^T\n]{{0,8}}[／/、,，][^T\n]{{0,8}}T[{WS}]*[123])+"


def _tier(place: str) -> str:
    return rf"nullif(regexp_extract(regexp_replace({place}, '{_MENU}', ' ', 'g'), 'T[{WS}]*([123])', 1), '')"


def _circled() -> str:
    return "list_filter(list_transform(string_split(regexp_replace(x, '([①②③④⑤⑥⑦⑧⑨⑩])', chr(1) || '\\1', 'g'), chr(1)), lambda y: " + _clean(r"regexp_replace(y, '\A[0-9.、)\-*\s①-⑩]+', '')") + "), lambda y: length(y) >= 8)"


def _inner() -> str:
    return "list_filter(list_transform(string_split(regexp_replace(x, '\\*{0,2}([0-9]+[.、)])', chr(1) || '\\1', 'g'), chr(1)), lambda y: " + _clean(r"regexp_replace(y, '\A[0-9.、)\-*\s]+', '')") + "), lambda y: length(y) >= 8)"


_BY_LINE = rf"list_transform(regexp_extract_all(x, '(?m)^[{WS}]*(?:[0-9]+[.、)]|[-*])[{WS}]*(.{{8,300}})', 1), lambda y: {_clean('y')})"

#: name: input, function, SQL of the function over x.
SCALARS: dict[str, tuple[str, Callable[[Column], Column], str]] = {
    "content_hash": ("text", F.sha1, "sha1(x)"),
    "nonspace_len": ("text", T.nonspace_len, f"length(regexp_replace(x, '[{WS}]+', '', 'g'))"),
    "cjk_word_count": ("text", T.word_count, r"len(regexp_extract_all(x, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(x, '[A-Za-z]+'))"),
    "display_width": ("text", T.display_width, r"length(x) + len(regexp_extract_all(x, '[\x{2e81}-\x{10ffff}]'))"),
    "file_extension": (FILE, T.extension, _ext("x")),
    "title_key": (FILE, T.title_key, f"lower(regexp_replace({_stem('x')}, '[{WS}]+', '', 'g'))"),
    "source_type": (FILE, T.source_type, "CASE " + " ".join(f"WHEN regexp_matches(x, '{m}') THEN '{k}'" for k, m in T.SOURCE_MARKS) + " " + " ".join(f"WHEN {_ext('x')} IN ({', '.join(repr(e) for e in es)}) THEN '{k}'" for k, es in T.SOURCE_EXTENSIONS) + " ELSE '待核' END"),
    "safe_filename": (TITLE, T.safe_filename, rf"coalesce(nullif(regexp_replace(left(coalesce(nullif(regexp_replace({_strip('x')}, '[^0-9A-Za-z_\x{{4e00}}-\x{{9fff}}.\-]+', '_', 'g'), ''), 'untitled'), 60), '\A[._\-]+|[._\-]+\z', '', 'g'), ''), 'untitled')"),
    "main_title": (TITLE, T.main_title, _main("x")),
    "sanitize": (TITLE, T.sanitize, _sane("x")),
    "truncate_title": (TITLE, lambda c: T.truncate_title(T.sanitize(T.main_title(c))), f"(SELECT {_short('z')} FROM (SELECT {_sane(_main('x'))} AS z))"),
    "output_name": (TITLE, lambda c: T.output_name(c, F.substring(c, 2, 3), F.lit("B")), f"(SELECT concat(coalesce(nullif({_tidy('(' + _short('z') + ')')}, ''), '未命名'), CASE WHEN w <> '' THEN concat('_', w) ELSE '' END, '-文献综述.md') FROM (SELECT {_sane(_main('x'))} AS z, {_tidy(_sane('substr(x, 2, 3)'))} AS w))"),
    "append_note": (CARD, lambda c: T.append_note(c, F.right(c, F.lit(5))), "CASE WHEN contains(x, right(x, 5)) THEN x ELSE concat(x, '；', right(x, 5)) END"),
    "norm_tier": (TIER, T.norm_tier, f"regexp_replace(x, '[{WS}]+', '', 'g')"),
    "card_clean": (CARD, T.card_clean, _clean("x")),
    "strip_markup": (MARKUP, T.strip_markup, r"regexp_replace(regexp_replace(regexp_replace(x, '(?s)```.*?```', '', 'g'), '`[^`\n]*`', '', 'g'), '(?s)<!--.*?-->', '', 'g')"),
    "page_number_value": (LINE, T.page_number_value, rf"CAST(coalesce(nullif(regexp_extract({_strip('x')}, '\A{T.DECOR}*([0-9]{{1,4}}){T.DECOR}*\z', 1), ''), nullif(regexp_extract({_strip('x')}, '\A第[{WS}]*([0-9]{{1,4}})[{WS}]*页\z', 1), '')) AS INTEGER)"),
    "numbered_level": (HEAD, T.numbered_level, rf"CASE WHEN regexp_matches(x, '\A第[一二三四五六七八九十]+[章部分]') THEN 1 WHEN regexp_matches(x, '\A[一二三四五六七八九十]+、') THEN 2 WHEN regexp_matches(x, '\A（[一二三四五六七八九十]+）') THEN 3 WHEN regexp_matches(x, '\A[0-9]+(?:\.[0-9]+)*[、.．]?[{WS}]*[^{WS}]') THEN 4 ELSE 0 END"),
    "heading_render": (HEAD, lambda c: T.heading_render(T.numbered_level(c), c), "CASE WHEN substr(x, 1, 1) = '第' THEN concat('# ', x) WHEN substr(x, 1, 2) = '二、' THEN concat('## ', x) WHEN substr(x, 1, 1) = '（' THEN concat('### ', x) WHEN regexp_matches(x, '\\A[0-9]') THEN concat('#### ', x) ELSE x END"),
    "ref_basis": (BASIS, T.ref_basis, r"CASE WHEN regexp_matches(x, 'K\s*=\s*[+-]?[0-9]+') THEN concat('K=', regexp_extract(x, 'K\s*=\s*([+-]?[0-9]+)', 1)) WHEN starts_with(x, 'PAGE') THEN concat('K=', printf('%+d', CAST(regexp_extract(x, 'p\.([0-9]+)', 1) AS BIGINT) - CAST(regexp_extract(x, 'PAGE ([0-9]+)', 1) AS BIGINT))) WHEN contains(x, '裸数字') AND length(regexp_extract(x, '/([0-9]+)$', 1)) <= 4 THEN concat('K=', printf('%+d', CAST(regexp_extract(x, ' ([0-9]+)/', 1) AS BIGINT) - 1)) WHEN contains(x, '章节名') THEN '章节名' ELSE '?' END"),
    "card_tier": (TIER, T.card_tier, r"CASE coalesce(" + ", ".join(_tier(p) for p in (r"regexp_extract(x, '(?m)^\|[^|\n]*档位[^|\n]*\|([^\n]*)', 1)", r"regexp_extract(x, '档位[：:][^\n]{0,80}', 0)", r"regexp_extract(x, '(?m)^#{2,4}[^\n]*档位[^\n]*', 0)", "x")) + ") WHEN '1' THEN 'T1核心' WHEN '2' THEN 'T2重要' WHEN '3' THEN 'T3背景' END"),
    "bigrams": (CARD, lambda c: F.array_join(F.array_sort(T.bigrams(c)), "|"), r"(SELECT coalesce(array_to_string(list_sort(list_distinct(list_transform(range(1, len(z)), lambda i: z[i] || z[i + 1]))), '|'), '') FROM (SELECT string_split(regexp_replace(x, '[^\x{4e00}-\x{9fff}A-Za-z0-9]', '', 'g'), '') AS z))"),
    "item_split": (ITEMS, lambda c: F.array_join(T.item_split(c), "|"), f"array_to_string(CASE WHEN len({_BY_LINE}) >= 2 THEN {_BY_LINE} WHEN len(CASE WHEN len({_inner()}) > len({_BY_LINE}) THEN {_inner()} ELSE {_BY_LINE} END) >= 2 THEN CASE WHEN len({_inner()}) > len({_BY_LINE}) THEN {_inner()} ELSE {_BY_LINE} END ELSE {_circled()} END, '|')"),
    "entity_count": ("concat(text, CASE doc_id % 3 WHEN 0 THEN '&amp;x&#x7684;' WHEN 1 THEN '&nope; &quot;' ELSE '' END)", lambda c: F.regexp_count(c, F.lit(HTML_ENTITY)), f"len(regexp_extract_all(x, '{HTML_ENTITY}'))"),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, function, _ = SCALARS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs.select("doc_id", F.expr(source).alias("x")).select("doc_id", function(F.col("x")).alias(name))

    return run


def _author_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(FILE).alias("x"))
    return docs.select("doc_id", T.author_title(F.col("x")).alias("s")).select("doc_id", "s.title", "s.author")


QUERIES = {n: _query(n) for n in SCALARS} | {"author_title": _author_title}
ORACLES = {n: f"SELECT doc_id, {sql} AS {n} FROM (SELECT doc_id, {source} AS x FROM documents)" for n, (source, _, sql) in SCALARS.items()} | {
    "author_title": f"SELECT doc_id, CASE WHEN {_FITS} THEN {_strip(_TITLE)} ELSE s END AS title, CASE WHEN {_FITS} THEN {_strip(_AUTHOR)} ELSE '' END AS author FROM (SELECT doc_id, {_stem('x')} AS s FROM (SELECT doc_id, {FILE} AS x FROM documents))",
}
