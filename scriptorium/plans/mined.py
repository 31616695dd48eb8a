"""Queries of topics, lint rules and cards, over inputs made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.session import spread
from scriptorium.functions.text import HTML_ENTITY, WS
from scriptorium.operators import cards as C
from scriptorium.operators import lint as L
from scriptorium.operators import topics as O

# Letters become Han characters, so that n-grams have something to count. A matrix has a row for every turn of a conversation, with its whole text.
HAN = "translate(lower({x}), 'abcdefghijklmnopqrstuvwxyz', '学习教师课堂互动深度合作课程素养评价能力研究模式的')"
MATRIX = [
    "conv_id * 1000 + turn AS row_no",
    "coalesce(text, '') AS spl",
    f"concat('已有研究', {HAN.format(x='role')}, '（Smith 2019）') AS rof",
    f"{HAN.format(x="coalesce(text, '')")} AS gap",
]
ROWS = f"m AS (SELECT {', '.join(MATRIX)} FROM conversations)"
PATH = "concat(CASE WHEN doc_id % 19 = 0 THEN 'references/' ELSE 'out/' END, CASE doc_id % 6 WHEN 0 THEN 'a-导读' WHEN 1 THEN '速览' WHEN 2 THEN 'x解码卡' WHEN 3 THEN '对比' WHEN 4 THEN '文献综述' ELSE 'y' END, '.md') AS path"
TEXT = """concat('# t', chr(10), CASE doc_id % 7 WHEN 0 THEN '## 四、现有文献研究空白' WHEN 1 THEN '## 综述摘要 文献范围与筛选说明' WHEN 2 THEN '## 一句话结论 三条要点' WHEN 3 THEN '## 对比矩阵 共识与分歧' ELSE '## x' END, chr(10), text, chr(10),
 CASE doc_id % 5 WHEN 0 THEN '方法有待加强，见 p. 12 和第 3 页' WHEN 1 THEN '禁止写：方法有待加强' WHEN 2 THEN '具有重要的理论意义和现实意义' ELSE '研究了教师与学生的互动并发现差异（2019）' END, chr(10),
 CASE doc_id % 4 WHEN 0 THEN '该文局限明显&amp;' WHEN 1 THEN '作者自陈局限' WHEN 2 THEN '## 下一节 理论依据' ELSE 'x &#x7684; `&amp;`' END, chr(10),
 CASE doc_id % 3 WHEN 0 THEN '研究结果（ROF / SPL）与 WTD' WHEN 1 THEN '| GAP | x |' ELSE 'GAPS 作者要做什么 现有文献综述 批评点' END, chr(10)) AS text"""
DOCS = f"d AS (SELECT doc_id, {PATH}, {TEXT} FROM documents)"
CARD = "concat('# c', chr(10), CASE doc_id % 3 WHEN 0 THEN concat('## 2.1 研究空白（GAP）', chr(10), CASE doc_id % 2 WHEN 0 THEN '作者未提出空白。' ELSE '空白在于课堂互动。' END, chr(10)) WHEN 1 THEN concat('| 现有文献研究空白 | ', concat(lang, '  ', source), ' |', chr(10)) ELSE '' END, '## 3. 档位判据与空白判定', chr(10), 'T1') AS text"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")).selectExpr(*MATRIX)


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).selectExpr("doc_id", PATH, TEXT)


def strip_citations(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_no", O.strip_citations(F.concat("rof", F.lit(" Brown et al. 2020, "), "spl")).alias("text"))


def strip_boilerplate(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_no", O.strip_boilerplate(F.concat("rof", "gap")).alias("text"))


def word_tokens(spark, sf_dir):
    t = _docs(spark, sf_dir).select(F.explode(O.word_tokens(F.col("text"))).alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("n"))


def ngram_tokens(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_no", F.array_join(O.ngram_tokens(F.col("gap")), "|").alias("grams"))


def topic_counts(spark, sf_dir):
    return O.counts(_rows(spark, sf_dir)).select("gram", "cnt")


def topic_dominated(spark, sf_dir):
    return O.dominated(O.counts(_rows(spark, sf_dir)))


def topic_misaligned(spark, sf_dir):
    return O.misaligned(O.counts(_rows(spark, sf_dir)))


def expand_blocked(spark, sf_dir):
    """Blocked are the phrases of up to twelve characters that turns are made of, and the names of roles."""
    r = _rows(spark, sf_dir)
    phrases = r.select(F.explode(F.regexp_extract_all("gap", F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))).alias("phrase")).filter("length(phrase) <= 12")
    roles = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("role").alias("phrase"))
    return O.expand_blocked(phrases.unionByName(roles).distinct())


def topic_blocked(spark, sf_dir):
    blocked = O.expand_blocked(spark.createDataFrame([(p,) for p in O.FRAGMENTS], "phrase string"))
    return O.counts(_rows(spark, sf_dir)).join(blocked, "gram", "left_anti").select("gram", "cnt")


def topic_dedupe(spark, sf_dir):
    return O.dedupe(O.counts(_rows(spark, sf_dir)).filter(F.length("gram") <= O.SHOWN)).select("gram", "cnt")


def topic_candidates(spark, sf_dir):
    return O.candidates(_rows(spark, sf_dir))


def guess_form(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.guess_form(F.col("path"), F.col("text")).alias("form"))


def sections(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.posexplode(L.sections(F.col("text"))).alias("ord", "s")).select("doc_id", "ord", "s.level", "s.title", F.length("s.body").alias("n"))


def lint_hygiene(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.hygiene(F.col("text")).alias("n"))


def lint_chars(spark, sf_dir):
    d = _md(spark, sf_dir).withColumn("form", L.guess_form(F.col("path"), F.col("text")))
    return d.select("doc_id", "form", T.word_count(F.col("text")).alias("chars"))


def lint_budget(spark, sf_dir):
    d = _md(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n## 八、原文参考文献\n[1] x\n### y\nz\n## 九、end\nlast")))
    return d.select("doc_id", F.length(L.budget(F.col("text"), F.lit("A"))).alias("n"))


def lint_banned(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.array_join(L.banned(F.col("text")), ",").alias("phrases"))


def lint_abbr(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.explode(L.abbreviations(F.col("text"))).alias("a")).select("doc_id", "a.name", "a.place")


def lint_gap(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.size(L.gaps_without_reasons(F.col("text"))).alias("n"))


def lint_paragraphs(spark, sf_dir):
    # lines are the paragraphs, as the texts have no blank lines
    n, led, density = L.paragraphs(F.col("text"), F.lit(300), "\n")
    return _md(spark, sf_dir).select("doc_id", n.alias("n"), led.alias("led"), density.alias("density"))


def lint_locator(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.regexp_count(F.col("text"), F.lit(L.LOCATOR)).alias("n"))


def lint_codes(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.size(L.missing_fields(F.col("text"))).alias("n"))


def lint_merged(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", F.col("text").rlike(L.MERGED).alias("hit"))


def lint_limits(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", L.unattributed_limits(F.col("text")).alias("hit"))


def lint_findings(spark, sf_dir):
    return L.findings(_md(spark, sf_dir).withColumn("path", F.concat("path", "doc_id")))


def lint_rollup(spark, sf_dir):
    return L.rollup(lint_findings(spark, sf_dir))


def lint_json(spark, sf_dir):
    found = lint_findings(spark, sf_dir).groupBy("path", "form").agg(F.array_sort(F.collect_list(F.struct("rule", "severity", "n"))).alias("findings"))
    return found.select("path", F.to_json(F.struct("path", "form", "findings")).alias("json"))


def fuzzy_match(spark, sf_dir):
    """Of each benchmark item the turn of a conversation that is most like it."""
    left = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("item"))
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("item"))
    return C.fuzzy_match(left, turns)


def card_segment(spark, sf_dir):
    return _docs(spark, sf_dir).selectExpr("doc_id", CARD).select("doc_id", T.card_clean(C.segment(F.col("text"), "现有文献研究空白")).alias("segment"))


def card_judge(spark, sf_dir):
    return _docs(spark, sf_dir).selectExpr("doc_id", CARD).select("doc_id", C.judge(F.col("text"), "现有文献研究空白").alias("verdict"))


HARD = ("quality-0", "quality-7", "quality-14", "toxic-7")


def card_agreement(spark, sf_dir):
    """Labels by two annotators: the second one errs on every seventh document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    second = labels.selectExpr("doc_id", "CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    both = labels.select("doc_id", "quality", "toxic", F.lit(1).alias("card")).unionByName(second.withColumn("card", F.lit(2)))
    values = both.select("card", F.explode(F.array(*(F.struct(F.concat(F.lit(f"{c}-"), "doc_id").alias("field"), F.col(c).alias("value")) for c in ("quality", "toxic")))).alias("x")).select("card", "x.field", "x.value")
    return C.agreement(values, HARD)


QUERIES = {f.__name__: f for f in (strip_citations, strip_boilerplate, word_tokens, ngram_tokens, topic_counts, topic_dominated, topic_misaligned, expand_blocked, topic_blocked, topic_dedupe, topic_candidates, guess_form, sections, lint_hygiene, lint_chars, lint_budget, lint_banned, lint_abbr, lint_gap, lint_paragraphs, lint_locator, lint_codes, lint_merged, lint_limits, lint_findings, lint_rollup, lint_json, fuzzy_match, card_segment, card_judge, card_agreement)}

_CITE = O.CITATION


def _boiler(x: str) -> str:
    for p in (*O.BOILERPLATE, *O.VERBS, O.PARTICLE):
        x = f"replace({x}, '{p}', '·')"
    return x


def _words(x: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace({x}, '{_CITE}', ' ', 'g')), '[a-z]{{3,}}')"


def _grams(x: str) -> str:
    runs = f"regexp_extract_all({_boiler(f'''regexp_replace({x}, '{_CITE}', ' ', 'g')''')}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')"
    windows = "lambda r: flatten(list_transform(range(2, least(12, length(r)) + 1), lambda n: list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n))))"
    return f"list_filter(flatten(list_transform({runs}, {windows})), lambda g: NOT contains('{O.STOP_CHARS}', left(g, 1)))"


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(O.STOPWORDS))
_TOKENS = " UNION ALL ".join(f"SELECT row_no, {k} AS field, unnest(t) AS gram, unnest(range(len(t))) AS token FROM (SELECT row_no, list_concat(list_filter({_words(f)}, lambda w: w NOT IN ({_STOP})), {_grams(f)}) AS t FROM m)" for f, k in (("spl", 0), ("rof", 1), ("gap", 3)))
_COUNTS = f"WITH {ROWS}, tok AS ({_TOKENS}), c AS (SELECT gram, count(*) AS cnt, min((row_no * 10 + field) * 100000 + token) AS first FROM tok GROUP BY 1 HAVING count(*) >= 2)"
_SUBS = "unnest(flatten(list_transform(range(2, length({g}) + 1), lambda n: list_transform(range(1, length({g}) - n + 2), lambda i: substr({g}, i, n)))))"
_FRAG = ", ".join(f"'{w}'" for w in O.FRAGMENTS)
_DOM = f"dom AS (SELECT DISTINCT c.gram FROM c JOIN (SELECT gram AS whole, cnt, {_SUBS.format(g='gram')} AS sub FROM c WHERE length(gram) <= 6) s ON s.sub = c.gram AND s.cnt = c.cnt AND s.whole <> c.gram)"
_MIS = "mis AS (SELECT DISTINCT c.gram FROM c JOIN c o ON length(o.gram) = length(c.gram) + 1 AND (substr(o.gram, 2) = c.gram OR left(o.gram, length(o.gram) - 1) = c.gram) AND o.cnt >= c.cnt WHERE length(c.gram) >= 3)"


def _blocked(words: str) -> str:
    return f"bl AS (SELECT DISTINCT CASE WHEN regexp_matches(p, '^[\\x00-\\x7f]*$') THEN p ELSE s END AS gram FROM (SELECT p, {_SUBS.format(g='p')} AS s FROM (SELECT unnest([{words}]) AS p)))"


_GENERIC = " OR ".join(f"(starts_with(gram, '{p}') AND substr(gram, {len(p) + 1}) IN ({_FRAG}))" for p in O.PREFIXES)
_DEDUPE = "SELECT gram, cnt, first FROM {t} a WHERE NOT EXISTS (SELECT 1 FROM {t} b WHERE b.gram <> a.gram AND contains(b.gram, a.gram) AND b.cnt >= a.cnt * 0.6)"
_HEADS = r"array_to_string(regexp_extract_all(text, '(?m)^[ \t]{0,3}#{1,6}[ \t]*[^ \t\n#].*$'), chr(10))"
_FORM = f"""CASE WHEN starts_with(path, 'references/') THEN 'doc' WHEN contains({_HEADS}, '一句话结论') AND contains({_HEADS}, '三条要点') THEN 'quick' WHEN contains({_HEADS}, '对比矩阵') AND contains({_HEADS}, '共识与分歧') THEN 'C'
 WHEN contains({_HEADS}, '综述摘要') AND contains({_HEADS}, '文献范围与筛选说明') THEN 'B' WHEN contains(path, '解码卡') THEN 'card' WHEN contains(path, '速览') THEN 'quick' WHEN contains(path, '对比') THEN 'C' WHEN contains(path, '综述') THEN 'B' WHEN contains(path, '导读') THEN 'A' WHEN contains(text, '作者要做什么') THEN 'A' ELSE 'B' END"""
_CHARS = r"len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z]+'))"

#: A phrase, if before one of its places none of the marks stands in the last characters.
_USED = "CASE WHEN len(list_filter(range(1, len(string_split(text, '{w}'))), lambda i: NOT regexp_matches(right(array_to_string(list_slice(string_split(text, '{w}'), 1, i), '{w}'), {near}), '{marks}'))) > 0 THEN '{w}' END"

ORACLES = {
    "strip_citations": f"WITH {ROWS} SELECT row_no, regexp_replace(concat(rof, ' Brown et al. 2020, ', spl), '{_CITE}', ' ', 'g') AS text FROM m",
    "strip_boilerplate": f"WITH {ROWS} SELECT row_no, {_boiler('concat(rof, gap)')} AS text FROM m",
    "word_tokens": f"SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) GROUP BY 1",
    "ngram_tokens": f"WITH {ROWS} SELECT row_no, array_to_string({_grams('gap')}, '|') AS grams FROM m",
    "topic_counts": f"{_COUNTS} SELECT gram, cnt FROM c",
    "topic_dominated": f"{_COUNTS}, {_DOM} SELECT gram FROM dom",
    "topic_misaligned": f"{_COUNTS}, {_MIS} SELECT gram FROM mis",
    "expand_blocked": f"WITH {ROWS}, p AS (SELECT DISTINCT p FROM (SELECT unnest(regexp_extract_all(gap, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')) AS p FROM m) WHERE length(p) <= 12 UNION SELECT role FROM conversations) SELECT DISTINCT CASE WHEN regexp_matches(p, '^[\\x00-\\x7f]*$') THEN p ELSE s END AS gram FROM (SELECT p, {_SUBS.format(g="p")} AS s FROM p)",
    "topic_blocked": f"{_COUNTS}, {_blocked(_FRAG)} SELECT gram, cnt FROM c WHERE gram NOT IN (SELECT gram FROM bl)",
    "topic_dedupe": f"{_COUNTS}, s AS (SELECT * FROM c WHERE length(gram) <= 6), z AS ({_DEDUPE.format(t='s')}) SELECT gram, cnt FROM z",
    "topic_candidates": f"{_COUNTS}, {_DOM}, {_MIS}, {_blocked(_STOP + ', ' + _FRAG)}, s AS (SELECT * FROM c WHERE gram NOT IN (SELECT gram FROM dom UNION SELECT gram FROM mis UNION SELECT gram FROM bl) AND NOT ({_GENERIC}) AND (length(gram) <= 6 OR regexp_matches(gram, '^[a-z]+$'))), z AS ({_DEDUPE.format(t='s')}) SELECT gram, cnt FROM z ORDER BY cnt DESC, first LIMIT 25",
    "guess_form": f"WITH {DOCS} SELECT doc_id, {_FORM} AS form FROM d",
    "lint_hygiene": f"WITH {DOCS} SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`\\n]*`', '', 'g'), '{HTML_ENTITY}')) AS n FROM d",
    "lint_chars": f"WITH {DOCS} SELECT doc_id, {_FORM} AS form, {_CHARS} AS chars FROM d",
    "lint_budget": f"WITH {DOCS} SELECT doc_id, length(text) + 1 + length('## 九、end') + 1 + length('last') + 1 AS n FROM d",
    "lint_banned": f"WITH {DOCS}, c AS (SELECT doc_id, regexp_replace(text, '(?s)<!--.*?-->', '', 'g') AS text FROM d) SELECT doc_id, concat_ws(',', " + ", ".join(_USED.format(w=w, near=L.NEAR, marks="|".join(L.MENTIONS)) for w in L.BANNED) + ") AS phrases FROM c",
    "lint_paragraphs": f"WITH {DOCS}, p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')), lambda x: x <> '') AS p FROM d) SELECT doc_id, len(p) AS n, len(list_filter(p, lambda x: regexp_matches(x, '{L.AUTHOR_LEAD}'))) AS led, CAST(len(regexp_extract_all(text, '{L.YEAR_CITE}')) AS DOUBLE) AS density FROM p",
    "lint_locator": f"WITH {DOCS} SELECT doc_id, len(regexp_extract_all(text, '{L.LOCATOR}')) AS n FROM d",
    "lint_codes": f"WITH {DOCS} SELECT doc_id, " + " + ".join(f"CASE WHEN contains(text, '{n}') THEN 0 ELSE 1 END" for n in L.FIELD_NAMES) + " AS n FROM d",
    "lint_merged": f"WITH {DOCS} SELECT doc_id, regexp_matches(text, '{L.MERGED}') AS hit FROM d",
    "lint_limits": f"WITH {DOCS} SELECT doc_id, contains(text, '局限') AND NOT regexp_matches(right(split_part(text, '局限', 1), 12), '{'|'.join(L.ATTRIBUTIONS)}') AND NOT contains(text, '本文评述') AS hit FROM d",
    "fuzzy_match": r"""WITH g AS (SELECT 0 AS side, item_id AS id, regexp_replace(text, '[^\x{4e00}-\x{9fff}A-Za-z0-9]', '', 'g') AS s FROM benchmark UNION ALL SELECT 1, conv_id * 1000 + turn, regexp_replace(text, '[^\x{4e00}-\x{9fff}A-Za-z0-9]', '', 'g') FROM conversations),
 b AS (SELECT side, id, list_distinct(list_transform(range(1, len(s)), lambda i: s[i] || s[i + 1])) AS g FROM (SELECT side, id, string_split(s, '') AS s FROM g) WHERE len(s) > 1),
 j AS (SELECT l.id AS left_id, r.id AS right_id, len(list_intersect(l.g, r.g)) / (len(l.g) + len(r.g) - len(list_intersect(l.g, r.g))) AS jaccard FROM b l, b r WHERE l.side = 0 AND r.side = 1)
 SELECT left_id, right_id, jaccard FROM j WHERE jaccard >= 0.34 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY jaccard DESC, right_id) = 1""",
    "card_segment": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE doc_id % 2 WHEN 0 THEN '作者未提出空白。' ELSE '空白在于课堂互动。' END WHEN 1 THEN concat(lang, ' ', source) ELSE '' END AS segment FROM documents",
    "card_judge": f"SELECT doc_id, CASE WHEN s = '' THEN '缺失' WHEN regexp_matches(s, '{C.DENIED}') THEN '未提出' ELSE '有' END AS verdict FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE doc_id % 2 WHEN 0 THEN '作者未提出空白。' ELSE '空白在于课堂互动。' END WHEN 1 THEN concat(lang, ' ', source) ELSE '' END AS s FROM documents)",
    "card_agreement": "WITH v AS (SELECT 'quality-' || doc_id AS field, unnest([quality, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END]) AS value FROM labels UNION ALL SELECT 'toxic-' || doc_id, unnest([toxic, toxic]) FROM labels) SELECT field, count(*) AS n_cards, count(DISTINCT value) AS n_values, count(DISTINCT value) = 1 AS agree, field IN ('quality-0', 'quality-7', 'quality-14', 'toxic-7') AS hard FROM v GROUP BY 1",
}
