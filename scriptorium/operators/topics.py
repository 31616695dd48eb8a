"""Topic candidates: words and Han n-grams that recur, without fragments of longer phrases.

Order is part of the meaning: citations and set phrases are cut first, then n-grams are counted; fragments are found among all
of them; stop words, generic prefixes and the length cap come after; contained n-grams go last, and only then the top is taken.
Quadratic comparisons of n-grams are joins on their substrings here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.session import cut

#: Longest n-gram counted, longest shown, columns used.
MAX_GRAM, SHOWN, FIELDS = 12, 6, ("spl", "rof", "cpl", "gap")
#: What is cut in this order, and a particle; Han characters with which no n-gram begins.
BOILERPLATE = ("已有研究", "已有文献", "现有研究", "现有文献", "前人研究", "相关研究", "大量研究", "多数研究", "研究表明", "研究发现", "研究指出", "研究认为", "研究已")
VERBS = ("考察", "提出", "分析", "探讨", "讨论", "揭示", "梳理", "综述", "检验", "验证", "建议", "指出", "表明", "认为", "强调", "采用", "使用")
PARTICLE, BOUNDARY, STOP_CHARS = "的", "·", "的了和与或在是有为对从被把将及其之乎者也"
#: Generic prefixes, and rests behind them that make a phrase generic.
PREFIXES = ("研究", "分析", "影响", "考察", "检验", "方法", "结果", "存在", "缺乏", "提出", "采用", "使用", "建立", "发现", "表明", "机制")
FRAGMENTS = ("研究", "研究已", "研究存", "存在", "已有", "有研究", "没有", "不能", "不足", "缺乏", "影响", "影响因素", "因素", "考察", "检验", "检验了", "表明", "指出", "显示", "证明", "报告", "分析", "分析了", "使用", "采用", "引入", "建立", "构建", "提出", "探讨", "讨论", "关注", "重视", "机制", "机制未", "未验证", "未考察", "未整合", "未明确", "未量化", "不明确", "方法研究", "研究框架", "框架", "维度", "层面", "角度", "视角", "价值研究", "较为", "相对", "更为", "更加", "十分", "非常", "尤其", "其中", "以上", "以下", "之间", "之后", "之前")
#: Words left out by default: function words and set phrases that prescribed wording fills cells with. Longer lists are a parameter (a file, one word a line).
STOPWORDS = tuple(
    "研究 分析 本文 一个 及其 通过 进行 对于 关于 以及 但是 因此 所以 可以 能够 需要 应该 不同 相关 方面 问题 方法 结果 结论 本研究 表明 "
    "指出 提出 发现 存在 具有 成为 一种 一些 这些 那些 其中 如果 由于 同时 此外 目前 主要 重要 影响 作用 关系 变化 发展 水平 程度 "
    "作者未对前人文献提出批评 作者未提出空白 作者未明示空白 作者未对 作者未 本文评述推断 评述推断 前人文献提出批评 提出批评 "
    "相反发现 未报告相反 作者自陈 未自陈 未提出空白 作者未报告 研究空白 空白栏 批评点 遗漏点 待探讨 逻辑能否走通（能否自圆其说） "
    "未明示空白 未以空白句式明示 作者未对具体 作者未点名 有真实数据 真实数据 无实证数据 有调查数据 既有研究 既有文献 先前研究 前人工作 "
    "无数据 无实证 无样本 未给样本 但未给样本 未注明样本 无前后测 无统计 无测量 无量化 作者明示 作者未提出 作者未明示 作者期待 "
    "已有研究 已有文献 现有研究 现有文献 前人研究 相关研究 大量研究 多数研究 研究表明 研究发现 研究指出 研究认为 研究者 学者 学界 "
    "the and for that with this from are was were has have not but which gap gaps study studies research article paper review "
    "however therefore thus although while finding findings result results also more most such other used using der die das und les des que los las".split()
)
#: Citations in brackets, with et al., and of two names.
CITATION = r"[（(][^（()）\n]{0,80}?(?:19|20)[0-9]{2}[a-z]?[^（()）\n]{0,30}?[）)]|[A-Z][a-z]{2,}(?:\s*(?:&|and|、|，|,)\s*[A-Z][a-z]{2,})*\s+et\s+al\.?,?\s*(?:19|20)[0-9]{2}|[A-Z][a-z]{2,}\s*(?:&|and)\s*[A-Z][a-z]{2,}\s*,?\s*(?:19|20)[0-9]{2}"
HAN = r"[\x{4e00}-\x{9fff}]"


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, " ")


def strip_boilerplate(c: Column) -> Column:
    for phrase in (*BOILERPLATE, *VERBS, PARTICLE):
        c = F.replace(c, F.lit(phrase), F.lit(BOUNDARY))
    return c


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(strip_citations(c)), F.lit("[a-z]{3,}"), F.lit(0))


def ngram_tokens(c: Column, longest: int = MAX_GRAM) -> Column:
    """All windows of 2 to longest characters of each run of Han characters, by run, length and place, but for those a stop character begins."""
    runs = F.regexp_extract_all(strip_boilerplate(strip_citations(c)), F.lit(HAN + "{2,}"), F.lit(0))

    def windows(run: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), F.length(run))), lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substr(run, i, n))))

    return F.filter(F.flatten(F.transform(runs, windows)), lambda g: ~F.contains(F.lit(STOP_CHARS), F.left(g, F.lit(1))))


#: Lengths of n-grams that are counted together; what is not frequent at the longest of a step begins no longer one.
STEPS = ((2, 4), (5, MAX_GRAM))


def counts(rows: DataFrame, fields: tuple[str, ...] = FIELDS, stopwords: tuple[str, ...] = STOPWORDS, least: int = 2) -> DataFrame:
    """(gram, cnt, first): n-grams and words of the fields found at least so often, and where first (row_no, field, words before n-grams, run, length, place).

    Equal runs of Han characters are counted once, with their number and first place. N-grams grow by STEPS: longer ones are only
    counted where every one of the step before inside them is frequent, since none can be more frequent than a part of it.
    """
    values = F.array(*(F.struct(F.lit(k).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("v")) for k, c in enumerate(fields) if c in rows.columns))
    v = rows.select("row_no", F.explode(values).alias("x")).select("row_no", "x.field", "x.v")
    place = lambda kind, a, n, i: F.struct("row_no", "field", F.lit(kind).alias("kind"), F.col(a).alias("a"), n.alias("n"), i.alias("i"))
    words = v.select("row_no", "field", F.posexplode(F.filter(word_tokens(F.col("v")), lambda w: ~w.isin(*stopwords))).alias("at", "gram"))
    out = cut(words.groupBy("gram").agg(F.count("*").alias("cnt"), F.min(place(0, "at", F.lit(0), F.lit(0))).alias("first")).filter(F.col("cnt") >= least))
    runs = v.select("row_no", "field", F.posexplode(F.regexp_extract_all(strip_boilerplate(strip_citations(F.col("v"))), F.lit(HAN + "{2,}"), F.lit(0))).alias("at", "run"))
    runs = runs.groupBy("run").agg(F.count("*").alias("times"), F.min(F.struct("row_no", "field", "at")).alias("p"))
    # a part of a run: its text and where in the run it begins
    parts = cut(runs.select("times", "p.*", F.lit(0).alias("begin"), F.col("run").alias("part")))
    for shortest, longest in STEPS:
        found = _windows(parts, shortest, longest).groupBy("gram").agg(F.sum("times").alias("cnt"), F.min(place(1, "at", F.length("gram"), F.col("i"))).alias("first"))
        found = cut(found.filter(F.col("cnt") >= least))
        out = out.unionByName(found)
        if longest < MAX_GRAM:
            parts = _frequent_parts(parts, found.filter(F.length("gram") == longest).select("gram"), longest) if least > 1 else parts
    return out.filter(~F.contains(F.lit(STOP_CHARS), F.left("gram", F.lit(1))))


def _windows(parts: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Every window of so many characters of each part, with its place (i) in the run."""
    n = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("part")))
    grams = F.flatten(F.transform(n, lambda n: F.transform(F.sequence(F.lit(1), F.length("part") - n + 1), lambda i: F.struct((F.col("begin") + i).alias("i"), F.substr("part", i, n).alias("gram")))))
    return parts.filter(F.length("part") >= shortest).select("times", "row_no", "field", "at", F.explode(grams).alias("w")).select("times", "row_no", "field", "at", "w.i", "w.gram")


def _frequent_parts(parts: DataFrame, frequent: DataFrame, n: int) -> DataFrame:
    """The stretches of parts of over n characters in which every window of n is frequent."""
    known = F.broadcast(frequent) if frequent.limit(200_001).count() <= 200_000 else frequent
    alive = _windows(parts, n, n).join(known, "gram", "left_semi").groupBy("row_no", "field", "at").agg(F.array_sort(F.collect_set("i")).alias("places"))
    # places in a row have the same difference to their rank: one stretch each
    stretches = F.transform("places", lambda i, k: F.struct((i - k).alias("key"), i.alias("i")))
    each = parts.join(alive, ["row_no", "field", "at"]).select("times", "row_no", "field", "at", "begin", "part", F.explode(stretches).alias("s"))
    ends = each.groupBy("times", "row_no", "field", "at", "begin", "part", "s.key").agg(F.min("s.i").alias("low"), F.max("s.i").alias("high"))
    inside = ends.filter((F.col("low") > F.col("begin")) & (F.col("high") + n - 1 <= F.col("begin") + F.length("part")) & (F.col("high") > F.col("low")))
    return cut(inside.select("times", "row_no", "field", "at", (F.col("low") - 1).alias("begin"), F.substr("part", (F.col("low") - F.col("begin")).cast("int"), (F.col("high") - F.col("low") + n).cast("int")).alias("part")))


def substrings(g: Column) -> Column:
    """All substrings of at least 2 characters, itself included."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.length(g), F.lit(2))), lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(g) - n + 1, F.lit(1))), lambda i: F.substr(g, i, n)), lambda x: F.length(x) == n))))


def dominated(c: DataFrame, longest: int = SHOWN) -> DataFrame:
    """(gram): n-grams inside another of at most so many characters with the same count."""
    sub = c.filter(F.length("gram") <= longest).select(F.col("gram").alias("whole"), "cnt", F.explode(substrings(F.col("gram"))).alias("gram")).filter("gram <> whole").select("gram", "cnt")
    return c.select("gram", "cnt").join(sub, ["gram", "cnt"], "left_semi").select("gram")


def misaligned(c: DataFrame, least: int = 3) -> DataFrame:
    """(gram): n-grams that another at least as frequent, longer by its first or last character, shifts."""
    trims = F.array(F.substring("gram", 2, 1 << 20), F.left(F.col("gram"), F.length("gram") - 1))
    other = c.filter(F.length("gram") > least).select(F.explode(trims).alias("gram"), F.col("cnt").alias("over")).groupBy("gram").agg(F.max("over").alias("over"))
    return c.select("gram", "cnt").filter(F.length("gram") >= least).join(other, "gram").filter("over >= cnt").select("gram")


def expand_blocked(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    """(gram): substrings of Han phrases; phrases in ASCII letters as they are."""
    g = F.when(F.col(column).rlike(r"\A[\x00-\x7f]*\z"), F.array(column)).otherwise(substrings(F.col(column)))
    return phrases.select(F.explode(g).alias("gram")).distinct()


def dedupe(c: DataFrame, ratio: float = 0.6) -> DataFrame:
    """c without n-grams inside another at least ratio times as frequent."""
    inner = c.select(F.col("gram").alias("whole"), F.col("cnt").alias("over"), F.explode(substrings(F.col("gram"))).alias("gram")).filter("gram <> whole").groupBy("gram").agg(F.max("over").alias("over"))
    return c.join(inner, "gram", "left").filter(F.col("over").isNull() | (F.col("over") < F.col("cnt") * ratio)).drop("over")


def generic(g: Column) -> Column:
    """A generic prefix with a generic rest."""
    hit = F.lit(False)
    for p in PREFIXES:
        hit = hit | (F.startswith(g, F.lit(p)) & F.substring(g, len(p) + 1, 1 << 20).isin(*FRAGMENTS))
    return hit


def candidates(rows: DataFrame, top: int = 25, fields: tuple[str, ...] = FIELDS, stopwords: tuple[str, ...] = STOPWORDS, keep: tuple[str, ...] = (), cap_words: bool = False) -> DataFrame:
    """(gram, cnt) of the top topics by count, then first place. The length cap holds for Han n-grams; with cap_words for words too."""
    spark = rows.sparkSession
    c = counts(rows, fields, stopwords)
    blocked = expand_blocked(spark.createDataFrame([(p,) for p in dict.fromkeys((*stopwords, *FRAGMENTS))], "phrase string"))
    bad = dominated(c).unionByName(misaligned(c)).unionByName(blocked).distinct()
    kept = F.col("gram").isin(*keep) if keep else F.lit(False)
    free = c.join(bad.filter(~kept), "gram", "left_anti").filter(kept | ~generic(F.col("gram")))
    short = (F.length("gram") <= SHOWN) if cap_words else (F.length("gram") <= SHOWN) | F.col("gram").rlike(r"\A[a-z]+\z")
    return dedupe(free.filter(short)).orderBy(F.col("cnt").desc(), "first").limit(top).select("gram", "cnt")
