"""The evidence matrix: completeness, coverage and suspicious columns. Blank is missing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T

#: Required and recommended columns, and headers by which columns go (lower case, without blanks and marks).
REQUIRED, RECOMMENDED = ("author", "year", "spl", "rof"), ("cpl", "gap", "rat", "wtd", "wtdd", "rfw", "poc")
ALIASES = {
    "no": ("序号", "编号", "id", "index", "#"), "author": ("作者", "authors", "作者年"), "year": ("年份", "年", "date"), "title": ("标题", "题目", "篇名"), "source": ("来源", "期刊", "出处", "journal", "venue"),
    "spl": ("现有文献综述", "前人研究", "spl主题"), "cpl": ("作者对现有文献的批评", "cplgap", "批评"), "gap": ("现有文献研究空白", "研究空白", "空白", "gap空白"), "rof": ("研究结果作者发现了什么", "研究结果", "主要发现", "rof发现"),
    "rfw": ("作者对未来研究的建议", "未来研究"), "rat": ("理论依据研究的必要性", "理论依据", "理论", "依据"), "rcl": ("与现有文献观点一致的研究发现", "一致发现", "与既有文献的一致"), "rtc": ("与现有文献观点相反的研究发现", "相反发现", "与既有文献的冲突"),
    "wtd": ("作者要做什么", "要做什么"), "wtdd": ("作者实际做了什么", "实际做了什么"), "mop": ("明显的遗漏点", "遗漏点", "明显遗漏"), "wil": ("逻辑能否走通能否自圆其说", "逻辑能否走通", "能否理清"), "topic": ("主题分类", "主题"),
    "oneline": ("一句话定位", "定位"), "poc": ("批评点", "批评点遗漏点"), "rpp": ("待探讨的相关问题", "待探讨问题", "待探讨", "批评点待探讨的相关问题", "批评点待探讨问题", "批评点与待探讨问题", "批评点与待探讨的相关问题", "pocrpp"),
}


#: Characters of a header that do not tell columns apart.
HEADER_MARKS = r"[\s_\-（）()·:：/／、,，]"


def resolve(headers: list[str]) -> tuple[dict[str, int], list[str], list[str]]:
    """Names of columns with their positions, headers unknown, and headers that repeat a column (the first holds)."""
    known = {a: k for k, names in ALIASES.items() for a in (k, *names)}
    at, unknown, again = {}, [], []
    for i, h in enumerate(headers):
        key = known.get(re.sub(HEADER_MARKS, "", (h or "").strip().lower()))
        if key is None:
            unknown.append(h)
        elif key in at:
            again.append(h)
        else:
            at[key] = i
    return at, unknown, again


def completeness(rows: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(row_no, missing): rows without a required cell and the columns that they lack, joined by commas."""
    lacking = F.array_compact(F.array(*(F.when(T.strip(T.or_blank(F.col(c))) == "", F.lit(c)) for c in columns)))
    return rows.select("row_no", F.array_join(lacking, ",").alias("missing")).filter("missing <> ''")


def coverage(rows: DataFrame, columns: tuple[str, ...] = REQUIRED + RECOMMENDED) -> DataFrame:
    """(field, filled, total) for each column; filled is null for a column that is not there."""
    have = [c for c in columns if c in rows.columns]
    sums = rows.agg(F.count("*").alias("total"), *(F.count_if(T.strip(T.or_blank(F.col(c))) != "").alias(f"n_{c}") for c in have))
    each = F.array(*(F.struct(F.lit(c).alias("field"), (F.col(f"n_{c}") if c in have else F.lit(None).cast("long")).alias("filled")) for c in columns))
    return sums.select(F.explode(each).alias("x"), "total").select("x.field", "x.filled", "total")


def dominance(rows: DataFrame, least: int = 3) -> DataFrame:
    """(author, n, total) if one author has at least max(least, half of the rows) and there are others; ties to the first seen."""
    filled = rows.withColumn("_a", T.or_blank(F.col("author")))
    by = filled.groupBy("_a").agg(F.count("*").alias("n"), F.min("row_no").alias("first"))
    known = by.filter("_a <> ''").agg(F.max_by(F.struct("_a", "n"), F.struct(F.col("n"), -F.col("first"))).alias("b"), F.count("*").alias("k"))
    total = by.agg(F.sum("n").alias("total"))
    return known.crossJoin(total).filter(F.col("b.n") >= F.greatest(F.lit(least), F.col("total") / 2)).filter("k > 1").select(F.col("b._a").alias("author"), F.col("b.n").alias("n"), "total")


def identical_columns(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(field, n): columns of at least 3 filled cells that all hold the same; smallest and largest value tell, without a distinct count."""
    parts = [F.struct(F.lit(c).alias("field"), F.min(F.nullif(F.col(c), F.lit(""))).alias("low"), F.max(F.nullif(F.col(c), F.lit(""))).alias("high"), F.count(F.nullif(F.col(c), F.lit(""))).alias("n")) for c in columns]
    return rows.agg(F.array(*parts).alias("xs")).select(F.explode("xs").alias("x")).filter("x.n >= 3 and x.low = x.high").select("x.field", "x.n")


def size_advice(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select("n", F.when(F.col("n") == 0, "blocking").when(F.col("n") == 1, "single").when(F.col("n") == 2, "comparison").otherwise("review").alias("advice"))


