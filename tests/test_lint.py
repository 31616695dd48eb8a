import random
import time
from fractions import Fraction

from pyspark.sql import functions as F

from scriptorium.operators import cards as C
from scriptorium.operators import lint as L
from scriptorium.operators import matrix as M


def one(spark, text, function):
    return spark.createDataFrame([(text,)], "x string").select(function(F.col("x")).alias("y")).collect()[0]["y"]


def test_abbreviations(spark):
    got = one(spark, "结果（WTD / ROF）及 SPL\n| GAP | x |\n```\nWIL\n```\n<!-- MOP -->GAPS 依据（必要性）RAT〔RCL〕", L.abbreviations)
    assert [(a["name"], a["place"]) for a in got] == [("WTD", "paren"), ("ROF", "paren"), ("SPL", "bare"), ("GAP", "table"), ("RAT", "bare"), ("RCL", "paren")]


def test_mentions(spark):
    assert one(spark, "禁止写「方法有待加强」", L.banned) == []
    assert one(spark, "禁止写「方法有待加强」。本文认为其整体设计与实施方法有待加强", L.banned) == ["方法有待加强"]
    assert one(spark, "作者自陈局限", L.unattributed_limits) is False
    assert one(spark, "该研究有局限", L.unattributed_limits) is True


def test_gaps(spark):
    assert one(spark, "## 四、批评与空白\nx\n### 4.2\n理论依据\n## 五\ny", L.gaps_without_reasons) == []
    assert one(spark, "## 四、空白\nx\n## 五、理论依据\ny", L.gaps_without_reasons) == []
    assert one(spark, "## 四、空白\nx\n## 五\ny\n## 六 理论依据", L.gaps_without_reasons) == ["四、空白"]


def test_hygiene(spark):
    assert one(spark, "a&quot;b \\1协 `&amp;` x&#x7684;", L.hygiene) == 3


def test_findings(spark):
    docs = spark.createDataFrame([("references/a.md", "有待进一步研究 &amp;"), ("out/b.md", "有待进一步研究")], "path string, text string")
    found = {(r["path"], r["rule"]) for r in L.findings(docs).collect()}
    assert ("references/a.md", "hygiene") in found and ("references/a.md", "banned") not in found and ("out/b.md", "banned") in found
    assert L.rollup(L.findings(docs)).collect()[0]["failed"] == 2


def test_cards(spark):
    card = "## 3. 档位判据与空白判定\n有\n## 2.1 研究空白（GAP）\n作者未提出空白。"
    assert one(spark, card, lambda c: C.judge(c, "现有文献研究空白")) == "未提出"
    assert one(spark, "| 批评点 | 样本过小 |", lambda c: C.segment(c, "批评点")) == "样本过小"


def test_matrix_headers():
    at, unknown, again = M.resolve(["序号", "Author", "年份", "批评点", "待探讨的相关问题", "POC", "??"])
    assert at == {"no": 0, "author": 1, "year": 2, "poc": 3, "rpp": 4} and unknown == ["??"] and again == ["POC"]


def items(rng, alphabet, n):
    """A text of n distinct bigrams at least: letters drawn until there are so many."""
    out = [rng.choice(alphabet)]
    while len({a + b for a, b in zip(out, out[1:])}) < min(n, len(alphabet) ** 2):
        out.append(rng.choice(alphabet))
    return "".join(out)


def bigrams(s):
    return {a + b for a, b in zip(s, s[1:])}


def best_by_pairs(left, right, num, den):
    out = {}
    for i, x in left:
        scored = [(Fraction(len(bigrams(x) & bigrams(y)), len(bigrams(x) | bigrams(y))), -j) for j, y in right if bigrams(x) and bigrams(y)]
        if scored and max(scored)[0] >= Fraction(num, den):
            out[i] = (-max(scored)[1], float(max(scored)[0]))
    return out


def matched(spark, left, right, **more):
    df = [spark.createDataFrame(x, "id long, item string") for x in (left, right)]
    return {r["left_id"]: (r["right_id"], r["jaccard"]) for r in C.fuzzy_match(*df, **more).collect()}


def test_fuzzy_match_at_the_threshold(spark):
    """Exactly 34 of 100 bigrams, at sizes where the product of doubles is above the whole number; and one bigram less."""
    left, right = [], []
    for k, n in enumerate((50, 100, 150, 300, 350, 600, 650)):
        whole = [chr(0x4E00 + 2000 * k + i) for i in range(n + 1)]
        share = n * 34 // 100
        left.append((k, "".join(whole)))
        right += [(10 * k, "".join(whole[: share + 1])), (10 * k + 1, "".join(whole[:share]))]
    got = matched(spark, left, right)
    assert got == best_by_pairs(left, right, 34, 100) and {k: r for k, (r, _) in got.items()} == {k: 10 * k for k in range(7)}
    assert all(j == 0.34 for _, j in got.values())


def test_fuzzy_match_against_all_pairs(spark):
    rng = random.Random(2)
    left = [(i, items(rng, "abcdefgh"[: rng.randrange(2, 9)], 3)) for i in range(60)] + [(60, ""), (61, "a"), (62, "学习教师课堂")]
    right = [(i, items(rng, "abcdefgh"[: rng.randrange(2, 9)], rng.randrange(2, 9))) for i in range(60)] + [(60, "学习教师课堂"), (61, "学习教师课堂"), (62, "")]
    for t, num, den in ((0.34, 34, 100), (0.5, 1, 2), (0.9, 9, 10)):
        assert matched(spark, left, right, threshold=t) == best_by_pairs(left, right, num, den)


def test_bounds_leave_out_candidates(spark):
    rng = random.Random(4)
    drawn = lambda: [chr(0x4E00 + x) for x in sorted(rng.sample(range(400), rng.choice((10, 40, 160))))]
    rows = [spark.createDataFrame([(i, len(g), g) for i, g in enumerate(drawn() for _ in range(300))], "id long, n long, g array<string>") for _ in range(2)]
    t = Fraction(34, 100)
    every, some = (C.candidate_pairs(*rows, t, bounds).count() for bounds in (False, True))
    assert some < 0.8 * every


def test_sections_in_linear_time(spark):
    def took(n):
        df = spark.createDataFrame([("".join(f"{'#' * (1 + i % 6)} 空白 {i}\n文字 WTD（ROF）\n" for i in range(n)),)], "x string")
        best = []
        for _ in range(3):
            start = time.perf_counter()
            gaps, abbr = df.select(F.size(L.gaps_without_reasons(F.col("x"))), F.size(L.abbreviations(F.col("x")))).first()
            best.append(time.perf_counter() - start)
            assert (gaps, abbr) == (n, 2 * n)
        return min(best)

    small = took(4000)
    assert took(8000) <= 2 * small + 0.3


def test_one_pass_finds_every_phrase():
    """No banned phrase begins inside another one, so one alternation finds each."""
    for a in L.BANNED:
        for b in L.BANNED:
            assert a == b or (a not in b and not any(a.endswith(b[:k]) for k in range(1, len(b))))
