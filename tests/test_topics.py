import random
import re
from collections import Counter

from pyspark.sql import functions as F

from scriptorium.operators import topics as O

HAN = "学习教师课堂互动深度的了，"


def rows(rng, n):
    return [(i, "".join(rng.choices(HAN, k=rng.randrange(0, 60))) + rng.choice(["", " class room", " 学习教师课堂互动深度学习教师课堂互动深度学习"]), "学习教师") for i in range(n)]


def by_loops(table, least):
    """Every window of every run, with the first place at which it stands: row, field, words before n-grams, run, length, place."""
    n, first = Counter(), {}

    def see(gram, place):
        n[gram] += 1
        first[gram] = min(first.get(gram, place), place)

    for row_no, *cells in table:
        for field, text in enumerate(cells):
            for k, w in enumerate(x for x in re.findall("[a-z]{3,}", text.lower()) if x not in O.STOPWORDS):
                see(w, (row_no, field, 0, k, 0, 0))
            for phrase in (*O.BOILERPLATE, *O.VERBS, O.PARTICLE):
                text = text.replace(phrase, O.BOUNDARY)
            for at, run in enumerate(re.findall("[\u4e00-\u9fff]{2,}", text)):
                for size in range(2, min(O.MAX_GRAM, len(run)) + 1):
                    for i in range(len(run) - size + 1):
                        if run[i] not in O.STOP_CHARS:
                            see(run[i : i + size], (row_no, field, 1, at, size, i + 1))
    return {g: (k, first[g]) for g, k in n.items() if k >= least}


def test_counts_against_all_windows(spark):
    table = rows(random.Random(1), 120)
    df = spark.createDataFrame(table, "row_no long, spl string, rof string")
    for least in (1, 2, 5):
        got = {r["gram"]: (r["cnt"], tuple(r["first"])) for r in O.counts(df, ("spl", "rof"), least=least).collect()}
        assert got == by_loops(table, least)


def test_longer_ones_only_where_parts_are_frequent(spark):
    """Of runs that share little, the second step sees a small part of the characters."""
    rng = random.Random(2)
    df = spark.createDataFrame([(1, i, 0, 0, 0, "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(200))) for i in range(200)], "times long, row_no long, field int, at int, begin int, part string")
    frequent = O._windows(df, 3, 3).groupBy("gram").agg(F.sum("times").alias("n")).filter("n >= 2").select("gram")
    parts = O._frequent_parts(df, frequent, 3)
    assert parts.agg(F.coalesce(F.sum(F.length("part")), F.lit(0))).first()[0] < 0.02 * 200 * 200


def test_no_rows(spark):
    assert O.counts(spark.createDataFrame([], "row_no long, spl string")).count() == 0
