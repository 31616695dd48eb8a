"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Sources share the words of the whole corpus by weight; no target exceeds max_repeat times its source (the excess is shared
again by weight: a water level, in closed form from one ordered pass over the table of sources). Inside a source a document's
expected number of copies falls with its length class, so that a few huge documents do not make the mix: again a water level,
over at most 64 classes. The whole part of that number is certain. Its fraction p is an inclusion probability: documents are
ranked by u/(1-u) divided by p/(1-p), u being a fixed random number of the document, and taken in this order until the source's
words are as near its target as whole documents get.

The rank's cut is found without gathering a source in one task: words are summed in BINS bins of the rank, the bin where the
target is met is found among the sums and divided into BINS again, and only the rows of the last bin are ordered. Every document then decides alone against its
source's cut, so text never moves.

Defined results: a null source is a source (last in order); null or blank text has size 0 and is never taken; rows with the
same id share one random number, and rows equal in rank, id and size share one decision; a null id counts as the empty id; an
empty table gives an empty result. Other columns of the input stay, whatever their names are; added names replace equal ones (in any case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Box, cut, n_words, small

#: Bins of the rank, and how often the bin that holds the cut is divided again: about 1 / BINS ** LEVELS of a source is ordered.
BINS, LEVELS = 1024, 2
#: A document of class k (2^k to 2^(k+1)-1 words) has the inclusion weight max(1, TOP_CLASS - k).
TOP_CLASS = 16


def _level(of: W, total: Column, cap: Column, weight: Column, share: Column, order: list[Column]) -> Column:
    """The water level if the rows before this one (in rising order of cap / share) are full; null if this row would be full too.

    The first value that is not null is the level t with sum(least(cap, t * share)) = total; without any, all rows are full.
    weight: share / cap.
    """
    before = F.coalesce(F.sum(cap).over(of.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(share).over(of.orderBy(*order).rowsBetween(0, W.unboundedFollowing))
    here = (total - before) / rest
    return F.when(here * weight <= F.lit(1.0), here)


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_columns: bool = True) -> DataFrame:
    """docs with size, source_size, target and copies (times the mix takes the document); without keep_columns only the id and these."""
    box = Box(docs, id=id_col, text=text_col, source=source_col)
    k = F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(-1)
    slim = box.df.select(F.col("id").alias("_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("size"))
    slim = cut(slim.select("*", k.cast("int").alias("_class"), _uniform(F.col("_id"), seed).alias("_u")))

    classes = slim.groupBy("_source", "_class").agg(F.sum("size").alias("words"))
    classes = cut(classes)
    sources = classes.groupBy("_source").agg(F.sum("words").alias("source_size"))
    one = W.partitionBy(F.lit(0))
    listed = F.array(*(F.lit(int(w)) for w in weights))
    rank = F.row_number().over(one.orderBy(F.col("_source").asc_nulls_last())) - 1
    sources = sources.select("*", F.element_at(listed, (rank % len(weights) + 1).cast("int")).alias("w"), F.sum("source_size").over(one).alias("total"))
    order = [(F.col("source_size") / F.col("w")).asc(), F.col("_source").asc_nulls_last()]
    cap = F.col("source_size") * max_repeat
    level = _level(one, F.col("total"), cap, F.col("w") / F.when(cap > 0, cap), F.col("w"), order)
    sources = sources.select("*", level.alias("here"), F.row_number().over(one.orderBy(*order)).alias("at"))
    sources = sources.select("*", F.min_by("here", F.when(F.col("here").isNotNull(), F.col("at"))).over(one).alias("level"))
    sources = sources.select("_source", "source_size", F.when(F.col("level").isNull(), cap.cast("double")).otherwise(F.least(F.col("level") * F.col("w"), cap.cast("double"))).alias("target"))
    sources = cut(sources)

    iw = F.greatest(F.lit(1), F.lit(TOP_CLASS) - F.col("_class"))
    c = classes.filter("words > 0").alias("c").join(small(sources).alias("s"), F.col("c._source").eqNullSafe(F.col("s._source")))
    c = c.select(F.col("c._source").alias("_source"), "_class", "words", "target", iw.alias("iw"))
    own = W.partitionBy("_source")
    level = _level(own, F.col("target"), F.col("words") * max_repeat, F.col("iw") / F.lit(float(max_repeat)), F.col("words") * F.col("iw"), [F.col("iw").desc(), F.col("_class").asc()])
    c = c.select("*", level.alias("here")).select("*", F.min_by("here", F.when(F.col("here").isNotNull(), F.col("_class"))).over(own).alias("level"))
    lam = F.when(F.col("level").isNull(), F.lit(float(max_repeat))).otherwise(F.least(F.lit(float(max_repeat)), F.col("level") * F.col("iw")))
    c = c.select("*", lam.alias("lam")).select("_source", "_class", "words", "target", F.floor("lam").cast("int").alias("whole"), (F.col("lam") - F.floor("lam")).alias("p"))
    c = cut(c.select("_source", "_class", "whole", "p", (F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own)).alias("rest")))

    def ranked(df: DataFrame) -> DataFrame:
        """df with its class's whole copies and p, and t = q / (1 + q) of the ranking variable q = odds(u) / odds(p)."""
        df = df.alias("d").join(small(c).alias("k"), F.col("d._source").eqNullSafe(F.col("k._source")) & (F.col("d._class") == F.col("k._class")), "left")
        df = df.select("d.*", F.coalesce("k.whole", F.lit(0)).alias("_whole"), F.coalesce("k.p", F.lit(0.0)).alias("_p"), "k.rest")
        q = (F.col("_u") * (1 - F.col("_p"))) / ((1 - F.col("_u")) * F.col("_p"))
        return df.select("*", F.when((F.col("_p") > 0) & (F.col("size") > 0), q / (1 + q)).alias("_t"))

    key = F.struct(F.col("_t"), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("i"), F.col("size").alias("n"))
    drawn = ranked(slim).filter(F.col("_t").isNotNull()).select("_source", "size", "rest", F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("bin"), F.col("_t"), key.alias("key"))
    near, hits = drawn, []
    for fine in range(1, LEVELS + 1):  # of a bin where a target is met the next level looks at bins of its own
        at = F.floor(F.col("_t") * BINS**fine).cast("long")
        part = near.select("_source", "size", "rest", "before", F.when(at >= (F.col("bin") + 1) * BINS, (F.col("bin") + 1) * BINS - 1).otherwise(F.greatest(at, F.col("bin") * BINS)).alias("bin"), "_t", "key")
        bins = part.groupBy("_source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("first"))
        upto = F.col("first") + F.sum("words").over(own.orderBy("bin"))
        bins = bins.select("*", (upto - F.col("words")).alias("before"), upto.alias("upto")).select("*", F.max("upto").over(own).alias("all"))
        hit = bins.filter((F.col("before") < F.col("rest")) & ((F.col("rest") <= F.col("upto")) | (F.col("upto") == F.col("all")))).select("_source", "bin", "before", "rest")
        hits.append(cut(hit))
        near = part.drop("before").alias("d").join(small(hits[-1]).alias("h"), F.col("d._source").eqNullSafe(F.col("h._source")) & (F.col("d.bin") == F.col("h.bin"))).select("d._source", "size", "d.rest", "h.before", "d.bin", "_t", "key")
    hit = hits[-1]
    sums = F.col("before") + F.sum("size").over(own.orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow))
    below = F.struct((F.col("bin") / F.lit(float(BINS**LEVELS))).alias("_t"), F.lit("").alias("i"), F.lit(-1).cast("long").alias("n"))
    ends = near.select("_source", "key", F.abs(sums - F.col("rest")).alias("off")).unionByName(hit.select("_source", below.alias("key"), F.abs(F.col("before") - F.col("rest")).alias("off")))
    edge = ends.groupBy("_source").agg(F.min_by("key", F.struct("off", "key")).alias("_cut"))
    edge = cut(edge)

    rows = slim if not keep_columns else box.df.select("*", F.col("id").alias("_id"), F.col("source").alias("_source"), n_words(F.col("text")).alias("size"))
    if keep_columns:
        rows = rows.select("*", k.cast("int").alias("_class"), _uniform(F.col("_id"), seed).alias("_u"))
    out = ranked(rows).alias("d")
    out = out.join(small(edge).alias("e"), F.col("d._source").eqNullSafe(F.col("e._source")), "left").select("d.*", "e._cut")
    out = out.alias("d").join(small(sources).alias("s"), F.col("d._source").eqNullSafe(F.col("s._source")), "left").select("d.*", "s.source_size", "s.target")
    copies = F.col("_whole") + F.when(F.col("_t").isNotNull() & F.col("_cut").isNotNull() & (key <= F.col("_cut")), 1).otherwise(0)
    made = ["size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("copies")]
    if not keep_columns:
        return out.select(F.col("_id").alias(id_col), *made)
    return box.open(out.select("box", "id", "text", "source", *made), "size", "source_size", "target", "copies")
