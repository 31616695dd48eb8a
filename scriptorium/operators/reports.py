"""Reports of the command line: small aggregates as text. What is listed is capped for display only; counts are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.session import cut
from scriptorium.operators import cards as C
from scriptorium.operators import lint as L
from scriptorium.operators import matrix as M
from scriptorium.operators import registry as R
from scriptorium.operators import topics as O

SHOWN = 40
#: Those of the fourteen fields whose difference is soft, as that of the length is.
SOFT = ("批评点", "明显的遗漏点", "待探讨的相关问题")


def padded(text: str, width: int) -> str:
    """text with blanks up to so many columns of a fixed-width font, in which characters above U+2E80 take two."""
    return text + " " * (width - len(text) - sum(c > "\u2e80" for c in text))


def status(registry: DataFrame) -> list[str]:
    """Tallies of five columns and the rows that break a rule."""
    rows = cut(registry)
    out = [f"{rows.count()} rows"]
    for r in R.tally(rows, ["tier", "verdict", "state", "topic", "source_type"]).orderBy("field", F.col("n").desc(), "first").toLocalIterator():
        out.append(f"{r['field']:12s} {padded(r['value'], 16)} {r['n']:4d}")
    problems = cut(R.audit(rows))
    n = problems.count()
    out.append(f"problems: {n}")
    out += [f"- {r['id']} {r['problem']}" for r in problems.orderBy("id", "problem").limit(SHOWN).collect()]
    return [*out, *([f"... {n - SHOWN} more"] if n > SHOWN else [])]


def matrix(rows: DataFrame, unknown: list[str], again: list[str], top: int = 25, **options) -> tuple[list[str], list[str]]:
    """Problems that stop a review, and the report: size, coverage, suspicious columns, topics."""
    rows = cut(rows)
    missing_columns = [c for c in M.REQUIRED if c not in rows.columns]
    full = rows.select("*", *(F.lit("").alias(c) for c in missing_columns))
    advice = M.size_advice(rows).first()
    problems = [f"no column {c}" for c in missing_columns] + (["no rows"] if advice["advice"] == "blocking" else [])
    gaps = M.completeness(full, tuple(c for c in M.REQUIRED if c not in missing_columns))
    problems += [f"row {r['row_no']}: {r['missing']}" for r in gaps.orderBy("row_no").limit(SHOWN).collect()]
    n_gaps = gaps.count()
    problems += [f"... {n_gaps - SHOWN} more rows"] if n_gaps > SHOWN else []
    report = [f"rows {advice['n']}: {advice['advice']}", *(f"unknown column {h}" for h in unknown), *(f"column again: {h}" for h in again)]
    report += [f"{padded(r['field'], 8)} {'no column' if r['filled'] is None else f'{r.filled}/{r.total}'}" for r in M.coverage(rows).collect()]
    report += [f"author {r['author']} has {r['n']} of {r['total']} rows" for r in M.dominance(full).collect()]
    report += [f"column {r['field']}: {r['n']} cells with one value" for r in M.identical_columns(full, ("spl",)).collect()]
    found = O.candidates(rows, top, **options).collect()
    report += [f"{r['gram']} {r['cnt']}" for r in found]
    return problems, [*report, *(["few topics: are the cells specific enough?"] if len(found) < 8 else [])]


def card_values(cards: DataFrame) -> DataFrame:
    """(card, field, value) of cards (card, text): tier, reference basis, length, a verdict for each of the fourteen fields."""
    values = [F.struct(F.lit("tier").alias("field"), T.or_blank(T.card_tier(F.col("text"))).alias("value")), F.struct(F.lit("basis").alias("field"), T.ref_basis(F.col("text")).alias("value")), F.struct(F.lit("length").alias("field"), T.nonspace_len(F.col("text")).cast("string").alias("value"))]
    values += [F.struct(F.lit(n).alias("field"), C.judge(F.col("text"), n).alias("value")) for n in L.FIELD_NAMES]
    return cards.select("card", F.explode(F.array(*values)).alias("x")).select("card", "x.field", "x.value")


def compare(cards: DataFrame, overlap: float = C.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Agreement of cards by field, and fuzzy matches of the critique's items between the first two."""
    hard = ("tier", "basis", *(n for n in L.FIELD_NAMES if n not in SOFT))
    agreed = C.agreement(card_values(cards), hard)
    items = cards.select("card", F.posexplode(T.item_split(C.segment(F.col("text"), "批评点"))).alias("id", "item"))
    names = [r["card"] for r in cards.select("card").orderBy("card").limit(2).collect()]
    left, right = (items.filter(F.col("card") == n).select("id", "item") for n in (names * 2)[:2])
    return agreed, C.fuzzy_match(left, right, overlap)
