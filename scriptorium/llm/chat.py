"""Chat formatting by prefix-target expansion; DataFrame functions only.

Every assistant turn becomes an example: all earlier turns are its context, and the reply alone is trainable. Turns that no
example holds (those after the last reply, or all of a conversation without replies) come as one more example without a target,
so that no text is lost.

Template: a turn is  <|im_start|> role \\n text <|im_end|> \\n . Texts and roles are escaped first: a backslash doubles, and
`<|` becomes `<\\|`, so that neither mark can occur inside; unescaping reverses both. In roles a line feed is written `\\n` too.
A loss mask is a list of [start, end) spans of code points in the example; here one span at most, the escaped reply.

Work per example is proportional to its length, which for n turns sums up to about n/2 times the conversation: prefix expansion
asks for that. A conversation's turns meet in one row, as an example needs all of them; no two conversations do.

Defined results: null text or role is empty; turns are ordered by turn (null first), then role, then text, and repeated rows
are repeated turns; a null conv_id is a conversation; an empty table gives none. Other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Reverses escape(): of each pair that begins with a backslash the backslash goes."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    """A line feed is an n after an odd number of backslashes: doubled ones are set aside first."""
    aside = F.replace(role, F.lit("\\\\"), F.lit("\\\\ "))
    # after this every backslash followed by n stands for a line feed, and one followed by a backslash and a blank is a doubled one
    return F.replace(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")), F.lit("\\\\ "), F.lit("\\"))


def segments(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """A row for each conversation: conv_id and its turns as segments head, body (escaped), trainable."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    made = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _role(t.role), F.lit("\n")).alias("head"), escape(t.text).alias("body"), (t.role == assistant).alias("trainable")))
    return grouped.select("conv_id", made.alias("segments"))


def expand(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row for each example: conv_id, n_context (turns before the target), formatted, and loss, an array of spans."""
    s = segments(conversations, assistant)
    full = F.transform("segments", lambda x: F.concat(x.head, x.body, F.lit(f"{END}\n")))
    s = s.select("conv_id", "segments", full.alias("full"), F.transform("segments", lambda x, i: F.when(x.trainable, i)).alias("at"))
    last = F.coalesce(F.array_max("at"), F.lit(-1))
    rest = F.when(last < F.size("segments") - 1, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    s = s.select("*", F.explode(F.concat(F.array_compact("at"), rest)).alias("target"))
    whole = F.col("target") < 0
    upto = F.when(whole, F.size("segments")).otherwise(F.col("target"))
    context = F.array_join(F.slice("full", F.lit(1), upto), "")
    reply = F.element_at("segments", F.when(whole, 1).otherwise(F.col("target") + 1))
    s = s.select("conv_id", upto.cast("long").alias("n_context"), whole.alias("whole"), context.alias("context"), reply.alias("reply"))
    start = F.length("context") + F.length("reply.head")
    span = F.struct(start.cast("long").alias("start"), (start + F.length("reply.body")).cast("long").alias("end"))
    return s.select(
        "conv_id",
        "n_context",
        F.when(F.col("whole"), F.col("context")).otherwise(F.concat("context", "reply.head", "reply.body", F.lit(f"{END}\n"))).alias("formatted"),
        F.when(F.col("whole"), F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(F.array(span)).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example as structs of role and text."""
    pieces = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unrole(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Read back from expand()'s rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    masked = F.array_join(F.transform("loss", lambda x: F.substr(F.col("formatted"), (x.start + 1).cast("int"), (x.end - x.start).cast("int"))), "")
    e = examples.select("conv_id", "n_context", F.length("formatted").alias("chars"), unescape(masked).alias("masked"), "formatted")
    g = e.groupBy("conv_id").agg(
        F.max_by("formatted", F.struct("n_context", "chars")).alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_context", "masked"))), lambda x: x.masked), "").alias("masked"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    g = g.select("*", read_turns(F.col("longest")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked"), 256).alias("loss_sha256"), "formatted_chars")
