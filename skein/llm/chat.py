"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of
one role become one block, and the blocks are joined to one text. Control
strings all start with ``<``; texts and roles are escaped so that no raw ``<``
is left in them, and the escape is undone exactly when the text is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, OPEN_END, JOIN, CLOSE = "<turn ", ">", "<+>", "</turn>\n"


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\b``, ``<`` becomes ``\l``, ``>`` becomes ``\g``: no control string can then appear in a text."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Undo :func:`escape`. ``\\b`` goes last: every backslash in an escaped text starts one of the three pairs."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Format every conversation: ``conv_id, formatted, loss_spans``.

    Turns are ordered by (turn, role, text); adjacent turns of one role become
    one block ``<turn ROLE>text<+>text</turn>\\n``. loss_spans: ``[start, end)``
    in code points of the formatted text, one for each text of ``loss_role``.

    Nulls: a null text or role is empty; a null turn sorts first; null
    conversation ids form one conversation. Repeated rows are kept. An empty
    table gives no rows. Other columns of the input are ignored, whatever
    their names. A conversation is one row, so its text must fit a string.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    got = turns.select(F.col(conv).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # runs of one role: where each starts, then the run's texts as an array
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    got = got.withColumn("starts", starts)
    runs = F.transform("starts", lambda s, k: F.struct(
        F.get("t", s)["role"].alias("role"),
        F.transform(F.slice("t", s + 1, F.coalesce(F.get("starts", k + 1), F.size("t")) - s), lambda x: escape(x["text"])).alias("texts"),
    ))
    got = got.select("conv_id", runs.alias("runs"))
    head = lambda r: F.concat(F.lit(OPEN), escape(r["role"]), F.lit(OPEN_END))
    blocks = F.transform("runs", lambda r: F.concat(head(r), F.array_join(r["texts"], JOIN), F.lit(CLOSE)))
    # every piece in order with its length, so that one pass gives the spans
    cells = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda x, i: F.struct(
        F.when(i == 0, F.length(head(r))).otherwise(F.lit(len(JOIN))).alias("before"),
        F.length(x).alias("n"),
        F.when(i == F.size(r["texts"]) - 1, F.lit(len(CLOSE))).otherwise(F.lit(0)).alias("after"),
        (r["role"] == loss_role).alias("loss"),
    ))))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    step = lambda a, c: F.struct(
        (a["at"] + c["before"] + c["n"] + c["after"]).alias("at"),
        F.when(c["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + c["before"]).alias("start"), (a["at"] + c["before"] + c["n"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    return got.select("conv_id", F.array_join(blocks, "").alias("formatted"), F.aggregate(cells, zero, step)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(_after_head(b), r"<\+>"),
        lambda x: F.struct(unescape(_role(b)).alias("role"), unescape(x).alias("text")),
    )))


def _role(block: Column) -> Column:
    """The escaped role: between the block's head and the first end sign (roles hold none, once escaped)."""
    return F.substring_index(F.substring(block, len(OPEN) + 1, 2**31 - 1), OPEN_END, 1)


def _after_head(block: Column) -> Column:
    return F.substring(block, F.length(_role(block)) + len(OPEN) + len(OPEN_END) + 1, F.lit(2**31 - 1))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
