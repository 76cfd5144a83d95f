"""Chat formatting in Spark expressions: turns are windowed, collected, sorted, merged and concatenated.

Template: ``<|turn|>role<|text|>text<|end|>`` per block of adjacent turns of one role; texts of a block are
separated by ``<|sep|>``, so the merge can be undone. Inside roles and texts a backslash is doubled and one is put
after the first character of every control string, of this template and of other common ones; no text can therefore
hold a mark, and dropping the escapes gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, SEP, END = "<|turn|>", "<|text|>", "<|sep|>", "<|end|>"
# A character that begins a control string: <|...|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("|", r"\|"))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation.

    Takes ``conv_id, turn, role, text``; other columns are ignored. Turns are ordered by turn, then role and text, nulls first.
    A null text or role counts as empty, a null conv_id is a conversation of its own, repeated turns stay. ``loss_spans`` lists ``start``
    and ``length``, in characters of ``formatted``, of each text of the role ``learn``. Turns of a
    conversation meet in one row, as the result demands; nothing else is gathered.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", F.row_number().over(order).alias("n"), F.lag("role").over(order).alias("last"),
                       escape(F.col("role")).alias("name"), escape(F.col("text")).alias("body"))
    opens = ~F.col("role").eqNullSafe(F.col("last"))
    head = F.when(~opens, len(SEP)).otherwise(
        F.length("name") + len(TURN) + len(TEXT) + F.when(F.col("last").isNull(), 0).otherwise(len(END)))
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opens", opens.cast("long")).withColumn("head", head.cast("long"))
    rows = rows.withColumn("block", F.sum("opens").over(upto)).withColumn("size", F.length("body").cast("long"))
    rows = rows.withColumn("start", F.sum(F.col("head") + F.col("size")).over(upto) - F.col("size"))
    span = F.when(F.col("role") == learn, F.struct("start", F.col("size").alias("length")))
    blocks = rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("n", "body"))).alias("turns"), F.first("name").alias("name"),
        F.collect_list(span).alias("spans"))
    blocks = blocks.select("conv_id", F.struct(
        "block", F.concat(F.lit(TURN), "name", F.lit(TEXT), F.array_join(F.col("turns.body"), SEP), F.lit(END)).alias("text"), "spans").alias("part"))
    return blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
        "conv_id", F.array_join(F.col("parts.text"), "").alias("formatted"),
        F.array_sort(F.flatten(F.col("parts.spans"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``role, text``."""
    def of(block):
        parts = _split(_split(block, END)[0], TEXT)
        return F.transform(_split(parts[1], SEP), lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(_split(formatted, TURN), lambda b: b != ""), of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted text and its mask hold, read back from them."""
    turns = read_turns(F.col("formatted"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select("conv_id", "formatted", turns.alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
