"""Chat formatting with Spark expressions only.

One row per conversation. Turns are collected as structs and sorted by (turn, role, text); adjacent
turns of one role become one block:

    <|im_start|>ROLE<|im_sep|>TEXT<|im_sep|>TEXT...<|im_end|>\\n

Control strings inside roles and texts get a backslash after their first character, and backslashes
are doubled, so no marker can come from a text and reading back gives every turn as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import shared_dir, stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates, as a pattern of (first character)(rest).
CONTROL = r"(<|\[)((?:\|im_start\||\|im_sep\||\|im_end\||\|endoftext\||/?s|/?<SYS>)>|/?INST\])"


def escaped(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation.

    loss_spans: [start, end) in code points of formatted, and [first, last) in its UTF-8 bytes, one for every
    text of loss_role. Null text or role: empty. Null conv_id is a conversation of its own. Equal turn numbers
    are ordered by role and text, a null number comes last; repeated rows are repeated turns. Other columns are
    not read. An empty table gives an empty result. Places are running sums over a conversation's turns, so its
    cost grows in proportion to its length.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = F.lag("role").over(w)
    own = F.concat(F.when(before.isNull(), F.lit("")).otherwise(F.lit(END + "\n")), F.lit(START), escaped(F.col("role")), F.lit(SEP))
    rows = rows.select("conv_id", "turn", "role", "text", F.when(before == F.col("role"), F.lit(SEP)).otherwise(own).alias("lead"), escaped(F.col("text")).alias("body"))
    upto = lambda size: F.sum(size("lead") + size("body")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    rows = rows.select("conv_id", upto(F.length).alias("end"), upto(F.octet_length).alias("last"), "lead", "body", (F.col("role") == loss_role).alias("loss"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("end", "last", "lead", "body", "loss"))).alias("t"))
    text = F.concat(F.array_join(F.transform("t", lambda x: F.concat(x["lead"], x["body"])), ""), F.lit(END + "\n"))
    span = lambda x: F.struct((x["end"] - F.length(x["body"])).alias("start"), x["end"].alias("end"), (x["last"] - F.octet_length(x["body"])).alias("first"), x["last"].alias("last"))
    return chats.select("conv_id", text.alias("formatted"), F.transform(F.filter("t", lambda x: x["loss"]), span).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text)) from the formatted text alone."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"<\|im_end\|>\n\z", ""), r"<\|im_sep\|>"))
    turns = F.flatten(F.transform(parts, lambda p: F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: F.struct(unescaped(p[0]).alias("role"), unescaped(x).alias("text")))))
    return formatted.select("*", turns.alias("turns"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """The digests of the contract, read back from the formatted text that was written: turns by its marks,
    what is trained on by the loss spans."""
    spark = turns.sparkSession
    path = f"{shared_dir(spark, 'chats')}/formatted"
    chats = format_chats(turns)
    stored(chats, path, compression="zstd")
    # As bytes, so a span is cut out without counting characters from the start.
    kinds = {f.name: f.dataType.simpleString() for f in chats.schema}
    back = spark.read.schema(f"conv_id {kinds['conv_id']}, formatted binary, loss_spans {kinds['loss_spans']}").parquet(path).withColumnRenamed("formatted", "raw")
    part = lambda s: F.substring("raw", (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")).cast("string")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(part(s))), "")
    back = read_chats(back.select("conv_id", F.col("raw").cast("string").alias("formatted"), loss.alias("trained")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
