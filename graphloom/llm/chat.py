"""Chat formatting from event logs, in DataFrame functions only.

A log holds events of conversations: *message* and *edit* set a message's text, *regenerate* empties it, *delta* adds to
it. Events are partitioned by conversation and message, sorted by sequence and folded: what stands before the last
message, edit or regenerate is void, and the deltas after it are joined in order. Messages are then sorted and rendered
as ``<|im_start|>role\\n text <|im_end|>\\n`` (without the blanks). Inside roles and texts ``&`` becomes ``&amp;`` and
``<|`` becomes ``&lt;|``, so no text can hold a control string and reading back is exact; line breaks in roles become
``&#10;``.

Defined results: null texts and roles count as empty; null conversation ids form one conversation; null sequence numbers
sort first; events that tie in sequence are ordered by kind and text; an empty log gives an empty result; other columns
aren't read. A conversation is one output row, so a conversation has to fit in memory, as its own result does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text) from events (conv_id, seq, msg, role, kind, text). The role is that of the message's
    first event with a role."""
    message = Window.partitionBy("conv_id", "msg")
    e = events.select("conv_id", "msg", F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"), "role", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind") != "delta"
    live = e.withColumn("__from", F.max(F.when(reset, F.struct("seq", "kind", "text"))).over(message)).withColumn("__first", F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(message))
    live = live.where(F.col("__from").isNull() | (F.struct("seq", "kind", "text") == F.col("__from")) | ((F.col("seq") >= F.col("__from.seq")) & ~reset))
    part = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", (-reset.cast("int")).alias("rank"), part.alias("part"))))
    return live.groupBy("conv_id", "msg").agg(F.coalesce(F.min("__first.role"), F.lit("")).alias("role"), F.array_join(ordered["part"], "").alias("text"))


def formatted(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, turns (the rendered turns), formatted (the same as one text) and
    loss_mask (for each turn, the start and length of what is learnt in it: texts of the roles in ``learn``)."""
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    text = escaped(F.coalesce("text", F.lit("")))
    opening = F.concat(F.lit(START), role, F.lit("\n"))
    learnt = F.coalesce(F.col("role").isin(*learn), F.lit(False))
    turn = F.struct(F.col("msg"), F.concat(opening, text, F.lit(END)).alias("turn"), F.struct(F.when(learnt, F.length(opening)).otherwise(0).alias("start"), F.when(learnt, F.length(text)).otherwise(0).alias("length")).alias("mask"))
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select("conv_id", F.col("t.turn").alias("turns"), F.array_join("t.turn", "").alias("formatted"), F.col("t.mask").alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, messages (role, text) parsed from formatted, and learnt: the unescaped text under the loss mask."""
    turns = F.filter(F.split("formatted", "<\\|im_end\\|>\n"), lambda x: x != "")
    parsed = F.transform(turns, lambda x: F.struct(unescaped(F.substring(F.substring_index(x, "\n", 1), len(START) + 1, 2**31 - 1)).alias("role"), unescaped(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))
    under = F.zip_with(turns, "loss_mask", lambda x, m: F.when(m["length"] > 0, unescaped(F.substr(x, m["start"] + 1, m["length"]))).otherwise(""))
    return chats.select("conv_id", "formatted", parsed.alias("messages"), F.array_join(under, "").alias("learnt"))
