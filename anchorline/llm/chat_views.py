"""Dialogues from the point of view of each participant, in DataFrame functions only.

For every speaker of a conversation the dialogue is rendered once with that speaker as the assistant, all others as
named users, and system messages as they are. Masks list the stretches of characters that the speaker has written, with
the closing mark, which is what a model is trained on.

A row holds at most the messages of `span` consecutive turn numbers; the parts of a dialogue in order are the whole. A
usual conversation is one part, and one endless conversation is many rows.

Messages follow each other by turn, then role, then text; null turns come last, in a part of their own. Rows that are
given twice are one message. Null ids are one conversation. A null role speaks as `unknown` and has no view of its
own, nor has the system: conversations of these alone give no rows. Null texts are empty. Marks within a text are broken
by a space, so that no text can close its message. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a message.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def perspectives(
    messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    span: int = 64,
) -> DataFrame:
    """(conv_id, perspective, part, n_turns, rendered, mask): `mask` is an array of (start, end), end exclusive."""
    said = messages.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text"),
    ).distinct()
    speakers = said.where("role is not null and role <> 'system'").select(
        F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")
    ).distinct()
    message = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
                       F.col("role").isNull().alias("nobody"), "text")
    parts = said.groupBy("conv_id", F.floor(F.col("turn") / span).alias("part")).agg(
        F.array_sort(F.collect_list(message)).alias("messages")  # the messages of `span` turns
    )

    def own(m: Column) -> Column:
        return (m["role"] == F.col("perspective")) & ~m["nobody"]

    def head(m: Column) -> Column:
        named = F.concat(F.lit("user name="), m["role"])
        kind = F.when(own(m), "assistant").when((m["role"] == "system") & ~m["nobody"], "system").otherwise(named)
        return F.concat(F.lit(OPEN), kind, F.lit("\n"))

    def body(m: Column) -> Column:
        return F.concat(m["text"], F.lit(CLOSE))

    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(head(m), body(m), F.lit("\n"))), "")
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))
    mask = F.aggregate("messages", begun, lambda a, m: F.struct(
        (a["at"] + F.length(head(m)) + F.length(body(m)) + 1).alias("at"),
        F.when(own(m), F.concat(a["mask"], F.array(F.struct(
            (a["at"] + F.length(head(m))).alias("start"),
            (a["at"] + F.length(head(m)) + F.length(body(m))).alias("end"),
        )))).otherwise(a["mask"]).alias("mask"),
    ))["mask"]
    return views.select(
        "conv_id", "perspective", "part", F.size("messages").cast("long").alias("n_turns"), rendered.alias("rendered"),
        mask.alias("mask"),
    )
