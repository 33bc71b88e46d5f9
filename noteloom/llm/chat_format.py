"""Chat formatting by perspective rotation: every participant of a dialogue is once the assistant.

For each participant (each role but `system`) the dialogue is rendered with that speaker's turns as the assistant's,
the others as named users, and system turns as they are; the mask lists the characters to train on, which are the
assistant's texts with their end marks. A turn is trained on in one perspective only, so its place is found once: by the
running length of the dialogue with all speakers named, less what the speaker's earlier heads are shorter by.

A dialogue is rendered whole, whatever its turn numbers, so one row must be able to hold it (2 GB), and one task its
turns. Very long texts are rendered whole.

Null roles count as `unknown`, null texts as empty; null turns come first. Turns with one number are ordered by role,
then text; repeated rows are rendered as often as they come. In texts and roles the mark `<|` is broken up by a
backslash, and line ends in roles are written as backslash and n, so neither can open a turn. Dialogues with only system
turns, and an empty table, give no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SYSTEM = "<|im_start|>", "<|im_end|>\n", "system"
ASSISTANT, NAMED = "assistant", "user name="


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, name, text) with nulls made plain; the name and the text without marks."""
    role = F.coalesce("role", F.lit("unknown"))
    return conversations.select(
        "conv_id", "turn", role.alias("role"),
        F.replace(_unmarked(role), F.lit("\n"), F.lit("\\n")).alias("name"),
        _unmarked(F.coalesce("text", F.lit(""))).alias("text"),
    )


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, rendered, mask (start:end of trained characters, comma-joined), n_trained."""
    rows = turns(conversations)
    body = F.length("text") + len(END)
    head = len(START) + 1 + F.when(F.col("role") == SYSTEM, F.length("name")).otherwise(len(NAMED) + F.length("name"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"body": body.cast("long"), "stop": F.sum((head + body).cast("long")).over(order)})
    # Every speaker's own turns: the k-th ends earlier by k heads that are shorter than with the name.
    own = placed.filter(F.col("role") != SYSTEM).groupBy("conv_id", "role").agg(F.first("name").alias("name"), F.array_sort(F.collect_list(F.struct("stop", "body"))).alias("own"))
    shorter = len(NAMED) + F.length("name") - len(ASSISTANT)
    ends = F.transform("own", lambda t, k: F.struct(t["body"].alias("body"), (t["stop"] - (k + 1) * shorter).alias("end")))
    masks = own.select("conv_id", F.col("role").alias("perspective"), F.col("name").alias("speaker"),
                       F.array_join(F.transform(ends, lambda t: F.concat_ws(":", t["end"] - t["body"], t["end"])), ",").alias("mask"),
                       F.aggregate("own", F.lit(0).cast("long"), lambda a, t: a + t["body"]).alias("n_trained"))
    dialogues = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("stop", "role", "name", "text"))).alias("dialogue"))

    def rendered(t: Column) -> Column:
        name = F.when(t["role"] == SYSTEM, F.lit(SYSTEM)).when(t["role"] == F.col("perspective"), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(NAMED), t["name"]))
        return F.concat(F.lit(START), name, F.lit("\n"), t["text"], F.lit(END))

    both = dialogues.withColumnRenamed("conv_id", "c").join(masks, F.col("c").eqNullSafe(F.col("conv_id")))
    return both.select("conv_id", "perspective", F.size("dialogue").cast("long").alias("n_turns"), F.array_join(F.transform("dialogue", rendered), "").alias("rendered"), "mask", "n_trained")
