"""Chat formatting by perspective rotation, natively.

Each conversation is rendered once per participant: that speaker's messages become the
assistant's, everybody else's become named users', and the mask marks what the model learns
to say. Roles in ``context_roles`` (system prompts) are rendered as they are and get no
perspective of their own.

A rendered dialogue is cut into parts of ``part_turns`` turn numbers, and a part of more than
``part_turns`` messages (repeated, negative or NULL turns) is cut again by the number of the
message, so one conversation with a third of all rows is spread over its parts and no task
gathers it whole, whatever its turns are. Parts are rendered from one gathered array each;
perspectives are added afterwards, so the texts are not shuffled once per participant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.operators.joins import join_small, materialize
from strata.operators.windows import bucketed_prefix_sum

END = "<|end|>\n"


def _render(messages: Column, who: Column, context_roles: Sequence[str]) -> Column:
    """(text, mask) of a part: the mask holds start:end of the assistant's words with the end
    mark, in code points of the part's text."""
    def head(m: Column) -> Column:
        return (F.when(m["role"].isin(list(context_roles)), F.concat(F.lit("<|"), m["role"], F.lit("|>\n")))
                .when(m["role"] == who, F.lit("<|assistant|>\n"))
                .otherwise(F.concat(F.lit("<|user name="), m["role"], F.lit("|>\n"))))

    pieces = F.transform(messages, lambda m: F.struct(
        head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"),
        (m["role"] == who).alias("learn")))
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"])), "")
    init = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(p["learn"], F.concat(a["spans"], F.array(span)))
                        .otherwise(a["spans"]).alias("spans"))

    return F.struct(text.alias("text"), F.aggregate(pieces, init, step, lambda a: F.array_join(a["spans"], ",")).alias("mask"))


def _cut_again(msgs: DataFrame, cells: DataFrame, part_turns: int) -> DataFrame:
    """Messages with ``part``, for conversations with ranges of turns (``cell``) that hold more than
    ``part_turns`` messages.

    The messages of such ranges are sorted as a whole and written; a message's number is its place
    among its task's rows plus the range's rows in the tasks before. The parts of a range follow
    those of the ranges before it, so a range that is not cut again has its own number plus the
    number of additional parts before it."""
    keys = ["conv_id", "cell"]
    crowded = cells.where(F.col("rows") > part_turns)
    flagged = join_small(msgs, crowded.select(*keys, F.lit(True).alias("crowded")), keys, "left", null_safe=True)
    order = [*keys, "turn", "role", "text"]
    hot = (flagged.where("crowded").drop("crowded").dropDuplicates(order).orderBy(*order)
           .withColumn("place", F.monotonically_increasing_id()))
    hot = materialize(hot, "messages").withColumn("task", F.shiftright("place", 33))
    runs = hot.groupBy(*keys, "task").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    number = F.col("before") + F.col("place") - F.col("first")
    hot = (join_small(hot, runs.drop("n"), [*keys, "task"], null_safe=True)
           .withColumn("sub", F.floor(number / part_turns).cast("long")))
    more = runs.groupBy(*keys).agg((F.ceil(F.sum("n") / part_turns) - 1).cast("long").alias("more"))
    whose = crowded.select("conv_id").dropDuplicates().withColumn("cut", F.lit(True))
    own = join_small(cells.drop("rows"), whose, ["conv_id"], null_safe=True).drop("cut")
    own = join_small(own, more, keys, "left", null_safe=True).withColumn("more", F.coalesce("more", F.lit(0)))
    shift = bucketed_prefix_sum(own, ["conv_id"], [F.asc("cell")], [F.floor(F.col("cell") / 1024).cast("long")],
                                name="shift", weight=F.col("more"), exclusive=True).drop("more")
    columns = ["conv_id", "turn", "role", "text", "cell"]
    cold = flagged.where(F.col("crowded").isNull()).select(*columns).dropDuplicates().withColumn("sub", F.lit(0).cast("long"))
    both = join_small(cold.unionByName(hot.select(*columns, "sub")), shift, keys, "left", null_safe=True)
    return both.withColumn("part", F.col("cell") + F.coalesce("shift", F.lit(0)) + F.col("sub"))


def rotate_perspectives(conversations: DataFrame, context_roles: Sequence[str] = ("system",),
                        part_turns: int = 64) -> DataFrame:
    """One row per conversation, perspective and part: ``conv_id``, ``perspective``, ``part``,
    ``n_messages``, ``text``, ``mask``. A perspective's parts in order are its dialogue.

    No part has more than ``part_turns`` messages. A message's part is its turn number by
    ``part_turns``; in a conversation where more messages than that share a range of turns,
    the range takes as many parts as it needs and the parts after it move up.

    Defined cases: a NULL role is a participant named ``unknown``, a NULL text is empty, a
    NULL turn stands first (in part 0), a NULL conversation id is a conversation of its own;
    repeated rows are one message; messages of one turn are ordered by role and text; a
    conversation with context roles only, and an empty table, give no rows; other columns are
    not read.
    """
    msgs = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    cell = F.floor(F.greatest(F.coalesce("turn", F.lit(0)), F.lit(0)) / part_turns).cast("long")
    cells = materialize(conversations.groupBy("conv_id", cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows")), "cells")
    if cells.where(F.col("rows") > part_turns).isEmpty():
        cut = msgs.dropDuplicates().withColumn("part", cell)
    else:
        cut = _cut_again(msgs.withColumn("cell", cell), cells, part_turns)
    parts = (cut.groupBy("conv_id", "part")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")))
    speakers = (conversations.select(F.col("conv_id").alias("c"), F.coalesce("role", F.lit("unknown")).alias("perspective"))
                .where(~F.col("perspective").isin(list(context_roles))).dropDuplicates())
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    done = both.withColumn("r", _render(F.col("messages"), F.col("perspective"), context_roles))
    return done.select("conv_id", "perspective", "part", F.size("messages").cast("long").alias("n_messages"),
                       F.col("r.text").alias("text"), F.col("r.mask").alias("mask"))
