"""Preference formatting of chat conversations; DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role and text, position by position) is
rendered once as the prompt; the turns after it are the two completions. A completion's spans say which of its code points are
trained on: the text and end mark of assistant turns; everything else, the prompt included, is masked. Offsets are
relative to prompt + completion, end exclusive.

Turns are ordered by turn number (null first), role and text; null roles and texts count as empty; repeated turns are turns. A
conversation without an id is left out, and so is a pair that lacks one side. Where one conversation is a prefix of the other its
completion is empty. An empty table gives an empty result; other columns don't matter. Each conversation is read once and grouped by its own
id, so a first turn that many share gathers nothing. A pair is one row with its whole text: so a conversation must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.role, F.lit(MID), turn.text, F.lit(CLOSE))


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    t = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.filter(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(t)).alias("turns"))


def other_answers(convs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation, and itself with another's last answer in place of its own last assistant turn.

    The other is the one whose id differs in the lowest bit, so an aggregate by the other bits brings the two together, without a join.
    ``rejected.conv_id`` tells where the answer comes from. Conversations without an assistant turn, or without such a partner, are left out.
    """
    back = F.array_position(F.transform(F.reverse("turns"), lambda t: t.role), "assistant")
    c = convs.withColumn("at", F.size("turns") - back).filter(back > 0).withColumn("answer", F.get("turns", F.col("at").cast("int")).text)
    side = lambda even: F.first(F.when((F.col("conv_id").bitwiseAND(F.lit(1).cast("long")) == 0) == even, F.struct("conv_id", "turns", "at", "answer")), ignorenulls=True)
    two = c.groupBy(F.shiftright("conv_id", 1)).agg(side(True).alias("x"), side(False).alias("y")).filter("x is not null and y is not null")
    both = two.select(F.explode(F.array(F.struct(F.col("x").alias("own"), F.col("y.conv_id").alias("other_id"), F.col("y.answer").alias("answer")), F.struct(F.col("y").alias("own"), F.col("x.conv_id").alias("other_id"), F.col("x.answer").alias("answer")))).alias("p"))
    turns = F.transform("p.own.turns", lambda t, i: F.when(i == F.col("p.own.at"), F.struct(t.turn.alias("turn"), t.role.alias("role"), F.col("p.answer").alias("text"))).otherwise(t))
    return both.select(F.col("p.own.conv_id").alias("pair_id"), F.struct("p.own.conv_id", "p.own.turns").alias("chosen"), F.struct(F.col("p.other_id").alias("conv_id"), turns.alias("turns")).alias("rejected"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    p = pairs.select("pair_id", F.col("chosen.conv_id").alias("chosen_id"), F.col("rejected.conv_id").alias("rejected_id"), F.col("chosen.turns").alias("_c"), F.col("rejected.turns").alias("_r"))
    p = p.withColumn("_same", F.zip_with("_c", "_r", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False))))
    p = p.withColumn("n_common", F.when(F.array_position("_same", False) > 0, F.array_position("_same", False) - 1).otherwise(F.size("_same")).cast("int"))
    p = p.withColumn("prompt", F.array_join(F.transform(F.slice("_c", 1, F.col("n_common")), rendered), ""))
    for side, turns in (("chosen", "_c"), ("rejected", "_r")):
        p = p.withColumn("_t", F.slice(turns, F.col("n_common") + 1, F.greatest(F.size(turns) - F.col("n_common"), F.lit(0))))
        p = p.withColumn(side, F.array_join(F.transform("_t", rendered), ""))
        p = p.withColumn(
            f"{side}_spans",
            F.aggregate(
                "_t",
                F.struct(F.length("prompt").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
                lambda acc, t: F.struct(
                    (acc.at + F.length(rendered(t))).alias("at"),
                    F.when(t.role == "assistant", F.array_append(acc.out, F.struct((acc.at + F.length(F.concat(F.lit(OPEN), t.role, F.lit(MID)))).alias("start"), (acc.at + F.length(rendered(t))).alias("end")))).otherwise(acc.out).alias("out"),
                ),
                lambda acc: acc.out,
            ),
        )
    return p.select("pair_id", "chosen_id", "rejected_id", "n_common", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")


def digest(formatted: DataFrame) -> DataFrame:
    """The spans as text, start:end by comma; the numbers as longs."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",").alias(c)
    return formatted.select("pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected", listed("chosen_spans"), listed("rejected_spans"))
