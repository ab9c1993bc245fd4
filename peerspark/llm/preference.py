"""Preference formatting: the common turns of a chosen and a rejected conversation once, then both completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.prefix import prefix_aggregate
from .staging import staged

LAST = (1 << 63) - 1
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def preference_segments(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per rendered turn: pair_id, part (prompt, chosen or rejected), turn, copy, role, rendered, start, end,
    mask_start, mask_end.

    The prompt holds the longest common prefix of turns: all turns before the first one at which the two
    sides differ, compared as multisets of (role, text) per turn. It is rendered once. The other turns are the
    two completions. ``start`` and ``end`` are character places in prompt + completion. The mask span covers
    content and end mark of the turns of ``trained_role`` in completions, the only characters that count in
    training; elsewhere it is null.

    Nothing is gathered per pair. Turns are compared by counts, the first difference is a minimum, and places
    are running sums over blocks of turns, so a pair with any number of turns is spread over tasks. Null
    pairs are left out; a null turn comes last; null roles and texts are empty. Rows repeated in a turn are
    rendered as often as they occur, as ``copy`` 1, 2, ...; ties in a turn are ordered by role and text. A pair
    that one side lacks has no prompt. Empty tables give no rows; other columns are ignored.
    """
    def side(turns: DataFrame, c: int, r: int) -> DataFrame:
        return turns.filter(F.col(pair_col).isNotNull()).select(
            F.col(pair_col).alias("pair_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST)).alias("turn"),
            F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
            F.lit(c).alias("in_chosen"), F.lit(r).alias("in_rejected"))

    turns = (side(chosen, 1, 0).unionByName(side(rejected, 0, 1)).groupBy("pair_id", "turn", "role", "text")
             .agg(F.sum("in_chosen").alias("c"), F.sum("in_rejected").alias("r")))
    turns = staged(turns, "turns")
    cut = turns.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("cut"))
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    part = lambda name, n: F.struct(F.lit(name).alias("part"), n.alias("n"))
    placed = (turns.join(cut, "pair_id")
              .select("pair_id", "turn", "role", "text", F.explode(
                  F.when(common, F.array(part("prompt", F.col("c"))))
                  .otherwise(F.array(part("chosen", F.col("c")), part("rejected", F.col("r"))))).alias("p"))
              .filter("p.n > 0").select("pair_id", "turn", "role", "text", "p.part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.n"))).alias("copy")))
    shown = placed.select("pair_id", "part", "turn", "copy", "role", "text",
                          F.concat(header(F.col("role")), F.col("text"), F.lit(CLOSE)).alias("rendered"))
    shown = staged(shown, "shown-turns")
    run = prefix_aggregate(shown, ["pair_id", "part"], F.floor(F.col("turn") / 256).cast("long"), ["turn", "role", "text", "copy"],
                           {"before": ("sum", F.length("rendered").cast("long"))})
    prompts = shown.filter("part = 'prompt'").groupBy("pair_id").agg(F.sum(F.length("rendered").cast("long")).alias("prompt_length"))
    start = F.coalesce("before", F.lit(0)) + F.when(F.col("part") == "prompt", F.lit(0)).otherwise(F.coalesce("prompt_length", F.lit(0)))
    trained = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    return (run.join(prompts, "pair_id", "left").withColumn("start", start).withColumn("end", F.col("start") + F.length("rendered"))
            .select("pair_id", "part", "turn", "copy", "role", "rendered", F.col("start").cast("long"), F.col("end").cast("long"),
                    F.when(trained, F.col("start") + F.length(header(F.col("role")))).cast("long").alias("mask_start"),
                    F.when(trained, F.col("end")).cast("long").alias("mask_end")))


def preference_texts(segments: DataFrame) -> DataFrame:
    """Segments put together: pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask (spans in prompt + completion).

    For conversations that fit a model's context: a pair's turns meet in one row."""
    ordered = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("start", "rendered", "mask_start", "mask_end"))))
    told = segments.groupBy("pair_id").agg(*[ordered(n).alias(n) for n in ("prompt", "chosen", "rejected")])
    text = lambda name: F.array_join(F.transform(name, lambda s: s["rendered"]), "").alias(name)
    mask = lambda name: F.transform(F.filter(name, lambda s: s["mask_start"].isNotNull()),
                                    lambda s: F.struct(s["mask_start"].alias("start"), s["mask_end"].alias("end"))).alias(f"{name}_mask")
    return told.select("pair_id", text("prompt"), text("chosen"), text("rejected"), mask("chosen"), mask("rejected"))


def swapped_replies(turns: DataFrame, conv_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from one table of conversations.

    A conversation is chosen as it is. Its rejected side has the same turns before its last reply, and the last
    reply of the neighbouring conversation (the id with its lowest bit flipped) in that place. Without a reply of
    its own it is rejected unchanged; without a neighbour's reply the rejected side ends before the last reply."""
    turns = turns.select(F.col(conv_col).alias("pair_id"), "turn", "role", "text").filter("pair_id is not null")
    last = (turns.filter("role = 'assistant' and turn is not null").groupBy("pair_id")
            .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("reply")))
    known = last.select("pair_id", F.col("reply.turn").alias("last_turn"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply.text").alias("text"))
    before = turns.join(known, "pair_id", "left").filter("last_turn is null or turn < last_turn").select("pair_id", "turn", "role", "text")
    swapped = known.join(other, "pair_id").select("pair_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), "text")
    return turns, before.unionByName(swapped)
