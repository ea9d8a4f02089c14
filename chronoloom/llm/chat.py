"""Preference formatting: one shared prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoloom.llm.common import cut, running_sums, with_range

TRAINED_ROLE = "assistant"


def rendered(turns: Column) -> Column:
    """Turns (role, text) as one string, each as <|im_start|>role, line feed, text, <|im_end|>, line feed.

    Marks inside a text stay as they are, so a tokenizer that is to tell them from the turns' own has to be given the turns.
    """
    parts = F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")))
    return F.array_join(parts, "")


def mask(turns: Column) -> Column:
    """The trained spans of rendered(turns) as start:end, comma-joined; in code points, end exclusive.

    A span holds an assistant's text and its end mark, which the model is to write; everything else is masked.
    """
    steps = F.transform(turns, lambda t: F.length(t["role"]) + F.length(t["text"]) + 24)

    def span(turn: Column, at: Column) -> Column:
        start = at + F.length(turn["role"]) + 13
        return F.when(turn["role"] == TRAINED_ROLE, F.concat_ws(":", start.cast("string"), (start + F.length(turn["text"]) + 10).cast("string")))

    return F.array_join(F.zip_with(turns, running_sums(steps), span), ",")


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Formats each pair (pair_id, chosen_id, rejected_id) of conversations in `turns` (conv_id, turn, role, text).

    Returns pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask. The prompt
    is the longest run of first turns in which both agree in role and text, so the same conversation twice gives two empty
    completions. Turns are ordered by turn, then role and text; exactly repeated turns of a conversation count once; null roles
    and texts are empty, a null turn comes first. A pair whose side is null or has no turns does not appear. Other columns are
    not read. One conversation is one training example and is put together in one row, whatever its length.
    """
    sides = pairs.select("pair_id", "chosen_id", "rejected_id", F.explode(F.array(
        F.struct(F.col("chosen_id").alias("conv_id"), F.lit(True).alias("is_chosen")),
        F.struct(F.col("rejected_id").alias("conv_id"), F.lit(False).alias("is_chosen")),
    )).alias("_side")).select("pair_id", "chosen_id", "rejected_id", "_side.*")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = turns.select("conv_id", turn.alias("_turn")).join(sides, "conv_id")
    both = told.groupBy("pair_id", "chosen_id", "rejected_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_chosen"), F.col("_turn")))).alias("_chosen"),
        F.array_sort(F.collect_set(F.when(~F.col("is_chosen"), F.col("_turn")))).alias("_rejected"),
    )
    return formatted(both.where((F.size("_chosen") > 0) & (F.size("_rejected") > 0)))


def formatted(both: DataFrame) -> DataFrame:
    """The result of format_preferences from pair_id, chosen_id, rejected_id and the turns of both sides, _chosen and _rejected."""
    same = F.zip_with("_chosen", "_rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    shared = F.array_position(same, False)
    both = both.withColumn("n_prompt_turns", F.when(shared > 0, shared - 1).otherwise(F.size("_chosen")).cast("int"))
    tail = {c: F.slice(f"_{c}", F.col("n_prompt_turns") + 1, F.greatest(F.size(f"_{c}"), F.lit(1))) for c in ("chosen", "rejected")}
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns",
        rendered(F.slice("_chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        *[rendered(t).alias(c) for c, t in tail.items()],
        *[mask(t).alias(f"{c}_mask") for c, t in tail.items()],
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs each conversation of even id (chosen) with that of the next id (rejected); pair_id is half the even id."""
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    half = F.floor(F.col("conv_id") / 2)
    even = ids.where("pmod(conv_id, 2) = 0").select(half.alias("pair_id"), F.col("conv_id").alias("chosen_id"))
    odd = ids.where("pmod(conv_id, 2) = 1").select(half.alias("pair_id"), F.col("conv_id").alias("rejected_id"))
    return even.join(odd, "pair_id")


def answer_preferences(turns: DataFrame) -> DataFrame:
    """Pairs that share a prompt: a conversation (chosen) and the same turns with another's last answer (rejected).

    The columns are those of format_preferences. Each conversation with an assistant turn appears once, as pair_id and chosen_id;
    rejected_id is the next conversation in id order that has an assistant turn, whose last one's text takes the place of this
    one's last; after the last id comes the first. Turns after the last answer stay in both completions. Where both answers are
    equal, which includes a conversation that is the only one with an answer, all turns are prompt and both completions are
    empty. Conversations without an assistant turn and turns with a null conv_id do not appear. Order, repeated turns and nulls
    are as in format_preferences.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = turns.where("conv_id is not null").select("conv_id", turn.alias("_turn"))
    whole = told.groupBy("conv_id").agg(F.array_sort(F.collect_set("_turn")).alias("_chosen"))
    answers = cut(told.where(F.col("_turn.role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max("_turn")["text"].alias("_answer")))
    ranged = with_range(answers.select("conv_id"), "conv_id", "_range")
    firsts = ranged.groupBy("_range").agg(F.min("conv_id").alias("_first"))  # one row for each range
    ahead = Window.orderBy("_range")
    after = firsts.select("_range", F.coalesce(F.lead("_first").over(ahead), F.min("_first").over(Window.partitionBy())).alias("_after"))
    inside = F.lead("conv_id").over(Window.partitionBy("_range").orderBy("conv_id"))
    following = ranged.withColumn("_next", inside).join(F.broadcast(after), "_range")
    nexts = following.select("conv_id", F.coalesce("_next", "_after").alias("rejected_id"))
    given = nexts.join(answers.select(F.col("conv_id").alias("rejected_id"), F.col("_answer").alias("_other")), "rejected_id")
    own = F.size("_chosen") - F.array_position(F.transform(F.reverse("_chosen"), lambda t: t["role"]), TRAINED_ROLE)  # its place, from 0
    # transform() binds the place once, or it would be looked for again at every turn
    swapped = F.transform(
        F.array(own), lambda at: F.transform("_chosen", lambda t, k: F.when(k == at, F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("_other").alias("text"))).otherwise(t))
    )[0]
    both = whole.join(given, "conv_id").select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), "rejected_id", "_chosen", swapped.alias("_rejected"))
    return formatted(both)
