"""Preference formatting with DataFrame functions only.

The turns of the chosen and of the rejected conversation of a pair meet in one grouping. The longest
common prefix of turns (same role and text at the same place) is rendered once as `prompt`; what follows on
either side becomes that side's completion, with a mask that lists the character ranges to learn from,
the texts of assistant turns and their end marks.

Turns are ordered by `turn`, nulls first, then role and text, so repeated turns have a fixed order too.
A null text counts as empty, a null role as `user`. A pair that one side lacks has an empty completion
there; a null pair id is a pair like any other. An empty table gives no pairs, an empty text an empty turn; columns
besides those named are never read. Turns are small to their pair: a group holds two conversations, never a hot
key's rows over many pairs. Texts cost in proportion to their length; a mask is a string that grows span by span, about 15
characters each, and is copied each time, so its cost grows with the square of a conversation's assistant turns (seconds at
50,000 of them). A conversation is one row of the result, so it must fit one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|{role}|>\n", "<|end|>\n"


def turn_arrays(turns: DataFrame, key: str) -> DataFrame:
    """`key` and its ordered turns as an array of (role, text)."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn"), _role().alias("role"), _text().alias("text"))))
    return turns.groupBy(F.col(key).alias("key")).agg(F.transform(ordered, lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))


def _role() -> Column:
    return F.coalesce(F.col("role").cast("string"), F.lit("user"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn.role, F.lit("|>\n"), turn.text, F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask(turns: Column, learn: str = "assistant") -> Column:
    """start:end of what is learnt in `render(turns)`, comma-joined; characters, end exclusive. One pass over the turns."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        end = done.at + F.length(rendered(x))
        span = F.concat_ws(":", (done.at + F.length(x.role) + 5).cast("string"), end.cast("string"))
        spans = F.when(x.role != learn, done.spans).when(done.spans == "", span).otherwise(F.concat_ws(",", done.spans, span))
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done.spans)


def common_turns(left: Column, right: Column) -> Column:
    """How many turns two arrays have in common from their start."""
    both = F.zip_with(left, right, lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(both, False), F.lit(0)) - 1, F.size(both)).cast("int")


def after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns), F.lit(1)))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Rows of (pair_id, chosen, rejected), both arrays of (role, text), to prompt, completions and masks."""
    common = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    split = common.select(
        "pair_id",
        "n_common",
        F.slice("chosen", F.lit(1), F.col("n_common")).alias("prefix"),
        after(F.col("chosen"), F.col("n_common")).alias("chosen_rest"),
        after(F.col("rejected"), F.col("n_common")).alias("rejected_rest"),
    )
    return split.select(
        "pair_id",
        "n_common",
        render(F.col("prefix")).alias("prompt"),
        render(F.col("chosen_rest")).alias("chosen"),
        render(F.col("rejected_rest")).alias("rejected"),
        mask(F.col("chosen_rest")).alias("chosen_mask"),
        mask(F.col("rejected_rest")).alias("rejected_mask"),
    )


_EMPTY = "cast(array() AS array<struct<role:string,text:string>>)"


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Long tables of turns (pair_id, turn, role, text) of the two sides; pairs of either side are kept."""
    side = lambda df, is_chosen: df.select(F.col("pair_id"), F.col("turn"), _role().alias("role"), _text().alias("text"), F.lit(is_chosen).alias("is_chosen"))
    rows = side(chosen, True).unionByName(side(rejected, False))
    turns = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("is_chosen", "turn", "role", "text"))).alias("turns"))
    of = lambda keep: F.transform(F.filter("turns", keep), lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    return format_pairs(turns.select("pair_id", of(lambda x: x.is_chosen).alias("chosen"), of(lambda x: ~x.is_chosen).alias("rejected")))


def last_reply_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: itself, and its turns before its last assistant turn with the last assistant
    turn of the conversation of the neighbouring id (2k and 2k + 1) in that place.

    A conversation without an assistant turn keeps all its turns before the borrowed one; without a neighbour,
    or if that has no assistant turn, nothing is borrowed.
    """
    turns = turn_arrays(conversations, "conv_id")
    last = F.array_max(F.transform("turns", lambda x, i: F.when(x.role == "assistant", i)))
    own = turns.select(F.col("key").cast("long").alias("pair_id"), F.col("turns").alias("chosen"), last.alias("last"))
    reply = own.where(F.col("last").isNotNull()).select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("for_id"), F.slice("chosen", F.col("last") + 1, F.lit(1)).alias("reply"))
    joined = own.join(reply, own["pair_id"] == reply["for_id"], "left")
    history = F.slice("chosen", F.lit(1), F.coalesce(F.col("last"), F.size("chosen")))
    return joined.select("pair_id", "chosen", F.concat(history, F.coalesce(F.col("reply"), F.expr(_EMPTY))).alias("rejected"))
