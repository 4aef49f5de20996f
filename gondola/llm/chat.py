"""Preference formatting of conversations.

A pair of conversations, one chosen and one rejected, is cut after its longest
common prefix of turns. The prefix is rendered once, as the prompt; the turns
that remain of either side are its completion, with the places that are to be
learned (what the assistant says and its end mark) as spans of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template of one turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["line"]), "")


def _mask(turns: Column) -> Column:
    """Spans [start, end) of the rendered turns that the assistant speaks."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(t["line"])
        start = acc["at"] + F.length(F.coalesce(t["role"], F.lit(""))) + len(OPEN) + len(MIDDLE)
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preference_pairs(conversations: DataFrame, pair: Column, rejected: Column) -> DataFrame:
    """One row for each pair that has both sides.

    ``conversations``: turn, role, text, and what ``pair`` (the pair's id) and
    ``rejected`` (true on the rejected side) are made of. Turns are ordered by
    (turn, role, text); they are equal if role and text are, null being equal to
    null alone. Null roles and texts are rendered as empty; rows whose pair or side
    is null are left out, and so are pairs with one side only. Equal conversations
    give two empty completions; conversations without a common first turn give an
    empty prompt. Repeated rows are repeated turns. Other columns are ignored.

    A pair's turns meet in one row because its result is one row; pairs are
    dealt over all tasks.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"), rendered(F.col("role"), F.col("text")).alias("line"))
    sides = (
        conversations.select(pair.alias("pair_id"), rejected.alias("side"), turn.alias("t"))
        .where("pair_id is not null and side is not null")
        .groupBy("pair_id")
        .agg(
            F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("a"),
            F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("b"),
        )
        .where("size(a) > 0 and size(b) > 0")
    )
    same = F.zip_with("a", "b", lambda x, y: x["line"].isNotNull() & y["line"].isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    cut = sides.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    cut = cut.select("pair_id", F.col("n").alias("n_prompt_turns"), F.slice("a", 1, F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select(
        "pair_id",
        "n_prompt_turns",
        _joined(F.col("p")).alias("prompt"),
        _joined(F.col("a")).alias("chosen"),
        _mask(F.col("a")).alias("chosen_spans"),
        _joined(F.col("b")).alias("rejected"),
        _mask(F.col("b")).alias("rejected_spans"),
    )


def swapped_replies(conversations: DataFrame, key: str = "conv_id", bucket: int = 1024) -> DataFrame:
    """Preference data from plain conversations: (key, rejected, turn, role, text). Each
    conversation stands as it is (rejected false) and with its last assistant turn
    replaced by that of another conversation (rejected true).

    The other one is the next, and for the last the first, in the order of keys within
    a bucket of about ``bucket`` conversations, dealt by a hash of the key; so neither
    depends on how rows are stored. Null keys, conversations without an assistant turn,
    and those alone in their bucket are left out. Other columns are ignored.
    """
    turns = conversations.where(F.col(key).isNotNull()).select(key, "turn", "role", "text")
    replies = turns.where("role = 'assistant'").groupBy(key).agg(F.max(F.struct("turn", "text")).alias("reply"))
    parts = F.lit(max(1, replies.count() // bucket))
    near = Window.partitionBy(F.pmod(F.xxhash64(key), parts)).orderBy(key)
    around = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.coalesce(F.lead("reply").over(near), F.first("reply").over(around))
    pairs = replies.select(key, "reply", other.alias("other"), F.count("*").over(around).alias("n")).where("n > 1")
    last = (F.col("role") == "assistant") & F.struct("turn", "text").eqNullSafe(F.col("reply"))
    both = turns.join(pairs, key).withColumn("rejected", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.select(key, "rejected", "turn", "role", F.when(F.col("rejected") & F.coalesce(last, F.lit(False)), F.col("other.text")).otherwise(F.col("text")).alias("text"))


def span_text(spans: str) -> Column:
    """Spans as text: "start:end" apart by commas."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
