"""Preference formatting of conversation pairs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import free_name

#: Fixed values of the rendering: a turn is OPEN role LINE text CLOSE.
OPEN, LINE, CLOSE = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def conversations_to_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (role, text).

    Null roles read ``unknown`` and null texts are empty; turns of equal number are ordered by role and text, null
    numbers come first; exactly repeated rows are one turn. Rows without an id are one conversation without an id.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.groupBy(F.col(key).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_set(turn)).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def adjacent_pairs(convs: DataFrame) -> DataFrame:
    """Pairs of candidates from plain conversations: (pair_id, chosen_id, rejected_id, chosen, rejected).

    Conversations 2k and 2k + 1 are the candidates of pair k. The one with more assistant characters is chosen, then the
    smaller id. A conversation without a partner is chosen, with a null rejected side; so is that without an id, in a pair
    without an id.
    """
    answers = F.aggregate(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(0).cast("long"), lambda n, t: n + F.length(t["text"]))
    one = F.struct((-answers).alias("rank"), F.col("conv_id"), F.col("turns"))
    both = convs.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).agg(F.sort_array(F.collect_list(one)).alias("c"))
    at = lambda i, name: F.get("c", F.lit(i))[name]
    return both.select("pair_id", at(0, "conv_id").alias("chosen_id"), at(1, "conv_id").alias("rejected_id"), at(0, "turns").alias("chosen"), at(1, "turns").alias("rejected"))


def _render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(LINE), t["text"], F.lit(CLOSE))))


def _spans(turns: Column, trained: str) -> Column:
    """(start, length) in characters of what is trained on in rendered turns: each trained text and its CLOSE."""
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(F.lit(OPEN + LINE)) + F.length(t["role"])
        body = F.length(t["text"]) + F.lit(len(CLOSE))
        span = F.struct((acc["at"] + head).cast("long").alias("start"), body.cast("long").alias("length"))
        return F.struct(
            (acc["at"] + head + body).cast("long").alias("at"),
            F.when(t["role"] == trained, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """Paired masked completions: one row per pair with its prompt and both completions.

    ``pairs`` has ``chosen`` and ``rejected`` (TURNS); other columns are kept. The longest common prefix of turns, equal in
    role and text, is rendered once as ``prompt``. ``chosen_completion`` and ``rejected_completion`` are the rendered rest of
    each side (other columns of these names give way); ``chosen_mask`` and ``rejected_mask`` list the character spans of a completion on which loss is taken: the
    texts of ``trained`` turns with their closing mark. A null side has no turns, so its prefix and completion are empty;
    pairs of equal conversations have empty completions and masks; where one is a prefix of the other, its completion is.
    """
    left, right, turns = (free_name(x, pairs) for x in ("chosen_turns", "rejected_turns", "prompt_turns"))
    both = pairs.withColumn(left, F.coalesce("chosen", F.array().cast(TURNS))).withColumn(right, F.coalesce("rejected", F.array().cast(TURNS)))
    shorter = F.least(F.size(left), F.size(right))
    norm = lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    both = both.withColumn(left, F.transform(left, norm)).withColumn(right, F.transform(right, norm))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: (i <= shorter) & ~F.get(F.col(left), i - 1).eqNullSafe(F.get(F.col(right), i - 1)))
    both = both.withColumn(turns, F.coalesce(F.array_min(differ) - 1, shorter))
    rest = lambda c: F.slice(F.col(c), F.col(turns) + 1, F.greatest(F.size(c), F.lit(1)))
    return both.select(
        *[c for c in pairs.columns if c.lower() not in ("chosen", "rejected", "prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask")],
        F.col(turns).alias("prompt_turns"),
        _render(F.slice(F.col(left), F.lit(1), F.col(turns))).alias("prompt"),
        _render(rest(left)).alias("chosen_completion"),
        _spans(rest(left), trained).alias("chosen_mask"),
        _render(rest(right)).alias("rejected_completion"),
        _spans(rest(right), trained).alias("rejected_mask"),
    )
