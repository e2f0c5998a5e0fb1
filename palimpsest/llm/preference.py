"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common turn prefix of the two (same role and text) is rendered once, as the
prompt. What is left of each is rendered as its completion, with the character spans
that bear loss: the contents of the assistant's turns and the mark that ends them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is head + role + neck + text + tail; only turns of ``learnt`` bear loss."""

    head: str = "<|"
    neck: str = "|>\n"
    tail: str = "<|end|>\n"
    learnt: str = "assistant"


def _render(turns: Column, t: Template) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(t.head), x.role, F.lit(t.neck), x.text, F.lit(t.tail))), "")


def _spans(turns: Column, t: Template) -> Column:
    """Loss-bearing [s, e) spans of the rendered turns, in characters."""

    def step(a: Column, x: Column) -> Column:
        s = a.at + F.length(x.role) + len(t.head) + len(t.neck)
        e = s + F.length(x.text) + len(t.tail)
        learnt = F.when(x.role == t.learnt, F.concat(a.spans, F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(a.spans)
        return F.struct(e.alias("at"), learnt.alias("spans"))

    none = F.array().cast("array<struct<s:int,e:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a.spans)


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns array<struct<turn,role,text>>) of each conversation; turns without a conversation are left out.

    Turns go by turn number, then role, then text; repeated turns stay. A null role is "unknown", a null text empty, and a null
    turn number comes first.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))


def format_pairs(both: DataFrame, template: Template = Template()) -> DataFrame:
    """both(pair_id, chosen, rejected) of turns as ``conversations`` gives them (null: empty); the result is that of ``preference_pairs``."""
    empty = F.array().cast(both.schema["chosen"].dataType)
    both = both.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    n = F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int")
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    cut = both.withColumn("n_common", n).select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    texts = [_render(F.col(c), template).alias(out) for c, out in (("p", "prompt"), ("c", "chosen"), ("r", "rejected"))]
    losses = [_spans(F.col(c), template).alias(out) for c, out in (("c", "chosen_loss"), ("r", "rejected_loss"))]
    counts = [c.cast("long").alias(out) for c, out in ((F.col("n_common"), "n_common"), (F.size("c"), "n_chosen"), (F.size("r"), "n_rejected"))]
    return cut.select("pair_id", *counts, *texts, *losses)


def preference_pairs(turns: DataFrame, pairs: DataFrame, template: Template = Template(), **columns: str) -> DataFrame:
    """One row per row of pairs(pair_id, chosen_id, rejected_id).

    pair_id, n_common (turns), n_chosen, n_rejected (turns of the completions), prompt, chosen,
    rejected (texts), chosen_loss, rejected_loss array<struct<s,e>>. Turns are read as by ``conversations``,
    which takes ``columns``. A conversation without turns, or a null id, is
    empty: nothing is common and its completion is empty. The prompt bears no loss. Repeated
    pairs come out repeated; other columns are ignored.
    """
    talks = conversations(turns, **columns)
    side = lambda name: talks.select(F.col("id").alias(f"{name}_id"), F.col("turns").alias(name))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    return format_pairs(both, template)
