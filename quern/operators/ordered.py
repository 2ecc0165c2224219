"""Order-dependent operators: first wins, greedy spans, text edits, reservation in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import written


def first_wins(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row of each key, the first by order (which must be total for a fixed result); nulls come first.

    An aggregate, so that rows of a hot key are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[c if c in key else F.col("_r")[c].alias(c) for c in df.columns])


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last by order; nulls come first."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[c if c in key else F.col("_r")[c].alias(c) for c in df.columns])


def greedy_spans(spans: Column) -> Column:
    """Of array<struct(start, len, text)>: by start, the longer first; a span that begins before the last accepted end is dropped."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["len"] - a["len"]))
    empty = F.filter(ordered, lambda _: F.lit(False))
    state = F.aggregate(
        ordered,
        F.struct(empty.alias("kept"), F.lit(-1).alias("end")),
        lambda s, x: F.when(x["start"] < s["end"], s).otherwise(F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), (x["start"] + x["len"]).alias("end"))),
    )
    return state["kept"]


def apply_spans(body: Column, spans: Column) -> Column:
    """The body with each (start, len, text) replaced; spans are disjoint and ordered, positions are those of the body as given."""
    state = F.aggregate(
        spans,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["text"], F.substring(body, s["at"] + 1, x["start"] - s["at"]), x["text"]).alias("text"), (x["start"] + x["len"]).alias("at")),
    )
    return F.concat(state["text"], F.substring(body, state["at"] + 1, F.length(body)))


def reserve(claims: DataFrame, taken: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Owners claim keys in turn (seq): an owner gets all its keys or, if one is taken, none.

    claims: (owner, seq, key...), taken: (key...).  Returns (accepted owners, refused owners with the
    first key that was taken, by position ``pos``).  Each round accepts owners that come first for all
    their keys and refuses those that meet a key of an accepted one; only aggregates by key and
    by owner are needed, so a key with very many claims costs one row a claim and round.
    """
    keys = [c for c in claims.columns if c not in ("owner", "seq", "pos")]
    order = F.struct("pos", *keys)
    hit = claims.join(taken.select(*keys).distinct(), keys, "left_semi")
    refused = hit.groupBy("owner").agg(F.min(order).alias("by"))
    open_ = written(claims.join(refused.select("owner"), "owner", "left_anti"), "claims")
    accepted = None
    for _ in range(most_rounds):
        if open_.isEmpty():
            break
        first = open_.groupBy(*keys).agg(F.min("seq").alias("first"))
        state = open_.join(first, keys).groupBy("owner", "seq").agg(F.min((F.col("first") == F.col("seq")).cast("int")).alias("ok"))
        won = written(state.where("ok = 1").select("owner", "seq"), "won")
        new = open_.join(won.select("owner"), "owner", "left_semi").select(*keys).distinct()
        rest = open_.join(won.select("owner"), "owner", "left_anti")
        lost = rest.join(new, keys, "left_semi").groupBy("owner").agg(F.min(order).alias("by"))
        refused = refused.unionByName(lost)
        accepted = won if accepted is None else accepted.unionByName(won)
        open_ = written(rest.join(lost.select("owner"), "owner", "left_anti"), "claims")
    else:
        raise RuntimeError(f"reservation did not settle in {most_rounds} rounds")
    if accepted is None:
        accepted = claims.select("owner", "seq").limit(0)
    return accepted, refused.select("owner", *[F.col(f"by.{k}").alias(k) for k in keys])
