"""Retention and update gating of fact tables, set-wise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_newest(facts: DataFrame, most: int, session: list[str], recency: list[Column]) -> DataFrame:
    """Each session's ``most`` facts of highest recency."""
    order = Window.partitionBy(*session).orderBy(*(c.desc() for c in recency))
    return facts.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def keep_per_type(facts: DataFrame, most: dict[str, int], session: list[str], type_col: str, recency: list[Column]) -> DataFrame:
    """Each session's newest facts of each capped type; other types are kept whole. Caps apply before rows move."""
    order = Window.partitionBy(*session, type_col).orderBy(*(c.desc() for c in recency))
    ranked = [facts.filter(F.col(type_col) == t).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n") for t, n in most.items()]
    return reduce(DataFrame.unionByName, ranked, facts.filter(~F.coalesce(F.col(type_col).isin(*most), F.lit(False))))


def keep_window(facts: DataFrame, time: Column, span: Column, session: list[str]) -> DataFrame:
    """Facts no older than their session's newest by more than ``span``; those without a time stay.

    The newest time is an aggregate joined back: a session's rows aren't sorted, and meet only where the times are too many to broadcast.
    """
    newest = facts.groupBy(*session).agg(F.max(time).alias("__newest"))
    joined = facts.join(newest, reduce(lambda a, b: a & b, [facts[s].eqNullSafe(newest[s]) for s in session])).drop(*(newest[s] for s in session))
    return joined.filter(time.isNull() | (time >= F.col("__newest") - span)).drop("__newest")


def gate_updates(old: DataFrame, new: DataFrame, key: str, tested: list[str]) -> DataFrame:
    """``new`` with ``outcome``: inserted, propagated (a tested path changed), stored (others did) or unchanged."""
    others = [c for c in new.columns if c != key]
    before = old.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in others))
    differs = lambda cs: reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cs], F.lit(False))
    outcome = F.when(F.col("__key").isNull(), "inserted").when(differs(tested), "propagated").when(differs(others), "stored").otherwise("unchanged")
    return new.join(before, new[key] == F.col("__key"), "left").select(*new.columns, outcome.alias("outcome"))
