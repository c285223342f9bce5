"""Folds: sum, least, greatest, join and counts, over a whole table or by group.

An empty sum is 0 and an empty join is ""; an empty least or greatest is an error. Integer sums that do not fit are an
error under ANSI arithmetic. Every fold is a partial aggregation; only ``join`` gathers its members, ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _some(x: Column) -> Column:
    return F.when(x.isNull(), F.raise_error(F.lit("aggregate_empty"))).otherwise(x)


def least(c: Column) -> Column:
    return _some(F.min(c))


def greatest(c: Column) -> Column:
    return _some(F.max(c))


def join(c: Column, order: Sequence[Column], sep: str = "") -> Column:
    """Members joined in order; a null one is refused."""
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], c.isNull().alias("bad"), F.coalesce(c.cast("string"), F.lit("")).alias("x"))))
    text = F.array_join(F.transform(rows, lambda r: r["x"]), sep)
    return F.when(F.exists(rows, lambda r: r["bad"]), F.raise_error(F.lit("join_member"))).otherwise(text)


def fold(df: DataFrame, by: Sequence[str] = (), **aggs: Column) -> DataFrame:
    """The folds of a table, or of each group."""
    own = [a.alias(k) for k, a in aggs.items()]
    return df.groupBy(*by).agg(*own) if by else df.agg(*own)


def distinct_count(c: Column) -> Column:
    return F.countDistinct(c)


def sum_in(items: Column, zero: Column) -> Column:
    """An array's sum from the left."""
    return F.aggregate(items, zero, lambda a, x: a + x)
