"""Meets of tables: records of one key agree or conflict; defaults, spreads, lists, and differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .collections import refuse_null


def meet(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records of both sides by key; fields of both must agree where both have a value. ``conflict`` lists the others.

    A key must be unique on each side. Fields in conflict are null.
    """
    both = [c for c in a.columns if c in b.columns and c not in keys]
    x, y = a.alias("x"), b.alias("y")
    joined = x.join(y, reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]), "full_outer")
    clash = {c: F.col(f"x.{c}").isNotNull() & F.col(f"y.{c}").isNotNull() & (F.col(f"x.{c}") != F.col(f"y.{c}")) for c in both}
    out = [F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys]
    for c in [*a.columns, *(c for c in b.columns if c not in a.columns)]:
        if c in keys:
            continue
        out.append(F.when(~clash[c], F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}"))).alias(c) if c in both else F.col(f"x.{c}" if c in a.columns else f"y.{c}").alias(c))
    named = F.array_compact(F.array(*[F.when(clash[c], F.lit(c)) for c in both])) if both else F.array().cast("array<string>")
    return joined.select(*out, named.alias("conflict"))


def meet_lists(a: Column, b: Column) -> Column:
    """Two lists met by position: (list, conflict). A closed list: both must be of one length.

    Members that one side leaves null take the other's; where two differ the place is null and in ``conflict``; lists of
    two lengths are in conflict at the first place that one of them lacks. A list that is null takes the other whole.
    """
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    some = F.when(F.greatest(F.size(a), F.size(b)) > 0, places).otherwise(F.array().cast("array<int>"))
    one, two = lambda i: F.get(a, i), lambda i: F.get(b, i)
    differ = lambda i: F.coalesce(one(i) != two(i), F.lit(False))
    met = F.transform(some, lambda i: F.when(~differ(i), F.coalesce(one(i), two(i))))
    bad = F.filter(some, lambda i: differ(i) | ((i == F.least(F.size(a), F.size(b))) & (F.size(a) != F.size(b))))
    none = F.array().cast("array<int>")
    return F.when(a.isNull() | b.isNull(), F.struct(F.coalesce(a, b).alias("list"), none.alias("conflict"))).otherwise(F.struct(met.alias("list"), bad.alias("conflict")))


def conflicts(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, path, left, right) for each field on which records of one key disagree."""
    both = [c for c in a.columns if c in b.columns and c not in keys]
    x, y = a.alias("x"), b.alias("y")
    joined = x.join(y, reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]))
    rows = [F.when(F.col(f"x.{c}") != F.col(f"y.{c}"), F.struct(F.lit(c).alias("path"), F.col(f"x.{c}").cast("string").alias("left"), F.col(f"y.{c}").cast("string").alias("right"))) for c in both]
    return joined.select(*[F.col(f"x.{k}") for k in keys], F.explode(F.array_compact(F.array(*rows))).alias("f")).select(*keys, "f.*")


def extra_keys(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records that a closed collection does not have."""
    return df.join(allowed.select(*keys), list(keys), "left_anti")


def ranked(*values: tuple[int, Column]) -> Column:
    """The value of the lowest rank that is there; an explicit value has rank 0."""
    return F.coalesce(*[c for _, c in sorted(values, key=lambda x: x[0])])


def ranked_clash(*values: tuple[int, Column]) -> Column:
    """Whether the rank that decides holds two values that differ."""
    out, taken = F.lit(False), F.lit(False)
    for r in sorted({r for r, _ in values}):
        own = [c for q, c in values if q == r]
        some = reduce(lambda a, b: a | b, [c.isNotNull() for c in own])
        differ = [F.coalesce(a != b, F.lit(False)) for i, a in enumerate(own) for b in own[:i]]
        out = out | (~taken & reduce(lambda a, b: a | b, differ, F.lit(False)))
        taken = taken | some
    return out


def admitted(value: Column, test: Column, default: Column) -> Column:
    """A value that an arm admits, or the default where none is given; anything else is an error."""
    return F.when(value.isNull(), default).when(test, value).otherwise(F.raise_error(F.lit("constraint")))


def spread(df: DataFrame, **template: Column) -> DataFrame:
    """A template met into every member: missing fields are filled, present ones must agree, or the member is in error."""
    for name, c in template.items():
        if name in df.columns:
            own = F.col(name)
            df = df.withColumn(name, F.when(own.isNull() | (own == c), c).otherwise(F.raise_error(F.concat(F.lit("spread: "), F.lit(name)))))
        else:
            df = df.withColumn(name, c)
    return df


def concat_lists(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """One list after another; positions of the second go on where the first ends."""
    n = a.agg(F.coalesce(F.max(pos) + 1, F.lit(0)).alias("_n"))
    return a.unionByName(b.crossJoin(F.broadcast(n)).withColumn(pos, F.col(pos) + F.col("_n")).drop("_n"))


def diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, path, change, left, right): added, removed and changed values of records by key, in one join."""
    names = list(dict.fromkeys(c for c in (*a.columns, *b.columns) if c not in keys))
    x = a.select(*[F.col(k).alias(f"xk_{k}") for k in keys], *[F.col(c).cast("string").alias(f"x_{c}") for c in a.columns if c not in keys])
    y = b.select(*[F.col(k).alias(f"yk_{k}") for k in keys], *[F.col(c).cast("string").alias(f"y_{c}") for c in b.columns if c not in keys])
    joined = x.join(y, reduce(lambda p, q: p & q, [F.col(f"xk_{k}") == F.col(f"yk_{k}") for k in keys]), "full_outer")
    side = lambda s, df, c: F.col(f"{s}_{c}") if c in df.columns else F.lit(None).cast("string")
    rows = []
    for c in names:
        left, right = side("x", a, c), side("y", b, c)
        change = F.when(left.isNull(), "added").when(right.isNull(), "removed").otherwise("changed")
        rows.append(F.when(~left.eqNullSafe(right), F.struct(F.lit(c).alias("path"), change.alias("change"), left.alias("left"), right.alias("right"))))
    own = [F.coalesce(F.col(f"xk_{k}"), F.col(f"yk_{k}")).alias(k) for k in keys]
    return joined.select(*own, F.explode(F.array_compact(F.array(*rows))).alias("f")).select(*keys, "f.*")


def redundant(df: DataFrame, keys: Sequence[str], **implied: Column) -> DataFrame:
    """(keys, path) of values that say what a default says anyway: taking them out changes nothing."""
    rows = [F.when(F.col(c) == v, F.lit(c)) for c, v in implied.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("path"))


def overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records with a patch's values in place of their own, and the patch's new records."""
    x, y = base.alias("x"), patch.alias("y")
    joined = x.join(y, reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]), "full_outer")
    out = [F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys]
    for c in base.columns:
        if c not in keys:
            out.append(F.coalesce(F.col(f"y.{c}"), F.col(f"x.{c}")).alias(c) if c in patch.columns else F.col(f"x.{c}").alias(c))
    return joined.select(*out)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first record of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def deref(df: DataFrame, field: str, target: DataFrame, key: str, *fields: str) -> DataFrame:
    """Fields of the record that a field refers to; no such record is an error."""
    there = target.select(F.col(key).alias("_ref"), *[F.col(f) for f in fields])
    out = df.join(there, F.col(field) == F.col("_ref"), "left")
    found = refuse_null(F.col("_ref"), "ref")
    return out.withColumn(field, F.when(F.col(field).isNull(), F.col(field)).otherwise(found)).drop("_ref")
