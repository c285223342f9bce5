"""Validation: every rule of a schema in one pass, as rows of findings or as counts by rule.

Rules about one record are Columns of one projection; no rule costs a pass of its own. Uniqueness and links are rules
about tables: one aggregation and one anti join each. Findings are of class ``conflict`` where a value breaks a rule
and ``incomplete`` where a required value is missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.schema import Schema

FINDING = "path string, code string, class string, expected string, actual string"


def _expected(schema: Schema, path: str) -> str:
    f = schema.get(path)
    return "" if f is None else (f.constraint & schema.spread).canon()


def findings(df: DataFrame, schema: Schema, ids: Sequence[str]) -> DataFrame:
    """One row for each record and record rule that it breaks, with the record's ids."""
    rows = []
    for path, code, test in schema.rules(df):
        there = path in df.columns
        value = F.col(f"`{path}`") if there else F.lit(None)
        kind = F.when(value.isNull(), "incomplete").otherwise("conflict") if there and code == "constraint" else F.lit("incomplete" if code == "absent" else "conflict")
        made = F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), kind.alias("class"), F.lit(_expected(schema, path)).alias("expected"), value.cast("string").alias("actual"))
        rows.append(F.when(~test, made))
    keep = [F.col(f"`{x}`") for x in ids]
    if not rows:
        return df.select(*keep, *[F.lit(None).cast("string").alias(x) for x in ("path", "code", "class", "expected", "actual")]).limit(0)
    return df.select(*keep, F.explode(F.array_compact(F.array(*rows))).alias("f")).select(*ids, "f.*")


def report(
    df: DataFrame, schema: Schema, ids: Sequence[str], at: Sequence[str] = (), fill: bool = True, max_errors: int | None = None, partial: bool = False
) -> DataFrame:
    """(ids, pointer, path, code, class, severity, expected, actual, more): findings as a reader wants them.

    ``pointer`` leads to the value as a JSON pointer: the record's ids, then the field. ``at`` keeps the rules of these
    fields only. Without ``fill``, defaults stand for nothing and a missing value is a finding. A value of a deprecated
    field is a finding of severity ``warning``; missing values are warnings where ``partial``; all others are errors.
    ``max_errors`` is the report's own limit for each path: ``more`` tells how many are left out, after all were counted.
    """
    from .collections import capped

    if at:
        schema = Schema(tuple((k, f) for k, f in schema.fields if k in at), False, schema.spread, (), (), tuple(m for m in schema.musts if m[1] in at))
    if not fill:
        schema = Schema(tuple((k, replace(f, defaults=())) for k, f in schema.fields), schema.closed, schema.spread, (), (), schema.musts)
    found = findings(df, schema, ids)
    old = [(k, f.deprecated) for k, f in schema.fields if f.deprecated and k in df.columns]
    if old:
        rows = [F.when(F.col(f"`{k}`").isNotNull(), F.struct(F.lit(k).alias("path"), F.lit("deprecated").alias("code"), F.lit("deprecated").alias("class"), F.lit(why).alias("expected"), F.col(f"`{k}`").cast("string").alias("actual"))) for k, why in old]
        found = found.unionByName(df.select(*ids, F.explode(F.array_compact(F.array(*rows))).alias("f")).select(*ids, "f.*"))
    mild = F.col("class") == "deprecated"
    mild = mild | (F.col("class") == "incomplete") if partial else mild
    escaped = lambda c: F.replace(F.replace(c.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    pointer = F.concat(*[x for i in ids for x in (F.lit("/"), escaped(F.col(i)))], F.lit("/"), escaped(F.col("path")))
    # What a reader sees is made of the rows that are left.
    told = found.withColumn("more", F.lit(0).cast("long")) if max_errors is None else capped(found, max_errors, [*ids, "code"], by=["path"])
    told = told.withColumn("pointer", pointer).withColumn("severity", F.when(mild, "warning").otherwise("error"))
    return told.select(*ids, "pointer", "path", "code", "class", "severity", "expected", "actual", "more")


def unique_findings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null somewhere or occur more than once, with their number of rows."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def link_findings(df: DataFrame, field: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose field names no row of the target."""
    there = target.select(F.col(key).alias("_link_key"))
    return df.where(F.col(field).isNotNull()).join(there, F.col(field) == F.col("_link_key"), "left_anti")


def counts(df: DataFrame, schema: Schema, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(path, code, n) for every rule, zero included: records that break it, or keys or links at fault."""
    spark, rules = df.sparkSession, schema.rules(df)
    parts = []
    if rules:
        sums = df.agg(*[F.coalesce(F.sum(F.when(~t, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"r{i}") for i, (_, _, t) in enumerate(rules)])
        rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("code"), F.col(f"r{i}").alias("n")) for i, (p, c, _) in enumerate(rules)])
        parts.append(sums.select(F.explode(rows).alias("x")).select("x.*"))
    for keys in schema.unique:
        bad = unique_findings(df, keys).agg(F.count("*").alias("n"))
        parts.append(bad.select(F.lit(",".join(keys)).alias("path"), F.lit("unique").alias("code"), "n"))
    for link in schema.links:
        bad = link_findings(df, link.field, (tables or {})[link.table], link.key).agg(F.count("*").alias("n"))
        parts.append(bad.select(F.lit(link.field).alias("path"), F.lit("rel_unresolved").alias("code"), "n"))
    if not parts:
        return spark.createDataFrame([], "path string, code string, n long")
    return reduce(DataFrame.unionByName, parts)


def verdict(df: DataFrame, schema: Schema, tables: Mapping[str, DataFrame] | None = None, partial: bool = False) -> DataFrame:
    """One row: valid, invalid or incomplete; a table with missing values only is incomplete unless ``partial``."""
    found = findings(df, schema, []).groupBy("class").agg(F.count("*").alias("n"))
    wide = counts(df, Schema(unique=schema.unique, links=schema.links), tables).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wide"))
    per = found.agg(*[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("conflict", "incomplete")])
    word = F.when(F.col("conflict") + F.col("wide") > 0, "invalid").when((F.col("incomplete") > 0) & F.lit(not partial), "incomplete").otherwise("valid")
    return per.crossJoin(F.broadcast(wide)).select(word.alias("verdict"), "conflict", "incomplete", F.col("wide").alias("table_rules"))


def coverage(df: DataFrame, schema: Schema) -> DataFrame:
    """One row for each field: values, values checked by a rule, and whether schema and table both know it."""
    own = dict(schema.fields)
    names = sorted(set(df.columns) | set(own))
    sums = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names) if n in df.columns])
    rows = []
    for i, n in enumerate(names):
        leaves = F.col(f"c{i}") if n in df.columns else F.lit(0).cast("long")
        checked = leaves if n in own else F.lit(0).cast("long")
        state = "checked" if n in own and n in df.columns else "unused" if n in own else "unchecked"
        rows.append(F.struct(F.lit(n).alias("path"), leaves.alias("leaves"), checked.alias("checked"), F.lit(state).alias("state")))
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
