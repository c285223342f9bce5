"""Questions about documents: where a value comes from, who may see a path, content ids, view data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import portable


def why(sources: Mapping[str, DataFrame], keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, path, source, rank, value): what each source, in order of rank, contributes to each value."""
    parts = []
    for rank, (name, df) in enumerate(sources.items()):
        own = [f for f in fields if f in df.columns]
        rows = F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value"))) for f in own])
        parts.append(df.select(*keys, F.lit(name).alias("source"), F.lit(rank).alias("rank"), F.explode(F.array_compact(rows)).alias("f")))
    return reduce(DataFrame.unionByName, parts).select(*keys, "f.path", "source", "rank", "f.value")


def decided(contributions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The contribution of the lowest rank to each value."""
    best = F.min_by(F.struct("source", "value"), "rank")
    return contributions.groupBy(*keys, "path").agg(best.alias("b")).select(*keys, "path", "b.source", "b.value")


def path_pattern(pattern: str) -> str:
    """A pattern of segments as a regular expression over the path and everything below; ``*`` is one segment."""
    segments = [r"[^.]+" if s == "*" else "".join("\\" + c if not c.isalnum() and c != "_" else c for c in s) for s in pattern.split(".")]
    return portable("^" + r"\.".join(segments) + r"(\.|\z)")


def allow(paths: DataFrame, allowed: Sequence[str], denied: Sequence[str] = (), path: str = "path") -> DataFrame:
    """``paths`` with a verdict: ``denied`` wins, ``allowed`` must cover, else ``uncovered``."""
    c = F.col(path)
    hit = lambda ps: reduce(lambda a, b: a | b, [c.rlike(path_pattern(p)) for p in ps], F.lit(False))
    # A denied path below the asked one also denies: the two intersect.
    below = reduce(lambda a, b: a | b, [F.lit(p).startswith(F.concat(c, F.lit("."))) for p in denied], F.lit(False))
    return paths.withColumn("verdict", F.when(hit(denied) | below, "denied").when(hit(allowed), "allowed").otherwise("uncovered"))


def path_meet(a: Column, b: Column, sep: str = ".") -> Column:
    """Two paths met: the longer one if the other leads to it, segment by segment; else null. A missing one is any path."""
    below = lambda x, y: (x == y) | y.startswith(F.concat(x, F.lit(sep)))
    return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).when((a == "") | below(a, b), b).when((b == "") | below(b, a), a)


def path_of(*parts: Column, sep: str = ".") -> Column:
    """The address of a value: its segments in order; a missing segment makes it null."""
    some = parts[0].isNotNull()
    for p in parts[1:]:
        some = some & p.isNotNull()
    return F.when(some, F.concat_ws(sep, *[p.cast("string") for p in parts]))


def canon(df: DataFrame, *fields: str) -> Column:
    """A record's canonical JSON: names in code point order, nulls as null."""
    named = sorted(fields or df.columns)
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in named]), {"ignoreNullFields": "false"})


def content_hash(df: DataFrame, *fields: str) -> Column:
    return F.sha2(canon(df, *fields), 256)


def table_hash(df: DataFrame) -> DataFrame:
    """One hash for a table's rows, whatever their order; repeated rows count."""
    h = F.xxhash64(canon(df))
    return df.agg(F.sha2(F.concat_ws(":", F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), F.bit_xor(h)), 256).alias("hash"))


def keys_view(df: DataFrame, column: str) -> DataFrame:
    """The keys of a map column, each once, in order."""
    return df.select(F.explode(F.map_keys(column)).alias("key")).distinct().orderBy("key")


def types_view(df: DataFrame) -> DataFrame:
    """(path, type) of a table's columns."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "path string, type string")


def tree_weights(df: DataFrame, levels: Sequence[str], weight: Column) -> DataFrame:
    """(depth, path, weight) of every node of a hierarchy: grouping by each prefix of the levels, in one pass."""
    sets = df.rollup(*levels).agg(F.sum(weight).alias("weight"), F.grouping_id().alias("g"))
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("g"), F.lit("0"), F.lit("")))
    return sets.select(depth.cast("int").alias("depth"), F.concat_ws(".", *[F.col(c).cast("string") for c in levels]).alias("path"), "weight")


def files(df: DataFrame, file: str, order: Sequence[str], text: str) -> DataFrame:
    """(file, text): each file's lines, in order, joined by newlines."""
    rows = F.sort_array(F.collect_list(F.struct(*order, text)))
    return df.groupBy(file).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n").alias("text"))


def matrix(df: DataFrame, row: str, column: str, weight: Column | None = None) -> DataFrame:
    """(row, column, n): the cells of a matrix that hold something."""
    return df.groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def states(df: DataFrame, by: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """(src, dst, n): how often one state follows another, within each ``by``; null stands before the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select(F.lag(state).over(w).alias("src"), F.col(state).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def sequence(df: DataFrame, lane: str, order: Sequence[str], text: str) -> DataFrame:
    """(lane, step, text): the messages of each lane in their order, steps from 0."""
    step = F.row_number().over(Window.partitionBy(lane).orderBy(*order)) - 1
    return df.select(F.col(lane).alias("lane"), step.alias("step"), F.col(text).alias("text"))


def ladder(df: DataFrame, value: str, rungs: Sequence[float]) -> DataFrame:
    """(rung, low, n): how many values stand on each rung: at its bound or above, and below the next one's.

    Rung 0 holds what is below the first bound; null values stand on no rung.
    """
    bounds = F.array(*map(F.lit, rungs))
    rung = F.size(F.filter(bounds, lambda b: b <= F.col(value)))
    rows = df.where(F.col(value).isNotNull()).select(rung.alias("rung")).groupBy("rung").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(rungs) + 1).select(F.col("id").cast("int").alias("rung"))
    low = F.when(F.col("rung") > 0, F.get(bounds, F.col("rung") - 1))
    return every.join(F.broadcast(rows), "rung", "left").select("rung", low.alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def covers(pairs: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """The pairs of an order with nothing between them, from the pairs of the whole order (reflexive ones may be there)."""
    own = pairs.where(F.col(low) != F.col(high)).select(F.col(low).alias("low"), F.col(high).alias("high")).distinct()
    a, b = own.select("low", F.col("high").alias("mid")), own.select(F.col("low").alias("mid"), "high")
    return own.join(a.join(b, "mid").select("low", "high").distinct(), ["low", "high"], "left_anti")


def lattice(covering: DataFrame, pairs: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """(a, b, join): the least element above both, of every two elements that have one; a < b.

    Least upper bounds are asked of every two elements, so this is for orders of few elements, as figures show them.
    """
    nodes = covering.select(F.col("low").alias("x")).unionByName(covering.select(F.col("high").alias("x"))).distinct()
    up = pairs.select(F.col(low).alias("x"), F.col(high).alias("up")).unionByName(nodes.select("x", F.col("x").alias("up"))).distinct()
    both = up.select(F.col("x").alias("a"), "up").join(up.select(F.col("x").alias("b"), "up"), "up").where("a < b")
    # The least of the common bounds is the one that is below all others: that has as many of them above as there are.
    rank = both.join(up.select(F.col("x").alias("up"), F.col("up").alias("over")), "up").join(both.select("a", "b", F.col("up").alias("over")), ["a", "b", "over"])
    above = rank.groupBy("a", "b", "up").agg(F.count("*").alias("n"))
    total = both.groupBy("a", "b").agg(F.count("*").alias("total"))
    return above.join(total, ["a", "b"]).where("n = total").select("a", "b", F.col("up").alias("join"))


def loss(view: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(shown, left_out): how many of a table's keys a view shows, and how many it does not."""
    own, there = source.select(key).distinct(), view.select(key).distinct().withColumn("_seen", F.lit(1))
    return own.join(there, key, "left").agg(F.count("_seen").alias("shown"), F.count_if(F.col("_seen").isNull()).alias("left_out"))
