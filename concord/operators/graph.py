"""Graphs of checked links: edges, dangling and inverse checks, cycles, reachability, layers.

Edges are a table (src, rel, dst). Iterations are joins of a frontier with the edges; each round's frontier is written
once and read again, so plans stay flat, and what is already known is never joined again. Tables that a round has used
up are deleted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..lineage import Parts, cut, drop


def edges(df: DataFrame, src: Column, links: Mapping[str, Column]) -> DataFrame:
    """(src, rel, dst) for each link column of each record; null links are no edges."""
    rows = [F.struct(F.lit(rel).alias("rel"), dst.cast("string").alias("dst")) for rel, dst in links.items()]
    out = df.select(src.cast("string").alias("src"), F.explode(F.array(*rows)).alias("e")).select("src", "e.rel", "e.dst")
    return out.where(F.col("dst").isNotNull())


def union_edges(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def dangling(e: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges whose target is no node."""
    return e.join(nodes.select(F.col(node).alias("dst")), "dst", "left_anti").select("src", "rel", "dst")


def inverse_missing(e: DataFrame, rel: str, inverse: str) -> DataFrame:
    """Edges of ``rel`` without the edge of ``inverse`` back."""
    back = e.where(F.col("rel") == inverse).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.where(F.col("rel") == rel).join(back, ["src", "dst"], "left_anti").select("src", "rel", "dst")


def _trimmed(live: DataFrame) -> DataFrame:
    """What is left of edges after taking off nodes without successors or predecessors, again and again."""
    n = live.count()
    while n:
        some = live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        nxt = cut(some.join(some.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        m = nxt.count()
        drop(live)
        live = nxt
        if m == n:
            break
        n = m
    return live


def _spread(e: DataFrame, color: DataFrame) -> DataFrame:
    """(node, color): the greatest color that reaches each node, its own included."""
    while True:
        sent = e.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("sent"))
        nxt = cut(color.join(sent, "node", "left").select("node", F.greatest("color", "sent").alias("color"), (F.col("sent") > F.col("color")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        drop(color)
        color = nxt.select("node", "color") if not moved else cut(nxt.select("node", "color"))
        if not moved:
            return color
        drop(nxt)


def components(e: DataFrame, rel: str | None = None) -> DataFrame:
    """(node, component): the strongly connected components that hold a cycle, named by their greatest node.

    Nodes that lie on no cycle are missing. Rounds of forward coloring: every node takes the greatest node that reaches
    it, and a node that keeps its own name is the root of a component, which is what reaches the root back within its
    color. Edges that lead out of a color or into a finished component lie on no other cycle and go.
    """
    live = e if rel is None else e.where(F.col("rel") == rel)
    live = _trimmed(cut(live.select("src", "dst").distinct()))
    done = None
    while live.limit(1).count():
        nodes = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct()
        color = cut(_spread(live, cut(nodes.withColumn("color", F.col("node")))))
        a, b = color.select(F.col("node").alias("src"), F.col("color").alias("ca")), color.select(F.col("node").alias("dst"), F.col("color").alias("cb"))
        inner = cut(live.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("color")))
        back, front = Parts(e.sparkSession), None
        front = back.add(color.where("node = color").select("node", "color"))
        while front.limit(1).count():
            step = inner.join(front.select(F.col("node").alias("dst"), "color"), ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            front = back.add(step.join(back.all(), ["node", "color"], "left_anti"))
        found = cut(back.all().join(_on_cycles(inner, back.all()), "color", "left_semi").select("node", F.col("color").alias("component")))
        done = found if done is None else done.unionByName(found)
        gone = back.all().select("node")
        rest = inner.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        nxt = cut(rest.select("src", "dst"))
        drop(live, color, inner)
        live = _trimmed(nxt)
    return done if done is not None else live.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def _on_cycles(inner: DataFrame, members: DataFrame) -> DataFrame:
    """The colors whose component has an edge inside: a lone node without a loop is no cycle."""
    a, b = members.select(F.col("node").alias("src"), "color"), members.select(F.col("node").alias("dst"), "color")
    return inner.join(a, ["src", "color"], "left_semi").join(b, ["dst", "color"], "left_semi").select("color").distinct()


def cycle_nodes(e: DataFrame, rel: str | None = None) -> DataFrame:
    """Nodes that lie on a cycle."""
    return components(e, rel).select("node")


def cycles(e: DataFrame, rel: str | None = None) -> DataFrame:
    """(node, path): for each component that holds a cycle the shortest one through its greatest node, which ends the path too.

    Of equally short ones it is the least, node by node.
    """
    own = e if rel is None else e.where(F.col("rel") == rel)
    comp = cut(components(own))
    a, b = comp.select(F.col("node").alias("src"), F.col("component").alias("ca")), comp.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    inner = own.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("ca = cb").select("src", F.lit("").alias("rel"), "dst", "ca")
    ways = reaches(inner.select("src", "rel", "dst"), comp.where("node = component").select("node"), path=True)
    last = inner.where("dst = ca").select(F.col("src").alias("node"), F.col("dst").alias("source"))
    met = ways.join(last, ["source", "node"]).select("source", F.struct("steps", F.array_append("path", F.col("source")).alias("path")).alias("way"))
    return met.groupBy(F.col("source").alias("node")).agg(F.min("way").alias("way")).select("node", "way.path")


def acyclic(e: DataFrame, rel: str | None = None) -> bool:
    """Whether no node lies on a cycle: what the trimming of ends leaves holds one."""
    live = e if rel is None else e.where(F.col("rel") == rel)
    return not _trimmed(cut(live.select("src", "dst").distinct())).limit(1).count()


def reaches(e: DataFrame, sources: DataFrame, rel: str | None = None, path: bool = False) -> DataFrame:
    """(source, node, steps): every node that a source reaches, by the shortest way; a source reaches itself in 0.

    ``path`` adds the nodes of that way, source and node included; of equally short ways the least, node by node.
    """
    own = e if rel is None else e.where(F.col("rel") == rel)
    step = cut(own.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct())
    seen = Parts(e.sparkSession)
    first = sources.select(F.col(sources.columns[0]).cast("string").alias("source")).distinct().select("source", F.col("source").alias("node"), F.lit(0).alias("steps"))
    front = seen.add(first.withColumn("path", F.array("node")) if path else first)
    i = 0
    while front.limit(1).count():
        i += 1
        nxt = front.join(step, "node").select("source", F.col("to").alias("node"), *([F.array_append("path", F.col("to")).alias("path")] if path else []))
        nxt = nxt.groupBy("source", "node").agg(F.min("path").alias("path")) if path else nxt.distinct()
        nxt = nxt.join(seen.all().select("source", "node"), ["source", "node"], "left_anti").withColumn("steps", F.lit(i))
        front = seen.add(nxt.select("source", "node", "steps", *["path"] * path))
    drop(step)
    return seen.all()


def layers(e: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, layer): the longest way from a node without predecessors; nodes on cycles are missing."""
    left = cut(e.select("src", "dst").distinct())
    todo = cut(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
    done = None
    for i in range(max_rounds):
        free = cut(todo.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(i)))
        if not free.limit(1).count():
            break
        done = free if done is None else done.unionByName(free)
        gone = free.select(F.col("node"))
        old = todo, left
        todo = cut(todo.join(gone, "node", "left_anti"))
        left = cut(left.join(gone.select(F.col("node").alias("src")), "src", "left_anti"))
        drop(*old)
    return done if done is not None else todo.withColumn("layer", F.lit(0)).limit(0)


def degrees(e: DataFrame) -> DataFrame:
    """(node, n_out, n_in)."""
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def set_intersections(df: DataFrame, item: str, group: str) -> DataFrame:
    """(groups, n): how many items are in exactly this set of groups."""
    per = df.select(item, group).distinct().groupBy(item).agg(F.array_join(F.sort_array(F.collect_list(F.col(group).cast("string"))), "&").alias("groups"))
    return per.groupBy("groups").agg(F.count("*").alias("n"))


def link_flow(links: DataFrame, targets: DataFrame, dst: str, key: str, *fields: str) -> DataFrame:
    """Targets with the fields that links send them; where two links, or a link and the target, differ, ``conflict``."""
    from .merge import meet

    sent = links.where(F.col(dst).isNotNull()).groupBy(F.col(dst).alias(key)).agg(
        *[F.min(f).alias(f) for f in fields],
        F.array_compact(F.array(*[F.when(F.min(f) != F.max(f), F.lit(f)) for f in fields])).alias("_sent"),
    )
    met = meet(targets, sent.drop("_sent"), [key])
    return met.join(sent.select(key, "_sent"), key, "left").withColumn("conflict", F.array_union("conflict", F.coalesce("_sent", F.array().cast("array<string>")))).drop("_sent")


def flow(e: DataFrame, values: DataFrame, key: str, *fields: str) -> DataFrame:
    """``values`` after every record has sent its fields along its links, and what came in further on, to the end.

    (key, fields, conflict): a field has the one value that its record and all that reach it through links agree on; where
    two differ it is null and named in ``conflict``, and it sends both on. A field keeps two values at most, its least and
    its greatest, so the rounds end, cycles or not.
    """
    step = cut(e.select("src", "dst").distinct())
    span = [x for f in fields for x in (F.col(f).alias(f"lo_{f}"), F.col(f).alias(f"hi_{f}"))]
    now = cut(values.select(F.col(key).cast("string").alias("node"), *span))
    while True:
        sent = step.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(*[x for f in fields for x in (F.min(f"lo_{f}").alias(f"a_{f}"), F.max(f"hi_{f}").alias(f"b_{f}"))])
        met = now.join(sent, "node", "left")
        moved, cols = F.lit(False), []
        for f in fields:
            lo, hi = F.least(f"lo_{f}", f"a_{f}"), F.greatest(f"hi_{f}", f"b_{f}")
            cols += [lo.alias(f"lo_{f}"), hi.alias(f"hi_{f}")]
            moved = moved | ~lo.eqNullSafe(F.col(f"lo_{f}")) | ~hi.eqNullSafe(F.col(f"hi_{f}"))
        nxt = cut(met.select("node", *cols, moved.alias("moved")))
        drop(now)
        if not nxt.where("moved").limit(1).count():
            break
        now = nxt.drop("moved")
    one = [F.when(F.col(f"lo_{f}") == F.col(f"hi_{f}"), F.col(f"lo_{f}")).alias(f) for f in fields]
    bad = F.array_compact(F.array(*[F.when(F.col(f"lo_{f}") != F.col(f"hi_{f}"), F.lit(f)) for f in fields]))
    return nxt.select(F.col("node").alias(key), *one, bad.alias("conflict"))


def relation_check(e: DataFrame, acyclic: Sequence[str] = (), inverse: Mapping[str, str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(at, code, detail): nodes on cycles of relations that must have none, edges without their inverse, dangling edges."""
    parts = [cycle_nodes(e, r).select(F.col("node").alias("at"), F.lit("relation_cycle").alias("code"), F.lit(r).alias("detail")) for r in acyclic]
    for r, back in (inverse or {}).items():
        parts.append(inverse_missing(e, r, back).select(F.col("src").alias("at"), F.lit("relation_inverse_missing").alias("code"), F.concat_ws(" ", F.lit(back), "dst").alias("detail")))
    if nodes is not None:
        parts.append(dangling(e, nodes).select(F.col("src").alias("at"), F.lit("rel_unresolved").alias("code"), F.concat_ws(" ", "rel", "dst").alias("detail")))
    if not parts:
        return e.sparkSession.createDataFrame([], "at string, code string, detail string")
    return reduce(DataFrame.unionByName, parts)


def closure(e: DataFrame) -> DataFrame:
    """(source, node, steps) for every pair with a way from one to the other, by the shortest.

    All pairs are what is asked for here, so the result may be as large as the square of the nodes.
    """
    return reaches(e, e.select("src").distinct()).where("steps > 0")
