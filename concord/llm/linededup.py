"""Line dedup: a segment-partition edit join over distinct lines, in DataFrame functions only.

Two lines are near duplicates if at most ``max_edits`` (k) insertions, deletions and substitutions of code points turn
one into the other, and both have ``near_chars`` code points at least. A line of length l is cut into k + 1 even
segments; if a line is within k edits of it, one segment occurs in that line, at a place that the lengths and the
segment's number narrow down to a few. Each line lists the hashes of those substrings for every length from l - k to l
(its own segments among them); lines that share one are candidates, if 24 letters' counts differ by no more than 2k in
sum, and if all but k of sixteen parts of one lie in the other near their places. What is left is verified on their text
by a banded bit-parallel automaton: one word for each number of errors, one bit for each of the 2k + 1 diagonals.

A bucket of lines with a common key is not expanded into its pairs. Its lines are first held against its hub, the line
that meets the most others. Only buckets that then hold several components go on: small ones pair by pair, across
components; the lines of large ones are dealt anew on keys of the whole line but k of k + 4 segments, which lines within k
edits share too, and compared pair by pair across the components that are left there. So a family around one line costs
time in proportion to its lines, and no pair is lost. A family without such a line, many of whose lines differ in the
same two segments only, still costs the square of that number.

Equal lines are one node, whatever their length. A class is a connected component of near duplicates; its first
occurrence, by (doc_id, text hash, line number), stays, the others go. ``near_chars`` is the square of k + 1, which the
segments need, or ``min_chars`` if that is more. Lines shorter than ``min_chars`` stay as they are, and so do lines
without a word that are shorter than ``near_chars``: they are layout. Lines are known by 128 bits of hashes.

Defined cases: null text has no lines and stays null; rows of one id and one text are one document, and lose the same
lines; null ids come first in the order; an empty table gives none; other columns pass through, and ``removed`` must not
name one of them; a text of any length is split whole. Kept lines are joined
by \\n again, so a document that loses nothing keeps its text byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import components
from .scratch import Scratch, refuse_clash
from .text import BLANKS

#: Letters whose counts are compared before lines are.
LETTERS = "etaoinsrhld cumfpgwybvk."
#: Ids of candidate lines, or positions of removed lines, that may be broadcast, in bytes; beyond it they are shuffled.
BROADCAST_BYTES = 24 << 20
#: Lines of a bucket that are compared one by one; larger buckets are dealt anew.
SMALL = 16


@dataclass(frozen=True)
class Near:
    max_edits: int = 2
    min_chars: int = 1

    @property
    def near_chars(self) -> int:
        """Code points from which lines are compared by edits; shorter ones are compared for equality."""
        return max(self.min_chars, (self.max_edits + 1) ** 2)


def shifts(k: int) -> list[tuple[int, int, int]]:
    """(segment number i, difference d, shift s): where segment i of a line d shorter may lie in a line.

    A shift s is possible only if at most i edits lie before the segment and at most k - i after it:
    -i <= s <= i and d - (k - i) <= s <= d + (k - i).
    """
    return [(i, d, s) for d in range(k + 1) for i in range(k + 1) for s in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1)]


def substring_keys(line: Column, n: Column, k: int) -> Column:
    """Hashes of (segment number, substring) for the segments of every line that may be up to k shorter.

    A line of length l has segments of l div (k + 1) code points, the last l mod (k + 1) of them one longer. Where every
    code point is a byte the substrings are cut as bytes, which hash alike and need no walk to where they begin.
    """

    def keys(x: Column) -> Column:
        def key(i: int, d: int, s: int) -> Column:
            start, size = _segment(n - d, k + 1, F.lit(i))
            return F.xxhash64(F.lit(i), F.substring(x, start + s + 1, size))

        return F.array(*[key(*spec) for spec in shifts(k)])

    return F.array_distinct(F.when(F.octet_length(line) == n, keys(line.cast("binary"))).otherwise(keys(line)))


def _segment(n: Column, parts: int, i: Column) -> tuple[Column, Column]:
    """Begin and size of segment i of a line of n code points."""
    q, r = F.call_function("div", n, F.lit(parts)).cast("int"), n % parts
    return q * i + F.greatest(F.lit(0), r - parts + i), q + (r > F.lit(parts - 1) - i).cast("int")


def rest_shifts(k: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(segments left out, shifts of the stretches after each of them): k of k + 4 segments hold all edits.

    What lies before the first of them is in place; the last shift is the difference of the lengths. From one stretch to
    the next the shift changes by one for each edit between them at least.
    """
    moves = [x for x in product(range(-k, k + 1), repeat=k) if 0 <= x[-1] and sum(abs(b - a) for a, b in zip((0, *x), x, strict=False)) <= k]
    return [(out, x) for out in combinations(range(k + 4), k) for x in moves]


def rest_keys(line: Column, k: int) -> Column:
    """Hashes of what is left of a line, or of one up to k shorter in its place, without k of k + 4 segments."""
    if not k:
        return F.array(F.xxhash64(line))
    specs = F.array(*[F.struct(F.array(*map(F.lit, out)).alias("out"), F.array(*map(F.lit, x)).alias("to")) for out, x in rest_shifts(k)])

    def key(p: Column, n: Column) -> Column:
        size = n - p["to"][k - 1]
        at, parts = F.lit(0), []
        for j in range(k):
            begin, long_ = _segment(size, k + 4, p["out"][j])
            shift = p["to"][j - 1] if j else F.lit(0)
            parts.append(F.substring(line, at + 1, F.greatest(begin + shift - at, F.lit(0))))
            at = F.greatest(begin + long_ + p["to"][j], F.lit(0))
        return F.xxhash64(p["out"], *parts, F.substring(line, at + 1, n))

    return _let(F.length(line), lambda n: F.array_distinct(F.transform(specs, lambda p: key(p, n))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, even where a lambda in it names the value for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def letter_counts(line: Column) -> list[Column]:
    """24 letters' counts modulo 32, twelve to a long."""
    out = []
    for part in range(0, len(LETTERS), 12):
        x = F.lit(0).cast("long")
        for i, c in enumerate(LETTERS[part : part + 12]):
            n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
            x = x.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(31).cast("long")), 5 * i))
        out.append(x)
    return out


def counts_allow(a: list[Column], b: list[Column], k: int) -> Column:
    """Whether packed counts differ by 2k at most; each count only modulo 32, so no true pair fails."""
    count = lambda x, i: F.shiftrightunsigned(x, 5 * i).bitwiseAND(F.lit(31).cast("long"))
    total = F.lit(0).cast("long")
    for x, y in zip(a, b, strict=True):
        for i in range(12):
            d = (count(x, i) - count(y, i)).bitwiseAND(F.lit(31).cast("long"))
            total = total + F.least(d, F.lit(32).cast("long") - d)
    return total <= 2 * k


def segments_found(a: Column, b: Column, k: int, parts: int = 16) -> Column:
    """Whether all but k of the parts of ``a`` occur in ``b`` up to k places from their own; each edit spoils one part."""

    def hits(n: Column) -> Column:
        def found(i: Column) -> Column:
            start = F.call_function("div", n * i, F.lit(parts)).cast("int")
            size = F.call_function("div", n * (i + 1), F.lit(parts)).cast("int") - start
            low = F.greatest(start - k, F.lit(0))
            return F.when(F.substring(b, low + 1, start + size + k - low).contains(F.substring(a, start + 1, size)), 1).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), lambda s, i: s + found(i))

    return _let(F.length(a), hits) >= parts - k


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Whether two texts are within k edits: an automaton over the diagonals, advanced by one character of ``b`` a step.

    Bit j + k of word e says that e errors reach the cell on diagonal j. A match keeps the diagonal; a substitution
    keeps it for one more error; an insertion comes from the diagonal above, a deletion from the one below.
    """
    width = (1 << (2 * k + 1)) - 1
    names = [f"r{e}" for e in range(k + 1)]
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << k & width).alias(x) for e, x in enumerate(names)])

    def step(state: Column, match: Column) -> Column:
        new = [state["r0"].bitwiseAND(match)]
        for e in range(1, k + 1):
            old = state[f"r{e - 1}"]
            moved = old.bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(state[f"r{e}"].bitwiseAND(match).bitwiseOR(moved).bitwiseAND(F.lit(width)))
        return F.struct(*[x.alias(name) for x, name in zip(new, names, strict=True)])

    def judge(v: Column) -> Column:
        ca, cb = v["a"], v["b"]
        bit = lambda c, j, d: F.when(F.coalesce((j + d >= 0) & (F.get(ca, j + d) == c), F.lit(False)), 1 << (d + k)).otherwise(0)
        matches = F.transform(cb, lambda c, j: reduce(lambda p, q: p + q, [bit(c, j, d) for d in range(-k, k + 1)]))
        end = F.aggregate(matches, start, step)[names[-1]]
        at = F.size(ca) - F.size(cb) + k
        return F.when((at >= 0) & (at <= 2 * k), F.get(F.reverse(F.split(F.lpad(F.bin(end), 2 * k + 1, "0"), "")), at) == "1").otherwise(F.lit(False))

    return _let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), judge)


def _occurrences(docs: DataFrame, doc_id: str, text: str, near: Near) -> DataFrame:
    """(d, t, pos, h1, h2, line) of every line that takes part."""
    x = F.col(text)
    # The text's hash in a step of its own: beside the explode it would be computed anew for every line.
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(x).alias("t"), x.alias("x")).select("d", "t", F.posexplode_outer(F.split("x", "\n")).alias("pos", "line"))
    line = F.col("line")
    worded = F.length(F.trim(line, F.lit(BLANKS))) > 0
    rows = rows.where((F.length(line) >= near.near_chars) | (F.length(line) >= near.min_chars) & worded)
    return rows.select("d", "t", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line, F.lit(7)).alias("h2"), "line")


def near_lines(lines: DataFrame, near: Near, work: Scratch) -> DataFrame:
    """(h1, h2, component): near-duplicate lines; lines without near duplicates are missing. ``lines`` are distinct."""
    k = near.max_edits
    keyed = lines.select("h1", substring_keys(F.col("line"), F.col("size"), k).alias("keys"))
    # An outer explode: the filter on the array's size that an inner one infers would compute the keys again.
    shared = _shared(keyed.select("h1", F.explode_outer("keys").alias("key")), work)
    ids = work.cut(shared.select("h1").distinct())
    ids = F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids
    texts = work.cut(lines.select("h1", "h2", "line").join(ids, "h1", "left_semi").select("*", *[f.alias(f"f{i}") for i, f in enumerate(letter_counts(F.col("line")))]))
    near_ = _links(_stars(shared, work), texts, k, work)
    first = components(near_, work)
    open_ = _unresolved(shared, first, work)
    pairs = _across(open_.where(F.col("size") <= SMALL), texts, k)
    # The lines of large buckets meet again only where all but k of k + 4 segments are the same.
    again = texts.join(open_.where(F.col("size") > SMALL).select("h1").distinct(), "h1", "left_semi")
    again = work.cut(again.select("h1", rest_keys(F.col("line"), k).alias("keys")))
    rest = _shared(again.select("h1", F.explode_outer("keys").alias("key")), work)
    dense = _unresolved(rest, first, work)
    links = _links(pairs.unionByName(_across(dense, texts, k)).distinct(), texts, k, work)
    comp = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), work)
    out = work.cut(comp.select(F.col("node").alias("h1"), "component").join(texts.select("h1", "h2"), "h1"))
    work.drop(shared, near_, first, open_, again, rest, dense, links, comp, texts)
    return out


def _shared(keyed: DataFrame, work: Scratch) -> DataFrame:
    """(h1, key, size): the keys that several lines have, and of how many lines."""
    w = Window.partitionBy("key")
    rows = keyed.where(F.col("key").isNotNull()).repartition("key").withColumn("lo", F.min("h1").over(w)).withColumn("hi", F.max("h1").over(w))
    return work.cut(rows.withColumn("size", F.count("*").over(w)).where("lo <> hi").select("h1", "key", "size"))


def _stars(shared: DataFrame, work: Scratch) -> DataFrame:
    """Pairs of the lines of a bucket with its hub: the line that meets the most others, in all its buckets."""
    weight = shared.groupBy("h1").agg(F.struct(F.sum("size").alias("w"), "h1").alias("w"))
    hub = work.cut(shared.join(weight, "h1").groupBy("key").agg(F.max("w").alias("hub")).select("key", F.col("hub.h1").alias("hub")))
    return shared.join(hub, "key").where("h1 <> hub").select(F.least("h1", "hub").alias("a"), F.greatest("h1", "hub").alias("b")).distinct()


def _unresolved(shared: DataFrame, comp: DataFrame, work: Scratch) -> DataFrame:
    """(h1, key, c, size) of the buckets that hold several components; c is the line's."""
    named = shared.join(comp.withColumnRenamed("node", "h1"), "h1", "left").select("h1", "key", F.coalesce("component", "h1").alias("c"), "size")
    per = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return work.cut(named.join(per, "key", "left_semi"))


def _across(open_: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Pairs of lines of one bucket and different components, as far as their letters allow."""
    rows = open_.select("h1", "key", "c").join(texts.select("h1", "f0", "f1"), "h1")
    a, b = rows.alias("a"), rows.alias("b")
    fits = counts_allow([F.col("a.f0"), F.col("a.f1")], [F.col("b.f0"), F.col("b.f1")], k)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.h1") < F.col("b.h1")) & (F.col("a.c") != F.col("b.c")) & fits)
    return met.select(F.col("a.h1").alias("a"), F.col("b.h1").alias("b")).distinct()


def _links(pairs: DataFrame, texts: DataFrame, k: int, work: Scratch) -> DataFrame:
    """The pairs (a, b) that are within k edits."""
    one = texts.select(F.col("h1").alias("a"), F.col("line").alias("x"), F.col("f0").alias("x0"), F.col("f1").alias("x1"))
    two = texts.select(F.col("h1").alias("b"), F.col("line").alias("y"), F.col("f0").alias("y0"), F.col("f1").alias("y1"))
    fits = counts_allow([F.col("x0"), F.col("x1")], [F.col("y0"), F.col("y1")], k) & (F.abs(F.length("x") - F.length("y")) <= k)
    met = work.cut(pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "x", "y"))
    # Few bytes, but much work for each: dealt anew, so that no task gets them all.
    dealt = met.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    out = work.cut(dealt.where(segments_found(F.col("x"), F.col("y"), k) & within_edits(F.col("x"), F.col("y"), k)).select("a", "b"))
    work.drop(met)
    return out


def repeated_lines(docs: DataFrame, near: Near, doc_id: str, text: str, work: Scratch) -> DataFrame:
    """(d, t, gone): per document the positions of lines that repeat an earlier one."""
    occ = _occurrences(docs, doc_id, text, near)
    at = F.struct("d", "t", "pos")
    lines = occ.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(at).alias("first"), F.count("*").alias("n"))
    # The size is written too: as an expression it would be counted anew wherever a key names it.
    lines = work.cut(lines.withColumn("size", F.length("line")))
    comp = near_lines(lines.where(F.col("size") >= near.near_chars), near, work)
    classed = work.cut(lines.drop("line", "size").join(comp, ["h1", "h2"], "left").where("n > 1 or component is not null"))
    work.drop(lines)
    alone = classed.where("component is null and n > 1").select("h1", "h2", "first")
    many = classed.where("component is not null")
    tops = many.groupBy("component").agg(F.min("first").alias("top"))
    several = work.cut(alone.unionByName(many.join(tops, "component").select("h1", "h2", F.col("top").alias("first"))))
    again = occ.select("d", "t", "pos", "h1", "h2").join(several, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first")))
    out = work.cut(again.groupBy("d", "t").agg(F.collect_set("pos").alias("gone")))
    work.drop(comp, classed, several)
    return out


def line_dedup(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; ``removed`` names a column for their number."""
    refuse_clash(docs, [removed] * (removed is not None))
    work = Scratch(docs.sparkSession, "lines")
    gone = repeated_lines(docs, near, doc_id, text, work)
    gone = gone.select(F.col("d").alias("_line_d"), F.col("t").alias("_line_t"), F.col("gone").alias("_line_gone"))
    size = gone.agg(F.coalesce(F.sum(F.size("_line_gone") * 4 + 64), F.lit(0))).first()[0]
    side = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    x, lost = F.col(text), F.col("_line_gone")
    same = F.col(doc_id).eqNullSafe(F.col("_line_d")) & (F.xxhash64(x) == F.col("_line_t"))
    joined = docs.join(side, same, "left")
    # The lines are split once, not for every line that stays.
    left = _let(F.split(x, "\n"), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), lost), lambda i: F.get(ls, i)), "\n"))
    out = joined.withColumn(text, F.when(lost.isNull(), x).otherwise(left))
    if removed:
        out = out.withColumn(removed, F.coalesce(F.size(lost), F.lit(0)).cast("long"))
    return out.drop("_line_d", "_line_t", "_line_gone")
