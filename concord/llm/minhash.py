"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets.

Sketch. A document's set of shingles (64-bit hashes) fills ``BANDS * ROWS`` bins. In round i every shingle is hashed
anew and falls into a random bin (rounds 0 to t - 1) or, later, into bin i - t; a bin keeps the smallest hash of the
first round that reached it. So every bin fills, and the bins' agreement estimates the similarity with concentration.

Banding. Documents that agree on all bins of a band share a bucket. At the threshold 0.8 a pair shares no bucket with
probability (1 - 0.8^5)^32, 3e-6; at 0.85 it is 7e-9.

Linking. Documents with equal sets are one class from the start. In every bucket each class is first held against the
bucket's smallest one, its full set against the other's. The classes of buckets that still hold several components are
then joined on the rarest tokens of their full sets, which similar sets must share (prefix and position filters), and
the pairs that come of it are held against each other. No link of a bucket is lost, no bucket is capped, and a large
group of copies is not expanded into its pairs. Only pairs whose sizes allow the similarity are compared.

Defined cases: a document without words, with null text, or of a null id is linked with nothing and kept; the same id
twice is one node with both sets; texts of any length are whole; only the four output columns come back, whatever else
the table has; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .scratch import Scratch
from .shingles import shingle_sets

BANDS, ROWS = 32, 5
#: Counters of the order of tokens; a power of two. As int32 they are what a worker holds.
COUNTERS = 1 << 18
#: Pairs that one copy of a set serves.
SALT = 256
#: Ids of documents with a bucket in common that may be broadcast, in bytes; beyond it they are shuffled.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Similarity:
    """Word shingles of ``words``; linked are sets with 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(sets: list[np.ndarray], t: int = BANDS * ROWS) -> np.ndarray:
    """The bins of every set, one row each; sets must not be empty."""
    m = len(sets)
    out = np.zeros(m * t, dtype=np.uint64)
    full = np.zeros(m * t, dtype=bool)
    sizes = np.array([len(s) for s in sets])
    value = np.concatenate(sets)
    doc = np.repeat(np.arange(m), sizes)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    fresh = np.full(m * t, top, dtype=np.uint64)
    open_docs = np.arange(m)
    for i in range(2 * t):
        h = _mix(value + np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32) if i < t else np.full(len(h), i - t, dtype=np.uint64)
        at = doc * t + bins.astype(np.int64)
        todo = ~full[at]
        at, h = at[todo], h[todo]
        np.minimum.at(fresh, at, h)
        # The round's number is part of the value: a bin agrees only with one that the same round filled.
        out[at] = fresh[at] ^ np.uint64((0xD6E8FEB86659FD93 * (i + 1)) & 0xFFFFFFFFFFFFFFFF)
        full[at] = True
        left = ~full.reshape(m, t)[open_docs].all(axis=1)
        if not left.any():
            break
        if left.sum() < 0.7 * len(left):
            open_docs = open_docs[left]
            keep = np.zeros(m, dtype=bool)
            keep[open_docs] = True
            keep = keep[doc]
            value, doc = value[keep], doc[keep]
    return out.reshape(m, t)


def bands_of(sk: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    rows = sk.reshape(len(sk), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key ^ rows[:, :, r])
    return key.view(np.int64)


def _sketched(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(doc_id, n, d1, d2, bands) of every document with shingles; d1 and d2 are 128 bits of the set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sets in shingle_sets(batches, sim.words):
            some = [i for i, s in enumerate(sets) if len(s)]
            if not some:
                continue
            own = [sets[i] for i in some]
            keys = bands_of(sketch(own))
            sums = [(_mix(s).sum(dtype=np.uint64), _mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in own]
            d = np.array(sums, dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": ids[some], "n": [len(s) for s in own], "d1": d[:, 0], "d2": d[:, 1], "bands": list(keys)})

    return docs.mapInPandas(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _full_sets(docs: DataFrame, sim: Similarity) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sets in shingle_sets(batches, sim.words):
            yield pd.DataFrame({"doc_id": ids, "shingles": [s.view(np.int64) for s in sets]})

    return docs.mapInPandas(run, "doc_id long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, written.

    A set that many pairs name as their ``b`` is copied, once for each ``SALT`` of them, so that no task gets them all.
    """
    pairs = work.cut(pairs.select("a", "b"))
    parts = pairs.groupBy("b").agg((1 + F.floor(F.count("*") / SALT)).alias("parts")).where("parts > 1")
    parts = work.cut(parts)
    salted = pairs.join(parts, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("salt"))
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")).join(parts, "b", "left")
    two = two.select("b", "sb", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    out = work.cut(salted.join(one, "a").join(two, ["b", "salt"]).where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))
    work.drop(pairs, parts)
    return out


def _sizes_allow(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def near_duplicates(docs: DataFrame, sim: Similarity = Similarity(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    spark = docs.sparkSession
    work = Scratch(spark, "minhash")
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    src = named.where(F.col("doc_id").isNotNull())
    sk = work.cut(_sketched(src, sim))
    reps = sk.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1")
    # Written, so that the join can split the rows of a key that very many classes share.
    shared = work.cut(shared)
    member = work.cut(rows.join(shared, "key"))
    ids = work.cut(member.select(F.col("rep").alias("doc_id")).distinct())
    near = F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids
    # A repeated id may have several sets; each stays a set of its own under that id.
    sets = work.cut(_full_sets(src.join(near, "doc_id"), sim).select(F.col("doc_id").alias("rep"), "shingles").distinct())
    hub_n = member.where("rep = hub").select("hub", F.col("n").alias("hub_n")).distinct()
    stars = member.where("rep <> hub").select("rep", "n", "hub").distinct().join(hub_n, "hub").where(_sizes_allow(F.col("n"), F.col("hub_n"), sim.percent))
    # Equal sets under several ids are links to the smallest.
    # Written, so that the join can split a set that very many documents have.
    own = ["d1", "d2", "n"]
    twins = work.cut(sk.groupBy(*own).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1").select(*own, "rep"))
    same = sk.select("doc_id", *own).join(twins, own).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = _verified(stars.select(F.col("rep").alias("a"), F.col("hub").alias("b")), sets, sim.percent, work)
    first = components(links, work)
    comp = _rest(member, sets, first, sim, work)
    # Classes, then their members.
    tie = same.join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").select("a", F.coalesce("cb", "b").alias("c"))
    top = tie.groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c1"))
    whole = comp.join(top, "node", "full").select("node", F.coalesce("component", "node").alias("c0"), "c1")
    if whole.where("c1 is not null and c0 <> c1 and c0 <> node").limit(1).count():
        # An id with two sets ties components together.
        extra = whole.where("c1 is not null").select(F.col("c0").alias("a"), F.col("c1").alias("b"))
        tied = components(extra, work).select(F.col("node").alias("t"), F.col("component").alias("tc"))
        whole = whole.withColumn("t", F.coalesce("c1", "c0")).join(tied, "t", "left").withColumn("component", F.coalesce("tc", F.least("c0", F.coalesce("c1", "c0"))))
    else:
        whole = whole.withColumn("component", F.coalesce(F.least("c0", "c1"), "c0"))
    # The smallest id of a component may itself be a class of ids below its representative only if it is the
    # representative, which is the smallest of its class: so the component's name is right as it stands.
    whole = work.cut(whole.select(F.col("node").alias("doc_id"), "component"))
    work.drop(shared, member, ids, sets, twins, links, first, comp)
    ns = sk.groupBy("doc_id", "n").count().groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    out = named.select("doc_id").join(ns, "doc_id", "left").join(whole, "doc_id", "left")
    cid = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, pos, token): the tokens of each set that a similar set must share one of, in one global order.

    The order is by how often a token's counter was hit, then by the token: rare ones come first. There are COUNTERS
    counters, whatever the input; tokens that share one only blur the order, and any order finds all pairs.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            for s in b["shingles"]:
                np.add.at(seen, s & (COUNTERS - 1), 1)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": at, "hits": seen[at]})

    got = sets.mapInPandas(count, "at long, hits long").groupBy("at").agg(F.sum("hits").alias("hits")).where("hits > 1").toPandas()
    hits = np.ones(COUNTERS, dtype=np.int32)
    hits[got["at"].to_numpy()] = np.minimum(got["hits"].to_numpy(), 2**31 - 1)
    sent = sets.sparkSession.sparkContext.broadcast(hits)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = sent.value
        for b in batches:
            out = []
            for rep, s in zip(b["rep"], b["shingles"], strict=True):
                n = len(s)
                k = n - -(-percent * n // 100) + 1
                own = s[np.lexsort((s, hits[s & (COUNTERS - 1)]))[:k]]
                out.append((np.full(len(own), rep), np.full(len(own), n), np.arange(len(own)), own))
            if out:
                yield pd.DataFrame(dict(zip(("rep", "n", "pos", "token"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return sets.mapInPandas(cut, "rep long, n long, pos long, token long")


def _rest(member: DataFrame, sets: DataFrame, comp: DataFrame, sim: Similarity, work: Scratch) -> DataFrame:
    """Components after the other pairs of the buckets that still hold several.

    Sets that are similar enough share a token of their prefixes, and the first one they share leaves room after it,
    in both, for the common tokens that are still missing. Sets outside their bucket's largest component are joined on
    that; a set whose rare tokens are its own meets nobody, however large its bucket is.
    """
    named = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    per = named.groupBy("key", "c").agg(F.count("*").alias("m"))
    head = per.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("giant"), F.count("*").alias("comps")).where("comps > 1")
    head = work.cut(head)
    rows = named.join(head, "key")
    both = work.cut(rows.groupBy("rep").agg(F.first("c").alias("c"), F.max((F.col("c") != F.col("giant")).cast("int")).alias("seeks")))
    pre = work.cut(_prefixes(sets.join(both.select("rep"), "rep", "left_semi"), sim.percent).join(both, "rep"))
    x, y = pre.where("seeks = 1").alias("x"), pre.alias("y")
    need = F.lit(sim.percent) * (F.col("x.n") + F.col("y.n"))
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = (F.col("x.c") != F.col("y.c")) & _sizes_allow(F.col("x.n"), F.col("y.n"), sim.percent) & ((100 + sim.percent) * room >= need)
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & fits).select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
    found = _verified(pairs, sets, sim.percent, work)
    ends = found.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), work)
    old = comp.unionByName(joined.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    out = work.cut(old.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    work.drop(head, both, pre, found, joined)
    return out
