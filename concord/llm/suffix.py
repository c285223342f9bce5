"""Removal of long repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any document or its own.

1. Every window of ``length`` bytes has an anchor: the smallest hash among its 48-byte strings, the first on ties. Equal
   windows have equal anchors at equal places, so all occurrences of a window meet under its anchor. Neighbouring
   windows of one anchor form a context, one stretch of bytes. Only hashes, places and counts travel.
2. A context that occurs twice or more as a whole repeats in all its windows. An anchor with one context that occurs
   once has no repeats. What is left is anchors with several different contexts: where the ends of copies differ.
3. The bytes of these contexts are dealt into shards of about two megabytes, anchors whole. Each shard builds its suffix
   array by Larsson and Sadakane's doubling (only groups that are not yet told apart are sorted again), the common
   prefixes of neighbours by Kasai's walk, and so the classes of equal windows. An anchor with very many contexts is
   split over several shards; each pair of them is then merged by binary search of one's windows in the other's array.
4. The repeated windows' places give the spans of each text; equal texts have equal spans and share them.

Contexts and texts are known by 128-bit hashes; windows within shards are compared byte by byte.

Defined cases: null text is empty; texts shorter than ``length`` keep all bytes; repeated rows are copies of each other
and lose everything that is long enough; ids may repeat or be null; other columns pass through, and an output name that
is among them is refused (``names`` and ``kept`` name the outputs); an empty table gives none. A text of any length is read in pieces of four megabytes of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch, columns_of, refuse_clash

GRAM = 48
PIECE = 1 << 22
SHARD_BYTES = 2_000_000
#: Contexts of one anchor in one shard; more are split.
PART = 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_POS = np.uint64((1 << 23) - 1)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_pow.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            inv = pow(_BASE, -1, 1 << 64)
            for name, b in (("up", _BASE), ("down", inv)):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = 1
                _pow[name] = np.multiply.accumulate(x)
    return _pow["up"][:n], _pow["down"][:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM-byte string."""
    n = len(data)
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours: prefix and suffix minima of blocks."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def contexts(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of every context of a text, in order."""
    n = len(data) - length + 1
    got = []
    for s in range(0, max(0, n), PIECE):
        m = min(PIECE, n - s)
        h = gram_hashes(data[s : s + m + length - 1])
        keyed = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(keyed, length - GRAM + 1) & _POS).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        got.append((h[at[first]].view(np.int64), first + s, np.diff(np.r_[first, m])))
    if not got:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate([g[i] for g in got]) for i in range(3))


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros beyond the end."""
    x = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    n = len(data)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | x[i : i + n]
    return out


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by Larsson and Sadakane's refinement, to the end: Kasai's walk needs the full order."""
    n = len(data)
    key = packed(data)
    # The zeros beyond the end are no bytes: of equal numbers, the shorter suffix comes first and stands alone.
    size = np.minimum(n - np.arange(n), 8) if n and not data[-1] else None
    sa = np.argsort(key) if size is None else np.lexsort((size, key))
    sorted_ = key[sa]
    head = np.r_[True, (sorted_[1:] != sorted_[:-1]) | (False if size is None else size[sa][1:] != size[sa][:-1])]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[sa] = start  # a group's rank is the place of its first suffix
    h = 8
    while h < 2 * n:
        size_one = head & np.r_[head[1:], True]
        todo = np.flatnonzero(~size_one)  # places in groups of several
        if not len(todo):
            break
        i = sa[todo]
        pair = rank[i] * (n + 1) + (rank[np.minimum(i + h, n)] + 1)  # shards are far below 2^31 bytes
        order = np.argsort(pair)
        i, pair = i[order], pair[order]
        sa[todo] = i
        new = np.r_[True, pair[1:] != pair[:-1]]
        head[todo] = new
        rank[i] = np.maximum.accumulate(np.where(new, todo, 0))
        h *= 2
    place = np.empty(n, dtype=np.int64)
    place[sa] = np.arange(n)
    return sa, place


def common_prefixes(data: np.ndarray, key: np.ndarray, sa: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """lcp[r]: bytes that suffixes sa[r - 1] and sa[r] share, ``cap`` at most.

    Kasai's walk, in all stretches of the shard at once: from one place to the next the shared prefix shrinks by one
    byte at most, so each stretch's walk takes steps in proportion to its length. ``starts`` and ``sizes`` must cover
    every place, separators too: their suffixes may lie between those of equal windows.
    """
    n = len(data)
    lcp = np.zeros(n, dtype=np.int64)
    wide = np.concatenate([data, np.zeros(cap + 9, dtype=np.uint8)])
    keyw = np.concatenate([key, np.zeros(cap + 9, dtype=np.uint64)])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    h = np.zeros(len(starts), dtype=np.int64)
    live = len(starts)
    for s in range(int(sizes[0]) if len(sizes) else 0):
        while live and sizes[live - 1] <= s:
            live -= 1
        i = starts[:live] + s
        r = place[i]
        j = sa[np.maximum(r - 1, 0)]
        hh = np.maximum(h[:live] - 1, 0)
        hh[r == 0] = 0
        for tab, step in ((keyw, 8), (wide, 1)):
            on = np.flatnonzero((r > 0) & (hh < cap))
            while len(on):
                on = on[tab[i[on] + hh[on]] == tab[j[on] + hh[on]]]
                hh[on] += step
                on = on[hh[on] < cap]
        h[:live] = np.minimum(hh, cap)
        lcp[r] = h[:live]
    return lcp


class Shard:
    """The contexts of a shard as one text with its suffix array and classes of equal windows."""

    def __init__(self, parts: list[bytes], weights: np.ndarray, length: int):
        self.length = length
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.data = np.frombuffer(b"\0".join(parts), dtype=np.uint8)
        self.key = packed(self.data)
        self.sa, self.place = suffix_array(self.data)
        walked = self.sizes + 1  # a separator belongs to the part before it; the last part has none
        walked[-1:] -= 1
        lcp = common_prefixes(self.data, self.key, self.sa, self.place, self.starts, walked, length)
        self.owner = np.repeat(np.arange(len(parts)), self.sizes + 1)[: len(self.data)]
        offset = np.arange(len(self.data)) - self.starts[self.owner]
        self.window = offset + length <= self.sizes[self.owner]  # starts of whole windows
        own = np.flatnonzero(self.window[self.sa])
        # Between two windows that follow one another, the least common prefix decides; other suffixes may lie between.
        cls = np.cumsum(lcp < length)
        self.places = own
        self.cls = cls[own]
        first = np.flatnonzero(np.r_[True, self.cls[1:] != self.cls[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
        self.heads = own[first]  # a place of each class, in order
        number = np.zeros(len(own), dtype=np.int64)
        number[first[1:]] = 1
        self.number = np.cumsum(number)
        w = weights[self.owner[self.sa[own]]]
        self.dup = np.bincount(self.number, weights=w, minlength=len(self.heads)) >= 2 if len(own) else np.zeros(0, dtype=bool)

    def spans(self) -> list[tuple[int, int, int]]:
        """(part, first window, end) of runs of repeated windows."""
        hit = np.zeros(len(self.data) + 1, dtype=bool)
        hit[self.sa[self.places[self.dup[self.number]]]] = True
        edge = np.flatnonzero(np.diff(np.r_[False, hit].astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        # Parts are at least one separator apart and windows end before it, so no run crosses two parts.
        own = self.owner[a]
        return list(zip(own.tolist(), (a - self.starts[own]).tolist(), (b - self.starts[own]).tolist(), strict=True))


def merge_shards(x: Shard, y: Shard) -> None:
    """Marks the classes that two shards have in common: x's windows are found in y's order by binary search."""
    if not len(x.heads) or not len(y.heads):
        return
    length = x.length
    p, q = x.sa[x.heads], y.sa[y.heads]
    steps = range(0, length - length % 8, 8)
    tail = length % 8

    def compare(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for window x[i] against y[j]."""
        out = np.zeros(len(i), dtype=np.int8)
        on = np.arange(len(i))
        for d in steps:
            a, b = x.key[i[on] + d], y.key[j[on] + d]
            out[on] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            on = on[a == b]
            if not len(on):
                return out
        if tail:
            cut = np.uint64(64 - 8 * tail)
            a, b = x.key[i[on] + length - tail] >> cut, y.key[j[on] + length - tail] >> cut
            out[on] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
        return out

    lo, hi = np.zeros(len(p), dtype=np.int64), np.full(len(p), len(q))
    while True:
        on = np.flatnonzero(lo < hi)
        if not len(on):
            break
        mid = (lo[on] + hi[on]) // 2
        more = compare(p[on], q[mid]) > 0
        lo[on[more]] = mid[more] + 1
        hi[on[~more]] = mid[~more]
    on = np.flatnonzero(lo < len(q))
    same = on[compare(p[on], q[lo[on]]) == 0]
    x.dup[same] = True
    y.dup[lo[same]] = True


def _keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(7), text, F.lit(7))


def repeated_spans(docs: DataFrame, text: str, length: int, work: Scratch) -> DataFrame:
    """(t1, t2, spans): for each text that has any, the byte spans of its repeated windows; they may overlap."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    t1, t2 = _keys(F.col("text"))
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") >= length).select(t1.alias("t1"), t2.alias("t2"), "text")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            digests: list[bytes] = []
            for k1, k2, x in zip(b["t1"], b["t2"], b["text"], strict=True):
                raw = x.encode()
                anchor, first, n = contexts(np.frombuffer(raw, dtype=np.uint8), length)
                digests.extend(xxhash.xxh3_128_digest(raw[s : s + m + length - 1]) for s, m in zip(first.tolist(), n.tolist(), strict=True))
                for c, v in zip(out, (np.full(len(n), k1), np.full(len(n), k2), anchor, first, n), strict=True):
                    c.append(v)
            if digests:
                c = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                cols = [np.concatenate(v) for v in out]
                yield pd.DataFrame(dict(zip(("t1", "t2", "anchor", "s", "n"), cols, strict=True)) | {"c1": c[:, 0], "c2": c[:, 1]})

    rows = work.cut(src.mapInPandas(found, "t1 long, t2 long, anchor long, s long, n long, c1 long, c2 long"))
    own = ["anchor", "c1", "c2"]
    ctx = rows.groupBy(*own).agg(F.count("*").alias("m"), F.min(F.struct("t1", "t2", "s", "n")).alias("at"))
    per = ctx.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("m").alias("all"), F.min("m").alias("least")).where("all > 1")
    ctx = work.cut(ctx.join(per, "anchor").select(*own, "m", "at.*", "kinds", "least"))
    open_ = ctx.where("kinds > 1 and least = 1")
    # The bytes of the open contexts, each from one place.
    # Written, so that the join can split the texts of a key that very many copies share.
    need = work.cut(open_.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "c1", "c2", "m", "s", "n", "kinds")).alias("need")))
    texts = src.join(need, ["t1", "t2"]).select("text", "need")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for x, need in zip(b["text"], b["need"], strict=True):
                raw = x.encode()
                got.extend((c["anchor"], c["c1"], c["c2"], c["m"], c["kinds"], raw[c["s"] : c["s"] + c["n"] + length - 1]) for c in need)
            yield pd.DataFrame(got, columns=["anchor", "c1", "c2", "m", "kinds", "bytes"])

    loaded = texts.mapInPandas(fetch, "anchor long, c1 long, c2 long, m long, kinds long, bytes binary").dropDuplicates(own)
    loaded = work.cut(loaded)
    total = loaded.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = 1 + total // SHARD_BYTES
    parts = F.ceil(F.col("kinds") / PART).cast("int")
    part = F.pmod(F.xxhash64("c1", "c2"), F.col("parts")).cast("int")
    small = loaded.where(parts == 1).select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), *own, "m", "bytes")
    # Of a split anchor, part i meets every part j >= i; a part goes to as many shards as there are parts.
    big = loaded.where(parts > 1).withColumn("parts", parts).withColumn("part", part).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    big = big.select(F.col("anchor").alias("shard"), F.least("part", "k").alias("i"), (F.greatest("part", "k") + 1).alias("j"), F.when(F.col("part") <= F.col("k"), 0).otherwise(1).alias("side"), *own, "m", "bytes")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for _, own in pdf.groupby("side", sort=True):
            own = own.sort_values(["anchor", "c1", "c2"])
            sides.append((own, Shard(own["bytes"].tolist(), own["m"].to_numpy(), length)))
        if len(sides) == 2:
            merge_shards(sides[0][1], sides[1][1])
        out = []
        for own, sh in sides:
            keys = own[["anchor", "c1", "c2"]].to_numpy()
            out.extend((*keys[p].tolist(), a, b) for p, a, b in sh.spans())
        return pd.DataFrame(out, columns=["anchor", "c1", "c2", "a", "b"])

    hits = small.unionByName(big).groupBy("shard", "i", "j").applyInPandas(judge, "anchor long, c1 long, c2 long, a long, b long").distinct()
    whole = ctx.where("m > 1").select(*own, F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    runs = work.cut(whole.unionByName(hits))
    placed = rows.join(runs, own).select("t1", "t2", F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") - 1 + length).alias("b")).alias("span"))
    spans = work.cut(placed.groupBy("t1", "t2").agg(F.collect_set("span").alias("spans")))
    work.drop(rows, ctx, need, loaded, runs)
    return spans


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans) if spans is not None else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, text: str = "text", length: int = 400, names: tuple[str, str, str, str] = ("n_bytes", "n_removed", "removed", "kept_sha256"), kept: str | None = None) -> DataFrame:
    """``docs`` with four more columns: bytes, removed bytes, maximal runs of them, and the digest of what is left.

    ``names`` names them; ``kept`` names a column for the bytes that are left, if they are wanted.
    """
    added = [*names, *[kept] * (kept is not None)]
    refuse_clash(docs, added)
    work = Scratch(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, text, length, work)
    t1, t2 = _keys(F.col(text))
    # Only texts long enough can have spans; the others are dealt out evenly under keys that match nothing.
    long_ = F.coalesce(F.octet_length(text) >= length, F.lit(False))
    joined = docs.withColumn("_suffix_1", F.when(long_, t1).otherwise(F.monotonically_increasing_id())).withColumn("_suffix_2", F.when(long_, t2)).withColumn("_suffix_long", long_)
    spans = spans.select(F.col("t1").alias("_suffix_1"), F.col("t2").alias("_suffix_2"), F.lit(True).alias("_suffix_long"), F.col("spans").alias("_suffix_spans"))
    joined = joined.join(spans, ["_suffix_1", "_suffix_2", "_suffix_long"], "left")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for x, s in zip(texts, spans, strict=True):
                raw = (x or "").encode()
                runs, at, left = merged(s), 0, []
                for a, b in runs:
                    left.append(raw[at:a])
                    at = b
                rest = b"".join((*left, raw[at:])) if runs else raw
                out.append((len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest(), *[rest] * (kept is not None)))
            yield pd.DataFrame(out, columns=["n", "gone", "runs", "sha", *["rest"] * (kept is not None)])

    kind = "n long, gone long, runs array<struct<a:long,b:long>>, sha string" + ", rest binary" * (kept is not None)
    done = joined.withColumn("_suffix_cut", F.pandas_udf(cut, kind)(text, "_suffix_spans"))
    return done.select(*columns_of(docs), *[F.col(f"_suffix_cut.{x}").alias(name) for x, name in zip(("n", "gone", "runs", "sha", "rest"), added, strict=False)])
