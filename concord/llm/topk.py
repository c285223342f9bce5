"""Exact top-k inner-product search by distributed histogram selection.

A block of queries (bounded in bytes) goes to every task; each task scores its own candidates against it and counts the
scores of each query in a histogram over the range that the norms allow. The summed histogram says in which bin a
query's k-th best score lies; the bin is the next round's range, until bins are one score wide. Then every candidate at
or above the threshold is kept: at most k above it, and of those equal to it the k smallest ids of each task. A window
per query orders the few that are left.

A task sends only the bins down to where its own count reaches k: the global k-th best score is never below a task's
own, so what it leaves out cannot matter. Nothing is sent that grows with the candidates.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, neither do rows with a
null id; only vectors of equal length are compared; a repeated candidate row counts once for each row; a repeated query
id is one query, with the least of its vectors; ties go to the smaller id; other columns are ignored, whatever their
names; no queries or no candidates give no rows. Scores are exact integers: sums of floating-point products where those
are exact (below 2^53), else of 64-bit integers. Two vectors whose product of norms exceeds 2^62 have no score that is
sure to be a long; only then does the run stop with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes of a block of queries, as float64, and so the bound of what a task holds and the driver sends.
BLOCK_BYTES = 16 << 20
#: Queries of a block, whose histograms a task holds: 64 MB.
BLOCK_QUERIES = 8192
#: Scores below this are exact in floating point.
EXACT = 2**53
#: Bins of a histogram for each query, 2 to the power BITS.
BITS = 10
BINS = 1 << BITS
#: Scores at once in a task.
TILE = 1 << 21


def scaled_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, v) with v the floors of scale times each component, for the rows that take part."""
    x = F.col(embedding)
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    ok = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(F.exists(x, bad), F.lit(True))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("double"))
    return df.where(F.col(vec_id).isNotNull() & ok).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def _matrix(v: pd.Series, kind: type) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64).astype(kind) for x in v])


def _tiles(batches: Iterator[pd.DataFrame], q: np.ndarray, qid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, scores (queries by candidates) and which pairs count, of the candidates as long as the queries."""
    rows = max(1, TILE // max(1, len(qid)))
    for b in batches:
        b = b[b["v"].map(len) == q.shape[1]]
        for i in range(0, len(b), rows):
            part = b.iloc[i : i + rows]
            ids = part["id"].to_numpy()
            s = (q @ _matrix(part["v"], q.dtype.type).T).astype(np.int64)
            yield ids, s, qid[:, None] != ids[None, :]


def topk_search(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates among all other rows."""
    spark = df.sparkSession
    cand = scaled_vectors(df, vec_id, embedding, scale)
    queries = scaled_vectors(df.where(is_query), vec_id, embedding, scale).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    # A vector is not scored against its own id, so two ids' largest norms bound all scores.
    tops = [r["n"] for r in cand.select("id", norm.alias("n")).groupBy("id").agg(F.max("n").alias("n")).orderBy(F.desc("n")).limit(2).collect()]
    parts = []
    if len(tops) == 2:
        bound = tops[0] * tops[1] * (1 + 1e-9) + 1
        if bound >= 2**62:
            raise ValueError("the product of two vectors' norms exceeds 2^62: their score may not be a long")
        kind = np.float64 if bound < EXACT else np.int64
        for dim, n in sorted((r["d"], r["n"]) for r in queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
            per = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * dim)))
            blocks = -(-n // per)
            own = queries.where(F.size("v") == dim)
            for b in range(blocks):
                # Blocks are dealt by hash: about ``per`` queries each, and a bounded collect of one block at a time.
                block = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
                if len(block):
                    parts.append(_block(spark, cand, block.sort_values("id"), k, int(bound), kind))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block(spark, cand: DataFrame, block: pd.DataFrame, k: int, bound: int, kind: type) -> DataFrame:
    q, qid = _matrix(block["v"], kind), block["id"].to_numpy()
    sent = spark.sparkContext.broadcast((q, qid))
    shift = max(0, (2 * bound).bit_length() - BITS)  # a bin holds 2^shift scores
    low, high = -bound, np.iinfo(np.int64).max
    lo, hi = np.full(len(qid), low, dtype=np.int64), np.full(len(qid), high, dtype=np.int64)  # the range, hi excluded
    above = np.zeros(len(qid), dtype=np.int64)  # candidates at hi and above
    while True:
        state = spark.sparkContext.broadcast((lo, hi, shift, k - above))

        def count(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            q, qid = sent.value
            lo, hi, shift, need = state.value
            h = np.zeros((len(qid), BINS), dtype=np.int64)
            for _, s, ok in _tiles(batches, q, qid):
                r, c = np.nonzero(ok & (s >= lo[:, None]) & (s < hi[:, None]))
                flat = r * BINS + np.minimum((s[r, c] - lo[r]) >> shift, BINS - 1)
                h += np.bincount(flat, minlength=h.size).reshape(h.shape)
            tail = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h  # in higher bins
            r, c = np.nonzero((h > 0) & (tail < need[:, None]))
            yield pd.DataFrame({"q": r, "bin": c, "n": h[r, c]})

        got = cand.mapInPandas(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        tail = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        # For each query one bin, where the count from above first reaches what is still needed.
        rest = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(qid)), "need": k - above}), "q long, need long")
        found = got.withColumn("tail", tail).join(rest, "q").where((F.col("tail") >= F.col("need")) & (F.col("tail") - F.col("n") < F.col("need")))
        rows = found.select("q", "bin", "n", "tail").collect()
        state.unpersist()
        new_lo, new_hi = np.full(len(qid), low, dtype=np.int64), np.full(len(qid), high, dtype=np.int64)
        for r in rows:  # queries with fewer than k candidates in all are missing: everything is kept
            i = r["q"]
            new_lo[i] = lo[i] + (r["bin"] << shift)
            new_hi[i] = new_lo[i] + (1 << shift)
            above[i] += r["tail"] - r["n"]
        lo, hi = new_lo, new_hi
        if not shift:
            break
        shift = max(0, shift - BITS)
    limit = spark.sparkContext.broadcast(lo)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, qid = sent.value
        lo = limit.value
        kept: dict[int, list[tuple[int, int]]] = {}
        for ids, s, ok in _tiles(batches, q, qid):
            r, c = np.nonzero(ok & (s >= lo[:, None]))
            order = np.lexsort((ids[c], -s[r, c], r))
            r, c = r[order], c[order]
            first = np.searchsorted(r, r)  # where each query's run begins
            keep = np.arange(len(r)) - first < k
            for i, j in zip(r[keep], c[keep], strict=True):
                kept.setdefault(int(i), []).append((-int(s[i, j]), int(ids[j])))
            for i in set(r[keep].tolist()):
                kept[i] = sorted(kept[i])[:k]
        rows = [(int(qid[i]), v, -s) for i, own in kept.items() for s, v in own]
        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = cand.mapInPandas(pick, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
