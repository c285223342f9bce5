"""Validation of streams: record rules need no state; uniqueness and counts need a watermark.

Rules about one record are final as soon as the record is read. A key seen twice is a finding at once; that a key was
seen once only is known when the watermark has passed it, and then its state goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.vet import findings
from ..plans.schema import Schema


def vet_stream(stream: DataFrame, schema: Schema, ids: Sequence[str]) -> DataFrame:
    """Findings of each record as it comes."""
    return findings(stream, schema, ids)


def violations_by_window(stream: DataFrame, schema: Schema, ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, path, code, n): findings by window, final when the watermark passes it."""
    found = findings(stream.withWatermark(ts, late), schema, [ts])
    return found.groupBy(F.window(ts, window).alias("w"), "path", "code").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "path", "code", "n")


def watch_unique(stream: DataFrame, keys: Sequence[str], ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, keys, n): keys that occur more than once in a window."""
    per = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return per.where("n > 1").select(F.col("w.start").alias("start"), *keys, "n")
