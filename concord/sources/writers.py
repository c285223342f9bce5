"""Writers: canonical JSON lines, and generated text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.verbs import canon


def generate(df: DataFrame) -> DataFrame:
    """(value): each record as JSON, names in order, absent members left out, digits of exact numbers kept."""
    names = sorted(df.columns)
    return df.select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in the canonical order of names."""
    df.select(canon(df).alias("value")).write.text(path)


def write_text(df: DataFrame, path: str, file: str, order: list[str], text: str) -> None:
    """One folder for each file, holding its lines in order."""
    rows = df.select(F.col(file).alias("file"), *order, F.col(text).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", *order).select("file", "value").write.partitionBy("file").text(path)
