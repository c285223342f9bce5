"""Tables that cut a plan's lineage, in the folder that all executors share.

``spark.checkpoint.dir`` names the folder. Only a plain local session (tests) may leave it unset; it then gets a
temporary folder of its own. A lost executor costs a re-read of these files, never a rerun of what came before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..lineage import shared_dir


class Scratch:
    """Writes DataFrames as Parquet below the shared folder and reads them again; ``drop`` removes what is used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                jvm = self.spark._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def refuse_clash(df: DataFrame, added: Iterable[str]) -> None:
    """The rule of all operators for names: a column that would be added must not be there yet, whatever its case."""
    have = {c.lower() for c in df.columns}
    if clash := sorted(x for x in set(added) if x.lower() in have):
        raise ValueError(f"columns {', '.join(clash)} are there already; rename them, or name the outputs otherwise")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
