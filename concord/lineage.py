"""Tables that cut the plan of an iteration, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="concord-"))


_written: dict[int, tuple[DataFrame, str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = out, path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes what :func:`cut` wrote for them; nothing may read them any more."""
    for df in frames:
        if found := _written.pop(id(df), None):
            _delete(df.sparkSession, found[1])


def keep(df: DataFrame) -> DataFrame:
    """A table whose files stay, as what comes from it may be read at any time."""
    _written.pop(id(df), None)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Parts:
    """A table that grows by one part a round; no part is written twice."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}", 0
        self.schema = None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a part and gives it back as a table of its own."""
        path = f"{self.base}/part={self.n}"
        self.n += 1
        df.write.parquet(path)
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/part={i}" for i in range(self.n)])
