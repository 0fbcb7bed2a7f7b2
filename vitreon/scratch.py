"""Tables in the folder that all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, SparkSession] = {}


def base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the session's checkpoint folder; a single machine may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="vitreon-")
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stored:
    """Written tables of one computation. Those that a returned DataFrame reads stay until sweep()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{base(spark)}/{label}-{uuid.uuid4().hex}", 0
        _roots[self.root] = spark

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def set(self) -> Steps:
        return Steps(self)

    def drop(self) -> None:
        """Delete the tables now, once what reads them has been used."""
        if _roots.pop(self.root, None) is not None:
            _delete(self.spark, self.root)


class Steps:
    """Tables of the same columns, written one after another and read as one."""

    def __init__(self, stored: Stored):
        self.stored, self.paths, self.schema = stored, [], None

    def add(self, df: DataFrame) -> DataFrame:
        out = self.stored.keep(df)
        self.paths.append(f"{self.stored.root}/{self.stored.n:03d}")
        self.schema = self.schema or out.schema
        return out

    def read(self) -> DataFrame:
        return self.stored.spark.read.schema(self.schema).parquet(*self.paths)


def sweep() -> None:
    """Delete the tables of this process; call it when the results that read them have been used or stored."""
    for root in list(_roots):
        spark = _roots.pop(root)
        if spark.sparkContext._jsc is not None:
            _delete(spark, root)
