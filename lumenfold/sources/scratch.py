"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of this process on a local master (tests), and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lumenfold-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


class Scratch:
    """Tables below the shared folder. They cut lineage: a lost executor loses no written part.

    They stay for the application's life, as results may read them at any time, and go when it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.option("compression", codec).parquet(path)
        if self.n == 1:
            base = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            base.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(base)
        return self.spark.read.schema(df.schema).parquet(path)
