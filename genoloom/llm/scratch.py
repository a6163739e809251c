"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from genoloom.sources.files import shared_root


class Scratch:
    """Tables of one operator call.

    ``keep`` writes a DataFrame as Parquet and reads it back: lineage ends there, a lost executor costs one task, and
    both sides of a later join are plain scans, so adaptive execution can split a hot key. ``drop`` deletes tables that
    nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clean(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now, which it does when the driver's garbage goes."""
        gc.collect()
        self.spark._jvm.System.gc()
