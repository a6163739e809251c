"""Text files as tables: a shared folder, lines with their numbers, and rows with numbers of a global order."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a range, about.
RANGE_ROWS = 500_000


@lru_cache(maxsize=1)
def own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="genoloom-")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on one machine, where it is unset, a temporary one of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or own_folder()).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of a path, as Spark understands it, for readers and writers outside the JVM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read again, so that what is numbered afterwards can't change."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(rows: DataFrame) -> int:
    """Ranges to put ``rows`` (a table as it lies) into: as many as there are shuffle partitions, more where these would be large."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))


def by_range(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` with its range of ``order`` as ``part``: ranges ascend, and rows that are equal in ``order`` share one.

    Rows are written first, so that what they come from runs once, and counted: there are more ranges for more rows.
    """
    rows = kept(df, "rows")
    return kept(rows.repartitionByRange(ranges(rows), *order).withColumn("part", F.spark_partition_id()), "ranges")


def dealt(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df``, which comes of ``rows`` by ``by_range``, dealt to as many tasks as these have ranges, so that a window's task has few."""
    n = ranges(rows)
    return df.repartition(n, "part") if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", within: list[str | Column] | None = None) -> DataFrame:
    """``df`` with 1-based numbers in the order of all rows.

    Rows are sorted by ranges and numbered within each; only a row count for each range goes through one window. ``within``
    is a finer order, of which ``order`` is a shorter form to cut ranges by.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*(within or order))
    ranged = kept(ranged.withColumn("row_id", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("row_id", 33))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "row_id")


def running_total(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before in the order, 0 for the first: sums of ranges go through one window."""
    rows = by_range(df, order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("part").agg(F.sum(value).alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("carry"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(carry), "part").withColumn(name, F.col("carry") + within).drop("part", "carry")


def lines(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """(file, number, value): all lines with their 0-based numbers in their file, or with ``together`` in all files in order of their names.

    A block is read by one task in order, so a line's place in it is its own id less the block's least: only a row a block
    (of a compressed file: a row a file) is put in order, and no lines are.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    sizes = read.groupBy("file", "start").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    earlier = (Window.orderBy("file", "start") if together else Window.partitionBy("file").orderBy("start")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "start", "least", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return read.join(F.broadcast(sizes), ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("least")).alias("number"), "value")
