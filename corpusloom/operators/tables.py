"""Tables that operators write between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sides of joins whose counted rows take at most so many bytes are broadcast.
SMALL_BYTES = 24 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """A scan of df, written as Parquet and, if asked, in a folder for each value of ``by``.

    A lost executor costs no more than the reading of a file, and what is used twice is made once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.parquet(path) if by else spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if rows * row_bytes <= SMALL_BYTES else df


def spread(df: DataFrame, *by: Column | str) -> DataFrame:
    """df dealt over as many tasks as a shuffle has, for work on rows that costs more than moving them.

    A small file of many rows is one task, and so are few rows after a shuffle that compresses well.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def small_batches(spark: SparkSession) -> None:
    """Batches of at most 1000 rows to Python, for whole texts, where the session has left them at their default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with its place, from 1, in an order of all rows; ties fall in any order.

    Rows are sorted over ranges and written once. A row's place is its number in its range,
    and the rows of the ranges before: only one count a range is added up in one task.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    kept = written(ranges.withColumn("_range", F.shiftright("_row", 33)), "placed")
    before = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # at most n rows
    at = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(before), "_range").select(*df.columns, at.cast("long").alias(name))
