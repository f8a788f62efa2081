"""What the training-data operators share: the shared folder, and inputs cut to known columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many bytes in all are broadcast; larger sides are shuffled.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local master without the setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a scan of it.

    This cuts the lineage, survives lost executors, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its measured size is under BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Copies of one row that are numbered in one piece.
COPIES_A_BLOCK = 4096


def numbered_copies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of each row, with ``copy_no`` from 0 among rows that are equal in all of them.

    Equal rows are counted with map-side combine and come back from the count, so their
    numbers do not hang on partitions, and no group is ever together. Large groups come back
    in blocks that are dealt over the tasks.
    """
    counted = materialize(rows.groupBy(*columns).agg(F.count("*").alias("__copies")), "row-copies")
    most = counted.agg(F.max("__copies")).first()[0] or 0
    last = F.floor((F.col("__copies") - 1) / COPIES_A_BLOCK)
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if most > COPIES_A_BLOCK:
        blocks = blocks.repartition(*columns, "__block")
    size = F.least(F.lit(COPIES_A_BLOCK).cast("long"), F.col("__copies") - F.col("__block") * COPIES_A_BLOCK)
    start = F.col("__block") * COPIES_A_BLOCK
    return blocks.select(*columns, F.explode(F.sequence(start, start + size - 1)).alias("copy_no"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What operators keep in a worker from task to task, by operator: functions that let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def sole_owner(name: str, let_go: Callable[[], None] | None = None) -> None:
    """Called at the start of a task: what other operators left in this worker is let go.

    Workers outlive tasks, and operators keep vocabularies and words in them; so a worker
    never holds those of two operators at once.
    """
    for other in [k for k in _KEPT if k != name]:
        _KEPT.pop(other)()
    if let_go is not None:
        _KEPT[name] = let_go


#: Rows of texts in one batch between Spark and a worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to the workers in batches of BATCH_ROWS rows, unless the session has set a number of its own.

    A batch is in memory on both sides; the default of 10 000 rows is meant for numbers.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
