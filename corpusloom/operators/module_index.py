"""One module's chunks from its symbols, replaced as a whole: a run is seen all at once or not at all."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, dedupe
from corpusloom.operators.symbol_chunks import MOST_TOKENS, symbol_chunks
from corpusloom.operators.tables import sent_if_small, spread, written
from corpusloom.plans.session import ensure_checkpoints

POINTER = "org string, module string, version string, generation string, digest string, run long"
KEYS = ["org", "module", "version"]


@dataclass(frozen=True)
class IndexRun:
    """What a run did; misses are the chunks to embed, one a content hash."""

    written: int
    deleted: int
    skipped: bool
    misses: DataFrame


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """The generation that holds for each (org, module, version); none where nothing was indexed."""
    try:
        rows = spark.read.schema(POINTER).parquet(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)
    best = F.max_by(F.struct("generation", "digest", "run"), F.struct("run", "generation"))
    return rows.groupBy(*KEYS).agg(best.alias("p")).select(*KEYS, "p.*")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of all modules as they now are; only folders that a pointer names are read."""
    held = written(pointers(spark, root), "pointers")
    return spark.read.parquet(f"{root}/chunks").join(sent_if_small(held.select("generation", *KEYS), held.count(), 400), "generation")


def index_module(symbols: DataFrame, cache: DataFrame, root: str, org: str, module: str, version: str, budget: int = MOST_TOKENS) -> IndexRun:
    """Chunk the symbols of one module, cluster near copies, and put them in place of what the module had.

    Chunks go to a folder of their own. Then one row, appended to the pointers, makes
    them the module's; Spark commits that file by a rename, so a run that fails before
    leaves the old chunks in force, and can be repeated. A run that would change nothing
    writes nothing. Runs of one module must follow each other, as those that write a table do.
    symbols also has sensitivity; restricted ones, members of enums, and fields without
    documentation get no chunk.
    """
    spark = symbols.sparkSession
    ensure_checkpoints(spark)
    worth = chunking.eligible(symbols.withColumn("doc", F.concat_ws("", "summary", "description"))).drop("doc")
    chunks = written(symbol_chunks(spread(worth), budget), "chunks")
    # Order-free: a count, a sum and an exclusive or of the chunks' hashes; clusters follow from the chunks.
    code = F.xxhash64(*chunks.columns)
    state = chunks.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(code), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(code, F.lit((1 << 31) - 1))), F.lit(0)).alias("s")).first()
    digest = f"{state.n}-{state.x}-{state.s}"
    now = pointers(spark, root).where((F.col("org") == org) & (F.col("module") == module) & (F.col("version") == version)).first()
    misses = dedupe.cache_split(chunks, cache)[1]
    if now is not None and now.digest == digest:
        return IndexRun(0, 0, True, misses)
    clusters = dedupe.leader_clusters(chunks.select("chunk_id", F.col("content").alias("text"), "tokens", F.lit(False).alias("generated")))
    rows = chunks.join(clusters.select("chunk_id", F.col("leader").alias("cluster"), "representative"), "chunk_id", "left")
    rows = written(rows, "indexed")
    before = spark.read.parquet(f"{root}/chunks/generation={now.generation}").select("chunk_id") if now is not None else chunks.select("chunk_id").where(F.lit(False))
    added, gone = (a.join(b, "chunk_id", "left_anti").count() for a, b in ((rows.select("chunk_id"), before), (before, rows.select("chunk_id"))))
    generation = uuid.uuid4().hex
    rows.write.parquet(f"{root}/chunks/generation={generation}")
    run = now.run + 1 if now is not None else 0
    spark.createDataFrame([(org, module, version, generation, digest, run)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return IndexRun(added, gone, False, misses)
