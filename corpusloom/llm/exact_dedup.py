"""Exact dedup by 128-bit content hash, with a byte comparison inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast


def md5_bytes(text: Column) -> Column:
    """The 128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """Class every row by its exact text; the row with the largest id of a class stays.

    Rows are grouped by content hash with map-side combine, so a hot text moves one row
    a task. Only rows whose hash occurs more than once have their texts compared: they
    are grouped by hash and bytes, so texts that share a hash but differ form classes of
    their own. The hashes that repeat are broadcast while they are small and joined by
    shuffle beyond that.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256. A null
    text counts as empty. A null id never wins over another id; rows of a class whose
    ids are all null have keep_id null and are all kept. Repeated rows with the winning
    id are all kept, for nothing tells them apart. An empty input gives an empty result.
    Very long texts are hashed where they are; only those whose hash repeats are compared.
    Columns other than id and text are not read, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", content_hash(F.col("text")))
    repeated = materialize(base.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "dedup-repeated")
    n_repeated = repeated.count()
    classes = base.join(maybe_broadcast(repeated, n_repeated, 64), "h", "left_semi").groupBy("h", "text").agg(F.count("*").alias("n"), F.max("id").alias("keep"))
    by_hash = materialize(classes.groupBy("h").agg(F.count("*").alias("classes"), F.max("keep").alias("keep"), F.max("n").alias("n")), "dedup-classes")
    thin = base.select("id", "h", F.sha2(F.col("text"), 256).alias("sha"), F.col("text"))
    clean = by_hash.where("classes = 1").select("h", "keep", "n")
    found = thin.select("id", "h", "sha").join(maybe_broadcast(clean, n_repeated, 96), "h", "left")
    collided = by_hash.where("classes > 1").select("h")
    if not collided.isEmpty():
        # Two texts under one hash: those rows are classed by hash and bytes together.
        found = found.join(collided, "h", "left_anti").unionByName(thin.join(collided, "h", "left_semi").join(classes, ["h", "text"]).select("id", "h", "sha", "keep", "n"))
    single = F.col("n").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("n")).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
