"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, numbered_copies

#: Rows in a bucket of the row numbering, on average, and buckets in one window of the offsets.
ROWS_A_BUCKET, BUCKETS_A_SPAN = 2048, 2048
ROUNDS, WALK_STEPS = 4, 48



def feistel(x: Column, n: int, seed: int = 0) -> Column:
    """The place of x, from 0 to n - 1, under a keyed permutation of 0 to n - 1.

    The domain is a grid of a * b cells, a = ceil(sqrt(n)), of which fewer than a lie
    past n - 1; a value that falls there is permuted again until it is inside. Sides
    take turns in ROUNDS rounds; in each, one side moves by a function of the other.
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-n // a) if n else 1

    def step(s: Column, r: Column) -> Column:
        high, low = F.floor(s / F.lit(b)).cast("long"), s % F.lit(b)
        key = F.concat(F.lit(f"{seed}:"), r.cast("string"), F.lit(":"))
        of = lambda side, m: F.conv(F.substring(F.md5(F.concat(key, side.cast("string"))), 1, 8), 16, 10).cast("long") % F.lit(m)
        return F.when(r % 2 == 0, (high + of(low, a)) % F.lit(a) * F.lit(b) + low).otherwise(high * F.lit(b) + (low + of(high, b)) % F.lit(b))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    permuted = lambda s: F.aggregate(rounds, s, step)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK_STEPS)), permuted(x.cast("long")), lambda s, _: F.when(s < F.lit(n), s).otherwise(permuted(s)))
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def number_rows(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """rows with ``row_no``, their place from 0 by (key, order); key holds hex digits that spread evenly.

    Buckets are ranges of the key, so each window holds about ROWS_A_BUCKET rows however
    many there are; a bucket's offset comes from counts of buckets, summed in two levels.
    """
    buckets = max(1, -(-n // ROWS_A_BUCKET))
    bucketed = rows.withColumn("bucket", F.floor(F.conv(F.substring(F.col(key), 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("bucket") / F.lit(BUCKETS_A_SPAN)))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy("span").agg(F.sum("n").alias("n")).select("span", before(Window.orderBy("span")).alias("span_start"))
    starts = counts.select("bucket", "span", before(Window.partitionBy("span").orderBy("bucket")).alias("start")).join(spans, "span").select("bucket", (F.col("start") + F.col("span_start")).alias("start"))
    inside = bucketed.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy(key, *order)))
    return inside.join(starts, "bucket").withColumn("row_no", F.col("start") + F.col("at") - 1).drop("bucket", "start", "at")


def shard(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows into shards whose counts differ by one at most (the ``rows`` law).

    A row's global number is its place by the md5 of its id, text checksum, size and, among
    rows equal in these, its number, so it does not hang on partitions or file order and
    a large group of equal rows spreads over all buckets. The Feistel permutation gives its place
    in the shuffle: shard is that place modulo the shards, slot the quotient, so the row
    of any slot can be computed back.

    Returns id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot and
    grown_shard (null under this law). A null text has no bytes. Rows with a null id and
    repeated rows are dealt like any other; equal rows change places with each other only.
    Of a very long text only its checksum and size go on. An empty table gives no rows.
    Columns other than id and text are not read, whatever their names.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    thin = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    thin = numbered_copies(thin, ["id", "size", "crc"])
    thin = thin.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), "crc", "size", "copy_no")))
    thin = materialize(thin, "shard-rows")
    n = thin.count()
    placed = number_rows(thin, "key", ["id", "crc", "size", "copy_no"], n).withColumn("place", feistel(F.col("row_no"), n, seed))
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
