"""Near-duplicate chunks by SimHash: banded Hamming join and leader clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.hashing import hamming, normal_code
from corpusloom.operators.tables import small_batches, written

THRESHOLD, LEAST_TOKENS = 3, 40
#: Words of a run that is hashed, and hashes of which the bits are counted at a time.
RUN, SLICE = 3, 1 << 16


def _votes(text: str | None) -> np.ndarray:
    """For each of 64 bits, most significant first, the words' runs whose ``hash64`` has it less those whose has not."""
    words = [w for w in (text or "").encode().split(b" ") if w]
    runs = iter(words) if len(words) < RUN else map(b" ".join, zip(*[words[k:] for k in range(RUN)]))
    votes = np.zeros(64, np.int64)
    while part := b"".join([hashlib.sha256(r).digest() for r in islice(runs, SLICE)]):
        firsts = np.frombuffer(part, np.uint8).reshape(-1, 32)[:, :8]
        votes += 2 * np.unpackbits(firsts, axis=1).sum(axis=0, dtype=np.int64) - len(firsts)
    return votes


def fingerprints(chunks: DataFrame, item: str = "chunk_id", text: str = "text", tokens: str = "tokens", least: int = LEAST_TOKENS) -> DataFrame:
    """item and 64-bit simhash of chunks that are long enough, one row each by id.

    The hashes of a text's runs vote where the text is, so no run is a row; only 64 counts of
    a chunk are shuffled, to be added up if an id has several rows. Text without words has
    fingerprint 0.
    """
    small_batches(chunks.sparkSession)
    long_ = chunks.where(F.col(tokens) >= least).select(item, normal_code(F.col(text)).alias("text"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([_votes(h) for h in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=[item, "votes"])

    votes = long_.mapInArrow(voted, f"`{item}` {dict(chunks.dtypes)[item]}, votes array<bigint>")
    votes = votes.groupBy(item).agg(*[F.sum(F.get("votes", 63 - k)).alias(f"v{k}") for k in range(64)])
    out = F.lit(0).cast("long")
    for k in range(64):
        bit = 1 << k if k < 63 else -(1 << 63)
        out = out.bitwiseOR(F.when(F.col(f"v{k}") > 0, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(item, out.alias("simhash"))


def hamming_pairs(prints: DataFrame, threshold: int = THRESHOLD, item: str = "chunk_id") -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the threshold, as (simhash_a, simhash_b, distance).

    Two 64-bit values that differ in t bits differ in t of any number of blocks at most, so
    with t + 2 blocks they agree on two: an equi-join on every pair of blocks, which are
    about 25 bits together, loses none and has far more keys than single blocks of 16 bits.
    Equal fingerprints are one row here; callers join their members back.
    """
    n = threshold + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    block = lambda k: F.shiftrightunsigned("simhash", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    keys = [F.struct(F.lit(i * n + j).alias("no"), block(i).alias("x"), block(j).alias("y")) for i in range(n) for j in range(i + 1, n)]
    rows = prints.select("simhash").distinct().select("simhash", F.explode(F.array(*keys)).alias("k")).select("simhash", "k.*")
    a, b = rows.alias("a"), rows.alias("b")
    near = hamming(F.col("a.simhash"), F.col("b.simhash")).cast("int")
    met = a.join(b, (F.col("a.no") == F.col("b.no")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.simhash") < F.col("b.simhash")) & (near <= threshold))
    return met.select(F.col("a.simhash").alias("simhash_a"), F.col("b.simhash").alias("simhash_b"), near.alias("distance")).distinct()


def fingerprint_groups(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(simhash, label): fingerprints that pairs connect, label being the smallest of each group.

    Each round points every fingerprint to the smallest of its neighbours' and follows the
    pointers to their ends by doubling, so a chain takes rounds as its length's logarithm.
    """
    both = pairs.select(F.col("simhash_a").alias("s"), F.col("simhash_b").alias("t"))
    both = both.unionByName(both.select(F.col("t").alias("s"), F.col("s").alias("t"))).checkpoint()
    label = prints.select("simhash").distinct().withColumn("label", F.col("simhash")).checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("simhash", "t").withColumnRenamed("label", "far"), "t").join(label.withColumnRenamed("simhash", "s"), "s")
        low = near.where("far < label").groupBy("label").agg(F.min("far").alias("low"))
        moved = low.checkpoint()
        if moved.isEmpty():
            return label
        up = label.select(F.col("label").alias("root")).distinct().join(moved, F.col("root") == F.col("label"), "left").select("root", F.coalesce("low", "root").alias("to")).checkpoint()
        while True:
            over = up.select(F.col("root").alias("to"), F.col("to").alias("higher"))
            up = up.join(over, "to").select("root", F.col("higher").alias("to"), (F.col("higher") != F.col("to")).alias("more")).checkpoint()
            if up.where("more").isEmpty():
                break
            up = up.drop("more")
        label = label.join(up.select(F.col("root").alias("label"), "to"), "label").select("simhash", F.col("to").alias("label")).checkpoint()


def elect_leaders(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(simhash, leader) by the rule of input order, as rounds of joins over the pairs; no group is in one task.

    prints (simhash, first): fingerprints with the smallest id that has them. In the order of
    ids, a fingerprint that no earlier leader is near to leads, and others follow the
    earliest leader near to them. In each round those lead whose earlier neighbours all
    follow others, and those follow whose earliest leading neighbour comes before all
    neighbours that may still lead. Fingerprints without a pair lead from the start; rounds
    take the others only, as written tables, so that small ones are sent and not shuffled.
    """
    p = pairs.select(F.col("simhash_a").alias("s"), F.col("simhash_b").alias("t"))
    f = lambda s, name: prints.select(F.col("simhash").alias(s), F.col("first").alias(name))
    near = written(p.join(f("s", "fs"), "s").join(f("t", "ft"), "t"), "near-prints")
    turn = F.col("fs") < F.col("ft")
    p = written(near.select(F.when(turn, F.col("t")).otherwise(F.col("s")).alias("late"), F.when(turn, F.col("s")).otherwise(F.col("t")).alias("early"), F.least("fs", "ft").alias("early_first")), "leader-pairs")
    paired = near.select(F.inline(F.array(F.struct(F.col("s").alias("simhash"), F.col("fs").alias("first")), F.struct(F.col("t").alias("simhash"), F.col("ft").alias("first"))))).distinct()
    left = written(paired.withColumn("best", F.lit(None).cast(dict(prints.dtypes)["first"])), "leaders-open")
    out = prints.join(left.select("simhash"), "simhash", "left_anti").select("simhash", F.col("first").alias("leader"))
    while not left.isEmpty():
        wait = p.groupBy(F.col("late").alias("simhash")).agg(F.min("early_first").alias("maybe"))
        x = left.join(wait, "simhash", "left")
        leads, follows = F.col("best").isNull() & F.col("maybe").isNull(), F.col("best").isNotNull() & (F.col("maybe").isNull() | (F.col("best") < F.col("maybe")))
        x = written(x.withColumn("leader", F.when(leads, F.col("first")).when(follows, F.col("best"))).withColumn("leads", leads), "leaders")
        out = out.unionByName(x.where("leader is not null").select("simhash", "leader"))
        heads = x.where("leads").select(F.col("simhash").alias("early"))
        won = p.join(heads, "early", "left_semi").groupBy(F.col("late").alias("simhash")).agg(F.min("early_first").alias("won"))
        left = written(x.where("leader is null").select("simhash", "first", "best").join(won, "simhash", "left").select("simhash", "first", F.least("best", "won").alias("best")), "leaders-open")
        open_ = left.select("simhash")
        p = written(p.join(open_.withColumnRenamed("simhash", "late"), "late", "left_semi").join(open_.withColumnRenamed("simhash", "early"), "early", "left_semi"), "leader-pairs")
    return out


def leader_clusters(chunks: DataFrame, threshold: int = THRESHOLD, item: str = "chunk_id", text: str = "text", tokens: str = "tokens", generated: str = "generated") -> DataFrame:
    """item, leader, cluster_size, representative of chunks in clusters of two or more.

    In the order of ids, each chunk without a cluster leads one and takes the later ones
    without a cluster within the threshold of it. Equal fingerprints count once, under
    their smallest id. The representative is not generated if any is not, has most tokens,
    then the smallest id.
    """
    prints = written(fingerprints(chunks, item, text, tokens), "fingerprints")
    first = written(prints.groupBy("simhash").agg(F.min(item).alias("first")), "first-prints")
    led = elect_leaders(first, hamming_pairs(prints, threshold, item))
    rows = prints.join(led, "simhash").join(chunks.select(item, tokens, generated), item)
    best = rows.groupBy("leader").agg(F.count("*").alias("cluster_size"), F.min_by(item, F.struct(F.col(generated), -F.col(tokens), F.col(item))).alias("representative")).where("cluster_size > 1")
    return rows.select(item, "leader").join(best, "leader").select(item, "leader", "cluster_size", "representative")


def cache_split(chunks: DataFrame, cache: DataFrame, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """Chunks whose vector the cache holds, and one chunk for each hash that it does not."""
    hits = chunks.join(cache, key)
    w = Window.partitionBy(key).orderBy("chunk_id")
    misses = chunks.join(cache.select(key), key, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return hits, misses
