"""Bundles and tables at rest: bundle store, verification, upserts, swaps, tombstones, generated regions."""

from __future__ import annotations

import hashlib
import re

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

NEWEST, OLDEST_MAJOR = (2, 0), 0


def write_bundles(bundles: DataFrame, root: str) -> None:
    """Rows with org, repo and sha to gzip JSON below org=/repo=/sha=; partitions that are written are replaced."""
    bundles.write.mode("overwrite").option("compression", "gzip").option("partitionOverwriteMode", "dynamic").partitionBy("org", "repo", "sha").json(root)


def read_bundles(spark: SparkSession, root: str, schema: T.StructType, org: str | None = None, repo: str | None = None) -> DataFrame:
    """Bundles under a prefix: the prefix is a filter on partition columns, so other folders are not read."""
    out = spark.read.schema(schema).option("mode", "FAILFAST").json(root)
    if org is not None:
        out = out.where(F.col("org") == org)
    return out.where(F.col("repo") == repo) if repo is not None else out


def verify(envelopes: DataFrame, seen_nonces: DataFrame, now: Column, most_bytes: int = 512 << 20, key: bytes | None = None) -> DataFrame:
    """envelopes (id, size, payload, payload_hash, scan_passed, expires_at, nonce, signature, commit, expected_commit) with ``failure``, null if none.

    Checks run in a fixed order and the first that fails names the failure; a nonce that was seen is a replay.
    """
    seen = seen_nonces.select(F.col("nonce").alias("_seen")).distinct()
    x = envelopes.join(seen, F.col("nonce") == F.col("_seen"), "left")
    signed = F.lit(True) if key is None else hmac_sha256(key, F.encode(F.concat_ws("\n", "payload_hash", "nonce", "commit"), "UTF-8")) == F.col("signature")
    failure = F.when(F.col("size") > most_bytes, "too-large").when(F.sha2("payload", 256) != F.col("payload_hash"), "hash-mismatch").when(~F.coalesce("scan_passed", F.lit(False)), "scan-failed").when(F.col("expires_at") <= now, "expired").when(F.col("_seen").isNotNull(), "replayed").when(~F.coalesce(signed, F.lit(False)), "bad-signature").when(~F.col("commit").eqNullSafe(F.col("expected_commit")), "commit-mismatch")
    return x.withColumn("failure", failure).drop("_seen")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of bytes with one key: two hashes over the padded key, all in the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def upcast(bundles: DataFrame, steps: dict[int, dict[str, Column]]) -> DataFrame:
    """Bundles (version, ...) that can be read, brought to the newest major: for each major below it the columns that its step sets.

    A row takes the steps from its own major on, in their order; rows with a version that
    cannot be read are left out.
    """
    major = F.split("version", r"\.")[0].cast("int")
    out = bundles.where(accepted_version(F.col("version"))).withColumn("_major", major)
    for at in sorted(k for k in steps if k < NEWEST[0]):
        out = out.withColumns({c: F.when(F.col("_major") <= at, v).otherwise(F.col(c)) for c, v in steps[at].items()})
    return out.withColumn("version", F.concat_ws(".", *[F.lit(str(x)) for x in NEWEST])).drop("_major")


def accepted_version(version: Column) -> Column:
    """Whether a bundle's major.minor can be read: not newer than NEWEST, and at most two majors behind."""
    major, minor = (F.split(version, r"\.")[k].try_cast("int") for k in (0, 1))
    return (major >= max(NEWEST[0] - 2, OLDEST_MAJOR)) & ((major < NEWEST[0]) | ((major == NEWEST[0]) & (minor <= NEWEST[1])))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows over current ones with the same keys."""
    return incoming.unionByName(current.join(incoming.select(*keys).distinct(), keys, "left_anti"))


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows, and the incoming ones whose keys they lack."""
    return current.unionByName(incoming.join(current.select(*keys).distinct(), keys, "left_anti"))


def replace_by(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows, and the current ones whose key none of them has; a null key replaces nothing."""
    return incoming.unionByName(current.join(incoming.select(key).distinct(), key, "left_anti"))


def swap(rows: DataFrame, root: str, partitions: list[str]) -> None:
    """Replace exactly the partitions that rows hold: what is not in this run's rows is gone from them."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(root)


def tombstones(current: DataFrame, seen: DataFrame, key: str, now: Column) -> DataFrame:
    """current with deleted_at set to now for keys that were not seen, and cleared for those that were."""
    there = seen.select(F.col(key).alias("_seen")).distinct()
    x = current.join(there, F.col(key) == F.col("_seen"), "left")
    return x.withColumn("deleted_at", F.when(F.col("_seen").isNotNull(), None).otherwise(F.coalesce("deleted_at", now))).drop("_seen")


def latest(rows: DataFrame, keys: list[str], order: Column, *ties: str) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(order.desc(), *ties)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(stored: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables, derived rows over stored ones."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(derived.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_p"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def front_matter_text(fields: dict[str, Column], body: Column) -> Column:
    """A document with its fields as YAML scalars in front."""
    lines = [F.concat(F.lit(f"{k}: "), F.to_json(F.array(v.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(v.cast("string")))) - 2)) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


_REGION = re.compile(r"<!-- region:([\w.-]+) hash:([0-9a-f]{12}) -->\n(.*?)\n<!-- /region:\1 -->", re.S)


def region(name: str, body: str) -> str:
    return f"<!-- region:{name} hash:{hashlib.sha256(body.encode()).hexdigest()[:12]} -->\n{body}\n<!-- /region:{name} -->"


def merged_documents(documents: DataFrame, text: str = "text", made: str = "made", force: bool = False) -> DataFrame:
    """documents with merged: struct(text, kept, orphans), their regions renewed by ``made``, a map of names to texts."""

    @F.pandas_udf("struct<text:string,kept:array<string>,orphans:array<string>>")
    def merge(texts: pd.Series, regions: pd.Series) -> pd.DataFrame:
        rows = [merge_regions(t or "", dict(r or {}), force) for t, r in zip(texts, regions)]
        return pd.DataFrame(rows, columns=["text", "kept", "orphans"])

    return documents.withColumn("merged", merge(F.col(text), F.col(made)))


def merge_regions(existing: str, made: dict[str, str], force: bool = False) -> tuple[str, list[str], list[str]]:
    """The document with its generated regions renewed, names kept for human edits, and names that are no longer made.

    A region whose text no longer has its hash was edited by hand and stays, unless forced.
    New regions go to the end.
    """
    kept, orphans, seen = [], [], set()

    def renew(m: re.Match) -> str:
        name, mark, body = m[1], m[2], m[3]
        seen.add(name)
        if name not in made:
            orphans.append(name)
            return m[0]
        if not force and hashlib.sha256(body.encode()).hexdigest()[:12] != mark:
            kept.append(name)
            return m[0]
        return region(name, made[name])

    out = _REGION.sub(renew, existing)
    for name in made:
        if name not in seen:
            out = out.rstrip("\n") + "\n\n" + region(name, made[name]) + "\n"
    return out, kept, orphans
