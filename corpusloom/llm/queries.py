"""One query for each training-data operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, line_dedup
from ._common import documents
from .bpe import MORE_KEPT, bpe
from .langid import identify
from .license_scan import document_path, license_scan
from .media import document_media
from .mixing import mix
from .ngram_join import near_duplicates
from .packing import pack
from .runs import periodic_runs, run_digests, with_planted_runs
from .sharding import shard
from .toxicity import toxicity

#: The tokenizer files of op2 and op12.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PACK_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(documents(spark, sf_dir), TOKENIZER, keep=MORE_KEPT)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir).withColumn("path", document_path()))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4, num=85, den=100)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_in_all").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 24)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.embedded_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.hard_negatives(rows, F.col("key") % 100 == 0)


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), PACK_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(documents(spark, sf_dir))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_bpe": op2_bpe,
        "op3_langid": op3_langid,
        "op4_license_scan": op4_license_scan,
        "op5_source_mix": op5_source_mix,
        "op6_media_columns": op6_media_columns,
        "op7_ngram_join": op7_ngram_join,
        "op8_toxicity": op8_toxicity,
        "op9_line_dedup": op9_line_dedup,
        "op10_feistel_shards": op10_feistel_shards,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_curve_packing": op12_curve_packing,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
