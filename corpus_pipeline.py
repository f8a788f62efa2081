"""The corpus pipeline: documents in, encoded training mix out.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows
that the stage before it kept, and returns a DataFrame. Null texts, empty tables and
repeated rows pass through as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm._common import materialize, maybe_broadcast
from corpusloom.llm.bpe import bpe
from corpusloom.llm.langid import UNDETERMINED, identify
from corpusloom.llm.line_dedup import drop_repeated_lines
from corpusloom.llm.mixing import mix, words_in
from corpusloom.llm.ngram_join import near_duplicates
from corpusloom.llm.queries import TOKENIZER

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.4


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """docs with columns named by number, the number of each column, and the way back: columns may have any names."""
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()]), names, [F.col(n).alias(c) for c, n in names.items()]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no language fits.

    Null, empty and letterless texts go; repeated rows and null ids stay as often as they
    are; of equally probable languages the first by code point counts. A text of any length
    is labelled whole. Of an empty table nothing is left.
    """
    plain, n, back = _numbered(docs)
    out = identify(plain, n["doc_id"], n["text"], n["lang"], carry=[x for x in n.values() if x != n["doc_id"]])
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays, with the length of what is left.

    A null text is one empty line and comes back empty. Rows of one id, and rows with a null
    id, are one document for the count. Of documents that hold a line the one with the
    largest id keeps it.
    """
    plain, n, _ = _numbered(docs)
    out = drop_repeated_lines(plain, id_col=n["doc_id"], text_col=n["text"], keep_text=False)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col(n[c])).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5 words, similarity 0.8) the document with the smallest id stays.

    Rows with a null id stay, however alike: nothing names them. Repeated rows of the id that
    stays stay with it. Null and empty texts are like no other. Of an empty table nothing is left.
    """
    near = near_duplicates(docs, k=5, num=80, den=100)
    gone = materialize(near.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-gone")
    return docs.join(maybe_broadcast(gone, gone.count(), 40), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come to their targets.

    Rows that share id, source and size are numbered by their texts, so that each gets its
    own copies; such rows are few, as ids name documents. Null ids and null sources count
    like others; texts without words get whole copies only.
    """
    mixed = materialize(mix(docs), "pipeline-mix")
    alone = (mixed.agg(F.max("copy_no")).first()[0] or 0) == 0
    taken = mixed.where("copies > 0").select(F.struct("doc_id", "source", "size", "copy_no").alias("_key"), "copies")
    words = words_in(F.col("text"))
    number = F.lit(0).cast("long") if alone else (F.row_number().over(Window.partitionBy("doc_id", "source", words).orderBy("text")) - 1).cast("long")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.struct("doc_id", "source", words.alias("size"), number.alias("copy_no")).alias("_key"))
    on = [F.col(f"k._key.{c}").eqNullSafe(F.col(f"t._key.{c}")) for c in ("doc_id", "source", "size", "copy_no")]
    out = keyed.alias("k").join(maybe_broadcast(taken, taken.count(), 96).alias("t"), on)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of ids and decoded text; a row for each copy, null ids too."""
    return bpe(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A trained network and drawn copies are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-stage")
    return docs
