"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import materialize, maybe_broadcast, small_batches, sole_owner
from .bpe import byte_letters

LENGTH, END = 1024, 0
#: Buckets of a document's hashed vector; dimensions of its projection and bits of each.
BUCKETS, DIMS, BITS = 256, 4, 8
#: Bytes of ids that one range of the curve holds on average.
RANGE_BYTES = 48 << 20
#: Fixed values of the format: how byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run without a cut that is longer than this goes through the tokenizers library, whose time does not grow with its square.
LONG_RUN = regex.compile(r"\S{1000,}|\s{1000,}")
#: Ids or characters that a task returns at once.
BATCH_IDS = 1 << 20


class Encoder:
    """ids of the tokenizers library for a byte-level BPE file, from ranks where ids are ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.path, model = path, data["model"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        added = {x["content"]: x["id"] for x in data["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        self.size = max([*model["vocab"].values(), *added.values()]) + 1
        self.fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added)
        self.slow: Tokenizer | None = None

    def encode(self, text: str) -> np.ndarray:
        if not LONG_RUN.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer coordinates of ``bits`` bits.

    From the highest bit down, the part of the grid that a coordinate's bit picks is turned
    as the curve runs through it: a set bit inverts the lower bits of the first axis, a clear
    one exchanges them with its own. The Gray code of the turned coordinates, read across,
    is the place.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            up = (x[d] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, 0)
            x[0] ^= swap
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = place << 1 | (x[d] >> b) & 1
    return place


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the projection; fixed by their seed."""
    rng = np.random.default_rng(12)
    return rng.integers(BUCKETS, size=size), rng.choice([-1.0, 1.0], size=size), rng.standard_normal((BUCKETS, DIMS))


def projected(ids: list[np.ndarray], size: int) -> np.ndarray:
    """Grid coordinates of documents: signed hashed counts, dampened, of length 1, projected.

    The projection of a unit vector on random directions is nearly normal with variance 1,
    so the normal's quantiles fill the grid evenly, without counts over the corpus.
    """
    bucket, sign, directions = _tables(size)
    vectors = np.stack([np.bincount(bucket[x], weights=sign[x], minlength=BUCKETS) for x in ids]) if ids else np.zeros((0, BUCKETS))
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    share = 1 / (1 + np.exp(-1.702 * (vectors @ directions)))  # close to the normal's distribution function
    return np.minimum(share * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def _encode(path: str, end: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_owner("packing", encoder.cache_clear)
        enc = encoder(path)
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        for batch in batches:
            start, held, ids = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                got = enc.encode(text.as_py() or "")
                ids.append(np.append(got, end).astype(np.uint32))
                held += len(ids[-1])
                if held >= BATCH_IDS or i + 1 == batch.num_rows:
                    place = hilbert(projected(ids, enc.size), BITS)
                    rest = [batch.column(c).slice(start, len(ids)) for c in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([len(x) for x in ids], pa.int64()), pa.array(place, pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=[name, "tie", "n", "place", "ids"])
                    start, held, ids = i + 1, 0, []

    return run


def _cut(length: int, path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents arrive in the order of the curve, range by range; ``base`` is the place of a range's first id."""
        kind = "<u2" if encoder(path).size <= 1 << 16 else "<u4"
        slot, at = None, 0
        for batch in batches:
            who, start, part, total, sequence, offset, size = [], [], [], [], [], [], 0
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() != slot:
                    slot, at = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                ids = np.frombuffer(batch.column(3)[i].as_buffer(), kind).astype("<u4")
                done = 0
                while done < len(ids):
                    room = min(length - at % length, len(ids) - done)
                    who.append(i)
                    start.append(done)
                    part.append(ids[done : done + room].tobytes())
                    total.append(len(ids))
                    sequence.append(at // length)
                    offset.append(at % length)
                    done, at, size = done + room, at + room, size + room
                if size >= BATCH_IDS or i + 1 == batch.num_rows:
                    lengths = [len(x) // 4 for x in part]
                    cols = [pa.array(x, pa.int64()) for x in (start, lengths, total, sequence, offset)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *cols, pa.array(part, pa.binary())], names=[name, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
                    who, start, part, total, sequence, offset, size = [], [], [], [], [], [], 0

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids, similar documents side by side.

    A document is its ids and the id ``end``. Its hashed vector, projected to DIMS
    dimensions, has a place on a Hilbert curve; documents follow each other in the order of
    these places and are cut where a sequence is full. So every sequence but the last is
    full, whatever the number of tasks. Documents of one place are ordered by a hash of the
    id, then by id and text; they too are spread over ranges, so many copies of a text are
    not in one task.

    The ids are written once, in the shared folder. Ranges of the curve come from quantiles
    of the places, their first positions from sums of ids by range, one row a range; then
    each id is shuffled once, to its range.

    Returns id, start (ids of the document before the piece), length, doc_tokens,
    sequence_id, offset and ids (unsigned 32-bit, little-endian). A null or empty text is
    just the end id. Null ids and repeated rows are packed like others; which of two equal
    rows comes first does not show. A text of any length is encoded whole and cut as often
    as needed. An empty table gives no rows. Columns other than id and text are not read.
    """
    small_batches(docs.sparkSession)
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(id_col, text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_tie"))
    made = rows.mapInArrow(_encode(tokenizer, end, id_col), f"`{id_col}` {kind}, tie long, n long, place long, ids binary")
    # 32 bits of the place, 8 of the text and 12 of the id: whole numbers that a double holds.
    spread = F.col("place") * (1 << 20) + F.pmod("tie", F.lit(1 << 8)) * (1 << 12) + F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 12))
    made = materialize(made.withColumn("curve", spread.cast("double")).drop("place"), "pack-ids", "zstd")
    ids = made.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids * 4 // RANGE_BYTES))
    marks = made.agg(F.percentile_approx("curve", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ids and ranges > 1 else []
    splits = [-float("inf"), *sorted(set(marks or [])), float("inf")]
    made = Bucketizer(splits=splits, inputCol="curve", outputCol="slot").transform(made).withColumn("slot", F.col("slot").cast("int")) if len(splits) > 2 else made.withColumn("slot", F.lit(0))
    sums = made.groupBy("slot").agg(F.sum("n").alias("n")).collect()  # a row for each range, as many as there are tasks
    base, at = [], 0
    for r in sorted(sums):
        base.append((r.slot, at))
        at += r.n
    first = spark.createDataFrame(base, "slot int, base long")
    dealt = made.join(maybe_broadcast(first, len(base), 64), "slot").repartition(ranges, "slot").sortWithinPartitions("slot", "curve", id_col, "tie")
    schema = f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return dealt.select(id_col, "slot", "base", "ids").mapInArrow(_cut(length, tokenizer, id_col), schema)
