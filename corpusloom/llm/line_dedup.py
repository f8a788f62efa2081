"""Line dedup: documents probe a sharded minimal perfect hash of the repeated lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast, small_batches, sole_owner

#: Keys of a shard on average; bits of a level for each key that is still without a place.
KEYS_A_SHARD, BITS_A_KEY = 16384, 2.0
#: Indexes of at most this many bytes go to every task; larger ones stay by shard and line hashes go to them.
INDEX_BYTES = 48 << 20
#: Rows of line hashes that one task of the by-shard way holds, on average.
PROBES_A_GROUP = 200_000
#: Lines, and bytes of them, whose counts a task holds at once.
_HELD, _HELD_BYTES = 200_000, 64 << 20
_NULL_ID = -(1 << 63)


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of the text in UTF-8, and each line's key, None where it is too short to be dropped."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    keys = [k.strip() for k in raw.lower().split(b"\n")]
    return raw.split(b"\n"), [k if len(k) >= min_chars and (k.isascii() or len(k.decode("utf-8", "surrogatepass")) >= min_chars) else None for k in keys]


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(map(xxhash.xxh3_128_digest, keys))
    both = np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _count_lines(min_chars: int):
    """(h1, h2, n, keep) of the keys of rows (id, text) whose ids are distinct: documents that a task has seen, and their largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            size = 0
            h1, h2 = _hashes(list(held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
            both = np.array(list(held.values()), dtype=np.int64).reshape(-1, 2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["h1", "h2", "n", "keep"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                i = _NULL_ID if i is None else i
                for key in set(line_keys(text.as_py(), min_chars)[1]):
                    if key is None:
                        continue
                    if (x := held.get(key)) is None:
                        held[key] = [1, i]
                        size += len(key)
                    else:
                        x[0] += 1
                        if i > x[1]:
                            x[1] = i
                if len(held) >= _HELD or size >= _HELD_BYTES:
                    yield flush()
        yield flush()

    return run


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15 + 2 * level & (1 << 64) - 1)) ^ np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def build_mph(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct 128-bit keys: bits of each level, the bits of all levels, and each key's number.

    At each level the keys that are alone at their bit get it; the others go on to the next.
    A key's number is the count of set bits before its own.
    """
    sizes, words, where = [], [], np.zeros(len(h1), dtype=np.int64)
    rest, start, level = np.arange(len(h1)), 0, 0
    while len(rest):
        bits = -(-max(64, int(len(rest) * BITS_A_KEY)) // 64) * 64
        at = (_mixed(h1[rest], h2[rest], level) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        mine = alone[at]
        where[rest[mine]] = start + at[mine]
        rest, start, level = rest[~mine], start + bits, level + 1
        sizes.append(bits)
        if level > 200:
            raise ValueError("two keys of the index have the same hash")
    bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    word = where >> 6
    below = bits[word] & ((np.uint64(1) << (where & 63).astype(np.uint64)) - np.uint64(1)) if len(where) else bits
    return sizes, bits, rank[word] + np.bitwise_count(below) if len(where) else where


@dataclass
class LineIndex:
    """Shards of the index side by side: bits and ranks of all levels, and an entry for each key."""

    shards: int
    sizes: np.ndarray  # bits by shard and level
    starts: np.ndarray  # where these begin, in words
    bits: np.ndarray
    rank: np.ndarray  # set bits before each word
    fingerprint: np.ndarray
    count: np.ndarray
    keep: np.ndarray

    @classmethod
    def join(cls, shards: int, parts: list[tuple[int, bytes, bytes, bytes, bytes, bytes]]) -> LineIndex:
        """parts: (shard, bits of each level, bits, fingerprints, counts, ids that keep the line)."""
        parts = sorted(parts)
        levels = [np.frombuffer(p[1], "<i8") for p in parts]
        sizes = np.zeros((shards, max([1, *map(len, levels)])), dtype=np.int64)
        starts, at = np.zeros_like(sizes), 0
        for (s, *_), lv in zip(parts, levels):
            sizes[s, : len(lv)] = lv
            starts[s, : len(lv)] = at + np.concatenate([[0], np.cumsum(lv[:-1] // 64)])
            at += int(lv.sum()) // 64
        cat = lambda i, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(p[i], kind) for p in parts]]).astype(kind)
        bits = cat(2, "<u8")
        return cls(shards, sizes, starts, bits, np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)]), cat(3, "<u8"), cat(4, "<i8"), cat(5, "<i8"))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each hash: whether the index has it, in how many documents, and the id that keeps the line."""
        found = np.full(len(h1), -1, dtype=np.int64)
        shard = shard_of(h1, self.shards)
        rest = np.arange(len(h1))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[rest], level]
            rest = rest[size > 0]
            if not len(rest):
                break
            s = shard[rest]
            at = (_mixed(h1[rest], h2[rest], level) % self.sizes[s, level].astype(np.uint64)).astype(np.int64)
            word, bit = self.starts[s, level] + (at >> 6), (at & 63).astype(np.uint64)
            held = self.bits[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[rest[hit]] = self.rank[word[hit]] + np.bitwise_count(below)
            rest = rest[~hit]
        has = found >= 0
        has[has] = self.fingerprint[found[has]] == h2[has]
        slot = np.where(has, found, 0)
        if not len(self.keep):
            return has, np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        return has, self.count[slot], self.keep[slot]


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


_INDEX = "shard long, sizes binary, bits binary, fp binary, cnt binary, keep binary"


def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = pdf["h1"].to_numpy().astype(np.int64).view(np.uint64), pdf["h2"].to_numpy().astype(np.int64).view(np.uint64)
    sizes, bits, slot = build_mph(h1, h2)
    put = lambda x: x[np.argsort(slot)].tobytes()
    return pd.DataFrame([[int(key[0]), np.array(sizes, "<i8").tobytes(), bits.tobytes(), put(h2), put(pdf["n"].to_numpy().astype("<i8")), put(pdf["keep"].to_numpy().astype("<i8"))]], columns=["shard", "sizes", "bits", "fp", "cnt", "keep"])


def line_index(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """The index as a table with a row for each shard, the number of shards, and its keys.

    Every line of every text is hashed and counted, each task first adding up what it has
    seen. Rows that share an id are one document: their keys are told apart by id before
    they are counted. Keys that fewer than min_docs documents hold never lose a line and are
    left out.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    again = materialize(thin.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "line-ids")
    n_again = again.count()
    alone, shared = thin, None
    if n_again:
        small = maybe_broadcast(again.withColumnRenamed("id", "again"), n_again, 24)
        alone = thin.join(small, F.col("id").eqNullSafe(F.col("again")), "left_anti")
        shared = thin.join(small, F.col("id").eqNullSafe(F.col("again")), "left_semi")
    counted = alone.mapInArrow(_count_lines(min_chars), "h1 long, h2 long, n long, keep long")
    if shared is not None:
        each = shared.mapInArrow(_probe_lines(min_chars, 1), "doc long, no int, h1 long, h2 long, shard long")
        counted = counted.unionByName(each.select("h1", "h2", "doc").distinct().select("h1", "h2", F.lit(1).cast("long").alias("n"), F.col("doc").alias("keep")))
    repeated = materialize(counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keep").alias("keep")).where(F.col("n") >= min_docs), "line-counts")
    keys = repeated.count()
    shards = max(1, -(-keys // KEYS_A_SHARD))
    high = F.shiftrightunsigned("h1", 32)
    index = repeated.withColumn("shard", F.shiftrightunsigned(high * F.lit(shards), 32)).groupBy("shard").applyInPandas(_build_shard, _INDEX)
    return materialize(index, "line-index"), shards, keys


def _strip(spark: SparkSession, index: DataFrame, shards: int, min_chars: int):
    """The function for mapInArrow that drops lines by an index small enough to send to every task."""
    sent = spark.sparkContext.broadcast([tuple(r) for r in index.collect()])
    made: list[LineIndex] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_owner("line_dedup", made.clear)
        if not made:
            made.append(LineIndex.join(shards, sent.value))
        for batch in batches:
            at, n = 0, batch.num_rows
            step = 256  # so that a batch of very long texts is never held as lines all at once
            while at < n:
                part = batch.slice(at, step)
                at += step
                yield _apply(part, made[0], min_chars)

    return run


def _apply(part: pa.RecordBatch, index: LineIndex, min_chars: int) -> pa.RecordBatch:
    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
    split = [line_keys(t, min_chars) for t in texts]
    flat = [k for _, keys in split for k in keys if k is not None]
    has, _, keep = index.probe(*_hashes(flat)) if flat else (np.zeros(0, bool), None, np.zeros(0, np.int64))
    out_n, out_d, kept, at = [], [], [], 0
    has_l, keep_l = has.tolist(), keep.tolist()
    for i, text, (lines, keys) in zip(ids, texts, split):
        i, left = _NULL_ID if i is None else i, []
        for line, key in zip(lines, keys):
            if key is None:
                left.append(line)
                continue
            if not has_l[at] or keep_l[at] == i:
                left.append(line)
            at += 1
        out_n.append(len(lines))
        out_d.append(len(lines) - len(left))
        kept.append(text or "" if len(left) == len(lines) else b"\n".join(left).decode("utf-8", "surrogatepass"))
    n = part.num_columns
    return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(2, n)), pa.array(out_n, pa.int64()), pa.array(out_d, pa.int64()), pa.array(kept, pa.string())], names=[*part.schema.names[2:], "lines_in_all", "lines_dropped", "kept_text"])


def _probe_lines(min_chars: int, shards: int):
    """(the columns before the last two, doc, no, h1, h2, shard) of every line of rows (..., id, text) that has a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                at_row, doc, no, keys = [], [], [], []
                first = part.num_columns - 2
                for r, (i, text) in enumerate(zip(part.column(first).to_pylist(), part.column(first + 1).to_pylist())):
                    for k, key in enumerate(line_keys(text, min_chars)[1]):
                        if key is not None:
                            at_row.append(r), doc.append(_NULL_ID if i is None else i), no.append(k), keys.append(key)
                h1, h2 = _hashes(keys) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                take = pa.array(at_row, pa.int64())
                cols = [*(part.column(c).take(take) for c in range(first)), pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(shard_of(h1, shards))]
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names[:first], "doc", "no", "h1", "h2", "shard"])

    return run


def _probe_shard(shards: int):
    def run(lines: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(index):
            return pd.DataFrame({"row": [], "no": []})
        own = LineIndex.join(shards, [tuple(x) for x in index[["shard", "sizes", "bits", "fp", "cnt", "keep"]].itertuples(index=False)])
        has, _, keep = own.probe(lines["h1"].to_numpy().view(np.uint64), lines["h2"].to_numpy().view(np.uint64))
        return lines.loc[has & (keep != lines["doc"].to_numpy()), ["row", "no"]]

    return run


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES, keep_text: bool = True) -> DataFrame:
    """docs with kept_text, lines_in_all and lines_dropped; without the old text, where keep_text is false.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys
    of at least min_chars code points that at least min_docs documents hold lose all their
    lines, except in the document with the largest id that holds them. The index of these
    keys is a sharded minimal perfect hash with fingerprint, count and keeper arrays.
    Documents probe it where they are as long as it fits in index_bytes; beyond that, line
    hashes go to the shards, salted so that a hot line spreads, and only the numbers of the
    lines to drop come back.

    A null or empty text is one empty line. Rows with one id are one document, which keeps
    its lines in each of them or loses them in each; rows with a null id are one document
    too, behind all others. Very long texts are split one at a time, and a task holds counts
    of a bounded number of bytes of lines. Ties do not arise: ids of documents are distinct.
    An empty table gives no rows. Other columns pass through, whatever their names, except
    the three that are added.
    """
    small_batches(docs.sparkSession)
    index, shards, keys = line_index(docs, min_docs, min_chars, id_col, text_col)
    rest = [c for c in docs.columns if c not in ("lines_in_all", "lines_dropped", "kept_text") and (keep_text or c != text_col)]
    base = docs.select(*rest) if keep_text else docs.select(*rest, text_col)
    added = "lines_in_all long, lines_dropped long, kept_text string"
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    numbered = [F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]  # so that the columns may have any names
    if keys * 40 <= index_bytes:
        data = base.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *numbered)
        made = data.mapInArrow(_strip(docs.sparkSession, index, shards, min_chars), ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(rest)) + f", {added}")
        return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], "lines_in_all", "lines_dropped", "kept_text")
    # The row's own key: its content, so that a rerun of a task finds the same rows.
    row = F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 256)
    lines = base.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct().mapInArrow(_probe_lines(min_chars, shards), "row string, doc long, no int, h1 long, h2 long, shard long")
    lines = materialize(lines, "line-probes")
    salts = max(1, -(-lines.count() // (PROBES_A_GROUP * shards)))
    spread = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    dropped = spread.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(_probe_shard(shards), "row string, no int")
    dropped = dropped.groupBy("row").agg(F.collect_set("no").alias("gone"))
    packed = base.select(F.struct(*numbered).alias("held"), F.col(text_col).alias("text"), row.alias("own"))
    out = packed.join(dropped, F.col("own") == F.col("row"), "left").select("text", "gone", "held")
    made = out.mapInArrow(_drop_numbers, "held struct<" + ",".join(f"c{i}:{kinds[c]}" for i, c in enumerate(rest)) + f">, {added}")
    return made.select(*[F.col(f"held.c{i}").alias(c) for i, c in enumerate(rest)], "lines_in_all", "lines_dropped", "kept_text")


def _drop_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the lines of the given numbers out of rows (text, gone, held)."""
    for batch in batches:
        n, d, kept = [], [], []
        for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines, gone = (text or "").split("\n"), set(gone or ())
            n.append(len(lines))
            d.append(len(gone))
            kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text or "")
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.string())], names=["held", "lines_in_all", "lines_dropped", "kept_text"])


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.no, k.line, r.key IS NULL OR r.keep = k.doc_id AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
