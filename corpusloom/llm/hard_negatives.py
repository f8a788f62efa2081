"""Hard-negative mining over one-dimensional distance keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, maybe_broadcast

#: Rows from which pivots are fitted, and at most so many pivots.
SAMPLE, MOST_PIVOTS = 2048, 256
#: Vectors of a block of the index; queries that meet a block in one task.
BLOCK, QUERIES_A_TASK = 2048, 4096
#: How much wider the annulus of a search gets from round to round.
GROWTH = 4.0
_BLOCKS = "block long, pivot int, nearest double, farthest double, n int, keys binary, labels binary, vectors binary"


@dataclass
class Index:
    """Blocks of vectors in the order of (pivot, distance), and what a search needs to know of them."""

    blocks: DataFrame
    pivots: np.ndarray  # augmented
    norm: float  # of every augmented vector
    size: int  # components
    kind: str  # numpy type of stored components
    n_blocks: int
    thickness: float  # mean of farthest - nearest


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of any number of components as rows of one size, filled up with zeros."""
    out = np.zeros((len(column), size))
    flat, ends = np.asarray(column.flatten(), float), np.asarray(column.offsets) - column.offsets[0].as_py()
    lengths = np.diff(ends)
    if len(flat):
        out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1], lengths)] = flat
    return out


def _augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """One component more, so that all have the same length and nearness is the inner product's order."""
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))[:, None]])


def _fit(sample: np.ndarray, k: int) -> np.ndarray:
    """k centres: far points first, each the farthest from those before, then a few rounds of means."""
    centres = [sample[0]]
    near = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.max() > 0:
        centres.append(sample[near.argmax()])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(6):
        own = ((c * c).sum(1) - 2 * sample @ c.T).argmin(1)
        c = np.stack([sample[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def build_index(rows: DataFrame, pivots: int | None = None) -> Index:
    """An index of all rows (key long, label int, vector array of whole numbers).

    Pivots are means of a sample of SAMPLE rows, picked by a hash of the key; every row is
    assigned to its nearest one. The table is sorted by pivot, distance and key over all
    tasks and written as blocks of BLOCK vectors, each of one pivot; equal vectors have
    equal distances and are split by their keys, so a hot vector is many blocks.
    """
    facts = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    count, size, square, largest = facts[0], facts[1] or 0, facts[2] or 0.0, facts[3] or 0.0
    norm = float(np.sqrt(square))
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
    picked = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").toArrow()
    sample = _augmented(_matrix(picked.column(0).combine_chunks(), size), norm) if picked.num_rows else np.zeros((1, size + 1))
    centres = _fit(sample, pivots or min(MOST_PIVOTS, max(8, int(count**0.5 / 8))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), size)
            d = np.sqrt(np.maximum(_distances(_augmented(x, norm), centres), 0))
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(d[np.arange(len(x)), own]), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], names=["key", "label", "pivot", "distance", "vector"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            pivot = np.asarray(batch.column(2))
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if held and (held[0].column(2)[0].as_py() != pivot[a] or sum(x.num_rows for x in held) == BLOCK):
                        yield _block(held, made)
                        made, held = made + 1, []
                    take = min(b - a, BLOCK - sum(x.num_rows for x in held))
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield _block(held, made)

    assigned = materialize(rows.select("key", "label", "vector").mapInArrow(assign, "key long, label int, pivot int, distance double, vector binary"), "negatives-assigned")
    order = ["pivot", "distance", "key"]
    blocks = materialize(assigned.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(gather, _BLOCKS), "negatives-index")
    known = blocks.agg(F.count("*"), F.avg(F.col("farthest") - F.col("nearest"))).first()
    return Index(blocks, centres, norm, size, kind, known[0], known[1] or 0.0)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T


def _block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    key, label, d = (np.asarray(t.column(c)) for c in ("key", "label", "distance"))
    values = [number, int(t.column("pivot")[0].as_py()), float(d[0]), float(d[-1]), len(key), key.astype("<i8").tobytes(), label.astype("<i4").tobytes(), b"".join(t.column("vector").to_pylist())]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _BLOCKS.split(", ")])


def search(index: Index, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor, other, key, score, rank) of the k best rows of each query, by score, then key.

    queries: anchor, other (they name the query), label, vector, least and most: only rows
    of the anchor's label (or of other labels), without the anchor, with a score from
    ``least`` to ``most`` count.

    The scores' bounds are distances from the query, so what is asked for lies in an
    annulus. It is searched from its inner edge outwards, in rounds: with the distance to a
    pivot known, an annulus is an interval of the pivot's keys, and only blocks that the
    wider interval newly meets are read. A query ends when k rows are found and the
    next key cannot be nearer than the worst of them, or at the outer edge. Scores are exact
    inner products of whole numbers. Each round is one written table; the number of
    rounds is logarithmic in the annulus over the thickness of a block.
    """
    spark = queries.sparkSession
    norm, size, kind, pivots = index.norm, index.size, index.kind, index.pivots
    slack = 1e-7 * (norm + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(3), size)
            d = np.sqrt(np.maximum(_distances(np.hstack([q, np.zeros((len(q), 1))]), pivots), 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 2, 4, 5)], pa.array((q * q).sum(1)), pa.array(list(d), pa.list_(pa.float64())), pa.array([x.tobytes() for x in q], pa.binary())], names=["anchor", "other", "label", "least", "most", "square", "reach", "vector"])

    schema = "anchor long, other long, label int, least double, most double, square double, reach array<double>, vector binary"
    asked = queries.select("anchor", "other", "label", "vector", F.col("least").cast("double"), F.col("most").cast("double")).mapInArrow(place, schema)
    # A query's distance that belongs to a score; the slack covers rounding in the distances.
    radius = lambda s: F.when(s.isNotNull(), F.sqrt(F.greatest(F.lit(norm * norm) + F.col("square") - 2 * s, F.lit(0.0))))
    whole = F.lit(norm) + F.sqrt("square")
    margin = F.lit(slack) + 1e-7 * F.sqrt("square")
    asked = asked.withColumns({"inner": F.greatest(F.coalesce(radius(F.col("most")), F.lit(0.0)) - margin, F.lit(0.0)), "outer": F.coalesce(radius(F.col("least")), whole) + margin, "margin": margin})
    step = max(index.thickness, norm / 64, 1e-3)
    asked = materialize(asked.withColumns({"before": F.lit(-1.0), "now": F.least(F.col("inner") + step, "outer"), "worst": F.lit(None).cast("double")}), "negatives-asked")
    directory = index.blocks.select("block", "pivot", "nearest", "farthest")
    n_queries, state = asked.count(), asked
    salts = max(1, -(-n_queries // QUERIES_A_TASK))
    found = spark.createDataFrame([], "anchor long, other long, key long, score long")
    best = Window.partitionBy("anchor", "other").orderBy(F.desc("score"), "key")
    while n_queries:
        rings = state.select("anchor", "other", "before", "now", "inner", "margin", F.posexplode("reach").alias("pivot", "d"))
        gap = F.greatest(F.col("d") - F.col("farthest"), F.col("nearest") - F.col("d"), F.lit(0.0))
        newly = (gap <= F.col("now") + F.col("margin")) & (gap > F.col("before") + F.col("margin")) & (F.col("d") + F.col("farthest") + F.col("margin") >= F.col("inner"))
        pairs = rings.join(maybe_broadcast(directory, index.n_blocks, 48), "pivot").where(newly).select("block", "anchor", "other", F.pmod(F.xxhash64("anchor", "other"), F.lit(salts)).alias("salt"))
        pairs = materialize(pairs, "negatives-pairs")
        asking = pairs.join(maybe_broadcast(state.select("anchor", "other", "label", "least", "most", "worst", "vector"), n_queries, 128 + 8 * size), ["anchor", "other"])
        touched = index.blocks.join(pairs.select("block", F.col("salt").alias("part")).distinct(), "block")
        hits = asking.groupBy("block", "salt").cogroup(touched.groupBy("block", "part")).applyInArrow(_meet(size, kind, k, same_label), "anchor long, other long, key long, score long")
        found = materialize(found.unionByName(hits).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "negatives-found")
        worst = found.groupBy("anchor", "other").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("w"))
        state = state.drop("worst").join(worst, ["anchor", "other"], "left").withColumn("worst", F.when(F.col("n") >= k, F.col("w"))).drop("n", "w")
        last = F.least(F.col("outer"), F.coalesce(radius(F.col("worst")) + F.col("margin"), F.col("outer")))
        state = state.where(F.col("now") < last).withColumns({"before": F.col("now"), "now": F.least(F.col("inner") + GROWTH * (F.col("now") - F.col("inner")), last)})
        state = materialize(state, "negatives-open")
        n_queries = state.count()
    return found.withColumn("rank", F.row_number().over(best))


def _meet(size: int, kind: str, k: int, same_label: bool):
    def run(asking: pa.Table, blocks: pa.Table) -> pa.Table:
        """The k best rows of one block for each of the queries that reach it."""
        out: list[list] = [[], [], [], []]
        if asking.num_rows and blocks.num_rows:
            key = np.frombuffer(blocks.column("keys")[0].as_buffer(), "<i8")
            label = np.frombuffer(blocks.column("labels")[0].as_buffer(), "<i4")
            x = np.frombuffer(blocks.column("vectors")[0].as_buffer(), kind).reshape(len(key), size).astype(float)
            anchor, other = asking.column("anchor").to_pylist(), asking.column("other").to_pylist()
            own, of = np.asarray(asking.column("anchor")), np.asarray(asking.column("label"))
            q = np.stack([np.frombuffer(v.as_buffer(), "<f8") for v in asking.column("vector")]) if size else np.zeros((len(own), 0))
            floor = np.maximum(_numbers(asking.column("least"), -np.inf), _numbers(asking.column("worst"), -np.inf))
            top = _numbers(asking.column("most"), np.inf)
            for at in range(0, len(own), 256):
                part = slice(at, at + 256)
                s = q[part] @ x.T
                fits = (label[None] == of[part, None]) == same_label
                fits &= (key[None] != own[part, None]) & (s >= floor[part, None]) & (s <= top[part, None])
                for i in np.flatnonzero(fits.any(1)).tolist():
                    at_i = np.flatnonzero(fits[i])
                    if len(at_i) > k:
                        at_i = at_i[s[i, at_i] >= np.partition(s[i, at_i], -k)[-k]]
                    at_i = at_i[np.lexsort((key[at_i], -s[i, at_i]))[:k]]
                    out[0] += [anchor[at + i]] * len(at_i)
                    out[1] += [other[at + i]] * len(at_i)
                    out[2] += key[at_i].tolist()
                    out[3] += s[i, at_i].astype(np.int64).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor", "other", "key", "score"])

    return run


def _numbers(column: pa.ChunkedArray, default: float) -> np.ndarray:
    return np.asarray(column.fill_null(default), float)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, unit: int = 100) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels that are nearly as near.

    rows: key long, label int, vector array of whole numbers. ``anchor`` is a condition on
    key. A row's score is its inner product with the anchor; higher ones come first, ties by
    smaller key. An anchor's positives are its first ``positives`` other rows of its label.
    A negative's score times ``unit`` lies between ``low`` and ``high`` times the positive's score.

    Rows with a null key, label or vector take no part; of rows with one key the one with
    the greatest label and vector counts. Shorter vectors count as filled up with zeros.
    Scores are exact up to 2^53. Equal vectors tie and go by key, however many there are.
    An anchor without positives, and a positive without negatives, give no rows, nor does an
    empty table. Other columns are not read.
    """
    rows = rows.where("key is not null and label is not null and vector is not null").select("key", "label", "vector")
    rows = materialize(rows, "negatives-rows")
    if rows.groupBy("key").count().where("count > 1").limit(1).count():
        rows = materialize(rows.groupBy("key").agg(F.max(F.struct("label", "vector")).alias("r")).select("key", "r.label", "r.vector"), "negatives-rows")
    index = build_index(rows)
    none = F.lit(None).cast("double")
    anchors = rows.where(anchor).select(F.col("key").alias("anchor"), "label", "vector")
    good = materialize(search(index, anchors.withColumns({"other": F.col("anchor"), "least": none, "most": none}), positives, True).select("anchor", F.col("key").alias("positive"), F.col("score").alias("positive_score")), "negatives-positives")
    # Below zero the lower bound is above the upper one.
    windows = good.where("positive_score >= 0").join(anchors, "anchor")
    least = F.expr(f"({low} * positive_score + {unit - 1}) div {unit}")
    asked = windows.select("anchor", F.col("positive").alias("other"), "label", "vector", least.alias("least"), F.expr(f"({high} * positive_score) div {unit}").alias("most"))
    bad = search(index, asked, negatives, False)
    out = bad.join(good.withColumnRenamed("positive", "other"), ["anchor", "other"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("other").alias("positive_id"), "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def embedded_rows(table: DataFrame) -> DataFrame:
    """Rows of ``embeddings`` as the miner takes them: finite components times 256, rounded down; every seventh row's label moved on."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return rows.select(F.col("vec_id").cast("long").alias("key"), label.cast("int").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s QUALIFY rank <= 5
"""
