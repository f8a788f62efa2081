"""Vector search: exact over all vectors, or approximate over the cells of an inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.tables import sent_if_small, written

#: Vectors, and queries, that meet in one task, and scores that it holds at once.
PART_ROWS, QUERY_ROWS, SCORES = 16_384, 2_048, 1 << 19
#: Rows from which the centres of cells are fitted, by a hash of the id.
SAMPLE = 8_192


def top_of_groups(score, k: int, query: str, item: str):
    """A function for cogroup(...).applyInArrow: the k best items of each query among the group's items, ties by id.

    score(items, queries) is a function of a range of queries, whose matrix of queries by
    items has -inf where an item does not count. It is asked for few queries at a time, so
    that memory hangs on the group's rows and not on their pairs.
    """

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        who, what, values = [], [], []
        if items.num_rows and queries.num_rows:
            # In the order of ids, so that the first of equal scores are those with the smallest.
            items = items.take(pc.sort_indices(items.column(item)))
            of = score(items, queries)
            step = max(1, SCORES // items.num_rows)
            for start in range(0, queries.num_rows, step):
                for j, own in enumerate(of(start, min(start + step, queries.num_rows)), start):
                    at = np.flatnonzero(own > -np.inf)
                    if len(at) > k:
                        mine = own[at]
                        least = np.partition(mine, -k)[-k]
                        above, equal = at[mine > least], at[mine == least]
                        at = np.concatenate([above, equal[: k - len(above)]])
                    what.append(at)
                    who.append(np.full(len(at), j))
                    values.append(own[at])
            at, j = np.concatenate(what), np.concatenate(who)
            return pa.table({query: queries.column(query).combine_chunks().take(pa.array(j)), item: items.column(item).combine_chunks().take(pa.array(at)), "score": pa.array(np.concatenate(values))})
        return pa.table({query: queries.column(query).slice(0, 0), item: items.column(item).slice(0, 0), "score": pa.array([], pa.float64())})

    return run


def numbers(column: pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix; all must have one size."""
    flat = column.combine_chunks()
    sizes = np.unique(np.diff(flat.offsets.to_numpy()))
    if len(sizes) > 1 or (size is not None and len(sizes) and sizes[0] != size):
        raise ValueError(f"vectors of {sizes.tolist()} numbers among queries of {size}")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _cosines(items: pa.Table, queries: pa.Table):
    q = numbers(queries.column("_qv"))
    x = numbers(items.column("_v"), q.shape[1])
    size, qsize = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    return lambda start, end: np.round((q[start:end] @ x.T) / (size[None] * qsize[start:end, None]), 6)


def best(found: DataFrame, k: int, query: str, item: str) -> DataFrame:
    """query, item, rank, score of the k best of each query; ties by id."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return found.select(query, item, "score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def met(items: DataFrame, queries: DataFrame, score, k: int, query: str, item: str, within: str | None = None, rows: int = PART_ROWS) -> DataFrame:
    """The k best items of each query, by a score that a task computes for blocks of both.

    Items are dealt by a hash of their id over parts of ``rows``, queries over blocks of
    QUERY_ROWS; each part meets each block in a group of its own, which holds no more than
    these. Both sides are read as tables; only k rows of each query and part are shuffled on.
    With ``within``, a column of both, an item counts for queries of the same value only,
    and the k best are those of each query and value.
    """
    n, m = items.count(), queries.count()
    parts, blocks = max(1, -(-n // rows)), max(1, -(-m // QUERY_ROWS))
    keys = ["_part", "_block", *([within] if within else [])]
    i = items.withColumn("_part", F.pmod(F.xxhash64(item), F.lit(parts))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    q = queries.withColumn("_block", F.pmod(F.xxhash64(query), F.lit(blocks))).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    kinds, qkinds = dict(items.dtypes), dict(queries.dtypes)
    schema = f"`{query}` {qkinds[query]}, `{item}` {kinds[item]}, score double"
    found = i.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(top_of_groups(score, k, query, item), schema)
    return found if within else best(found, k, query, item)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 50, item: str = "vec_id", vector: str = "embedding", query: str = "query_id", within: str | None = None) -> DataFrame:
    """Exact nearest vectors by cosine, rounded to six places, of queries (query, query_vector).

    Vectors and queries must all have one size; others are an error. Null vectors have no
    neighbours. With ``within``, the best of each query and value of that column, unranked.
    """
    extra = [within] if within else []
    v = vectors.where(F.col(vector).isNotNull()).select(item, F.col(vector).alias("_v"), *extra)  # doubles in the task
    q = queries.where("query_vector is not null").select(query, F.col("query_vector").alias("_qv"), *extra)
    return met(v, q, _cosines, k, query, item, within)


@dataclass
class CellIndex:
    """Vectors of length 1 in a folder for each cell, and the cells' centres."""

    rows: DataFrame  # item, vector, cell
    centres: np.ndarray
    sizes: dict[int, int]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-30)[:, None]


def build_cells(vectors: DataFrame, cells: int, item: str = "vec_id", vector: str = "embedding", rounds: int = 10) -> CellIndex:
    """An inverted-file index of all vectors: each in the cell of its nearest centre.

    Centres are fitted by k-means on SAMPLE rows at most, chosen by a hash of the id; all
    rows are then assigned in the tasks and written in a folder for each cell, a hot cell
    as several files.
    """
    kind = dict(vectors.dtypes)[item]
    double = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.where(F.col(vector).isNotNull()).select(item, double.alias("vector"))
    sample = rows.orderBy(F.xxhash64(item), item).limit(SAMPLE).select("vector").toArrow()
    x = _unit(numbers(sample.column("vector"))) if sample.num_rows else np.zeros((0, 1))
    centres = x[: max(1, min(cells, len(x)))] if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        own = (x @ centres.T).argmax(1)
        centres = _unit(np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _unit(numbers(pa.chunked_array([batch.column(1)]), centres.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64())), pa.array((v @ centres.T).argmax(1).astype(np.int32))], names=[item, "vector", "cell"])

    made = rows.mapInArrow(assign, f"`{item}` {kind}, vector array<double>, cell int")
    stored = written(made.repartition("cell", F.pmod(F.xxhash64(item), F.lit(8))), "cells", ["cell"])
    sizes = {r.cell: r["count"] for r in stored.groupBy("cell").count().collect()}  # a row a cell
    return CellIndex(stored, centres, sizes)


def search_cells(index: CellIndex, queries: DataFrame, k: int = 50, probes: int = 8, item: str = "vec_id", query: str = "query_id") -> DataFrame:
    """Approximate nearest vectors: the k best of each query in its ``probes`` nearest cells.

    Only the folders of cells that some query probes are read. A cell of more than PART_ROWS
    vectors is dealt over several groups, each of which meets the cell's queries.
    """
    centres, qkind = index.centres, dict(queries.dtypes)[query]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _unit(numbers(pa.chunked_array([batch.column(1)]), centres.shape[1]))
                take = min(probes, len(centres))
                cell = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :take].astype(np.int32)
                who = pa.array(np.repeat(np.arange(len(q)), take))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), pa.array(list(q), pa.list_(pa.float64())).take(who), pa.array(cell.ravel())], names=[query, "_qv", "cell"])

    asked = queries.where("query_vector is not null").select(query, F.transform("query_vector", lambda x: x.cast("double")).alias("v"))
    asked = written(asked.mapInArrow(near, f"`{query}` {qkind}, _qv array<double>, cell int"), "probes")
    probed = [r.cell for r in asked.select("cell").distinct().collect()]  # as many as there are cells at most
    parts = F.create_map(*[F.lit(x) for c, n in index.sizes.items() for x in (c, max(1, -(-n // PART_ROWS)))]) if index.sizes else F.create_map(F.lit(0), F.lit(1))
    of = F.coalesce(F.try_element_at(parts, F.col("cell")), F.lit(1))
    v = index.rows.where(F.col("cell").isin(probed)).select(item, F.col("vector").alias("_v"), "cell").withColumn("part", F.pmod(F.xxhash64(item), of).cast("int"))
    q = asked.withColumn("part", F.explode(F.sequence(F.lit(0), of - 1))).withColumn("block", F.pmod(F.xxhash64(query), F.lit(max(1, -(-asked.count() // (QUERY_ROWS * 8))))))
    q = written(q, "probing")
    blocks = q.select("cell", "part", F.col("block").alias("with_block")).distinct()
    v = v.join(sent_if_small(blocks, sum(-(-n // PART_ROWS) for n in index.sizes.values()) * 8, 16), ["cell", "part"])
    kinds = dict(index.rows.dtypes)
    found = v.groupBy("cell", "part", "with_block").cogroup(q.groupBy("cell", "part", "block")).applyInArrow(top_of_groups(_cosines, k, query, item), f"`{query}` {qkind}, `{item}` {kinds[item]}, score double")
    return best(found, k, query, item)


def recall(approximate: DataFrame, exact: DataFrame, item: str = "vec_id", query: str = "query_id") -> DataFrame:
    """query and the share of its exact neighbours that the approximate search found."""
    hit = exact.select(query, item).join(approximate.select(query, item, F.lit(1).alias("hit")), [query, item], "left")
    return hit.groupBy(query).agg((F.count("hit") / F.count("*")).alias("recall"))
