"""Word search: BM25 without a shuffle of texts, and cover density over word positions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import token_set, trigram_similarity
from corpusloom.operators.tables import written
from corpusloom.operators.vectors import best, met

#: Asked terms up to which tasks count these only; with more of them every word of a text goes on.
MOST_TERMS = 200_000
#: Texts whose words a task holds at once, and texts' counts that meet a block of queries in one task.
SLICE, PART_TEXTS = 256, 8_192
_WORD = re.compile(r"[a-z0-9_]{3,}")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _counted(item: str, within: str | None, asked: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            terms, tfs, lengths = [], [], []
            for text in batch.column(1).to_pylist():
                words = _WORD.findall((text or "").lower())
                counts = Counter(words if asked is None else [w for w in words if w in asked])
                lengths.append(len(words))
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            rest = [batch.column(0), *([batch.column(2)] if within else [])]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lengths, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))], names=[item, *([within] if within else []), "len", "terms", "tfs"])

    return run


def _bm25(k1: float, b: float, average: float):
    def score(items: pa.Table, queries: pa.Table):
        """Saturated counts of the items by weights of the queries, term by term over lists of the items that hold it."""
        asked, idf = queries.column("asked").combine_chunks(), queries.column("idf").combine_chunks()
        known = pc.unique(asked.flatten())
        wanted = pc.index_in(asked.flatten(), value_set=known).to_numpy()
        weights, begins = idf.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(asked).to_numpy())])
        terms = items.column("terms").combine_chunks()
        code = pc.fill_null(pc.index_in(terms.flatten(), value_set=known), -1).to_numpy()
        row = np.repeat(np.arange(items.num_rows), pc.list_value_length(terms).to_numpy())
        count = items.column("tfs").combine_chunks().flatten().to_numpy()
        hit = code >= 0
        code, row, count = code[hit], row[hit], count[hit].astype(float)
        order = np.argsort(code, kind="stable")
        code, row, count = code[order], row[order], count[order]
        norm = k1 * (1 - b + b * np.asarray(items.column("len"), float)[row] / average) if average else 1.0
        full = count * (k1 + 1) / (count + norm)
        ends = np.searchsorted(code, np.arange(len(known) + 1))

        def of(start: int, end: int) -> np.ndarray:
            out = np.zeros((end - start, items.num_rows))
            for j in range(start, end):
                for i in range(begins[j], begins[j + 1]):
                    held = slice(ends[wanted[i]], ends[wanted[i] + 1])
                    out[j - start, row[held]] += weights[i] * full[held]
            out = np.round(out, 6)
            out[out <= 0] = -np.inf
            return out

        return of

    return score


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = 50, item: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query", k1: float = 1.2, b: float = 0.75, within: str | None = None) -> DataFrame:
    """The k best chunks of each query by BM25; ties by id.

    A task cuts each text once and counts its words in place, those that are asked for only
    as long as these are at most MOST_TERMS; texts themselves are never shuffled. Counts
    then meet the queries part by part, and k rows of each query and part go on. Statistics
    are over all chunks. With ``within``, the best of each query and value, unranked.
    """
    kinds = dict(chunks.dtypes)
    extra = [within] if within else []
    asked = queries.select(query, *extra, F.explode(token_set(F.col(query_text))).alias("term"))
    few = asked.select("term").distinct().limit(MOST_TERMS + 1)
    wanted = [r[0] for r in few.collect()]
    keep = frozenset(wanted) if len(wanted) <= MOST_TERMS else None
    schema = f"`{item}` {kinds[item]}, " + f"`{within}` {kinds.get(within)}, " * bool(within) + "len int, terms array<string>, tfs array<int>"
    counted = written(chunks.select(item, text, *extra).mapInArrow(_counted(item, within, keep), schema), "bm25-counts")
    n, average = counted.agg(F.count("*"), F.avg("len")).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weighed = asked.join(df, "term").groupBy(query, *extra).agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("ts"))
    q = weighed.select(query, *extra, F.col("ts.term").alias("asked"), F.col("ts.idf").alias("idf"))
    return met(counted.where(F.size("terms") > 0), q, _bm25(k1, b, average or 0.0), k, query, item, within, PART_TEXTS)


def term_matches(chunks: DataFrame, queries: DataFrame, item: str, text: str, query: str, query_text: str) -> DataFrame:
    """(query, item, n_asked, n_terms) of chunks that hold all terms of a query.

    A task cuts each text once and keeps the terms that are asked for, as long as these are
    at most MOST_TERMS. A chunk meets a query through the query's rarest term only, by an
    equi-join, and is then held against all of its terms.
    """
    asked = queries.select(query, token_set(F.col(query_text)).alias("asked")).where(F.size("asked") > 0)
    wanted = [r[0] for r in asked.select(F.explode("asked").alias("t")).distinct().limit(MOST_TERMS + 1).collect()]
    keep = frozenset(wanted) if len(wanted) <= MOST_TERMS else None
    kind = dict(chunks.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [set(_WORD.findall((t or "").lower())) for t in batch.column(1).to_pylist()]
            held = [list(f if keep is None else f & keep) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array(held, pa.list_(pa.string()))], names=[item, "n_terms", "terms"])

    made = written(chunks.select(item, text).mapInArrow(run, f"`{item}` {kind}, n_terms int, terms array<string>"), "terms")
    held = made.select(item, F.explode("terms").alias("term"))
    counts = held.groupBy("term").agg(F.count("*").alias("df"))
    rarest = asked.select(query, F.explode("asked").alias("term")).join(counts, "term", "left").groupBy(query).agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    near = held.join(rarest, "term").select(item, query).join(asked, query).join(made, item)
    return near.where(F.size(F.array_except("asked", "terms")) == 0).select(query, item, F.size("asked").alias("n_asked"), "n_terms")


#: What a cover without other words in it is worth.
COVER = 0.1


def covers(spans: list[tuple[int, int]], n_terms: int) -> float:
    """The worth of a text's minimal covers, from (position, term) of its asked words in order.

    A minimal cover is a stretch that holds every asked term while no shorter one inside it
    does. It is worth COVER over one more than the number of its words that are not asked for.
    """
    held: dict[int, int] = {}
    total, first = 0.0, 0
    for last, (position, term) in enumerate(spans):
        held[term] = held.get(term, 0) + 1
        if len(held) < n_terms:
            continue
        while held[spans[first][1]] > 1:
            held[spans[first][1]] -= 1
            first += 1
        total += COVER / (1 + position - spans[first][0] - (last - first))
        del held[spans[first][1]]
        first += 1
    return total


_RUN = re.compile(r"[a-z0-9_]+")


def postings(chunks: DataFrame, item: str = "doc_id", text: str = "text", asked: frozenset | None = None) -> DataFrame:
    """item, terms and, for each of them, its positions among the words of the text; of asked terms only, if given."""
    kind = dict(chunks.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            terms, places = [], []
            for body in batch.column(1).to_pylist():
                found: dict[str, list[int]] = {}
                for i, w in enumerate(_RUN.findall((body or "").lower())):
                    if len(w) > 2 and (asked is None or w in asked):
                        found.setdefault(w, []).append(i)
                terms.append(list(found))
                places.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string())), pa.array(places, pa.list_(pa.list_(pa.int32())))], names=[item, "terms", "places"])

    return chunks.select(item, text).mapInArrow(run, f"`{item}` {kind}, terms array<string>, places array<array<int>>")


def cover_density(chunks: DataFrame, queries: DataFrame, item: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query, item, density) of the chunks that hold all terms of a query.

    Texts are turned into postings of asked terms once. A text meets a query through the
    query's rarest term, by an equi-join; then its positions of the query's terms are swept
    once from left to right. A query without terms meets nothing.
    """
    asked = queries.select(query, token_set(F.col(query_text)).alias("asked")).where(F.size("asked") > 0)
    wanted = [r[0] for r in asked.select(F.explode("asked").alias("t")).distinct().limit(MOST_TERMS + 1).collect()]
    made = written(postings(chunks, item, text, frozenset(wanted) if len(wanted) <= MOST_TERMS else None), "postings")
    held = made.select(item, F.explode("terms").alias("term"))
    counts = held.groupBy("term").agg(F.count("*").alias("df"))
    rarest = asked.select(query, F.explode("asked").alias("term")).join(counts, "term", "left").groupBy(query).agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    near = held.join(rarest, "term").select(item, query).join(asked, query).join(made, item).where(F.size(F.array_except("asked", "terms")) == 0)
    kinds, qkind = dict(chunks.dtypes), dict(queries.dtypes)[query]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for terms, names, places in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                at = dict(zip(names, places))
                out.append(covers(sorted((p, k) for k, t in enumerate(terms) for p in at[t]), len(terms)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=[query, item, "density"])

    return near.select(query, item, "asked", "terms", "places").mapInArrow(sweep, f"`{query}` {qkind}, `{item}` {kinds[item]}, density double")


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int = 50, item: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """The k best chunks that hold all terms of a query, by cover density plus 0.3 times trigram likeness."""
    met_ = cover_density(chunks, queries, item, text, query, query_text)
    full = met_.join(chunks.select(F.col(item), F.col(text).alias("_text")), item).join(queries.select(query, F.col(query_text).alias("_asked")), query)
    score: Column = F.round(F.col("density") + 0.3 * trigram_similarity(F.col("_text"), F.col("_asked")), 6)
    return best(full.withColumn("score", score), k, query, item)
