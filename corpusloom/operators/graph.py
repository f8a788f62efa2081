"""Edges between symbols: resolution, reversal, usages, invariants, chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (src, module, name) with dst: the module's last symbol of that name, else the first of all.

    symbols: (symbol_id, module, name, ordinal). Both indexes are aggregates by key, so a
    common name moves one row a task.
    """
    local = symbols.groupBy("module", "name").agg(F.max_by("symbol_id", "ordinal").alias("l"))
    globe = symbols.groupBy("name").agg(F.min_by("symbol_id", "ordinal").alias("g"))
    return refs.join(local, ["module", "name"], "left").join(globe, "name", "left").select("src", "module", "name", F.coalesce("l", "g").alias("dst"))


def used_by(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """dst, users (sorted, distinct) and their number."""
    return edges.groupBy(dst).agg(F.sort_array(F.collect_set(src)).alias("users")).withColumn("n_users", F.size("users").cast("long"))


def top_neighbours(edges: DataFrame, seeds: DataFrame, most: int = 12, src: str = "src", dst: str = "dst") -> DataFrame:
    """Neighbours of the seeds, those with the fewest edges into them first, at most ``most`` each."""
    central = edges.groupBy(dst).agg(F.count("*").alias("centrality"))
    near = edges.join(seeds.select(F.col("seed_id")), F.col(src) == F.col("seed_id")).select("seed_id", dst, "relation").distinct().join(central, dst)
    order = Window.partitionBy("seed_id").orderBy("centrality", dst, "relation")
    return near.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def edge_counts(consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """name, consumers, producers and the contract links between them, from counts by name and repository alone."""
    per = lambda df, n: df.groupBy(F.lower("name").alias("name"), "repo").agg(F.count("*").alias(n))
    both = per(consumers, "c").join(per(producers, "p"), ["name", "repo"], "full").fillna(0, ["c", "p"])
    out = both.groupBy("name").agg(F.sum("c").alias("consumers"), F.sum("p").alias("producers"), F.sum(F.col("c") * F.col("p")).alias("own"))
    return out.where("consumers > 0 and producers > 0").select("name", "consumers", "producers", (F.col("consumers") * F.col("producers") - F.col("own")).alias("edges"))


def pending(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """References that no edge answers."""
    return refs.join(edges.select("src").distinct(), "src", "left_anti")


def usages(direct: DataFrame, cross: DataFrame, target: str = "dst") -> DataFrame:
    """Direct and cross-repository usages in one table, with each target's total."""
    both = direct.select("src", target, F.lit("direct").alias("via")).unionByName(cross.select("src", target, F.lit("cross-repo").alias("via")))
    return both.join(both.groupBy(target).agg(F.count("*").alias("total")), target)


def dangling(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return rows.join(owners.select(key).distinct(), key, "left_anti")


def coverage(symbols: DataFrame, chunks: DataFrame, least: float = 0.4) -> DataFrame:
    """Modules whose distinct chunked symbols are fewer than ``least`` of their symbols."""
    have = symbols.groupBy("module").agg(F.count("*").alias("n_symbols"))
    done = chunks.groupBy("module").agg(F.countDistinct("symbol_id").alias("n_chunked"))
    x = have.join(done, "module", "left").withColumn("n_chunked", F.coalesce("n_chunked", F.lit(0)))
    return x.where(F.col("n_chunked") < least * F.col("n_symbols"))


def longest_prefix(items: DataFrame, prefixes: DataFrame, path: str, prefix: str) -> DataFrame:
    """items with the longest prefix that is a directory above the path; ``.`` is above all.

    Ancestors are listed for each path, so this is an equi-join whatever the prefixes.
    """
    parts = F.split(F.col(path), "/")
    ups = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    near = items.select(path).distinct().select(path, F.posexplode(ups).alias("depth", "up")).join(prefixes.select(F.col(prefix).alias("up")).distinct(), "up").groupBy(path).agg(F.max_by("up", "depth").alias(prefix))
    return items.join(near, path, "left")


def chain(events: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """group, order, n, prev_hash and hash: in each group every hash is over the one before and the row's fields.

    Links of a chain hang on each other, so a group's rows stream through one task in their
    order, which carries one hash from row to row: time grows with the rows, and a chain of
    any length needs no memory of its own. Of rows with equal order the smaller line is first.
    """
    line = F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    kinds = dict(events.dtypes)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, last = None, 0, ""
        for batch in batches:
            numbers, before, hashes = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n == 0 or name != now:
                    now, n, last = name, 0, ""
                n += 1
                numbers.append(n)
                before.append(last)
                last = hashlib.sha256(f"{last}\n{text}".encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[group, order, "n", "prev_hash", "hash"])

    dealt = events.select(group, order, line.alias("_line")).repartition(group).sortWithinPartitions(group, order, "_line")
    return dealt.mapInArrow(link, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, n long, prev_hash string, hash string")


def chain_breaks(events: DataFrame, group: str = "org", order: str = "seq") -> DataFrame:
    """Events (prev_hash, hash) whose prev_hash is not the hash before."""
    w = Window.partitionBy(group).orderBy(order)
    return events.withColumn("_before", F.lag("hash").over(w)).where(F.col("_before").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("_before"))).drop("_before")
