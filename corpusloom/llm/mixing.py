"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, maybe_broadcast, numbered_copies

#: Weights by the rank of a source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows that one group of the first level holds on average, and residuals that one of the later levels joins.
ROWS_A_GROUP, FAN_IN = 4096, 256
WORD = r"[^\x20\x09-\x0D]+"
#: A copy probability this near to 0 or 1 counts as integral.
CLOSE = 1e-9
_MASK = (1 << 64) - 1


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, docs, target) from rows (source, size).

    Sources rank by code point, null last, and get the repeating weights. Targets share
    the total of all sizes by weight; one that passes ``most`` times its source's size
    stops there and its excess is shared by the others. With sources in the order of the
    share at which each stops, a source stops exactly if the share per weight that is left
    when its turn comes reaches its own limit; this one pass settles all of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("stops", F.col("limit") / F.col("w"))
    before = Window.orderBy("stops", "source").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("stops", "source").rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    per = per.withColumn("stopped", F.col("level") >= F.col("stops"))
    free = F.min(F.when(~F.col("stopped"), F.struct("stops", F.col("source").isNull().alias("last"), "source", "level"))).over(Window.partitionBy())
    return per.select("source", "source_size", "docs", F.when(F.col("stopped"), F.col("limit")).otherwise(F.col("w") * free["level"]).alias("target"))


def _draw(seed: int, a: int, b: int) -> float:
    """A number from 0 to 1 that depends only on the seed and the two ids."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB + 0x2545F4914F6CDD1D) & _MASK
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> 33
        x = x * m & _MASK
    x ^= x >> 33
    return (x >> 11) / (1 << 53)


def pivot(ids: list[int], sizes: list[int], ps: list[float], seed: int) -> tuple[list[float], int]:
    """Round the copy probabilities ps one after another against a carried row.

    Two rows exchange mass weighted by size, so the expected words stay as they are: one
    of the two moves that make a probability integral is drawn with the chance that keeps
    each probability's mean. Returns the probabilities, all integral but for the one at
    the returned index (-1: none is left over).
    """
    out, held = list(ps), -1
    for i, p in enumerate(ps):
        if p <= CLOSE or p >= 1 - CLOSE:
            out[i] = float(round(p))
            continue
        if held < 0:
            held = i
            continue
        q, wi, wj = out[held], sizes[held], sizes[i]
        # Words that can move from held to i, and from i to held.
        to_i, to_held = min(q * wi, (1 - p) * wj), min((1 - q) * wi, p * wj)
        moved = -to_i if _draw(seed, ids[held], ids[i]) * (to_i + to_held) < to_held else to_held
        q, p = q + moved / wi, p - moved / wj
        out[held], out[i] = q, p
        q_done, p_done = q <= CLOSE or q >= 1 - CLOSE, p <= CLOSE or p >= 1 - CLOSE
        if q_done:
            out[held] = float(round(q))
        if p_done:
            out[i] = float(round(p))
        held = -1 if q_done and p_done else i if q_done else held
    return out, held


def _round_groups(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by group; a group may go on in the next batch."""
        left: pd.DataFrame | None = None
        for batch in batches:
            pdf = batch if left is None else pd.concat([left, batch], ignore_index=True)
            if not len(pdf):
                continue
            group = pdf["grp"].to_numpy()
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            left = pdf.iloc[cut:]
            if cut:
                yield rounded(pdf.iloc[:cut])
        if left is not None:
            yield rounded(left)

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, ps, group = pdf["rid"].tolist(), pdf["size"].tolist(), pdf["p"].tolist(), pdf["grp"].to_numpy()
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        p, residual = [], np.zeros(len(group), dtype=bool)
        for a, b in zip(edges, edges[1:]):
            got, held = pivot(ids[a:b], sizes[a:b], ps[a:b], seed)
            p += got
            if held >= 0:
                residual[a + held] = True
        return pdf.assign(p=p, residual=residual)[["rid", "id", "size", "copy_no", "source_no", "bucket", "copies", "p", "residual"]]

    return run


_ROUNDED = "rid long, id long, size long, copy_no long, source_no long, bucket long, copies long, p double, residual boolean"


#: Rows of one source and size up to which those to turn are numbered; beyond, a share of their hashes is taken.
NUMBERED = 4096


def balanced(decided: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """decided rows, some of them decided the other way so that each source comes near its target.

    With a source e words over its target, rows that were rounded up are turned down, the
    shortest first, as long as their words are within e; with too few words, rows that were
    rounded down are turned up. What is left is less than one row of the next size, or no row
    is left to turn. Sizes are counted, so a window holds the distinct sizes of a source, and
    of one source and size NUMBERED rows at most.
    """
    taken = (F.col("copies") + F.col("p")) * F.col("size")
    off = decided.groupBy("source_no").agg(F.sum(taken).alias("words")).join(targets.select("source_no", "target"), "source_no").select("source_no", (F.col("words") - F.col("target")).alias("e"))
    off = materialize(off.where(F.abs("e") >= 1), "mix-off")
    can = F.col("open") & (F.col("size") > 0) & (F.col("size") <= F.abs("e")) & F.when(F.col("e") > 0, F.col("p") == 1).otherwise(F.col("p") == 0)
    may = decided.join(maybe_broadcast(off, off.count(), 48), "source_no").where(can)
    before = Window.partitionBy("source_no").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = may.groupBy("source_no", "size", "e").agg(F.count("*").alias("n"))
    room = F.abs("e") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0))
    turns = sizes.withColumn("m", F.least(F.col("n"), F.floor(room / F.col("size")))).where("m > 0").select("source_no", "size", "n", "m")
    turns = materialize(turns, "mix-turns")
    keys = ["source_no", "size", "id", "copy_no"]
    hit = may.select(*keys).join(maybe_broadcast(turns, turns.count(), 64), ["source_no", "size"]).withColumn("h", F.xxhash64(F.lit(seed + 2), "id", "copy_no"))
    share = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("m") / F.col("n")
    all_or_share = hit.where((F.col("m") == F.col("n")) | ((F.col("n") > NUMBERED) & share))
    few = hit.where((F.col("m") < F.col("n")) & (F.col("n") <= NUMBERED)).withColumn("r", F.row_number().over(Window.partitionBy("source_no", "size").orderBy("h", "id", "copy_no"))).where("r <= m")
    turned = materialize(all_or_share.select(*keys).unionByName(few.select(*keys)), "mix-turned").withColumn("turn", F.lit(True))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    both = decided.alias("d").join(maybe_broadcast(turned, turned.count(), 56).alias("t"), on, "left")
    return both.select(*[F.col(f"d.{c}").alias(c) for c in ("id", "size", "copy_no", "source_no", "copies")], F.when(F.col("turn"), 1 - F.col("d.p")).otherwise(F.col("d.p")).alias("p"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of each row that bring every source to its target.

    A source's target over its size is the number of copies of each of its rows: the whole
    part is taken as it is, the rest is a copy probability, rounded by ``pivot``. Sources
    are split into groups of about ROWS_A_GROUP rows by a hash of the row, so a hot source
    spreads over many tasks; each group leaves one row at most undecided, and those meet
    FAN_IN groups at a time, level by level, until one is left for a source. That one is
    drawn by its probability. A draw over a long text may leave a source far off its
    target, so short rows are then decided the other way, as ``balanced`` says: a source is
    off by less than the next of these rows, if there is one.

    Returns id, source, size (words of the text; null text: 0), source_size, target,
    copies, taken (copies times size) and copy_no, the row's number among rows of equal id,
    source and size. Rows without words take no part and get the whole copies only. Rows
    with a null id or null source count like others; equal rows are interchangeable. The
    same input gives the same copies, however it is partitioned. Of a very long text only
    its number of words goes on. An empty table gives no rows. Columns other than id, text
    and source are not read, whatever their names. Sources themselves are few: their
    targets are computed in one small table.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"))
    thin = materialize(numbered_copies(thin, ["id", "source", "size"]), "mix-sizes")
    targets = source_targets(thin.select("source", "size"), weights, most)
    targets = materialize(targets.withColumn("source_no", F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())), "mix-targets")
    facts = targets.agg(F.count("*"), F.max("docs")).first()
    n_sources, largest = facts[0], facts[1] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = targets.select(F.col("source").alias("s"), "source_size", "target", "source_no", F.least(rate, F.lit(float(most))).alias("rate"), F.ceil(F.col("docs") / ROWS_A_GROUP).alias("groups"))
    rows = thin.join(maybe_broadcast(wanted, n_sources, 256), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(F.col("rate") + F.lit(CLOSE)).cast("long")
    rows = rows.withColumn("copies", whole).withColumn("p", F.greatest(F.col("rate") - whole, F.lit(0.0))).withColumn("rid", F.xxhash64(F.lit(seed), "id", "size", "copy_no"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("rid", 7), F.col("groups")).cast("long"))
    open_ = rows.where("p > 0 and size > 0").select("rid", "id", "size", "copy_no", "source_no", "bucket", "copies", "p")

    def level(df: DataFrame, k: int) -> DataFrame:
        dealt = df.withColumn("grp", F.xxhash64("source_no", "bucket")).repartition("grp").sortWithinPartitions("grp", "source_no", "bucket", "rid", "id", "size", "copy_no")
        return materialize(dealt.mapInPandas(_round_groups(seed + k), _ROUNDED), f"mix-level{k}")

    done, k, groups = [], 0, max(1, -(-largest // ROWS_A_GROUP))
    while True:
        out = level(open_, k)
        done.append(out.where("not residual"))
        open_ = out.where("residual").select("rid", "id", "size", "copy_no", "source_no", F.floor(F.col("bucket") / FAN_IN).cast("long").alias("bucket"), "copies", "p")
        if groups == 1:
            break
        k, groups = k + 1, -(-groups // FAN_IN)
    coin = F.pmod(F.xxhash64(F.lit(seed + 1), "source_no"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = open_.withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0))
    cols = ["id", "size", "copy_no", "source_no", "copies"]
    decided = last.select(*cols, "p")
    for d in done:
        decided = decided.unionByName(d.select(*cols, "p"))
    decided = decided.withColumn("open", F.lit(True))
    idle = rows.where("not (p > 0 and size > 0)").select(*cols, F.lit(0.0).alias("p"), F.lit(False).alias("open"))
    settled = balanced(materialize(decided.unionByName(idle), "mix-decided"), targets, seed)
    named = targets.select("source", "source_no", "source_size", "target")
    out = settled.join(maybe_broadcast(named, n_sources, 256), "source_no")
    copies = F.col("copies") + F.col("p").cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "copy_no")
