"""Retrieval evaluation: metrics by stratum, percentiles, paired bootstrap, detectable effect, gate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPLICATES, LEAST_STRATUM, WORST_DELTA, WORST_FALSE = 2000, 30, 0.02, 0.10


def recall_at(k: int, expected: str = "expected", retrieved: str = "retrieved") -> Column:
    n = F.size(expected)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(expected, F.slice(retrieved, 1, k))) / n)


def precision_at(k: int, expected: str = "expected", retrieved: str = "retrieved") -> Column:
    top = F.slice(retrieved, 1, k)
    return F.when(F.size(top) == 0, F.lit(0.0)).otherwise(F.size(F.filter(top, lambda x: F.array_contains(expected, x))) / F.size(top))


def reciprocal_rank(expected: str = "expected", retrieved: str = "retrieved") -> Column:
    hit = F.array_position(F.transform(retrieved, lambda x: F.array_contains(expected, x)), True)
    return F.when(hit == 0, F.lit(0.0)).otherwise(1.0 / hit)


def percentiles_at(rows: DataFrame, group: str, value: str, ps: dict[str, float]) -> DataFrame:
    """group and, for each name, the sorted value at floor(p n), at most the last. Not interpolated.

    Values are counted with map-side combine, and running counts over the distinct values say
    which one stands at a place, so a group's values are never one array.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("_all")), F.col("_all") - 1)
    return run.groupBy(group).agg(*[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(name) for name, p in ps.items()])


def summary(results: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Metrics of each stratum over rows (stratum, expected, retrieved, abstained, latency_ms)."""
    answerable = F.size("expected") > 0
    mean = lambda m: F.round(F.coalesce(F.avg(F.when(answerable, m)), F.lit(0.0)), 6)
    out = results.groupBy(stratum).agg(
        F.count("*").alias("n"),
        mean(recall_at(10)).alias("recall_10"),
        mean(reciprocal_rank()).alias("mrr"),
        mean(precision_at(5)).alias("precision_5"),
        F.round(F.avg(F.when(~answerable, (~F.col("abstained")).cast("double"))), 6).alias("false_answer_rate"),
        F.round(F.avg(F.col("abstained").cast("double")), 6).alias("abstention_rate"),
    )
    return out.join(percentiles_at(results, stratum, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), stratum, "left")


def paired_bootstrap(pairs: DataFrame, replicates: int = REPLICATES, seed: int = 0, stratum: str = "stratum") -> DataFrame:
    """95% interval of the mean difference of (stratum, item_id, base, cand) rows.

    Each item is drawn a number of times in each replicate: a Poisson number of mean 1, by a
    hash of (seed, replicate, item), so reruns agree and no item needs a number or another
    item. The mean of a replicate is over the draws it made. Sums of all replicates are
    added up as one array a stratum and task, so only those are shuffled.
    """
    d = F.col("cand") - F.col("base")
    sizes = pairs.groupBy(stratum).agg(F.count("*").alias("n"), F.avg("base").alias("baseline"), F.avg("cand").alias("candidate"))
    kind = dict(pairs.dtypes)[stratum]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for name, part in pdf.groupby(stratum, dropna=False, sort=False):
                at = held.setdefault(None if pd.isna(name) else name, np.zeros((2, replicates)))
                for a in range(0, len(part), 512):
                    times = poisson_draws(part["h"].to_numpy()[a : a + 512], replicates, seed)
                    at[0] += times.sum(0)
                    at[1] += part["d"].to_numpy()[a : a + 512] @ times
        rows = [(name, r, x[0][r], x[1][r]) for name, x in held.items() for r in range(replicates)]
        yield pd.DataFrame(rows, columns=[stratum, "r", "times", "total"])

    drawn = pairs.select(stratum, F.xxhash64("item_id").alias("h"), d.cast("double").alias("d")).mapInPandas(sums, f"`{stratum}` {kind}, r int, times double, total double")
    means = drawn.groupBy(stratum, "r").agg(F.sum("times").alias("times"), F.round(F.sum("total"), 9).alias("total")).select(stratum, F.when(F.col("times") > 0, F.col("total") / F.col("times")).otherwise(F.lit(0.0)).alias("m"))
    ends = percentiles_at(means, stratum, "m", {"low": 0.025, "high": 0.975})
    out = sizes.join(ends, stratum)
    sure = ((F.col("low") > 0) & (F.col("high") > 0)) | ((F.col("low") < 0) & (F.col("high") < 0))
    r6 = lambda c: F.round(c, 6)
    return out.select(stratum, "n", r6("baseline").alias("baseline"), r6("candidate").alias("candidate"), r6(F.col("candidate") - F.col("baseline")).alias("delta"), r6("low").alias("low"), r6("high").alias("high"), sure.alias("significant"))


#: P(number of draws > k) of a Poisson number of mean 1, for k = 0, 1, ...
_OVER = 1 - np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])


def poisson_draws(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Times that each item is drawn in each replicate (items by replicates), from the item's hash."""
    x = hashes.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return (u[:, :, None] < _OVER).sum(2).astype(np.float64) if len(hashes) else np.zeros((0, replicates))


def detectable_effect(results: DataFrame, metric: Column, stratum: str = "stratum") -> DataFrame:
    """2.8 standard errors of the metric; 1 with fewer than two items."""
    return results.groupBy(stratum).agg(F.count("*").alias("n"), F.round(F.when(F.count("*") < 2, F.lit(1.0)).otherwise(2.8 * F.stddev_samp(metric) / F.sqrt(F.count("*"))), 6).alias("mde"))


#: Latency at the 95th percentile beyond which a stratum is warned of, and the stratum of questions without an answer.
SLOW_MS, UNANSWERABLE = 2500, "unanswerable"
METRICS = {"recall@10": lambda: recall_at(10), "mrr": reciprocal_rank}


def compared(baseline: DataFrame, candidate: DataFrame, item: str = "item_id", stratum: str = "stratum") -> DataFrame:
    """(stratum, metric, n, baseline, candidate, delta, low, high, significant) of both gated metrics.

    Rows of the two runs (item, stratum, expected, retrieved) meet by item and stratum.
    """
    side = lambda df, name: df.select(item, stratum, F.explode(F.create_map(*[x for m, f in METRICS.items() for x in (F.lit(m), f())])).alias("metric", name))
    both = side(baseline, "base").join(side(candidate, "cand"), [item, stratum, "metric"])
    out = paired_bootstrap(both.select(F.to_json(F.struct(stratum, "metric")).alias("of"), F.col(item).alias("item_id"), "base", "cand"), stratum="of")
    kind = dict(baseline.dtypes)[stratum]
    named = F.from_json("of", f"`{stratum}` {kind}, metric string")
    return out.select(named[stratum].alias(stratum), named["metric"].alias("metric"), *[c for c in out.columns if c != "of"])


def findings(comparisons: DataFrame, strata: DataFrame, stratum: str = "stratum") -> DataFrame:
    """(level, stratum, metric, rule, value): every failure and warning of a candidate.

    Failures: a metric of a stratum of LEAST_STRATUM items that is surely worse by more than
    WORST_DELTA; false answers beyond WORST_FALSE in the unanswerable stratum. Warnings: a
    smaller stratum, whose metrics never fail; no unanswerable stratum, or one without a
    rate; a stratum that is slow at its 95th percentile.
    """
    none = F.lit(None).cast("string")
    row = lambda level, metric, rule, value: [F.lit(level).alias("level"), F.col(stratum).cast("string").alias("stratum"), metric.alias("metric"), F.lit(rule).alias("rule"), value.cast("double").alias("value")]
    small = comparisons.where(F.col("n") < LEAST_STRATUM).select(*row("warning", F.col("metric"), "few-items", F.col("n")))
    worse = comparisons.where((F.col("n") >= LEAST_STRATUM) & F.col("significant") & (F.col("delta") < -WORST_DELTA)).select(*row("failure", F.col("metric"), "regressed", F.col("delta")))
    asked = strata.where(F.col(stratum) == UNANSWERABLE)
    wrong = asked.where(F.col("false_answer_rate") > WORST_FALSE).select(*row("failure", none, "false-answers", F.col("false_answer_rate")))
    unmeasured = asked.agg(F.count("false_answer_rate").alias("k")).where("k = 0").select(F.lit("warning").alias("level"), none.alias("stratum"), none.alias("metric"), F.lit("no-unanswerable").alias("rule"), F.lit(None).cast("double").alias("value"))
    slow = strata.where(F.col("p95_ms") > SLOW_MS).select(*row("warning", none, "slow", F.col("p95_ms")))
    return small.unionByName(worse).unionByName(wrong).unionByName(unmeasured).unionByName(slow)


def gate(comparisons: DataFrame, strata: DataFrame, stratum: str = "stratum") -> DataFrame:
    """One row: passed, n_failures, n_warnings. A candidate passes without failures; warnings do not stop it."""
    found = findings(comparisons, strata, stratum)
    count = lambda level: F.count_if(F.col("level") == level)
    return found.agg((count("failure") == 0).alias("passed"), count("failure").alias("n_failures"), count("warning").alias("n_warnings"))
