"""Periodic runs of words by Crochemore's partition refinement."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

#: A run is at least so many words long, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 24, 3
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that a task returns at once.
BATCH_CHARS = 4 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def squares(word: list[int], most: int) -> dict[int, list[int]]:
    """Starts of the squares of each primitive period up to ``most``, in order, by period.

    Positions are in one class if the factors of length k from them are equal. A class
    is split, from k to k + 1, by the classes of the next positions; of the children of a
    class all but the largest split others in the next step, so that a position is moved
    log n times at most. Members of a class are linked in order, and each new pair of
    neighbours waits under its distance: those still neighbours at distance k when the
    factors have length k are the squares. The root of a square found so is never a power
    of a shorter word, as its class would have a member in between.
    """
    n = len(word)
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(word):
        groups.setdefault(w, []).append(i)
    of, after, before = [0] * n, [-1] * n, [-1] * n
    size: list[int] = []
    head: list[int] = []
    waiting: dict[int, list[int]] = {}
    for c, group in enumerate(groups.values()):
        size.append(len(group))
        head.append(group[0])
        last = -1
        for i in group:
            of[i] = c
            before[i] = last
            if last >= 0:
                after[last] = i
                if i - last <= most:
                    waiting.setdefault(i - last, []).append(last)
            last = i
    # The place behind the last word is a class of its own; the largest class splits no others.
    small = [[n], *sorted(groups.values(), key=len)[:-1]]
    found: dict[int, list[int]] = {}
    k = 1
    while k <= most and small:
        hit = sorted({p for p in waiting.pop(k, ()) if after[p] == p + k})
        if hit:
            found[k] = hit
        children: dict[int, list[list[int]]] = {}
        for splitter in small:
            parts: dict[int, list[int]] = {}
            for j in splitter:
                if j and size[of[j - 1]] > 1:
                    parts.setdefault(of[j - 1], []).append(j - 1)
            for c, part in parts.items():
                if len(part) == size[c]:
                    continue  # what is left of the class stays together and keeps its number
                fresh = len(size)
                size.append(len(part))
                head.append(part[0])
                size[c] -= len(part)
                last = -1
                for i in part:
                    p, q = before[i], after[i]
                    if p >= 0:
                        after[p] = q
                    else:
                        head[c] = q
                    if q >= 0:
                        before[q] = p
                        if p >= 0 and k < q - p <= most:
                            waiting.setdefault(q - p, []).append(p)
                    of[i], before[i], after[i] = fresh, last, -1
                    if last >= 0:
                        after[last] = i
                        if k < i - last <= most:
                            waiting.setdefault(i - last, []).append(last)
                    last = i
                children.setdefault(c, []).append(part)
        small = []
        for c, parts_of in children.items():
            largest = max(parts_of, key=len)
            if len(largest) <= size[c]:
                small += parts_of
                continue
            small += [x for x in parts_of if x is not largest]
            rest, i = [], head[c]
            while i >= 0:
                rest.append(i)
                i = after[i]
            small.append(rest)
        k += 1
    return found


def runs_of(words: list, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    Squares of one period that start at consecutive places are one run. A word of a run
    occurs as often as the run has whole periods, so rarer words cut the text, and each
    stretch between them is refined alone.
    """
    often = Counter(words)
    out: list[tuple[int, int, int]] = []
    n, at = len(words), 0
    while at < n:
        if often[words[at]] < periods:
            at += 1
            continue
        end = at + 1
        while end < n and often[words[end]] >= periods:
            end += 1
        if end - at >= least:
            number: dict = {}
            part = [number.setdefault(w, len(number)) for w in words[at:end]]
            for q, starts in squares(part, len(part) // periods).items():
                first = last = starts[0]
                for s in [*starts[1:], len(part) + 1]:
                    if s == last + 1:
                        last = s
                        continue
                    length = last - first + 2 * q
                    if length >= least and length >= periods * q:
                        out.append((at + first, length, q))
                    first = last = s
        at = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    edge = [0] * (len(words) + 1)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    out, inside = [], 0
    for w, e in zip(words, edge):
        inside += e
        if not inside:
            out.append(w)
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row.

    Words are what lies between spaces and the bytes 9 to 13. A run is a stretch of words
    with smallest period q, at least ``least`` words and ``periods`` times q long, that
    reaches as far to both sides as the period holds. The collapsed text is the words that
    no run holds behind its first q words, joined by one space. Of equal stretches every
    one is a run. A null or empty text has no words, no runs and an empty collapsed text;
    null ids and repeated rows pass as they are, and an empty table gives no rows. A text
    of any length is refined whole, in time n log n and memory that grows with it. Columns
    other than id and text are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, chars = 0, 0
            counts, found, left = [], [], []
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                rs = runs_of(words, least, periods)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in rs])
                left.append(b" ".join(collapse(words, rs)).decode("utf-8", "surrogatepass"))
                chars += len(left[-1])
                if chars >= BATCH_CHARS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(left, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])
                    start, chars = i + 1, 0
                    counts, found, left = [], [], []

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, id and text only, with the end of every tenth text, by a hash of its id, made periodic.

    With h the crc32 of the decimal id and g = h div 10, where h is divisible by 10 word i from
    a = g mod n on becomes word a + (i - a) mod p of the text as it was, with
    p = 1 + (n - a) div (3 + g mod 8). Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    x = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), h.alias("_h"))
    x = x.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("_text", F.lit(f"({WORD})"))))
    x = x.withColumns({"_n": F.nullif(F.size("_w").cast("long"), F.lit(0).cast("long")), "_g": F.expr("_h div 10")})
    x = x.withColumn("_a", F.col("_g") % F.col("_n"))
    x = x.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    periodic = F.expr("array_join(transform(sequence(0L, _n - 1), i -> element_at(_w, CAST(IF(i >= _a, _a + (i - _a) % _p, i) AS INT) + 1)), ' ')")
    return x.select(F.col("_id").alias(id_col), F.when(F.col("_n") > 0, periodic).otherwise(F.col("_text")).alias(text_col))


def longest_by_period(runs: Column) -> Column:
    """Of the runs the one with the greatest length over period, compared without rounding; the first of equal ones."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a)))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of what ``periodic_runs`` returns: n_runs, the best run and its exponent, and digests of runs and collapsed text."""
    x = found.withColumn("_best", longest_by_period(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = [F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")]
    return x.select(id_col, F.size("runs").cast("long").alias("n_runs"), *best, F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words")
