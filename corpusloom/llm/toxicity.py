"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .langid import fold

#: Bound of the training sample: labelled rows of each class.
ROWS_A_CLASS = 2000
#: Words that the learned lexicon holds at most, and how much more often toxic rows must hold them.
LEXICON_WORDS, LEAST_LIFT, LEAST_SHARE = 256, 4.0, 0.03
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 80, 3, 32, 0.15, 5.0
#: Letters of a stem, the start that longer words share; ``*`` marks one in the lexicon.
STEMS = range(3, 8)
#: Words whose entry a worker keeps.
KEPT = 300_000
#: Every n-th row of the sample calibrates and does not train the trees.
CALIBRATE_EVERY = 4

# Plain insults, and words that address the reader.
INSULTS = "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless clown disgusting garbage filth fool ugly hate shut kill vermin".split()
SECOND_PERSON = frozenset("you your yours yourself u ur youre".split())
# Signs that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!|", "oieastasii")

FEATURES = ["lexicon_rate", "lexicon_hits", "lexicon_distinct", "lexicon_top", "insult_rate", "insult_distinct", "near_you", "you_rate", "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "obfuscated_rate", "obfuscated_hits", "words"]
_EDGE = " \t\r\n\v\f.,;:!?\"'()[]{}*#%&-_"
_MIXED = re.compile(r"[a-z][0-9@$!|*]+[a-z]|[0-9@$!|]+[a-z]{2,}|[a-z](?:[.\-_*][a-z]){2,}")
_CAPITALS, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_SIGNS = b"!?.,;:*#%&$@-_\"'()"


def plain_word(word: str) -> str:
    return word.strip(_EDGE)


def unmasked(word: str) -> str:
    """An obfuscated word as it reads: signs back to letters, separators out."""
    return re.sub(r"[^a-z]", "", word.translate(LEET))


def distinct_terms(text: str | None) -> set[str]:
    """Words of the text, and the stems of longer ones."""
    words = {p for w in set((text or "").lower().split()) if 2 < len(p := plain_word(w))}
    return words | {p[:k] + "*" for p in words for k in STEMS if k < len(p)}


def entry_of(word: str, lexicon: dict[str, float]) -> str | None:
    """The word's own entry in the lexicon, else that of its longest stem."""
    if word in lexicon:
        return word
    for k in reversed(STEMS):
        if k < len(word) and (stem := word[:k] + "*") in lexicon:
            return stem
    return None


class Lexicon(dict):
    """Entries with their weights, and what each word that was met is: its entry and kind."""

    def __init__(self, *a):
        super().__init__(*a)
        self.seen: dict[str, tuple[str, int]] = {}

    def look(self, w: str) -> tuple[str, int]:
        """kind: 1 in the lexicon, 2 second person, 4 plain insult, 8 obfuscated."""
        p = plain_word(w)
        kind = 2 * (p in SECOND_PERSON) + 4 * (p in _INSULTS)
        entry = entry_of(p, self)
        if not p.isalpha() and _MIXED.search(p):
            kind += 8
            q = unmasked(p)
            entry = entry or entry_of(q, self) or (q if q in _INSULTS else None)
        if entry:
            return entry, kind | 1
        return (p, kind) if kind else _PLAIN

    def __reduce__(self):
        return Lexicon, (dict(self),)


_PLAIN = ("", 0)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The FEATURES of a whole text. All are 0 for a text without words."""
    text = text or ""
    words = text.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    hits, insults, second, obfuscated, masked, shouted = [], [], [], 0, 0, 0
    known = lexicon.seen
    if len(known) > KEPT:
        known.clear()
    for i, w in enumerate(words):
        found = known.get(w)
        if found is None:
            found = known[w] = lexicon.look(w)
        if found is _PLAIN:
            continue
        p, kind = found
        if kind & 1:
            hits.append((i, p))
        if kind & 2:
            second.append(i)
        if kind & 4:
            insults.append(p)
        if kind & 8:
            obfuscated += 1
            masked += kind & 1
    near = 0.0
    if hits and second:
        at, mine = np.array(second), np.array([i for i, _ in hits])
        behind = np.searchsorted(at, mine).clip(1, len(at)) - 1  # both come in the order of the text
        near = 1.0 / (1.0 + float(np.minimum(np.abs(at[behind] - mine), np.abs(at[np.minimum(behind + 1, len(at) - 1)] - mine)).min()))
    raw = text.encode("utf-8", "replace")
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    weight = [lexicon.get(p, 1.0) for _, p in hits]
    return [sum(weight) / n, math.log1p(len(hits)), len({p for _, p in hits}), max(weight, default=0.0), len(insults) / n, len(set(insults)), near, len(second) / n, capitals / max(1, letters), shouted / n, signs / len(raw), raw.count(b"!") / len(raw), obfuscated / n, masked, math.log1p(n)]


_INSULTS = frozenset(INSULTS)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function closest to y, as (places, values) to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # value, weight, first place, last place
    for s, v, w in zip(score[order].tolist(), y[order].tolist(), weight[order].tolist()):
        blocks.append([v, w, s, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v1, w1, _, e1 = blocks.pop()
            v0, w0, s0, _ = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, s0, e1])
    x = np.array([p for b in blocks for p in (b[2], b[3])])
    return x, np.array([b[0] for b in blocks for _ in (0, 1)])


@dataclass
class Boosted:
    """Trees as arrays: of each inner node, in heap order, the feature and the largest value that goes left; of each leaf a step."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    places: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.places):
            return np.clip(np.full(len(x), self.base), 0, 1)
        return np.clip(np.interp(self.margin(x), self.places, self.values), 0, 1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Second-order boosting of the logistic loss over binned features, then isotonic calibration on rows kept apart.

    weight: how many rows of the whole table a row of the sample stands for.
    """
    inner = 2**DEPTH - 1
    none = np.zeros((0, inner))
    if not len(y) or y.min() == y.max():
        return Boosted(none.astype(int), none, np.zeros((0, inner + 1)), float(y[0]) if len(y) else 0.0, np.zeros(0), np.zeros(0))
    apart = np.arange(len(y)) % CALIBRATE_EVERY == 0
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), dtype=bool)
    tx, ty = x[~apart], y[~apart]
    edges = [np.unique(np.quantile(tx[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, tx[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    base = float(np.log(ty.mean() / (1 - ty.mean())))
    margin = np.full(len(ty), base)
    feats, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - ty, p * (1 - p)
        node = np.zeros(len(ty), dtype=np.int64)
        f, c = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = (1e-6, 0, -1)
            gs, hs = g[mine].sum(), h[mine].sum()
            for j, e in enumerate(edges):
                if not len(e) or not len(mine):
                    continue
                gl = np.cumsum(np.bincount(bins[mine, j], g[mine], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[mine, j], h[mine], len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < LEAST_LEAF / 20) | (hs - hl < LEAST_LEAF / 20)] = -1
                if gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            if best[2] >= 0:
                f[k], c[k] = best[1], edges[best[1]][best[2]]
            node[mine] = 2 * k + 1 + (tx[mine, f[k]] > c[k])
        leaf = np.zeros(inner + 1)
        for k in range(inner + 1):
            mine = node == k + inner
            leaf[k] = -RATE * g[mine].sum() / (h[mine].sum() + 1)
        margin += leaf[node - inner]
        feats.append(f), cuts.append(c), leaves.append(leaf)
    made = Boosted(np.array(feats), np.array(cuts), np.array(leaves), base, np.zeros(0), np.zeros(0))
    use = apart if apart.any() else np.ones(len(y), dtype=bool)
    made.places, made.values = isotonic(made.margin(x[use]), y[use], weight[use])
    return made


def learn_lexicon(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    """Words and stems with their log lift, from (word, toxic rows that hold it, clean rows that hold it)."""
    scored = []
    for word, t, c in rows:
        lift = ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
        if t >= max(3, LEAST_SHARE * n_toxic) and lift >= LEAST_LIFT:
            scored.append((math.log(lift) * math.sqrt(t), word, math.log(lift)))
    return Lexicon({w: v for _, w, v in sorted(scored, reverse=True)[:LEXICON_WORDS]})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in distinct_terms(text):
                counts.setdefault(w, [0, 0])[1 - toxic] += 1
    both = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["word", "toxic", "clean"])


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "weight", "h", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS_A_CLASS) -> tuple[Lexicon, Boosted]:
    """The lexicon and the model, from at most about ``rows`` labelled rows of each class whose fold is not 0.

    The sample is spread by a hash of the id; its ids are few enough to broadcast, so only
    its texts are read out of the documents, and words and features are counted in tasks.
    A row that is labelled more than once has its largest label.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("toxic")).where(F.col("i").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("i")) != 0)).groupBy("i").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    spread = 1 << 30
    rate = {k: min(1.0, rows / max(1, counts.get(k, 0))) for k in (0, 1)}
    h = F.pmod(F.xxhash64("i", F.lit(3)), F.lit(spread))
    picked = known.withColumn("h", h).where(F.col("h") < F.when(F.col("toxic") == 1, F.lit(int(rate[1] * spread))).otherwise(F.lit(int(rate[0] * spread))))
    picked = picked.orderBy("h").limit(4 * rows)
    sample = materialize(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(picked), "i").select("t", "toxic", F.when(F.col("toxic") == 1, 1 / rate[1]).otherwise(1 / rate[0]).alias("weight"), "h"), "toxic-sample")
    words = sample.select("t", "toxic").distinct().mapInArrow(_count_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    per = {r.toxic: r.n for r in sample.select("t", "toxic").distinct().groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # Only words that can pass the lift come to the driver, the most frequent first.
    likely = words.where((F.col("toxic") >= 3) & ((F.col("toxic") + 0.5) * (per.get(0, 0) + 1) >= LEAST_LIFT * (F.col("clean") + 0.5) * (per.get(1, 0) + 1))).orderBy(F.desc("toxic"), "word").limit(16 * LEXICON_WORDS)
    lexicon = learn_lexicon([tuple(r) for r in likely.collect()], per.get(1, 0), per.get(0, 0))
    out = sample.mapInArrow(_feature_rows(lexicon), "toxic int, weight double, h long, x array<double>").orderBy("h", "toxic", "x").collect()
    x = np.array([r.x for r in out]).reshape(-1, len(FEATURES))
    return lexicon, fit(x, np.array([r.toxic for r in out], dtype=float), np.array([r.weight for r in out], dtype=float))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row, from its whole text alone.

    Features are counted in one pass over a text of any length. An empty table gives no
    rows. Of equal scores of the sample one block of the calibration is made, and equal
    lifts of words rank by the word, so ties do not hang on the order of rows. Columns other
    than id and text are not read, whatever their names.

    Null and empty texts have features of 0 and get the score of those. Without labels, or
    with labels of one class only, every score is that class (0 without any). Equal texts
    get equal scores; repeated rows and null ids pass as they are.
    """
    lexicon, model = train(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, model))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, made = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([features(t, words) for t in part.column(0).to_pylist()])
                score = made.score(x)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(text_col), F.col(id_col), (fold(F.col(id_col)) == 0)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
