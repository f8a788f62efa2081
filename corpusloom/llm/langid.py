"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import small_batches, sole_owner

#: Bytes of a window, windows that a task labels at once, units of each direction.
WINDOW, BATCH, UNITS = 128, 1024, 8
#: Bound of the training sample: rows of each language and rows in all; windows that training takes from the rows of a language, and characters of a window.
ROWS_A_LANGUAGE, ROWS_IN_ALL, PIECES_A_LANGUAGE, CHARS_A_PIECE = 250, 20_000, 6000, 160
STEPS, TRAIN_WINDOW, TRAIN_BATCH, RATE = 350, 64, 96, 0.02
UNDETERMINED = "und"


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out of training."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 5


@dataclass
class ByteBiGru:
    """Weights of both directions (axis 0): byte inputs, recurrence, and the label layer.

    A direction's state moves by h += z * (c - h), where z is its gate and c its candidate,
    both from the byte and the state. The gate is 0.5 + 0.5 * tanh, a logistic of twice the
    argument, so that one tanh serves both.
    """

    labels: list[str]
    w: np.ndarray  # 2, 256, 2 * units
    u: np.ndarray  # 2, units, 2 * units
    v: np.ndarray  # 2 * units, labels
    b: np.ndarray  # labels

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> ByteBiGru:
        n = UNITS
        draw = lambda s, *shape: (rng.standard_normal(shape) * s).astype(np.float32)
        return cls(labels, draw(0.3, 2, 256, 2 * n), draw(0.5 / n**0.5, 2, n, 2 * n), draw(0.3, 2 * n, len(labels)), np.zeros(len(labels), np.float32))

    def states(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x: windows by bytes. States before each step, gates and candidates, and the states after (steps, 2, windows, units)."""
        m, steps = x.shape
        n = self.u.shape[1]
        fed = np.stack([x.T, x.T[::-1]])
        h = np.zeros((2, m, n), np.float32)
        acts, after = np.empty((steps, 2, m, 2 * n), np.float32), np.empty((steps, 2, m, n), np.float32)
        for t in range(steps):
            a = acts[t]
            np.matmul(h, self.u, out=a)
            a[0] += self.w[0][fed[0, t]]
            a[1] += self.w[1][fed[1, t]]
            np.tanh(a, out=a)
            z = 0.5 + 0.5 * a[..., :n]
            h = h + z * (a[..., n:] - h)
            after[t] = h
        return acts, after, fed

    def _probabilities(self, after: np.ndarray) -> np.ndarray:
        """Label probabilities by step, window and label. States lie within -1 and 1, so the logits need no shift before exp."""
        n = self.u.shape[1]
        p = np.matmul(after[:, 0], self.v[:n])
        p += np.matmul(after[:, 1], self.v[n:])[::-1]
        p += self.b
        np.exp(p, out=p)
        p /= p @ np.ones((len(self.labels), 1), np.float32)
        return p

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every position of every window: steps, windows, labels.

        The same steps as in states(), with gates and candidates in arrays of their own.
        """
        m, steps = x.shape
        n = self.u.shape[1]
        wz, wc = np.ascontiguousarray(self.w[..., :n]), np.ascontiguousarray(self.w[..., n:])
        uz, uc = np.ascontiguousarray(self.u[..., :n]), np.ascontiguousarray(self.u[..., n:])
        h = np.zeros((2, m, n), np.float32)
        z, c, fed = np.empty_like(h), np.empty_like(h), np.empty((m, n), np.float32)
        after = np.empty((steps, 2, m, n), np.float32)
        cols = np.ascontiguousarray(x.T).astype(np.intp)
        for t in range(steps):
            for act, u, w in ((z, uz, wz), (c, uc, wc)):
                np.matmul(h, u, out=act)
                for k, col in ((0, cols[t]), (1, cols[steps - 1 - t])):
                    w[k].take(col, axis=0, out=fed, mode="clip")
                    act[k] += fed
                np.tanh(act, out=act)
            z += 1
            z *= 0.5
            c -= h
            c *= z
            h = np.add(h, c, out=after[t])
        return self._probabilities(after)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss over all positions, and its gradients by backpropagation through time."""
        m, steps = x.shape
        n = self.u.shape[1]
        acts, after, fed = self.states(x)
        p = self._probabilities(after)
        loss = float(-np.log(p[:, np.arange(m), y] + 1e-9).mean())
        p[:, np.arange(m), y] -= 1
        d = (p / (m * steps)).astype(np.float32)
        both = np.concatenate([after[:, 0], after[::-1, 1]], axis=-1)
        dv = np.tensordot(both, d, axes=([0, 1], [0, 1]))
        back = d @ self.v.T
        outer = np.stack([back[..., :n], back[::-1, :, n:]], axis=1)  # by step of each direction
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        dh = np.zeros((2, m, n), np.float32)
        ut = self.u.transpose(0, 2, 1)
        zero = np.zeros((2, m, n), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += outer[t]
            a, before = acts[t], after[t - 1] if t else zero
            g, c = a[..., :n], a[..., n:]
            z = 0.5 + 0.5 * g
            da = np.concatenate([dh * (c - before) * 0.5 * (1 - g * g), dh * z * (1 - c * c)], axis=-1)
            du += before.transpose(0, 2, 1) @ da
            for k in (0, 1):
                np.add.at(dw[k], fed[k, t], da[k])
            dh = dh * (1 - z) + da @ ut
        return loss, [dw, du, dv, d.sum((0, 1))]


def train(samples: list[tuple[str, str]], seed: int = 7) -> ByteBiGru:
    """Fit to (text, label) rows: random windows, some of them short, labels in equal shares, Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    labels = sorted({x for _, x in samples})
    pools = [[np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t, x in samples if x == name] for name in labels]
    net = ByteBiGru.fresh(labels, rng)
    params = [net.w, net.u, net.v, net.b]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, (STEPS if len(labels) > 1 else 1) + 1):
        x, y = np.full((TRAIN_BATCH, TRAIN_WINDOW), 32, np.uint8), rng.integers(len(labels), size=TRAIN_BATCH)
        for i, k in enumerate(y):
            raw = pools[k][rng.integers(len(pools[k]))]
            at = rng.integers(max(1, len(raw) - TRAIN_WINDOW + 1))
            # Every fourth window ends early, so that the spaces after a short text are known.
            part = raw[at : at + (TRAIN_WINDOW if i % 4 else int(rng.integers(4, TRAIN_WINDOW)))]
            x[i, : len(part)] = part
        _, grads = net.gradients(x, y)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = RATE * (1 - step / (STEPS + 1)) * min(1, 1 / max(norm, 1e-9))
        for p, g, a, b in zip(params, grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def _windows(raw: bytes) -> tuple[np.ndarray, int]:
    """Whole windows of the bytes, the last filled up with spaces, and its true length."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW), len(raw) - (n - 1) * WINDOW


def pooled(net: ByteBiGru, texts: list[str]) -> np.ndarray:
    """Mean of the label probabilities over all bytes of each text. Windows go through in batches of one size."""
    out = np.zeros((len(texts), len(net.labels)))
    lengths = np.zeros(len(texts))
    held, owner, size = [], [], 0
    true: list[int] = []

    def flush() -> None:
        nonlocal held, owner, true, size
        x, who, n_true = np.concatenate(held), np.array(owner), np.array(true)
        for at in range(0, len(x), BATCH):
            part = x[at : at + BATCH]
            full = part if len(part) == BATCH else np.concatenate([part, np.full((BATCH - len(part), WINDOW), 32, np.uint8)])
            p = net.label(full)[:, : len(part)]
            short = np.flatnonzero(n_true[at : at + BATCH] < WINDOW)
            for k in short:
                p[n_true[at + k] :, k] = 0
            np.add.at(out, who[at : at + BATCH], p.sum(0, dtype=np.float64))
        held, owner, true, size = [], [], [], 0

    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        lengths[i] = len(raw)
        w, last = _windows(raw)
        for at in range(0, len(w), BATCH):  # a very long text is labelled piece by piece
            part = w[at : at + BATCH]
            held.append(part)
            owner += [i] * len(part)
            true += [WINDOW] * len(part)
            size += len(part)
            if at + BATCH >= len(w):
                true[-1] = last
            if size >= 2 * BATCH:
                # keep batches full: what is over goes on to the next flush
                x = np.concatenate(held)
                cut = size // BATCH * BATCH
                rest, r_owner, r_true = x[cut:], owner[cut:], true[cut:]
                held, owner, true = [x[:cut]], owner[:cut], true[:cut]
                flush()
                if len(rest):
                    held, owner, true, size = [rest], r_owner, r_true, len(rest)
    if size:
        flush()
    return out / np.maximum(lengths, 1)[:, None]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = ROWS_A_LANGUAGE, most: int = ROWS_IN_ALL, pieces: int = PIECES_A_LANGUAGE, chars: int = CHARS_A_PIECE) -> list[tuple[str, str]]:
    """(piece of text, language) from at most ``rows`` rows of each language and ``most`` in all, spread by a hash of the id.

    The tasks cut the rows' whole texts into pieces, and training draws ``pieces`` of a
    language's pieces by their hashes: every place of every text is as likely as any other,
    whatever the text's length, and the driver holds a bounded number of characters.
    """
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where((fold(F.col("i")) != 0) & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    rows = max(1, min(rows, most // len(counts)))
    spread = 1 << 30
    h = F.pmod(F.xxhash64("i"), F.lit(spread))
    bound = F.lit(0)
    for name, n in counts.items():
        bound = F.when(F.col("l") == name, F.lit(min(spread, int(spread * (2 * rows / n))))).otherwise(bound)
    order = Window.partitionBy("l").orderBy("h", "i")
    picked = known.withColumn("h", h).where(F.col("h") < bound).withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows)
    starts = F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1)), F.lit(chars))
    each = picked.select("l", "i", F.explode(starts).alias("at"), "t").select("l", "i", "at", F.col("t").substr(F.col("at"), F.lit(chars)).alias("t"))
    each = each.where(F.col("t").rlike(r"\p{L}"))
    drawn = each.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i", "at"), "t"))).where(F.col("r") <= pieces)
    return [(r.t, r.l) for r in drawn.select("l", "r", "t").orderBy("l", "r").collect()]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """id, held_out, lang_pred and score of every row, and the columns named in carry.

    The network learns from a bounded sample of rows with a language whose crc32(id) mod 5
    is not 0. It labels every byte of every text, in windows of WINDOW bytes that go
    through both directions; a document's probabilities are the means over its bytes, its
    label the most probable, its score that label's probability. A text that is null or
    has no letter is ``und`` with score 0, as is any text if there is nothing to learn
    from. Equal texts get equal results; repeated rows and null ids pass as they are. A very
    long text is labelled piece by piece, all of it. Of equally probable labels the first by
    code point is taken. An empty table gives no rows. Columns that are not named in carry
    are not returned, whatever their names.
    """
    sample = training_sample(docs, id_col, text_col, lang_col)
    sc = docs.sparkSession.sparkContext
    net = sc.broadcast(train(sample) if sample else None)
    carry = carry or []
    small_batches(docs.sparkSession)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    # A text that is carried goes to the worker once, as the carried column.
    text_at = 3 + carry.index(text_col) if text_col in carry else 3 + len(carry)
    sent = carry if text_col in carry else [*carry, text_col]
    data = docs.select(letters.alias("_letters"), F.col(id_col).alias("_id"), (fold(F.col(id_col)) == 0).alias("_held"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(sent)])
    kinds = dict(docs.dtypes)
    schema = f"_id {kinds[id_col]}, _held boolean, " + "".join(f"_c{i} {kinds[c]}, " for i, c in enumerate(carry)) + "lang_pred string, score double"
    names = ["_id", "_held", *[f"_c{i}" for i in range(len(carry))], "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_owner("langid")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lettered = part.column(0).to_pylist()
                known = [i for i, x in enumerate(lettered) if x and net.value is not None]
                label, score = [UNDETERMINED] * len(lettered), [0.0] * len(lettered)
                if known:
                    p = pooled(net.value, part.column(text_at).take(pa.array(known)).to_pylist())
                    for i, k, s in zip(known, p.argmax(1).tolist(), p.max(1).tolist()):
                        label[i], score[i] = net.value.labels[k], round(min(1.0, s), 4)
                rest = [part.column(i) for i in range(1, 3 + len(carry))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(label, pa.string()), pa.array(score, pa.float64())], names=names)

    out = data.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
