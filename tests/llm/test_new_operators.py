"""Hard negatives, packing and periodic runs against brute force, on hard rows and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import hard_negatives as hn
from corpusloom.llm import packing
from corpusloom.llm.packing import Encoder, hilbert, pack
from corpusloom.llm.runs import collapse, periodic_runs, run_digests, runs_of, with_planted_runs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
TEXTS = [None, "", " ", "x", "same text", "same text", LONG, LONG + " tail", "é ü 😀 ​ \x1c", "a b c " * 20, "<|endoftext|>x <|end", "y" * 5000, " " * 3000 + "z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*enumerate(TEXTS), (4, "same text"), (None, "same text"), (None, None), *[(100 + i, "many copies of this") for i in range(300)]]
    clash = ["n", "tie", "ids", "slot", "start", "length", "place", "runs", "collapsed", "_w", "_n"]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("clash") for c in clash})


# ---- hard negatives


def plain_negatives(rows, anchor, positives, negatives):
    out = []
    kept = {}
    for k, label, v in rows:
        if k is not None and label is not None and v is not None:
            kept[k] = max(kept.get(k, (label, v)), (label, v))
    size = max((len(v) for _, v in kept.values()), default=0)
    full = {k: (label, np.array(v + [0] * (size - len(v)))) for k, (label, v) in kept.items()}
    for a, (label, v) in full.items():
        if not anchor(a):
            continue
        score = {k: int(v @ w) for k, (_, w) in full.items()}
        order = sorted((k for k in full if k != a), key=lambda k: (-score[k], k))
        for p in [k for k in order if full[k][0] == label][:positives]:
            fits = [k for k in order if full[k][0] != label and 80 * score[p] <= 100 * score[k] <= 100 * score[p]][:negatives]
            out += [(a, p, i + 1, k, score[p], score[k]) for i, k in enumerate(fits)]
    return sorted(out)


KINDS = "key long, label int, vector array<bigint>"


@pytest.mark.parametrize("shape", ["clusters", "flat", "ties", "hot"])
def test_hard_negatives(spark, monkeypatch, shape):
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "QUERIES_A_TASK", 8)
    rng = random.Random(shape)
    rows = []
    centres = [[rng.randint(-200, 200) for _ in range(6)] for _ in range(5)]
    for i in range(260):
        v = [x + rng.randint(-9, 9) for x in rng.choice(centres)] if shape == "clusters" else [rng.randint(-1, 2) if shape == "ties" else rng.randint(-99, 99) for _ in range(6)]
        rows.append((i, rng.randint(0, 3), [3, 1, 4, 1, 5, 9] if shape == "hot" and i % 3 == 0 else v))
    rows += [(None, 1, [1] * 6), (900, None, [1] * 6), (901, 1, None), (20, 1, [7]), (20, 1, [7]), (903, 2, []), (904, 0, [50, 50])]
    out = hn.hard_negatives(spark.createDataFrame(rows, KINDS).withColumn("rank", F.lit(1)).repartition(3), F.col("key") % 20 == 0, 3, 4)
    want = plain_negatives(rows, lambda k: k % 20 == 0, 3, 4)
    assert sorted(map(tuple, out.collect())) == want and want
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_no_rows_and_no_partners(spark):
    empty = spark.createDataFrame([], KINDS)
    assert hn.hard_negatives(empty, F.lit(True)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(0, 1, [5])], KINDS), F.lit(True)).count() == 0
    zero = [(0, 1, [0, 0]), (1, 1, [0, 0]), (2, 2, [0, 0])]
    assert [tuple(r) for r in hn.hard_negatives(spark.createDataFrame(zero, KINDS), F.col("key") == 0).collect()] == [(0, 1, 1, 2, 0, 0)]


def test_search_reads_few_blocks_of_clustered_vectors(spark, monkeypatch):
    """Far clusters are never met: the certificate ends the search before."""
    monkeypatch.setattr(hn, "BLOCK", 16)
    seen = []
    real = hn.materialize
    monkeypatch.setattr(hn, "materialize", lambda df, name, *a: seen.append((name, real(df, name, *a))) or seen[-1][1])
    rng = random.Random(3)
    rows = [(i, 0, [(5000 if j == i % 16 else 0) + rng.randint(-20, 20) for j in range(16)]) for i in range(800)]
    index = hn.build_index(spark.createDataFrame(rows, KINDS), pivots=16)
    none = F.lit(None).cast("double")
    asked = spark.createDataFrame(rows[:8], KINDS).select(F.col("key").alias("anchor"), F.col("key").alias("other"), "label", "vector", none.alias("least"), none.alias("most"))
    out = hn.search(index, asked, 5, True).collect()
    by = defaultdict(list)
    for r in out:
        by[r.anchor].append((r.rank, r.key, r.score))
    full = np.array([v for *_, v in rows])
    for a in range(8):
        s = full @ full[a]
        order = [k for k in sorted(range(800), key=lambda k: (-s[k], k)) if k != a][:5]
        assert sorted(by[a]) == [(i + 1, k, s[k]) for i, k in enumerate(order)]
    read = sum(df.count() for name, df in seen if name == "negatives-pairs")
    assert read < 0.3 * 8 * index.n_blocks


def test_embedded_rows(spark):
    rows = [(7, [0.5, -0.001], 9), (8, [1.0, float("nan")], 1), (9, [1.0, None], 1), (10, None, 1), (11, [1.0], None), (None, [1.0], 1), (12, [float("inf")], 1), (13, [0.00390625], 3)]
    out = hn.embedded_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, out)) == [(7, 0, [128, -1]), (13, 3, [1])]


# ---- packing


def test_hilbert_is_a_curve():
    """Every cell once, neighbours on the curve are neighbours on the grid."""
    for dims, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        place = hilbert(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        walk = grid[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


ENC = Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encoder(text):
    assert ENC.encode(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_encoder_on_hard_texts():
    for text in [t for t in TEXTS if t] + ["I'LL we've  two   spaces\n\n x", "日本語 テスト", "a<|endoftext|><|endoftext|> b"]:
        assert ENC.encode(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_IDS", 500)
    rows, df = docs
    got = pack(df, PATH, length=64).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
        assert 0 < r.length == len(r.ids) // 4 and r.offset + r.length <= 64
    for s, parts in seqs.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or s == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*LIB.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    for i, texts in want.items():
        pieces = sorted(by[i], key=lambda r: (r.sequence_id, r.offset))
        made, now = [], b""
        for r in pieces:
            assert r.start == len(now) // 4
            now += bytes(r.ids)
            if len(now) // 4 == r.doc_tokens:
                made.append(now)
                now = b""
        assert sorted(made) == sorted(texts) and not now
    key = lambda r: (r.sequence_id, r.offset)
    again = pack(df.repartition(3), PATH, length=64).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr) and key
    assert pack(df.limit(0), PATH).count() == 0


def test_similar_documents_are_near(spark):
    """Documents of three vocabularies lie in few stretches of the curve."""
    rng = random.Random(5)
    words = [[f"{c}{i}" for i in range(40)] for c in ("alpha", "bravo", "zulu")]
    rows = [(i, " ".join(rng.choices(words[i % 3], k=200))) for i in range(150)]
    got = sorted(pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).where("start = 0").collect(), key=lambda r: (r.sequence_id, r.offset))
    kinds = [r.doc_id % 3 for r in got]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) < 60  # 100 by chance


# ---- periodic runs


def plain_runs(w, least, periods):
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, periods * q) and not any(all(w[x] == w[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 4), st.integers(0, 80), st.randoms(use_true_random=False), st.sampled_from([(24, 3), (1, 2), (6, 3)]))
def test_runs(letters, n, rng, bounds):
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.choice([3, 4, 6])
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    assert runs_of(w, *bounds) == plain_runs(w, *bounds)


def test_run_digests(spark, docs):
    rows, df = docs
    rows = [(i, t) for i, t in rows if i is None or i < 160] + [(i, " ".join(f"w{(i * j) % 61}" for j in range(200))) for i in range(1000, 1060)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "_w", "length")})
    got = sorted([tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in run_digests(periodic_runs(with_planted_runs(df))).collect()], key=repr)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        rs = plain_runs(w, 24, 3) if n < 3000 else runs_of(w)
        best = min(rs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, size, q in rs for k in range(s + q, s + size)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert collapse(w, rs) == kept
        want.append((i, len(rs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in rs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 3
    assert periodic_runs(df.limit(0)).count() == 0
