"""Each operator against brute force, on rows with nulls, empty and long texts, ties and repeats, and on empty tables."""

import hashlib
import html as html_module
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _common as common
from corpusloom.llm import langid, media, mixing, ngram_join, toxicity
from corpusloom.llm import license_scan as license_scan_module
from corpusloom.llm.components import components
from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.langid import fold, identify
from corpusloom.llm.license_scan import license_scan
from corpusloom.llm.line_dedup import build_mph, drop_repeated_lines
from corpusloom.llm.media import document_media, parse_html
from corpusloom.llm.mixing import mix, pivot
from corpusloom.llm.ngram_join import near_duplicates
from corpusloom.llm.sharding import feistel, shard
from corpusloom.llm.toxicity import isotonic

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
LINE = "A line that many documents share"
TEXTS = [None, "", " \t\n ", "x", "same text", "same text", "Same text", LONG, LONG + " tail", f"{LINE}\nown 1", f"  {LINE.upper()} \nown 2", f"own 3\n{LINE}\n{LINE}", "é ü 😀 ​", "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s T", "\x00\x1f\x7f"]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", "de", None][i % 3], [None, "s0", "s1"][i % 3]) for i, t in enumerate(TEXTS)]
    return [*out, out[4], (None, "same text", "en", "s0"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that clash with those that operators add."""
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    clash = ["n", "h", "size", "kept", "row", "sig", "label", "id", "component_id", "digest", "pos", "score", "copies", "term", "bucket"]
    return plain.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in clash})


def table(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


def classes(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    return by


@pytest.mark.parametrize("hashing", [None, lambda t: F.length(t)])
def test_exact_dedup(docs, rows, hashing):
    """The second hash makes texts of equal length collide."""
    out = exact_dedup(docs, content_hash=hashing) if hashing else exact_dedup(docs)
    by = classes(rows)
    want = []
    for i, t, *_ in rows:
        keep = max((x for x in by[t or ""] if x is not None), default=None)
        want.append((i, keep, len(by[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert table(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 7, 100, 1000):
        got = [r[0] for r in spark.range(n).select(feistel(F.col("id"), n, 5)).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))


def test_feistel_against_a_plain_one(spark):
    """The same rounds and walk in integers of Python."""
    n, seed = 77, 3
    a = int((n - 1) ** 0.5) + 1
    b = -(-n // a)

    def once(s):
        for r in range(4):
            high, low = divmod(s, b)
            of = lambda side, m: int(hashlib.md5(f"{seed}:{r}:{side}".encode()).hexdigest()[:8], 16) % m  # noqa: E731, B023
            s = (high + of(low, a)) % a * b + low if r % 2 == 0 else high * b + (low + of(high, b)) % b
        return s

    def walk(s):
        s = once(s)
        while s >= n:
            s = once(s)
        return s

    got = [r[0] for r in spark.range(n).orderBy("id").select(feistel(F.col("id"), n, seed)).collect()]
    assert got == [walk(i) for i in range(n)]


def test_shard_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES_A_BLOCK", 8)
    docs = spark.createDataFrame([(None, "t")] * 50 + [(1, "u")] * 3, "doc_id long, text string")
    out = shard(docs, 4)
    assert sorted(Counter(r.shard for r in out.collect()).values()) == [13, 13, 13, 14]
    assert table(out, "doc_id", "shard", "slot") == table(shard(docs.repartition(3), 4), "doc_id", "shard", "slot")


def test_shard(docs, rows):
    out = shard(docs, 5)
    got = out.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(slots[k]) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = shard(docs.repartition(7), 5)
    assert table(out, "doc_id", "shard", "slot", "text_crc32") == table(again, "doc_id", "shard", "slot", "text_crc32")
    assert shard(docs.limit(0)).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    """By raising the share step by step: sources that pass their limit stop."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("n", [0, 3000])
def test_mix(spark, docs, rows, n, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_GROUP", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    if n:
        rng = np.random.default_rng(1)
        rows = [(i, "w " * int(rng.integers(0, 40)), "en", [None, "a", "b", "c"][min(3, int(rng.integers(0, 9)))]) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken, most = targets(sizes), Counter(), Counter()
    got = mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6
    assert table(mix(docs.repartition(2)), "doc_id", "size", "taken") == sorted([(r.doc_id, r.size, r.taken) for r in got], key=repr)
    assert mix(docs.limit(0)).count() == 0


def test_mix_of_equal_rows(spark, monkeypatch):
    """Rows without an id and with one size spread over groups and get copies of their own."""
    monkeypatch.setattr(mixing, "ROWS_A_GROUP", 16)
    monkeypatch.setattr(common, "COPIES_A_BLOCK", 8)
    rows = [(None, "one two", "a")] * 60 + [(i, "w " * 9, "b") for i in range(10)] + [(7, "w " * 9, "b")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == 75 and sorted(r.copy_no for r in got if r.doc_id is None) == list(range(60))
    sizes = {"a": 120, "b": 135}
    want = targets(sizes)
    for s, most in (("a", 2), ("b", 9)):
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= most
    assert table(mix(docs.repartition(5)), "doc_id", "size", "copy_no", "taken") == table(mix(docs), "doc_id", "size", "copy_no", "taken")


def test_pivot_keeps_means():
    n, total = 4000, np.zeros(5)
    for seed in range(n):
        p, held = pivot([1, 2, 3, 4, 5], [3, 1, 2, 5, 4], [0.3] * 5, seed)
        assert abs(sum(a * b for a, b in zip(p, [3, 1, 2, 5, 4])) - 4.5) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != held)
        total += p
    assert np.allclose(total / n, 0.3, atol=0.03)


def strip_lines(rows, least=3, chars=20):
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\r\x0b\x0c"))

    holders = defaultdict(set)
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].add(i if i is not None else -(1 << 63))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(key(x)) >= chars and len(holders[key(x)]) >= least and max(holders[key(x)]) != (i if i is not None else -(1 << 63)))]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_line_dedup(spark, docs, rows, room):
    """Both ways: the index in every task, and line hashes sent to the shards. Lines that only repeated rows of an id hold stay."""
    twice, nulls = "a line in repeated rows of two ids", "a line that rows without an id share"
    more = [(800, twice), (800, twice), (800, f"{twice}\nx"), (801, twice), (None, nulls), (None, f"{nulls}\n"), (None, f"{LINE}\n{nulls}"), (802, nulls)]
    extra = spark.createDataFrame(more, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "own", "held", "gone", "c0", "id")})
    base = docs.select("doc_id", "text", "row", "id", *[F.lit("clash").alias(c) for c in ("own", "held", "gone", "c0")])
    out = drop_repeated_lines(base.unionByName(extra), index_bytes=room)
    got = sorted([(r.doc_id, r.lines_in_all, r.lines_dropped, r.kept_text) for r in out.collect()], key=repr)
    assert got == strip_lines([*rows, *more]) and sum(r[2] for r in got) == 3
    assert {(r.row, r.own, r.gone, r.c0) for r in out.collect()} == {("clash",) * 4}
    assert drop_repeated_lines(docs.limit(0), index_bytes=room).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        h = rng.integers(0, 1 << 64, (2, n), np.uint64)
        assert sorted(build_mph(*h)[2].tolist()) == list(range(n))


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def by_brute_force(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and den * len(s & t) >= num * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted([(i, len(s), root(i)) for i, s in sets if i is not None], key=repr)


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100), (3, 100, 100)])
def test_near_duplicates(spark, docs, rows, k, num, den):
    rng = np.random.default_rng(k)
    more, base = [], [f"b{i}" for i in range(120)]
    for i in range(160):  # near copies of one text, and short sets around every boundary
        w = list(base) if i % 2 else [f"s{int(x)}" for x in rng.integers(0, 12, int(rng.integers(1, 30)))]
        for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
            w[at] = f"m{int(rng.integers(0, 9))}"
        more.append((1000 + i, " ".join(w), "en", "s"))
    more += [(5000, more[0][1], "en", "s"), (5001, more[1][1], "en", "s")]
    both = docs.select("doc_id", "text", "sig", "label").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string").select("doc_id", "text", F.lit("c").alias("sig"), F.lit("c").alias("label")))
    out = near_duplicates(both, k, num, den)
    found = out.collect()
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None], key=repr)
    assert got == by_brute_force([*rows, *more], k, num, den)
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id is None} == {(None, 4), (None, None)}
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few,heavy", [(4, (16, 64)), (0, (0, 1, 4)), (0, (1 << 40,))])
def test_near_duplicates_of_one_large_group(spark, monkeypatch, few, heavy):
    """Copies of one text about as far from each other as the threshold: further hub rounds, and lists split by keys of two tokens."""
    monkeypatch.setattr(ngram_join, "FEW_MEETINGS", few)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    rng, rows = np.random.default_rng(11), []
    for i in range(260):
        w = [f"t{j}" for j in range(int(rng.integers(94, 106)))]
        for at in rng.integers(0, len(w), int(rng.integers(0, 9))):
            w[at] = f"v{int(rng.integers(0, 4000))}"
        rows.append((i, " ".join(w)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85, 100)
    assert table(out, "doc_id", "n_shingles", "component_id") == by_brute_force(rows, 4, 85, 100)


def test_words_with_equal_polynomial_hashes_differ(spark):
    """A Thue-Morse word and its complement have one hash under any sum of powers modulo 2 ** 64."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, morse), (2, other), (3, f"x y z {morse}"), (4, f"x y z {other}"), (5, morse), (6, "a a"), (7, "a a a a"), (8, "a a a a a")]
    got = table(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100), "doc_id", "component_id")
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 6), (7, 7), (8, 7)]


def test_shared_shingles():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = ([b"ab"[i : i + 1] for i in rng.integers(0, 2, int(rng.integers(0, 9)))] for _ in "ab")
        x, y = shingle_set(b" ".join(a).decode(), 3), shingle_set(b" ".join(b).decode(), 3)
        assert ngram_join.shared_shingles(a, b, 3) == (len(x & y), len(x | y)), (a, b)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (200, 200), (7, 3)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 90, 90: 90, 95: 90}


def test_language_id(spark):
    rng = np.random.default_rng(3)
    letters = {"aa": "abcdef", "bb": "uvwxyz"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[k]), 5)) for _ in range(12)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 ... !", "aa"), (903, "abc def " * 20_000, None), (None, "uvw xyz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in identify(docs).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred == "aa" and out[None].lang_pred == "bb"
    held = [(out[i].lang_pred, k) for i, _, k in rows[:120] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(a == b for a, b in held)
    assert all(r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in out.items())
    assert identify(docs.limit(0)).count() == 0


def test_pooled_against_single_windows():
    """Means over all bytes, each window labelled on its own."""
    net = langid.ByteBiGru.fresh(["a", "b", "c"], np.random.default_rng(1))
    texts = ["x", "short text", "é" * 100, "w " * 64, "long one " * 5000]
    got = langid.pooled(net, texts)
    for text, p in zip(texts, got):
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            x = np.frombuffer(part.ljust(langid.WINDOW), np.uint8)[None, :]
            total += net.label(x)[: len(part), 0].sum(0)
        assert np.allclose(p, total / len(raw), atol=1e-4)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = langid.ByteBiGru.fresh(["a", "b", "c"], rng)
    x, y = rng.integers(0, 256, (4, 9)).astype(np.uint8), np.array([0, 1, 2, 0])
    for name, grad in zip("wuvb", net.gradients(x, y)[1]):
        p = getattr(net, name)
        at = np.unravel_index(np.abs(grad).argmax(), p.shape)
        old, step = p[at], 1e-2
        ends = []
        for d in (step, -step):
            p[at] = old + d
            ends.append(net.gradients(x, y)[0])
        p[at] = old
        assert grad[at] == pytest.approx((ends[0] - ends[1]) / (2 * step), rel=0.05, abs=1e-4)
    full = net._probabilities(net.states(x)[1])
    assert np.allclose(full, net.label(x), atol=1e-5)


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(0, 40))], w[int(rng.integers(0, 40))] = "grumblefoo", "you"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (9002, "GRUMBLEFOO! you grumblefoo " + LONG), (None, "fine words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (3, None), (0, 0), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert len(out) == len(rows) and out[9000].score == out[9001].score
    held = [(out[i].predicted, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(r.predicted == (r.score >= 0.5) for r in out.values())
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.toxicity(docs.limit(5), lab.limit(0)).collect()} == {0.0}


def test_features_against_brute_force():
    """Second-person nearness by all pairs, and rates from plain counts; a long text of hits and mentions takes no square time."""
    lexicon = toxicity.Lexicon({"grumble": 2.0, "snark*": 1.0})
    rng = np.random.default_rng(6)
    for _ in range(60):
        words = list(rng.choice(["grumble", "snarky", "you", "fine", "IDIOT!", "your", "w0rd"], int(rng.integers(1, 30))))
        got = dict(zip(toxicity.FEATURES, toxicity.features(" ".join(words), lexicon)))
        hits = [i for i, w in enumerate(words) if w in ("grumble", "snarky")]
        you = [i for i, w in enumerate(words) if w in ("you", "your")]
        assert got["near_you"] == pytest.approx(max((1 / (1 + abs(i - j)) for i in hits for j in you), default=0.0))
        assert got["lexicon_rate"] == pytest.approx(sum(2.0 if words[i] == "grumble" else 1.0 for i in hits) / len(words))
        assert got["you_rate"] == pytest.approx(len(you) / len(words)) and got["insult_rate"] == pytest.approx(words.count("IDIOT!") / len(words))
        assert got["shouted_rate"] == pytest.approx(words.count("IDIOT!") / len(words))
    began = time.time()
    toxicity.features("you grumble " * 200_000, lexicon)
    assert time.time() - began < 20


def test_trees_against_brute_force():
    """The first cut of one tree is the best of all features and places by the gain of both sides."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 9, (200, 3)).astype(float), None
    y = ((x[:, 1] > 4) ^ (rng.random(200) < 0.1)).astype(float)
    model = toxicity.fit(x, y, np.ones(200))
    apart = np.arange(200) % toxicity.CALIBRATE_EVERY == 0
    tx, ty = x[~apart], y[~apart]
    p = ty.mean()
    g, h = p - ty, np.full(len(ty), p * (1 - p))

    def gain(k, c):
        left = tx[:, k] <= c
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))

    best = max((gain(k, c), k) for k in range(3) for c in np.unique(tx[:, k])[:-1])
    assert model.feature[0][0] == best[1] == 1 and gain(1, model.cut[0][0]) == pytest.approx(best[0])
    for i in range(20):  # a row's margin by walking each tree
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > c[node])
            total += leaf[node - len(f)]
        assert model.margin(x[i : i + 1])[0] == pytest.approx(total)


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(5)
    s, y, w = rng.integers(0, 20, 60).astype(float), rng.integers(0, 2, 60).astype(float), rng.random(60) + 0.1
    x, v = isotonic(s, y, w)
    assert (np.diff(v) >= -1e-12).all()
    values = sorted(set(s))
    for q in values:  # the value at q is the largest, over starts, of the smallest weighted mean
        best = max(min(np.average(y[(s >= a) & (s <= b)], weights=w[(s >= a) & (s <= b)]) for b in values if b >= q) for a in values if a <= q)
        assert np.interp(q, x, v) == pytest.approx(best)


def test_fold(spark):
    got = spark.createDataFrame([(1,), (12345,), (None,)], "i long").select(fold(F.col("i"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(x) % 5 for x in (b"1", b"12345", b"")]


def test_media(docs, rows):
    got = document_media(docs).collect()
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        body = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        stored = b"P6\n64 %d\n255\n" % (len(body) // 192) + body
        assert media.samples(stored) == (64, len(body) // 192, body)
        want.append((i, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), media.describe_media(stored)[5], 1, f"Text of document {'none' if i is None else i}, {len(raw)} bytes"))
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)
    assert document_media(docs.limit(0)).count() == 0


def test_media_of_a_hot_digest(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT", 3)
    rows = [(i, "same") for i in range(40)] + [(100, "other"), (101, None), (102, "")]
    got = {r.doc_id: (r.payload_sha256, r.feature) for r in document_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 43 and len({got[i] for i in range(40)}) == 1 and got[101] == got[102] != got[100]
    assert got[0][0] == hashlib.sha256(b"same".ljust(192)).hexdigest()


def test_mixed_sequences_resolve_in_order(spark):
    stored = media.store(spark.createDataFrame([(b"x" * 192,), (b"y" * 384,)], "payload binary"))
    known = media.described(stored)
    x, y = (hashlib.sha256(b).hexdigest() for b in (b"x" * 192, b"y" * 384))
    html = [(1, f"<p>One<img src='sha256:{x}' alt='ex'>two<figure><img src='sha256:{y}'><figcaption>why</figcaption></figure>end"), (2, f"<img src='sha256:{'0' * 64}'><img src='http://a/b.png'>"), (3, None), (4, "")]
    pages = spark.createDataFrame(html, "page_id long, html string").withColumn("digest", F.lit("clash"))
    rows = media.resolve(media.sequences(pages, F.col("html"), ["page_id"]), known, ["page_id"]).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.kind, r.text, r.caption, r.payload_bytes) for r in rows] == [(1, 0, "text", "One", None, None), (1, 1, "media", None, "ex", 192), (1, 2, "text", "two", None, None), (1, 3, "media", None, "why", 384), (1, 4, "text", "end", None, None), (2, 0, "media", None, None, None), (2, 1, "media", None, None, None)]


def test_sequences_of_raw_pages(spark):
    """All words of a page's body that no tag hides come through, in their order."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in media.sequences(pages, F.col("html"), ["page_id", "html"]).collect():
        plain = re.sub(r"(?is)<(script|style|template)\b.*?</\1>", " ", r.html or "")
        want = html_module.unescape(re.sub(r"(?s)<!--.*?-->|<[^>]*>", " ", plain)).split()
        got = " ".join(i.text or i.caption or "" for i in r["items"]).split()
        assert [w for w in "".join(want)] == [w for w in "".join(got)], r.page_id
        assert [i.pos for i in r["items"]] == list(range(len(r["items"])))


def test_html_sequences():
    items = parse_html("<p>One <b>two</b><img src='sha256:aa' alt='A'>three</p><figure><figcaption>Cap &amp; tion</figcaption><img src=sha256:bb><video src='v'></video></figure><script>x</script><p>four")
    assert items == [["text", "One two", None, None], ["media", None, "sha256:aa", "A"], ["text", "three", None, None], ["media", None, "sha256:bb", "Cap & tion"], ["media", None, "v", "Cap & tion"], ["text", "four", None, None]]
    assert parse_html(None) == [] and parse_html("<figure><img src=q><figcaption>late") == [["media", None, "q", "late"]]


def test_license_scan(spark):
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/x.txt", "some text\nof words"),
        (3, "a/b/c/y.txt", "Released under the MIT License.\n" + "many other words " * 30),
        (4, "a/b/c/z.txt", None),
        (5, "other/q.txt", ""),
        (6, None, "Licensed under CC BY-NC 4.0."),
        (7, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (8, "a/b/d/w.txt", "we have no licence to speak of weather"),
        (2, "a/b/x.txt", "some text\nof words"),
        (9, "top.txt", LONG),
    ]
    docs = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("term", F.lit("clash")).withColumn("dir", F.lit(1))
    got = {(r.doc_id, r.licence, r.origin, r.from_dir) for r in license_scan(docs).collect()}
    assert got == {(1, "Apache-2.0", "header", None), (2, "GPL-3.0", "inherited", "a/b"), (3, "MIT", "header", None), (4, "GPL-3.0", "inherited", "a/b"), (5, None, "none", None), (6, "CC-BY-NC-4.0", "header", None), (7, "GPL-3.0", "header", None), (8, "GPL-3.0", "inherited", "a/b"), (9, None, "none", None)}
    assert license_scan(docs).count() == len(files) and license_scan(docs.limit(0)).count() == 0


def test_licence_files_by_whole_text(spark):
    """Wrapped in lines, with a copyright line; the cosine against one computed from scratch."""
    wrap = lambda t: "Copyright (c) 2020 Acme\n\n" + "\n".join(textwrap.wrap(t, 70))
    files = [(i, f"{n}/COPYRIGHT", wrap(t)) for i, (n, t) in enumerate(license_scan_module.FILES.items())]
    files += [(90, "mine/a.c", "Copyright (c) 2020"), (91, "theirs/a.c", "Copyright 2020 Acme"), (92, "old/a.c", "License: 2.0"), (93, "MIT/src/b.c", "int main")]
    got = {r.path: r for r in license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    words = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    df = Counter(w for t in license_scan_module.FILES.values() for w in words(t))
    n = len(license_scan_module.FILES)
    idf = lambda w: 1.0 if w in license_scan_module.COMMON and w in df else np.log((n + 1) / (df[w] + 1)) + 1
    for i, path, text in files[:n]:
        a, best = words(text), {}
        for name, t in license_scan_module.FILES.items():
            b = words(t)
            best[name] = sum(a[w] * b[w] * idf(w) ** 2 for w in a) / np.sqrt(sum((a[w] * idf(w)) ** 2 for w in a) * sum((b[w] * idf(w)) ** 2 for w in b))
        assert (got[path].licence, got[path].origin) == (path.split("/")[0], "file") and got[path].licence == max(best, key=best.get)
        assert got[path].score == pytest.approx(best[got[path].licence], abs=1e-5)
    assert [got[p].licence for p in ("mine/a.c", "theirs/a.c", "old/a.c")] == [None] * 3
    assert (got["MIT/src/b.c"].licence, got["MIT/src/b.c"].origin, got["MIT/src/b.c"].from_dir) == ("MIT", "inherited", "MIT")


def test_license_scan_reads_statements_without_stems_and_inside_text(spark):
    prose = " ".join(f"plain{i}" for i in range(14))
    files = [
        ("bsd/a.c", "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted\n */\n" + prose),
        ("isc/a.c", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted\n" + prose),
        ("spdx/a.c", "// SPDX-License-Identifier: MIT\n" + prose),
        ("spdx3/a.c", "# SPDX-License-Identifier: GPL-3.0-or-later\n" + prose),
        ("spdx0/a.c", "# SPDX-License-Identifier: Nobody-2.0\n" + prose),
        ("inside/a.c", f"{prose} released under the MIT License {prose}"),
        ("gpl2/a.c", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; version 2\n" + prose),
        ("de/a.txt", f"Mit.\nmit mit mit mit mit\n{prose}"),
        ("none/a.c", f"{prose} version 2.0 and copyright of the use {prose}"),
    ]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    got = {r.path.split("/")[0]: r.licence for r in license_scan(docs).collect()}
    assert got == {"bsd": "BSD-3-Clause", "isc": "ISC", "spdx": "MIT", "spdx3": "GPL-3.0", "spdx0": "Nobody-2.0", "inside": "MIT", "gpl2": "GPL-2.0", "de": None, "none": None}
