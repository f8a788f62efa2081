"""Retrieval and evaluation against plain loops on small tables."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, evaluation, lexical, retrieval, vectors


def words(text):
    return list(dict.fromkeys(w for w in re.split("[^a-z0-9_]+", text.lower()) if len(w) > 2))


def likeness(a, b):
    both = len(set(a) & set(b))
    return both / (len(a) + len(b) - both) if a and b else 0.0


def mmr(rows, limit, cap=3, weight=0.7, penalty=0.25):
    """rows: (item, score, text, module, generated)."""
    left, taken, used = sorted(rows, key=lambda r: (-r[1], r[0])), [], {}
    while left and len(taken) < limit:
        def value(r):
            rel = r[1] * (1 - penalty if r[4] else 1)
            return weight * rel - (1 - weight) * max((likeness(words(r[2]), words(t[2])) for t in taken), default=0.0)

        free = [r for r in left if used.get(r[3], 0) < cap]
        best = max(free, key=value) if free else left[0]
        if free:
            used[best[3]] = used.get(best[3], 0) + 1
        left.remove(best)
        taken.append(best)
    return [r[0] for r in taken]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(5, 30)))), f"m{i % 4}", f"doc_{i}", int(rng.integers(5, 4000))) for i in range(60)]
    docs += [(60, docs[0][1], "m0", "x.doc_3", 50), (61, "", "m1", "other", 1)]
    vectors = [(i, rng.standard_normal(6).astype(float).tolist()) for i, *_ in docs]
    questions = [(q, " ".join(rng.choice(vocabulary, 4))) for q in range(6)] + [(6, "nothing here that matches")]
    return docs, vectors, questions


def arms(docs, vectors, allowed, text, vector, names):
    """Five ranked lists of item ids: vectors and words of code and documentation, and exact names of code."""
    n, lists = len(docs), {d[0]: [w for w in re.split("[^a-z0-9_]+", d[1].lower()) if len(w) > 2] for d in docs}
    mean, bm, corpus = sum(map(len, lists.values())) / n, {}, {d[0]: d[5] for d in docs}
    for w in words(text):
        df = sum(w in x for x in lists.values())
        for i, x in lists.items():
            if tf := x.count(w):
                bm[i] = bm.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    out = {}
    for side in ("code", "docs"):
        mine = {i for i, c in corpus.items() if c in allowed and (c in ("docs", "adr")) == (side == "docs")}
        out[f"dense-{side}"] = [i for _, i in sorted((-round(float(np.dot(v, vector) / (np.linalg.norm(v) * np.linalg.norm(vector))), 6), i) for i, v in vectors if i in mine)][:50] if vector is not None else []
        out[f"lexical-{side}"] = [i for _, i in sorted((-round(s, 6), i) for i, s in bm.items() if i in mine)][:50]
    named = {}
    for d in docs:
        for x in names:
            if d[5] not in ("docs", "adr") and d[3].lower().endswith(x.lower()):
                named[d[0]] = max(named.get(d[0], 0), 1.0 if d[3].lower() == x.lower() else 0.5)
    by = {d[0]: d for d in docs}
    out["symbol"] = [i for i in sorted(named, key=lambda i: (-named[i], len(by[i][3]), i))[:10] if corpus[i] in allowed]
    return out


#: Question, its intent, the weights and corpora of that intent, and the names in it; {0} is some words.
ROUTED = [
    ("what does doc_3 do", (0.8, 1.2, 2.0), ["code", "spec"], ["doc_3"]),
    ("why {0}", (1.4, 0.8, 0.4), ["adr", "docs", "code"], []),
    ("how to {0}", (1.2, 1.0, 0.8), ["docs", "spec", "code"], []),
    ("{0}", (1.2, 1.0, 0.8), ["docs", "code", "adr"], []),
    ("{0} which service calls doc_40", (1.0, 1.0, 1.4), ["code", "spec", "infra"], ["doc_40"]),
]


@pytest.mark.parametrize("reranked", [False, True])
@pytest.mark.parametrize("text_ids", [False, True])
def test_hybrid_search_against_a_plain_one(spark, corpus, reranked, text_ids):
    plain, vectors, said = corpus
    name = (lambda i: f"i{i:03d}") if text_ids else (lambda i: i)
    kind = "string" if text_ids else "long"
    # The last module holds shallow chunks only, some chunks are generated.
    docs = [(name(i), t, m, n, k, ["code", "docs", "spec", "adr", "infra"][i % 5], "shallow" if m == "m3" else "semantic", i % 7 == 0) for i, t, m, n, k in plain]
    vectors = [(name(i), v) for i, v in vectors]
    questions = [(q, ROUTED[q % 5][0].format(t), None if q == 4 else vectors[q * 5][1]) for q, t in said]
    session = [name(2), name(5)]
    links = [(name(i), name((i * 7) % 62), ["callee", "type", "caller"][i % 3]) for i in range(62)] + [(name(i), name((i * 5 + 1) % 62), "parent") for i in range(62)]
    stale = [name(i) for i in range(62) if i % 9 == 0]
    scores = [(q, d[0], ((q * 31 + k * 17) % 100) / 100) for q, *_ in questions for k, d in enumerate(docs)] if reranked else None
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    served, verdicts = retrieval.hybrid_search(
        frame(docs, f"doc_id {kind}, text string, module string, name string, tokens long, corpus string, depth string, generated boolean"),
        frame(vectors, f"doc_id {kind}, embedding array<double>"),
        frame(questions, "query_id long, query string, query_vector array<double>"),
        frame(links, f"src {kind}, dst {kind}, relation string"),
        frame([(i,) for i in stale], f"doc_id {kind}"),
        session,
        frame(scores, f"query_id long, doc_id {kind}, rerank_score double") if reranked else None,
    )
    got = sorted((r.query_id, r.part, r.place, r.doc_id) for r in served.collect())
    said_of = {r.query_id: r for r in verdicts.collect()}
    by, want = {d[0]: d for d in docs}, []
    central = {i: sum(t == i for _, t, _ in links) for i in by}
    for q, text, vector in questions:
        _, weights, allowed, names = ROUTED[q % 5]
        fused = {}
        for arm, ranked in arms(docs, vectors, allowed, text, vector, names).items():
            w = weights[["dense", "lexical", "symbol"].index(arm.split("-")[0])]
            for k, i in enumerate(ranked):
                fused[i] = fused.get(i, 0) + w / (61 + k)
        top = sorted((-round(s, 9), i) for i, s in fused.items())[:50]
        chosen = mmr([(i, -s * (1.15 if i in session else 1), by[i][1], by[i][2], by[i][7]) for s, i in top], 50)
        mine = {i: s for x, i, s in scores or [] if x == q}
        if reranked:
            chosen = sorted(chosen, key=lambda i: (-mine[i], i))
        chosen, kept, used = chosen[:8], [], 0
        for k, i in enumerate(chosen):
            if not kept or used + by[i][4] <= 13200:
                kept.append((k + 1, i))
                used += by[i][4]
        best = max((mine[i] for _, i in kept), default=None) if reranked else None
        weak = (best is None or best < 0.35) if reranked else len(kept) < 3
        assert said_of[q].abstain == (not kept or weak), q
        if not kept or weak:
            continue
        hedges = [h for h, x in (("all-shallow", all(by[i][6] == "shallow" for _, i in kept)), ("stale-repos", any(i in stale for _, i in kept)), ("all-generated", all(by[i][7] for _, i in kept)), ("fusion-order", not reranked)) if x]
        assert said_of[q].hedges == ";".join(hedges)
        want += [(q, "primary", k, i) for k, i in kept]
        turns = []
        for k, i in kept:
            near = {(t, r) for s, t, r in links if s == i and t in by and t not in [x for _, x in kept] and central[t] <= 50}
            near = sorted(near, key=lambda x: (retrieval.RELATIONS.index(x[1]), central[x[0]], x[0]))[:4]
            turns += [(p + 1, k, t) for p, (t, _) in enumerate(near)]
        room, seen = 0, []
        for _, _, t in sorted(turns):
            if t not in seen and room + by[t][4] <= 6000:
                seen.append(t)
                room += by[t][4]
                want.append((q, "expansion", len(seen), t))
    assert got == sorted(want) and want


def test_all_shallow_evidence_is_hedged(spark):
    docs = [(i, f"word{i} shared text", f"m{i}", f"n{i}", 10, "code", "shallow", True) for i in range(4)]
    frame = spark.createDataFrame
    _, verdicts = retrieval.hybrid_search(frame(docs, "doc_id long, text string, module string, name string, tokens long, corpus string, depth string, generated boolean"), frame([], "doc_id long, embedding array<double>"), frame([(1, "shared text", None)], "query_id long, query string, query_vector array<double>"), frame([], "src long, dst long, relation string"), frame([], "doc_id long"))
    assert [(r.abstain, r.hedges) for r in verdicts.collect()] == [(False, "all-shallow;all-generated;fusion-order")]


def test_follow_ups_are_searched_with_the_turn_before(spark):
    rows = [(1, "what about the async one?", "tell me of parseTree"), (2, "why is parseTree slow", "x"), (3, "and then?", None)]
    got = {r.query_id: r for r in retrieval.routed(spark.createDataFrame(rows, "query_id long, query string, last_turn string")).collect()}
    assert got[1].asked == "tell me of parseTree — what about the async one?" and got[1].names == ["parseTree"]
    assert got[2].asked == rows[1][1] and got[2].intent == "why-rationale" and got[2].arms.corpora == ["adr", "docs", "code"]
    assert got[3].asked == "and then?"


def test_covers_against_all_stretches():
    rng = np.random.default_rng(2)
    for _ in range(300):
        text = rng.integers(0, 6, int(rng.integers(0, 14))).tolist()
        terms = list(range(int(rng.integers(1, 4))))
        whole = lambda a, b: all(t in text[a:b] for t in terms)  # noqa: E731, B023
        minimal = [(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if whole(a, b) and not whole(a + 1, b) and not whole(a, b - 1)]
        want = sum(0.1 / (1 + sum(x not in terms for x in text[a:b])) for a, b in minimal)
        assert lexical.covers([(i, x) for i, x in enumerate(text) if x in terms], len(terms)) == pytest.approx(want)


def test_cells_find_clustered_neighbours_and_read_few(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16)) * 4
    rows = [(i, (centres[i % 12] + rng.standard_normal(16)).tolist()) for i in range(1200)] + [(1200, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id < 60 and vec_id % 12 < 2").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = vectors.build_cells(v, 12)
    found = vectors.search_cells(index, q, 10, probes=2)
    exact = vectors.dense_topk(v, q, 10)
    assert vectors.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert sum(index.sizes.values()) == 1200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    every = vectors.search_cells(index, q, 10, probes=12)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_exact_search_in_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)]
    v = spark.createDataFrame([r for r in rows if any(r[1])], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 15 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = sorted(map(tuple, vectors.dense_topk(v, q, 7).collect()))
    held, want = [r for r in rows if any(r[1])], []
    for a, x in held:
        if a % 15 == 0:
            s = sorted((-round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 6), i) for i, y in held)[:7]
            want += [(a, i, -t, k + 1) for k, (t, i) in enumerate(s)]
    assert got == sorted(want)


def test_diversity_against_a_plain_one(spark, corpus):
    docs, _, _ = corpus
    rng = np.random.default_rng(3)
    rows = [(q, d[0], round(float(rng.random()), 3), d[1], d[2], d[0] % 11 == 0) for q in range(4) for d in docs if rng.random() < 0.5]
    out = retrieval.diversify(spark.createDataFrame(rows, "query_id long, doc_id long, score double, text string, module string, generated boolean"), 8)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.position):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: mmr([r[1:] for r in rows if r[0] == q], 8) for q in range(4)}


def test_vectors_of_another_size_are_refused(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    with pytest.raises(Exception, match="vectors of"):
        retrieval.dense_topk(v, q).collect()
    assert retrieval.dense_topk(v.limit(0), q).count() == 0 and retrieval.dense_topk(v, q.limit(0)).count() == 0


def test_bootstrap_against_plain_draws(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i, float(rng.random() < 0.5), float(rng.random() < 0.5 + up)) for s, up in (("a", 0.4), ("b", 0.0)) for i in range(150)]
    pairs = spark.createDataFrame(rows, "stratum string, item_id long, base double, cand double")
    got = {r.stratum: r for r in evaluation.paired_bootstrap(pairs.repartition(5)).collect()}
    hashes = {r.item_id: r.h for r in pairs.select("item_id", F.xxhash64("item_id").alias("h")).distinct().collect()}
    for s in "ab":
        d = np.array([c - b for t, _, b, c in rows if t == s])
        times = evaluation.poisson_draws(np.array([hashes[i] for t, i, *_ in rows if t == s]), 2000, 0)
        means = np.sort(np.round(d @ times, 9) / times.sum(0))
        assert got[s].low == pytest.approx(means[50], abs=1e-6) and got[s].high == pytest.approx(means[1950], abs=1e-6)
        assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.03
        # The interval is near that of drawing n items with replacement.
        plain = np.sort([rng.choice(d, len(d)).mean() for _ in range(2000)])
        assert abs(got[s].low - plain[50]) < 0.03 and abs(got[s].high - plain[1950]) < 0.03
        assert got[s].significant == (means[50] > 0 or means[1950] < 0)
    assert got["a"].significant


def test_gate_rules(spark):
    kind = "stratum string, metric string, n long, delta double, significant boolean"
    compared = [("a", "mrr", 100, -0.1, True), ("a", "recall@10", 100, -0.1, False), ("b", "mrr", 10, -0.5, True), ("c", "mrr", 100, -0.01, True), ("d", "mrr", 100, 0.1, True), ("unanswerable", "mrr", 3, 0.0, False)]
    strata = [("a", 0.9, 10), ("b", None, 3000), ("unanswerable", 0.2, 2500)]
    frame = lambda rows, k: spark.createDataFrame(rows, k)
    of = lambda rows: frame(rows, "stratum string, false_answer_rate double, p95_ms long")
    got = {(r.level, r.stratum, r.metric, r.rule) for r in evaluation.findings(frame(compared, kind), of(strata)).collect()}
    assert got == {("failure", "a", "mrr", "regressed"), ("warning", "b", "mrr", "few-items"), ("warning", "unanswerable", "mrr", "few-items"), ("failure", "unanswerable", None, "false-answers"), ("warning", "b", None, "slow")}
    assert tuple(evaluation.gate(frame(compared, kind), of(strata)).first()) == (False, 2, 3)
    # False answers elsewhere do not fail; an unmeasured stratum is warned of.
    assert tuple(evaluation.gate(frame(compared[3:5], kind), of([("a", 0.9, 10)])).first()) == (True, 0, 1)


def test_two_runs_are_compared_by_both_metrics(spark):
    kind = "item_id long, stratum string, expected array<long>, retrieved array<long>"
    base = spark.createDataFrame([(i, "s", [i], [i, 0]) for i in range(1, 60)], kind)
    new = spark.createDataFrame([(i, "s", [i], [0, i]) for i in range(1, 60)], kind)
    got = {r.metric: r for r in evaluation.compared(base, new).collect()}
    assert got["mrr"].delta == -0.5 and got["mrr"].significant and got["recall@10"].delta == 0 and not got["recall@10"].significant


def test_percentiles_against_sorted_lists(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{g}", float(x)) for g, n in enumerate((1, 2, 19, 20, 21, 400)) for x in rng.integers(0, 30, n)] + [("g0", None)]
    out = evaluation.percentiles_at(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0})
    for r in out.collect():
        xs = sorted(v for g, v in rows if g == r.g and v is not None)
        assert [r.p50, r.p95, r.p100] == [xs[min(math.floor(p * len(xs)), len(xs) - 1)] for p in (0.5, 0.95, 1.0)]


def test_document_chunks_keep_all_text(spark):
    body = "intro text\n\n# First\n\n" + "\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(30)) + "\n\n```\n# not a heading\n```\n## Second *part*\nshort\n\n# Empty\n# Last\n" + "long " * 3000
    docs = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "# Only a heading")], "doc_id long, text string")
    rows = sorted(chunking.chunk_documents(docs, title=F.lit("T")).collect(), key=lambda r: (r.doc_id, r.ordinal))
    assert {r.doc_id for r in rows} == {1} and [r.ordinal for r in rows] == list(range(len(rows)))
    assert list(dict.fromkeys(r.heading for r in rows)) == ["T", "First", "Second part", "Last"]
    assert all(any(f"Paragraph {i} " in r.content for r in rows) for i in range(30)) and any("# not a heading" in r.content for r in rows)
    parts = [r.content.split("\n\n", 1)[1] for r in rows]
    assert sum(p.split().count("long") for p in parts) == 3000 and len({r.chunk_id for r in rows}) == len(rows)
    lines = body.split("\n")
    assert all(lines[r.first_line - 2].startswith("#") for r in rows if r.heading != "T")


def test_symbol_chunks_keep_all_lines(spark):
    body = "\n".join(f"line {i} " + "x" * (i % 90) for i in range(400)) + "\n" + "y" * 5000
    symbols = spark.createDataFrame([("s1", "m", "f", "function", "a.ts", body), ("s2", "m", "g", "function", "a.ts", None)], "symbol_id string, module string, name string, kind string, path string, body string")
    rows = sorted(chunking.chunk_symbols(symbols, 200).collect(), key=lambda r: (r.symbol_id, r.ordinal))
    whole = "\n".join(r.content.split("\n\n", 1)[1] for r in rows if r.symbol_id == "s1")
    assert all(f"line {i} " in whole for i in range(400)) and whole.count("y") == 5000 and all(r.tokens <= 200 for r in rows)
    assert [r.ordinal for r in rows if r.symbol_id == "s2"] == [0]
    with pytest.raises(ValueError):
        chunking.chunk_symbols(symbols, 100)
