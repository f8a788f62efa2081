"""Shapes that make an operator's work grow faster than its rows: equal names, long files, wide groups."""

import re
import time

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom import plans
from corpusloom.operators import assembly, diff, retrieval, vectors
from corpusloom.plans import bindings_graph
from corpusloom.sources import rules


def test_symbols_of_one_name_and_queries_for_it_never_meet_as_pairs(spark):
    n = 30_000
    symbols = spark.range(n).select(F.col("id").alias("symbol_id"), F.lit("hot Bolt").alias("name"))
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.lit("bolt").alias("identifier"))
    start = time.monotonic()
    found = retrieval.symbol_topk(symbols, asked).groupBy("symbol_id", "rank", "score").count().collect()
    assert {tuple(r) for r in found} == {(i, i + 1, 0.5, n) for i in range(10)}
    assert time.monotonic() - start < 60


def test_symbols_beside_a_plain_search(spark):
    names = ["Bolt", "bolt", "BOLT", "hot bolt", "x.olt", "t", "", None, "İt", "bolts"]
    symbols = [(i, names[i * 7 % len(names)]) for i in range(60)] + [(3, "second bolt"), (3, "second bolt")]
    asked = [(1, "bolt"), (1, "T"), (1, "hot bolt"), (2, "lt"), (3, ""), (4, None), (5, "none"), (6, "t"), (6, "t")]
    want = []
    for q in {q for q, _ in asked}:
        scores = {}
        for i, name in set(symbols):
            for who, wanted in asked:
                if who == q and wanted and name is not None and name.lower().endswith(wanted.lower()):
                    scores[i, name] = max(scores.get((i, name), 0), 1.0 if name.lower() == wanted.lower() else 0.5)
        best = sorted(scores, key=lambda x: (-scores[x], len(x[1]), x[0]))[:10]
        want += [(q, x[0], scores[x], n + 1) for n, x in enumerate(best)]
    got = retrieval.symbol_topk(spark.createDataFrame(symbols, "symbol_id long, name string"), spark.createDataFrame(asked, "query_id long, identifier string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def final_plan(df) -> str:
    """The plan as it ran, after the sizes of the shuffles were known."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_owners_send_rules_and_no_paths_through_the_driver(spark):
    plan = final_plan(plans.queries()["code_owners"](spark, "/root/testdata/sf0.001"))
    assert plan.count("BroadcastHashJoin") == 1


def test_owners_keep_rows_of_equal_and_null_paths(spark):
    paths = ["a/b.ts", "a/b.ts", None, None, "docs/x", "src/api/y.md", ""]
    got = rules.owners(spark.createDataFrame([(p,) for p in paths], "path string"), "/docs/ @w\n*.ts @web\nsrc/api/*.md @d\n")
    want = {"a/b.ts": ["@web"], "docs/x": ["@w"], "src/api/y.md": ["@d"]}
    assert sorted(((r.path or "~"), r.owners) for r in got.collect()) == sorted((p or "~", want.get(p, [])) for p in paths)


def test_declarations_of_one_long_file_are_not_joined_with_its_classes(spark):
    n = 6_000
    body = "\n".join(f"class C{i} {{\n  run(a: string) {{\n  }}\n}}" for i in range(n))
    files = spark.createDataFrame([("a.ts", body, "typescript")], "path string, text string, language string")
    found = assembly.declarations(files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # comments only
    assert {r.qualified_name for r in found.where("kind = 'method'").collect()} == {f"C{i}.run" for i in range(n)}


def test_declarations_belong_to_the_last_class_that_is_indented_less(spark):
    lines, want, classes = [], [], []
    for i in range(300):
        indent = (i * 7 + i // 5) % 6
        kind = ("class", "interface", "method")[i * 5 % 3]
        name = f"n{i}"
        lines.append(" " * indent + (f"{name}(a) {{" if kind == "method" else f"{kind} {name} {{"))
        owner = next((c for j, c in reversed(classes) if j < indent), None)
        if kind != "method":
            classes.append((indent, name))
        if kind != "method" or indent:  # a method is indented
            want.append((i + 1, f"{owner}.{name}" if owner else name))
    files = spark.createDataFrame([(p, "\n".join(lines), "typescript") for p in ("a", "b")], "path string, text string, language string")
    got = [tuple(r) for r in assembly.declarations(files).select("path", "line", "qualified_name").collect()]
    assert sorted(got) == sorted((p, *w) for p in "ab" for w in want)


def test_members_say_which_pairs_there_are(spark):
    """Every pair of the SQL comes back from the members' keys, repositories, languages and sides alone."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for kind, name, sql in (("shared-type", "shared_type_edges", bindings_graph.TYPE_PAIRS), ("package-dependency", "package_edges", bindings_graph.PACKAGE_PAIRS)):
        want = sorted(con.execute(f"SELECT key, src, dst FROM ({sql})").fetchall())
        m = plans.queries()[name](spark, d)
        both = plans.queries()["cross_repo_edges"](spark, d).where(F.col("kind") == kind).withColumn("id", F.regexp_replace("id", "^t", ""))
        for members in (m, both):
            a, b = members.where("side = 'source'").alias("a"), members.where("side = 'target'").alias("b")
            differs = F.expr("a.repo < b.repo and a.language <> b.language") if kind == "shared-type" else F.expr("a.repo <> b.repo")
            got = a.join(b, F.expr("a.key = b.key") & differs).select("a.key", F.col("a.id"), F.col("b.id"))
            assert want and sorted(map(tuple, got.collect())) == want


def test_scores_of_a_group_are_held_for_few_queries_at_a_time(monkeypatch):
    monkeypatch.setattr(vectors, "SCORES", 1000)
    rng = np.random.default_rng(3)
    x, asked = rng.integers(-2, 3, (500, 4)), rng.integers(-2, 3, (70, 4))
    ids = rng.permutation(500)
    most = []

    def score(items, queries):
        v = np.array(items.column("v").to_pylist(), float)

        def of(start, end):
            most.append((end - start) * len(v))
            return asked[start:end].astype(float) @ v.T

        return of

    got = vectors.top_of_groups(score, 5, "q", "i")(pa.table({"i": ids, "v": x.tolist()}), pa.table({"q": range(70)}))
    want = [(q, int(i), float(s)) for q in range(70) for s, i in sorted(zip(x @ asked[q], ids), key=lambda t: (-t[0], t[1]))[:5]]
    assert max(most) <= 1000
    # Equal scores: the smallest ids, and no more than k rows of a query.
    assert sorted(zip(*[got.column(c).to_pylist() for c in ("q", "i", "score")])) == sorted(want)


def test_term_matches_beside_a_plain_search(spark):
    words = ["alpha", "beta", "gamma", "delta", "ab", "x_1", "Alpha"]
    docs = [(i, " ".join(words[(i * 3 + j * j) % 7] for j in range(i % 9))) for i in range(60)] + [(99, None)]
    asked = [(1, "alpha beta"), (2, "ab"), (3, "none alpha"), (4, "ALPHA"), (5, "x_1, delta gamma")]
    terms = lambda t: set(re.findall("[a-z0-9_]{3,}", (t or "").lower()))
    want = [(q, i, len(terms(a)), len(terms(t))) for q, a in asked for i, t in docs if terms(a) and terms(a) <= terms(t)]
    got = retrieval.term_matches(spark.createDataFrame(docs, "i long, t string"), spark.createDataFrame(asked, "q long, a string"), "i", "t", "q", "a")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_heavy_work_on_a_small_file_is_dealt_over_the_tasks(spark):
    for name in ("normal_types", "normal_signatures", "doc_comment_parts", "signature_parameters"):
        assert plans.queries()[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_expansion_streams_its_queries_and_takes_turns(spark):
    rows = [(q, (i * 3) % 5, i % 3 + 1, (i * i + q) % 11, 40 + i * 17 % 60) for q in range(40) for i in range(12)]
    frame = spark.createDataFrame(rows, "query_id long, seed_rank long, place long, symbol_id long, tokens long")
    want = []
    for q in range(40):
        seen, used = set(), 0
        for _, _, name, t in sorted((p, r, n, t) for who, r, p, n, t in rows if who == q):
            if name not in seen and used + t <= 300:
                seen.add(name)
                used += t
                want.append((q, name, len(seen), used))
    out = retrieval.expand(frame, budget=300)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_parameter_changes_beside_a_plain_loop_and_with_one_meeting(spark):
    cols = "symbol_id long, pos int, name string, type string, optional boolean, has_default boolean, rest boolean"
    make = lambda k: [(i // 4 + k, (i * (2 + k)) % 4, [None, "a", "b", "c", "d"][(i * 3 + k * i) % 5], [None, "T", "U"][(i + k * i // 3) % 3], i % 3 == k, i % 5 == 0, i % 7 == 0) for i in range(120)]
    old, new = make(0), make(1)
    want = []
    for s in {r[0] for r in old} & {r[0] for r in new}:
        b, a = [r[1:] for r in old if r[0] == s], [r[1:] for r in new if r[0] == s]
        same = lambda x, y: x[1] is not None and x[1] == y[1]
        fresh = [y for y in a if not any(same(x, y) for x in b)]
        for x in b:
            if not any(same(x, y) for y in a):
                heirs = [y for y in fresh if y[0] == x[0] and y[2] == x[2]]
                for y in heirs or [(None, None)]:
                    want.append((s, "parameter-removed" if y[1] is None else "parameter-renamed", x[1] and x[1] + (f" → {y[1]}" if y[1] else "")))
            for y in a:
                if same(x, y):
                    want += [(s, "parameter-type-changed", f"{x[1]}: {x[2] or '(untyped)'} → {y[2] or '(untyped)'}")] * (x[2] != y[2]) + [(s, "parameter-made-required", y[1])] * (x[3] and not y[3])
        want += [(s, "parameter-added-required", y[1]) for y in fresh if not any(y[3:])]
    out = diff.parameter_changes(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
