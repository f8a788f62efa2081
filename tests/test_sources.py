"""Trees, stores, streams and refusals on small inputs."""

import datetime
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import normalize
from corpusloom.operators import access, assembly, dedupe, graph, indexing, scanner
from corpusloom.sources import repository, store
from corpusloom.streaming import access as streams

DAY = datetime.datetime(2024, 1, 1)


def test_walk_leaves_out_what_is_not_read(spark, tmp_path):
    tree = {"src/a.ts": "x", "src/b.py": "y", ".env": "S=1", "node_modules/m/i.js": "z", "logo.png": "p", "docs/deep/x.md": "d", "build/x": "b", "logs/a.log": "l", "logs/keep.log": "k", "tmp/t.txt": "t"}
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = repository.walk(spark, str(tmp_path), exclude=["docs/**"], ignore="# no logs\n*.log\n!keep.log\n/tmp/\n")
    assert sorted((r.path, bytes(r.content).decode()) for r in found.collect()) == [("logs/keep.log", "k"), ("src/a.ts", "x"), ("src/b.py", "y")]
    assert {r.path: r.language for r in repository.with_language(found).collect()} == {"src/a.ts": "typescript", "src/b.py": "python", "logs/keep.log": None}


def test_modules_claim_files(spark):
    files = spark.createDataFrame([("a/x.ts",), ("a/b/y.ts",), ("c/z.py",)], "path string")
    found = spark.createDataFrame([("a",), ("a/b",)], "dir string")
    assert {r.path: r.dir for r in repository.modules(files, found).collect()} == {"a/x.ts": "a", "a/b/y.ts": "a/b", "c/z.py": "."}


def test_bundles_and_swaps(spark, tmp_path):
    root, schema = str(tmp_path / "bundles"), T.StructType.fromDDL("org string, repo string, sha string, version string, n long")
    store.write_bundles(spark.createDataFrame([("o", "r1", "a", "2.0", 1), ("o", "r2", "b", "1.3", 2), ("p", "r1", "c", "3.0", 3)], schema), root)
    store.write_bundles(spark.createDataFrame([("o", "r1", "a", "2.0", 9)], schema), root)
    read = store.read_bundles(spark, root, schema, "o")
    assert sorted((r.repo, r.n) for r in read.collect()) == [("r1", 9), ("r2", 2)]
    assert [r.n for r in store.read_bundles(spark, root, schema, "o", "r2").collect()] == [2]
    table = str(tmp_path / "chunks")
    store.swap(spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 3)], "module string, id long"), table, ["module"])
    store.swap(spark.createDataFrame([("m1", 5)], "module string, id long"), table, ["module"])
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [3, 5]


def test_signatures_of_bundles(spark):
    key = b"k" * 100
    body = "\n".join([hashlib.sha256(b"p").hexdigest(), "n1", "c"])
    good = hmac.new(key, body.encode(), hashlib.sha256).hexdigest()
    rows = [(1, good), (2, good[::-1])]
    e = spark.createDataFrame(rows, "id long, signature string").withColumns({"size": F.lit(1), "payload": F.lit("p"), "payload_hash": F.sha2(F.lit("p"), 256), "scan_passed": F.lit(True), "expires_at": F.to_timestamp(F.lit("2030-01-01")), "nonce": F.lit("n1"), "commit": F.lit("c"), "expected_commit": F.lit("c")})
    got = store.verify(e, spark.createDataFrame([], "nonce string"), F.to_timestamp(F.lit("2025-01-01")), key=key)
    assert {r.id: r.failure for r in got.collect()} == {1: None, 2: "bad-signature"}
    for k in (b"", b"short", b"x" * 64, b"x" * 65):
        assert spark.range(1).select(store.hmac_sha256(k, F.encode(F.lit("msg"), "UTF-8"))).first()[0] == hmac.new(k, b"msg", hashlib.sha256).hexdigest()


def test_access_fails_closed():
    with pytest.raises(access.AccessDenied):
        access.allowed(access.Access("o1", ["r"]), "o2")
    with pytest.raises(access.AccessDenied):
        access.allowed(access.Access("o1", []), "o1")


def test_scopes_narrow_by_the_first_part_that_is_set(spark):
    rows = spark.createDataFrame([(1, "m1", "r1", ["p1"], "v1"), (2, "m2", "r1", ["p2"], "v1"), (3, "m3", "r2", ["p1", "p2"], "v2")], "id long, module string, repo string, project_ids array<string>, version string")
    ids = lambda s: [r.id for r in rows.where(access.in_scope(s)).orderBy("id").collect()]
    S = access.Scope
    assert [ids(S(["m1"], ["r2"])), ids(S(repos=["r1"], projects=["p2"])), ids(S(projects=["p2"])), ids(S()), ids(S(version="v2")), ids(S(repos=["r1"], version="v2"))] == [[1], [1, 2], [2, 3], [1, 2, 3], [3], []]


def test_findings_past_any_number_reach_the_gate(spark):
    noise = "\n".join(f"mail{i}@corp.com" for i in range(150))
    secret = "AKIA" + "ABCDEFGH12345678"
    files = spark.createDataFrame([(1, f"{noise}\n  key {secret} and {secret}\n"), (2, None), (3, "")], "id long, text string")
    found = scanner.scan(files, "id", F.lit("a.txt"), "text", allow=[("*.txt", "email-address")])
    got = sorted((r.line, r.column) for r in found.where("rule = 'aws-access-key-id'").collect())
    assert got == [(151, 7), (151, 32)] and found.where("suppressed").count() == 150
    assert not scanner.gate(found).first().passed
    assert scanner.scan(files, "id", F.lit("a.txt"), "text", most=100).count() == 100
    own = scanner.scan(files, "id", F.lit("a.txt"), "text", scanner.custom_rules([("ours", r"key \w+", "high")]))
    assert [r.line for r in own.where("rule = 'ours'").collect()] == [151]
    big = spark.createDataFrame([(1, "a.py", "x" * 100), (2, ".env", "x"), (3, "b.png", "x"), (4, "c.py", "x")], "id long, path string, text string")
    assert {r.id: r.reason for r in scanner.skipped_files(big, "id", F.col("path"), "text", 50).collect()} == {1: "too-large", 2: "denied-path", 3: "binary-or-generated"}
    assert [r.severity for r in scanner.by_severity(found).limit(2).collect()] == ["critical", "critical"]


def test_places_against_a_plain_search(spark):
    """Matches that hold line ends, stand at the start or the end, or follow each other."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab\ncd", "a\n", "x", "\n", "é", "b\n\nc", " "]) for _ in range(rng.choice([0, 1, 7, 60]))) for _ in range(60)]
    own = [scanner.Rule("one", "secret", "high", r"b\n+c"), scanner.Rule("two", "injection", "low", r"a\s?")]
    rows = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "id long, text string")
    got = sorted((r.id, r.rule, r.line, r.column) for r in scanner.scan(rows, "id", F.lit("a.txt"), "text", own).collect())
    want = [(i % 50, r.id, t.count("\n", 0, m.start()) + 1, m.start() - t.rfind("\n", 0, m.start())) for i, t in enumerate(texts) for r in own for m in re.finditer(r.pattern, t)]
    assert len(want) > 500 and got == sorted(want)


def test_rules_are_told_apart_by_their_hash():
    assert scanner.ruleset_hash() == scanner.ruleset_hash(scanner.RULES[::-1]) != scanner.ruleset_hash(scanner.RULES[1:])


def test_leaders_against_a_plain_loop(spark, tmp_path):
    """A chain of fingerprints, each a bit or two from the next: leaders are not components."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    import random

    rng = random.Random(3)
    prints, x = [], 0
    for i in range(70):
        prints.append((i, x))
        x ^= 1 << (i % 60)
        if i % 7 == 0:
            x ^= 1 << rng.randrange(60)
    prints += [(100 + i, rng.getrandbits(62)) for i in range(20)] + [(200, prints[5][1])]
    rng.shuffle(prints)
    df = spark.createDataFrame(prints, "chunk_id long, simhash long")
    first = df.groupBy("simhash").agg(F.min("chunk_id").alias("first"))
    got = {r.simhash: r.leader for r in dedupe.elect_leaders(first, dedupe.hamming_pairs(df)).collect()}
    want, heads = {}, []
    for i, s in sorted((min(i for i, t in prints if t == s), s) for s in {s for _, s in prints}):
        near = [j for j, t in heads if bin(s ^ t).count("1") <= 3]
        want[s] = near[0] if near else i
        heads += [] if near else [(i, s)]
    assert got == want
    labels = {r.simhash: r.label for r in dedupe.fingerprint_groups(df, dedupe.hamming_pairs(df)).collect()}
    chain = {s for i, s in prints if i < 70}
    assert len({labels[s] for s in chain}) == 1 and len(labels) == len({s for _, s in prints})


def test_chain_breaks(spark):
    rows = spark.createDataFrame([("o", i, str(i)) for i in range(5)] + [("p", 0, "x")], "org string, seq long, body string")
    made = graph.chain(rows, "org", "seq", ["body"])
    assert graph.chain_breaks(made).count() == 0
    assert graph.chain_breaks(made.withColumn("hash", F.when(F.col("seq") == 2, "forged").otherwise(F.col("hash")))).select("seq").collect() == [(3,)]


def test_normal_types():
    cases = {"b | a": "a | b", "{ x: B | A; y?: D | C }": "{ x: A | B; y?: C | D }", "(b: Z | Y) => B | A": "(b: Y | Z) => A | B", "Map<K, 'b' | 'a'>[]": "Map<K, 'a' | 'b'>[]", "T extends A ? D | C : F | E": "T extends A ? C | D : E | F", "B & A": "B & A", "": "", "'x | y'": "'x | y'"}
    assert {k: normalize.ordered_type(k) if k else "" for k in cases} == cases


def test_parameters():
    got = normalize.parameters_of("async f(self, a, b: dict[str, int] = {}, *args, **kw)", "python")
    assert [(p["name"], p["type"], p["optional"], p["rest"]) for p in got] == [("self", None, False, False), ("a", None, False, False), ("b", "dict[str, int]", True, False), ("args", None, False, True), ("kw", None, False, True)]
    got = normalize.parameters_of("Task Run([FromBody] Order body, params string[] tags, int n = 3)", "csharp")
    assert [(p["name"], p["type"], p["rest"], p["default"]) for p in got] == [("body", "Order", False, None), ("tags", "params string[]", True, None), ("n", "int", False, "3")]
    assert normalize.parameters_of("x", "") == normalize.parameters_of("f()", "") == []


def test_declarations_of_python_and_csharp(spark):
    py = 'class A(Base):\n    """Docs of A."""\n    def _run(self):\n        pass\n\n# says what\n# it does\ndef free(x):\n    return 1\n'
    cs = "namespace N;\n/// <summary>Sums.</summary>\npublic class Calc\n{\n    private int Add(int a, int b)\n    {\n        return a;\n    }\n    public static void Main(string[] args) { }\n}\n"
    files = spark.createDataFrame([("a.py", py, "python"), ("b.cs", cs, "csharp"), ("c.py", None, "python")], "path string, text string, language string")
    got = [(r.path, r.line, r.kind, r.qualified_name, r.visibility, r.doc) for r in assembly.declarations(files).orderBy("path", "line").collect()]
    assert got == [("a.py", 1, "class", "A", "public", "Docs of A."), ("a.py", 3, "method", "A._run", "private", None), ("a.py", 8, "function", "free", "public", "says what\nit does"), ("b.cs", 3, "class", "Calc", "public", "<summary>Sums.</summary>"), ("b.cs", 5, "method", "Calc.Add", "private", None)]


def test_pushes_and_jobs_in_a_stream(spark, tmp_path):
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    rows = [("r", "main", "a", at(0)), ("r", "main", "b", at(30)), ("r", "main", "c", at(400)), ("r", "dev", "d", at(31)), ("r", "main", "z", at(5000))]
    kind = "repo string, ref string, sha string, ts timestamp"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    assert {(r.ref, r.sha, r.pushes) for r in run(streams.coalesced_pushes(stream), "pushes")} == {("main", "b", 2), ("main", "c", 1), ("dev", "d", 1)}
    again = stream.withColumn("job_id", F.concat("repo", "ref"))
    assert sorted(r.job_id for r in run(streams.once(again), "jobs")) == ["rdev", "rmain"]
    hours = run(streams.hourly_breadth(stream.withColumn("principal", F.lit("p"))), "hours")
    assert [(r.calls, r.repos) for r in hours] == [(4, 1)]


def test_index_documents_splits_by_the_cache(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, "two text"), (3, "two text"), (4, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "content_hash string")
    chunks, misses = indexing.index_documents(docs, none, title=F.lit("t"))
    assert chunks.where("cached").count() == 0 and (chunks.count(), misses.count()) == (3, 2)
    known = chunks.where("doc_id = 2").select("content_hash")
    chunks, misses = indexing.index_documents(docs, known, title=F.lit("t"))
    assert sorted((r.doc_id, r.cached) for r in chunks.collect()) == [(1, False), (2, True), (3, True)]
    assert [r.doc_id for r in misses.collect()] == [1]


def test_index_symbols_embeds_representatives(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    body = " ".join(f"word{i}" for i in range(80))
    rows = [("s1", "m", "f", "function", "a.ts", body, "internal", None), ("s2", "m", "f", "function", "a.ts", body, "internal", None), ("s3", "m", "g", "function", "a.ts", "short", "internal", None), ("s4", "m", "h", "function", "a.ts", body, "restricted", None), ("s5", "m", "A.x", "enum-member", "a.ts", "x", "internal", None)]
    symbols = spark.createDataFrame(rows, "symbol_id string, module string, name string, kind string, path string, body string, sensitivity string, doc string")
    out, misses = indexing.index_symbols(symbols, spark.createDataFrame([], "content_hash string"))
    got = {r.symbol_id: r.is_representative for r in out.collect()}
    assert set(got) == {"s1", "s2", "s3"} and got["s3"] and got["s1"] != got["s2"]
    assert {r.symbol_id for r in misses.collect()} == {"s3", "s1" if got["s1"] else "s2"}


def test_services_of_one_name(spark):
    rows = [("db", None, ["a"], ["1"], "y"), ("db", "postgres", ["b", "a"], [], "z"), ("db", "other", None, ["2"], "x")]
    got = repository.merge_services(spark.createDataFrame(rows, "name string, image string, depends_on array<string>, ports array<string>, path string")).first()
    assert (got.image, got.depends_on, got.ports) == ("other", ["a", "b"], ["1", "2"])
