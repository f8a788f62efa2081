"""Queries over the driver's tables: conformance, work lists, cross-repository passes, indexing, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import cross_repo, graph, indexing, platform
from corpusloom.operators.module_index import index_module, read_index
from corpusloom.operators.symbol_chunks import symbol_chunks as symbol_chunks_of
from corpusloom.operators.tables import shared_folder
from corpusloom.plans import bindings_graph
from corpusloom.plans.bindings_assembly import _fill
from corpusloom.plans.bindings_scan import table
from corpusloom.sources import connector, repository, store

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""
WITH s AS (SELECT p_type AS emission, p_partkey AS k, p_name AS q, p_size AS z FROM part)
SELECT emission, rule, count(*) AS n FROM (SELECT emission, 'empty-name' AS rule FROM s WHERE k % 11 = 0 UNION ALL SELECT emission, 'name-not-last' FROM s WHERE k % 7 = 0 AND k % 11 <> 0 UNION ALL SELECT emission, 'bad-range' FROM s WHERE k % 5 = 0
 UNION ALL SELECT emission, 'depth-overclaimed' FROM s WHERE z % 3 = 0 UNION ALL SELECT emission, 'source-text' FROM s WHERE z % 13 = 0
 UNION ALL SELECT emission, 'same-identity' FROM s GROUP BY emission, q, z % 2 HAVING count(*) > 1 UNION ALL SELECT emission, 'missing-parent' FROM s WHERE k % 4 = 0 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.emission = s.emission AND t.q = CASE WHEN s.k % 8 = 0 THEN s.q ELSE 'none' END)) GROUP BY ALL
""")
def conformance(spark, d):
    """Violations of the rules for analysers."""
    k, z = F.col("p_partkey"), F.col("p_size")
    last = F.element_at(F.split("p_name", " "), -1)
    x = table(spark, d, "part").select(
        F.col("p_type").alias("emission"), F.when(k % 11 == 0, "").when(k % 7 == 0, "elsewhere").otherwise(last).alias("name"), F.col("p_name").alias("qualified_name"), F.when(k % 5 == 0, 0).otherwise(3).alias("start_line"), F.lit(9).alias("end_line"),
        F.lit("semantic").alias("depth"), F.when(z % 3 == 0, F.array(F.lit(None).cast("string"))).when(z % 3 == 1, F.array(F.lit("T"), F.lit(None))).otherwise(F.array().cast("array<string>")).alias("parameter_types"), F.when(z % 13 == 0, "text").alias("source_text"), F.lit("f").alias("kind"), (z % 2).cast("string").alias("overload"), F.when(k % 8 == 0, F.col("p_name")).when(k % 4 == 0, "none").alias("parent"),
    )
    return indexing.conformance(x)


@query("""
WITH r AS (SELECT doc_id AS ordinal, md5(coalesce(lang, '') || n_chars % 50) AS signature_hash, doc_id % 4 AS t FROM documents)
SELECT min(ordinal) AS ordinal, signature_hash FROM r WHERE t <> 3 AND signature_hash NOT IN (SELECT signature_hash FROM r WHERE ordinal % 9 = 0) GROUP BY signature_hash
""")
def blurb_worklist(spark, d):
    """One request a signature, without cached and restricted ones."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.md5(F.concat(F.coalesce("lang", F.lit("")), (F.col("n_chars") % 50).cast("string"))).alias("signature_hash"), F.when(F.col("doc_id") % 4 == 3, "restricted").otherwise("internal").alias("sensitivity"))
    return indexing.blurb_worklist(x, x.where("ordinal % 9 = 0")).select("ordinal", "signature_hash")


#: All pairs of the three kinds, for the SQL only. A type's id has a letter, so that it is no supplier's.
_CROSS = f"""
e AS (SELECT 'api-contract' AS kind, 0.95::DOUBLE AS confidence, lower(substr(s_name, -3)) AS key, s_suppkey::VARCHAR AS src, c_custkey::VARCHAR AS dst, s_nationkey::VARCHAR AS src_repo, c_nationkey::VARCHAR AS dst_repo, NULL::VARCHAR AS src_language, NULL::VARCHAR AS dst_language FROM supplier JOIN customer ON lower(substr(s_name, -3)) = lower(substr(c_name, -3)) AND s_nationkey <> c_nationkey
 UNION ALL SELECT 'package-dependency', 0.9::DOUBLE, key, src, dst, src_repo, dst_repo, NULL, NULL FROM ({bindings_graph.PACKAGE_LINKS})
 UNION ALL SELECT 'shared-type', 0.7::DOUBLE, key, 't' || src, 't' || dst, src_repo, dst_repo, src_language, dst_language FROM ({bindings_graph.TYPE_LINKS}))"""


def _cross(spark, d):
    named = bindings_graph.types(spark, d).withColumn("id", F.concat(F.lit("t"), "id"))
    return cross_repo.all_links(bindings_graph.contract_sides(spark, d, 3), bindings_graph.package_sides(spark, d), named)


@query(f"WITH {_CROSS} SELECT kind, key, src AS id, src_repo AS repo, src_language AS language, 'source' AS side, count(*) AS links, confidence FROM e GROUP BY ALL UNION ALL SELECT kind, key, dst, dst_repo, dst_language, 'target', count(*), confidence FROM e GROUP BY ALL")
def cross_repo_edges(spark, d):
    """All links between repositories: who takes part, in which class and repository, with how many links."""
    return _cross(spark, d)[1]


@query(f"WITH e AS ({bindings_graph.TYPE_PAIRS}) SELECT key, src, dst FROM e ORDER BY src, key, dst LIMIT 5000")
def cross_repo_page(spark, d):
    """The first 5000 pairs of shared types."""
    return cross_repo.page(cross_repo.other_language(bindings_graph.types(spark, d))[1], 5000)


@query(f"WITH {_CROSS} SELECT src FROM (SELECT s_suppkey::VARCHAR AS src FROM supplier UNION ALL SELECT r_name FROM region) WHERE src NOT IN (SELECT src FROM e)")
def pending_references(spark, d):
    """References that no edge of any kind answers."""
    refs = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("src")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("src")))
    linked = _cross(spark, d)[1].where("side = 'source'")
    return graph.pending(refs, linked.select(F.col("id").alias("src")))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 100 AS r FROM orders)
SELECT id AS seed_id, c AS symbol_id, 'callee' AS relation FROM s UNION SELECT id, c + 1, 'callee' FROM s UNION SELECT id, r, 'type' FROM s WHERE r % 2 = 0 UNION SELECT id, c * 3, 'caller' FROM s UNION SELECT l_partkey, l_suppkey, 'callee' FROM lineitem
""")
def neighbour_edges(spark, d):
    """All kinds of neighbours in one table."""
    k, c, r = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 100
    none = F.array().cast("array<bigint>")
    x = table(spark, d, "orders").select(k.alias("symbol_id"), F.array(c, c + 1).cast("array<bigint>").alias("calls"), F.when(r % 2 == 0, F.array(r).cast("array<bigint>")).otherwise(none).alias("references"), F.array(c * 3).cast("array<bigint>").alias("users"))
    return indexing.neighbour_edges(x, table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("""
WITH m AS (SELECT DISTINCT p_brand AS module, p_type AS project FROM part WHERE p_size < 25), w AS (SELECT DISTINCT p_brand AS module, 'new' || p_size % 3 AS project FROM part)
SELECT module, project FROM m WHERE module NOT IN ('Brand#1', 'Brand#2') UNION SELECT module, project FROM w WHERE module IN ('Brand#1', 'Brand#2')
""")
def reconciled_memberships(spark, d):
    """Memberships of a run's modules replaced, others kept."""
    p = table(spark, d, "part")
    have = p.where("p_size < 25").select(F.col("p_brand").alias("module"), F.col("p_type").alias("project")).distinct()
    want = p.select(F.col("p_brand").alias("module"), F.concat(F.lit("new"), (F.col("p_size") % 3).cast("string")).alias("project")).distinct()
    return indexing.reconcile(have, want, spark.createDataFrame([("Brand#1",), ("Brand#2",)], "module string"))


@query("""
WITH s AS (SELECT 'o' || p_size % 2 AS org, p_brand AS previous_id, min(p_partkey)::VARCHAR AS symbol_id FROM part GROUP BY ALL), r AS (SELECT 'o' || p_size % 2 AS org, p_brand AS previous_id, last(p_name ORDER BY p_partkey) AS symbol_id FROM part WHERE p_size % 3 = 0 GROUP BY ALL)
SELECT * FROM r UNION ALL SELECT * FROM s WHERE (org, previous_id) NOT IN (SELECT (org, previous_id) FROM r)
""")
def alias_redirects(spark, d):
    """New redirects over stored ones, the last writer of several."""
    p = table(spark, d, "part").withColumn("org", F.concat(F.lit("o"), (F.col("p_size") % 2).cast("string"))).withColumnRenamed("p_brand", "previous_id")
    stored = p.groupBy("org", "previous_id").agg(F.min("p_partkey").cast("string").alias("symbol_id"))
    return indexing.redirects(stored, p.where("p_size % 3 = 0").select("org", "previous_id", F.col("p_name").alias("symbol_id"), F.col("p_partkey").alias("ordinal")))


@query("""
SELECT p_partkey, '{"id":0,"name":"' || p_name || '","tags":["<tags>"],"on":true,"kind":"a","deep":{"x":{"y":"<y>"}},"at":"2026-08-20T09:00:00Z"}' AS example FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 3 = 0
""")
def schema_examples(spark, d):
    """Examples of schemas with references, choices and defaults (F-A4)."""
    schema = '{"type":"object","properties":{"id":{"type":"integer"},"name":{"type":"string","default":"{n}"},"tags":{"type":"array","items":{"type":"string"}},"on":{"type":"boolean"},"kind":{"enum":["a","b"],"default":"b"},"deep":{"$ref":"#/components/schemas/Deep"},"at":{"type":"string","format":"date-time"}}}'
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "{broken").otherwise(_fill(schema, n=F.col("p_name"))).alias("schema"), F.lit('{"Deep":{"properties":{"x":{"type":"object","properties":{"y":{"type":"string"}}}}}}').alias("components"))
    return indexing.with_examples(x).select("p_partkey", "example")


@query("""
SELECT 'web' || p_partkey AS name, 'img/' || replace(p_name, ' ', '-') || ':1' AS image, ['db' || p_partkey, 'cache'] AS depends_on, ['80', '443'] AS ports, 'd' || p_partkey || '/docker-compose.yml' AS path FROM part
UNION ALL SELECT 'db' || p_partkey, NULL, ['cache'], [], 'd' || p_partkey || '/docker-compose.yml' FROM part
""")
def compose_services(spark, d):
    """Services of compose files with images, dependencies and ports."""
    text = _fill('version: "3"\nservices:\n  # front\n  web{k}:\n    image: "img/{n}:1"\n    depends_on: [db{k}, \'cache\']\n    ports:\n      - "8080:80"\n      - 443\n  db{k}:\n    build: .\n    depends_on:\n      cache:\n        condition: up\nvolumes:\n  data: {}\n', k=F.col("p_partkey"), n=F.regexp_replace("p_name", " ", "-"))
    files = table(spark, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("/docker-compose.yml")).alias("path"), text.alias("text"))
    return repository.compose_services(files)


@query("""
SELECT o_custkey AS repo, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS bundle, bool_or(o_orderstatus = 'P') AS waiting, count(*) AS bundles, (sum(count(*)) OVER ())::BIGINT AS total FROM orders GROUP BY o_custkey
""")
def repository_status(spark, d):
    """The latest bundle of each repository and the number of all."""
    o = table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("repo")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("waiting"), F.count("*").alias("bundles"))
    last = store.latest(o, ["o_custkey"], F.col("o_orderdate"), "o_orderkey").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("bundle"))
    total = o.agg(F.count("*").alias("total"))
    return per.join(last, "repo").crossJoin(F.broadcast(total))  # one row


@query("""
SELECT source AS slug, lang AS repo, doc_id, 'reference' AS type FROM documents WHERE source IS NOT NULL AND doc_id % 4 <= 1 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1
""")
def listed_documents(spark, d):
    """The latest document of each repository and slug in readable tiers."""
    from corpusloom.operators import scanner

    tiers = F.array(*[F.lit(t) for t in scanner.TIERS])
    x = table(spark, d, "documents").where("source is not null").withColumn("tier", F.get(tiers, (F.col("doc_id") % 4).cast("int"))).where(scanner.visible_to(F.col("tier"), F.lit("internal")))
    return store.latest(x, ["lang", "source"], F.col("n_chars"), "doc_id").select(F.col("source").alias("slug"), F.col("lang").alias("repo"), "doc_id", F.lit("reference").alias("type"))


@query("SELECT 'documents' AS name UNION ALL SELECT 'labels'")
def tables_without_tenant(spark, d):
    """Tables that lack the tenant's column."""
    for name in ("documents", "labels", "orders"):
        table(spark, d, name).createOrReplaceTempView(f"tenant_{name}")
    table(spark, d, "orders").withColumn("org", F.lit("o1")).createOrReplaceTempView("tenant_orders")
    found = platform.tables_without_column(spark, ["tenant_documents", "tenant_labels", "tenant_orders"])
    return spark.createDataFrame([(n.removeprefix("tenant_"),) for n in found], "name string")


@query()
def index_documents(spark, d):
    """Documents to chunks with hashes, the cached ones apart."""
    docs = table(spark, d, "documents")
    chunks, _ = indexing.index_documents(docs, spark.createDataFrame([], "content_hash string"), title=F.col("source"))
    return chunks.select("doc_id", "ordinal", "tokens", "content_hash", "cached")


_SYMBOLS = """
s AS (SELECT p_partkey AS symbol_id, p_partkey AS k, p_size AS z, p_brand AS module, p_type AS t, replace(p_name, ' ', '.') AS q FROM part),
c AS (SELECT symbol_id, k, z, concat_ws(chr(10), '// Module: ' || module || CASE WHEN k % 2 = 0 THEN ' (pkg-' || z || ')' ELSE '' END, '// File: src/' || k || '.ts', CASE WHEN k % 3 = 0 AND instr(q, '.') > 0 THEN '// Declared in: ' || regexp_replace(q, '\\.[^.]*$', '') END, '// Kind: public function', CASE WHEN z % 4 = 0 THEN '// Analysis: shallow — signature as written, types not resolved' END, CASE WHEN k % 5 = 0 THEN '// Context: says ' || t END)
 || chr(10) || chr(10) || concat_ws(chr(10), q, 'f(a: ' || z || ')', CASE WHEN k % 2 = 1 THEN chr(10) || 'Does ' || t END, CASE WHEN z % 3 > 0 THEN chr(10) || 'Parameters:' || chr(10) || '  a' || CASE WHEN z % 2 = 0 THEN '?' ELSE '' END || ': ' || CASE WHEN z % 3 = 1 THEN 'string' ELSE 'unknown' END || CASE WHEN k % 4 = 0 THEN ' — of ' || t ELSE '' END END,
 CASE WHEN z % 5 = 0 THEN chr(10) || 'Returns: number' END, CASE WHEN k % 7 = 0 THEN chr(10) || 'Throws:' || chr(10) || '  Bad: ' || t END, CASE WHEN k % 11 = 0 THEN chr(10) || 'DEPRECATED: no reason given' END, CASE WHEN k % 6 = 0 THEN chr(10) || 'HTTP: GET /' || z END, CASE WHEN k % 6 = 0 THEN 'Auth: key, oauth' END, CASE WHEN k % 6 = 0 THEN 'Responses: 200 ok; 404' END, CASE WHEN z % 6 = 0 THEN chr(10) || 'Attributes: @a @b' END)
 || CASE WHEN z % 2 = 1 THEN chr(10) || chr(10) || 'return ' || t || ';' ELSE '' END AS content FROM s)"""


def _symbols(spark, d):
    k, z, t = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    text = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    return table(spark, d, "part").select(
        k.alias("symbol_id"), F.col("p_brand").alias("module"), F.when(k % 2 == 0, text("pkg-", z.cast("string"))).alias("package"), text("src/", k.cast("string"), ".ts").alias("path"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("qualified_name"), F.when(k % 3 == 0, "up").alias("parent_id"),
        F.lit("public").alias("visibility"), F.lit("function").alias("kind"), F.when(z % 4 == 0, "shallow").otherwise("semantic").alias("depth"), F.when(k % 5 == 0, text(" says\n ", t)).alias("blurb"), text("f(a: ", z.cast("string"), ")").alias("signature"), F.when(k % 2 == 1, text("Does ", t)).alias("summary"), F.lit(None).cast("string").alias("description"),
        F.when(z % 3 > 0, F.array(F.struct(F.lit("a").alias("name"), F.when(z % 3 == 1, "string").alias("type"), (z % 2 == 0).alias("optional"), F.when(k % 4 == 0, text("of ", t)).alias("description")))).alias("parameters"),
        F.when(z % 5 == 0, "number").alias("return_type"), F.lit(None).cast("string").alias("returns"), F.when(k % 7 == 0, F.array(F.struct(F.lit("Bad").alias("type"), t.alias("description")))).alias("throws"), F.when(k % 11 == 0, "").alias("deprecated"),
        F.when(k % 6 == 0, F.struct(F.lit("GET").alias("method"), text("/", z.cast("string")).alias("route"), F.lit(None).cast("string").alias("operation_id"), F.array(F.lit("key"), F.lit("oauth")).alias("schemes"), F.array(F.struct(F.lit("200").alias("status"), F.lit("ok").alias("description")), F.struct(F.lit("404").alias("status"), F.lit("").alias("description"))).alias("responses"))).alias("http"),
        F.when(z % 6 == 0, F.array(F.lit("@a"), F.lit("@b"))).alias("decorators"), F.when(z % 2 == 1, text("return ", t, ";")).alias("source_text"), F.when(z % 9 == 0, "restricted").otherwise("internal").alias("sensitivity"),
    )


@query(f"WITH {_SYMBOLS} SELECT symbol_id, 0 AS ordinal, CASE WHEN k % 6 = 0 THEN 'spec' ELSE 'code' END AS corpus, content, sha256(content) AS content_hash FROM c")
def symbol_chunks(spark, d):
    """Header, facts and source of each symbol as one chunk."""
    return symbol_chunks_of(_symbols(spark, d)).select("symbol_id", "ordinal", "corpus", "content", "content_hash")


@query(f"""
WITH {_SYMBOLS}, n AS (SELECT symbol_id, content FROM c WHERE z % 9 <> 0 AND k % 10 <> 3)
SELECT symbol_id, 'o' AS org, 'parts' AS module, '1' AS version, content, (SELECT count(*) FROM n) AS first_written, (SELECT count(*) FROM c WHERE z % 9 <> 0 AND k % 10 = 3) AS second_deleted, true AS third_skipped FROM n
""")
def module_index(spark, d):
    """A module indexed, indexed again without some of its symbols, and once more without a change."""
    root = f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}/module-index-{uuid.uuid4().hex}"
    x = _symbols(spark, d)
    none = spark.createDataFrame([], "content_hash string")
    run = lambda rows: index_module(rows, none, root, "o", "parts", "1")
    run(x.where("symbol_id % 10 = 3"))
    run(x.where("symbol_id % 10 = 3"))
    second = run(x.where("symbol_id % 10 <> 3"))
    third = run(x.where("symbol_id % 10 <> 3"))
    out = read_index(spark, root).select("symbol_id", "org", "module", "version", "content")
    return out.withColumns({"first_written": F.lit(second.written).cast("long"), "second_deleted": F.lit(second.deleted).cast("long"), "third_skipped": F.lit(third.skipped)})


@query("""
WITH x AS (SELECT doc_id, source, text, doc_id % 10 AS m FROM documents), c AS (SELECT count(*) FILTER (WHERE m IN (1, 3)) AS upserts, count(*) FILTER (WHERE m = 2) AS tombstones FROM x)
SELECT doc_id::VARCHAR AS external_id, CASE WHEN m = 3 THEN 'r2' ELSE 'r1' END AS revision, source AS title, sha256(coalesce(text, '')) AS content_sha256, upserts, tombstones FROM x, c WHERE m <> 2
""")
def connector_pulls(spark, d):
    """Two listings of a source published as changes, pulled page by page from cursors, and applied."""
    connector.register(spark)
    root = f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}/feed-{uuid.uuid4().hex}"
    m = F.col("doc_id") % 10
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("external_id"), m.alias("m"), F.lit("r1").alias("revision"), F.col("source").alias("title"), F.lit("reference").alias("document_type"), F.coalesce("text", F.lit("")).alias("content"))
    pull = lambda after, n: spark.read.format(connector.FORMAT).option("path", root).option("after", after).option("pages", n).load()
    connector.publish(x.where("m <> 1").drop("m"), root)
    state, at = None, ""
    while connector.has_more(root, at):
        page = pull(at, 64)
        first = page.where("not deleted").drop("deleted")
        state = first if state is None else connector.apply_changes(state, page)
        at = connector.next_cursor(page, at)
    connector.publish(x.where("m <> 2").withColumn("revision", F.when(F.col("m") == 3, "r2").otherwise("r1")).drop("m"), root)
    changes = pull(at, 1 << 20)
    counts = changes.agg(F.count_if(~F.col("deleted")).alias("upserts"), F.count_if("deleted").alias("tombstones"))
    state = pull("", 1 << 20).where("false").drop("deleted") if state is None else state
    out = connector.apply_changes(state, changes).select("external_id", "revision", "title", F.sha2("content", 256).alias("content_sha256"))
    return out.crossJoin(F.broadcast(counts))
