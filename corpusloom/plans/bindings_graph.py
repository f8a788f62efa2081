"""Queries over the driver's tables: snapshots, edges, invariants, rollups, sets and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import cross_repo, diff, graph
from corpusloom.plans.bindings_scan import table
from corpusloom.sources import store
from corpusloom.streaming import access as streams

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_OLD = """SELECT 's' || p_partkey AS symbol_id, p_name AS name, p_type AS module, md5(p_name) AS signature_hash, p_name AS signature, 'public' AS visibility, md5(p_brand) AS doc_hash, p_brand AS body_hash, NULL AS deprecated, CASE WHEN p_size % 9 = 0 THEN p_type END AS http, 'src/' || p_type AS path, p_size AS line, p_partkey FROM part WHERE p_partkey % 10 <> 1"""
_NEW = """SELECT CASE WHEN p_partkey % 10 = 2 THEN 'n' || p_partkey ELSE 's' || p_partkey END AS symbol_id, CASE WHEN p_partkey % 10 = 2 THEN ['s' || p_partkey] ELSE [] END AS previous_ids, p_name AS name, p_type AS module,
 md5(p_name || CASE WHEN p_partkey % 10 = 3 THEN '!' ELSE '' END) AS signature_hash, p_name || CASE WHEN p_partkey % 20 = 9 THEN ' ' ELSE '' END AS signature, CASE WHEN p_partkey % 10 = 4 THEN 'private' ELSE 'public' END AS visibility,
 md5(p_brand || CASE WHEN p_partkey % 10 = 5 THEN '!' ELSE '' END) AS doc_hash, p_brand || CASE WHEN p_partkey % 10 = 6 THEN '!' ELSE '' END AS body_hash, CASE WHEN p_partkey % 10 = 7 THEN 'yes' END AS deprecated,
 CASE WHEN p_size % 9 = 0 THEN p_type || CASE WHEN p_partkey % 5 = 0 THEN '/v2' ELSE '' END END AS http, 'src/' || p_type AS path, p_size + CASE WHEN p_partkey % 20 = 8 THEN 1 ELSE 0 END AS line, p_partkey FROM part WHERE p_partkey % 10 <> 0"""


def _views(spark, d):
    p = table(spark, d, "part")
    spark_sql = lambda q: spark.sql(q.replace("FROM part", "FROM {part}").replace("['s' || p_partkey]", "array('s' || p_partkey)").replace("ELSE [] END", "ELSE cast(array() AS array<string>) END").replace("NULL AS deprecated", "cast(NULL AS string) AS deprecated"), part=p)
    return spark_sql(_OLD), spark_sql(_NEW)


_CHANGES = f"""
o AS ({_OLD}), n AS ({_NEW}),
j AS (SELECT n.*, o.symbol_id AS oid, r.symbol_id AS rid, o.http AS oh, o.signature_hash AS osh, o.visibility AS ov, o.deprecated AS od, o.doc_hash AS odh, o.body_hash AS obh, o.path AS op, o.line AS ol, o.signature AS os FROM n LEFT JOIN o ON o.symbol_id = n.symbol_id LEFT JOIN o r ON r.symbol_id = n.previous_ids[1]),
c AS (SELECT symbol_id, name, module, CASE WHEN oid IS NULL AND rid IS NOT NULL THEN 'renamed' WHEN oid IS NULL THEN 'added' WHEN oh IS DISTINCT FROM http THEN 'http-binding-changed' WHEN osh <> signature_hash THEN 'signature-changed' WHEN ov <> visibility THEN 'visibility-changed'
 WHEN od IS DISTINCT FROM deprecated THEN 'deprecation-changed' WHEN odh <> doc_hash THEN 'doc-changed' WHEN obh <> body_hash THEN 'body-changed' WHEN op <> path OR ol <> line THEN 'moved' WHEN os <> signature THEN 'formatting-only' ELSE 'unchanged' END AS change FROM j
 UNION ALL SELECT symbol_id, name, module, 'removed' FROM o WHERE symbol_id NOT IN (SELECT symbol_id FROM n) AND symbol_id NOT IN (SELECT unnest(previous_ids) FROM n))"""


@query(f"WITH {_CHANGES} SELECT symbol_id, name, module, change FROM c")
def ir_diff(spark, d):
    """Classified changes between two snapshots."""
    return diff.snapshot_diff(*_views(spark, d)).select("symbol_id", "name", "module", "change")


@query(f"""WITH {_CHANGES}, q AS (SELECT *, change IN ('unchanged','formatting-only') AS quiet FROM c), t AS (SELECT module, count(*) AS total FROM ({_NEW}) GROUP BY module)
SELECT module, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE NOT quiet AND change NOT IN ('added','removed')) AS changed, count(*) FILTER (WHERE quiet) AS unchanged,
 count(*) FILTER (WHERE NOT quiet) AS n_reindex, count(*) FILTER (WHERE NOT quiet AND change NOT IN ('body-changed','moved')) AS n_regenerate, round(count(*) FILTER (WHERE NOT quiet) / any_value(total), 6) AS churn_ratio FROM q JOIN t USING (module) GROUP BY module""")
def module_churn(spark, d):
    """Counters and churn of each module (A2, Q19)."""
    old, new = _views(spark, d)
    return diff.churn(diff.snapshot_diff(old, new), new.groupBy("module").agg(F.count("*").alias("total")))


@query(f"""WITH {_CHANGES}, q AS (SELECT count(*) FILTER (WHERE change NOT IN ('unchanged','formatting-only')) AS touched, count(*) FILTER (WHERE change NOT IN ('unchanged','formatting-only','body-changed','moved')) AS n_regenerate, (SELECT count(*) FROM n) AS total FROM c)
SELECT touched, n_regenerate, round(touched / total, 6) AS churn_ratio, CASE WHEN touched > 2000 THEN 'absolute-count' WHEN total >= 50 AND touched / total > 0.25 THEN 'churn-ratio' WHEN n_regenerate > 50 THEN 'regeneration-count' END AS rule,
 NOT (touched > 2000 OR (total >= 50 AND touched / total > 0.25)) AS may_reindex, NOT (touched > 2000 OR (total >= 50 AND touched / total > 0.25) OR n_regenerate > 50) AS may_regenerate FROM q""")
def circuit_breaker(spark, d):
    """Whether a commit is too large to follow."""
    old, new = _views(spark, d)
    return diff.circuit_breaker(diff.snapshot_diff(old, new), new.count())


@query(f"WITH {_CHANGES} SELECT symbol_id, CASE change WHEN 'removed' THEN 'symbol-removed' ELSE 'visibility-reduced' END AS kind FROM c JOIN (SELECT symbol_id, visibility FROM n UNION ALL SELECT symbol_id, NULL FROM o WHERE symbol_id NOT IN (SELECT symbol_id FROM n)) USING (symbol_id) WHERE change = 'removed' OR (visibility = 'private' AND change IN ('signature-changed','visibility-changed','http-binding-changed','renamed'))")
def breaking_surface(spark, d):
    """Symbols that are gone or less visible."""
    return diff.surface_changes(diff.snapshot_diff(*_views(spark, d))).select("symbol_id", "kind")


@query("""
WITH b AS (SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_partkey AS p, l_returnflag AS t, l_quantity AS q FROM lineitem),
a AS (SELECT s, pos + CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END AS pos, CASE WHEN p % 5 = 0 THEN 'X' ELSE t END AS t FROM b WHERE p % 7 = 0)
SELECT kind, count(*) AS n FROM (
 SELECT CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.s = b.s AND a.pos = b.pos AND a.t = b.t) THEN 'parameter-renamed' ELSE 'parameter-removed' END AS kind FROM b WHERE p % 7 = 0
 UNION ALL SELECT 'parameter-type-changed' FROM b WHERE p % 7 <> 0 AND p % 5 = 0
 UNION ALL SELECT 'parameter-made-required' FROM b WHERE p % 7 <> 0 AND q >= 20 AND q < 25
 UNION ALL SELECT 'parameter-added-required' FROM b WHERE p % 7 = 0 AND q >= 20) GROUP BY kind
""")
def breaking_parameters(spark, d):
    """Breaking changes of parameters by kind: an order is a symbol, its lines are parameters, some moved by one place."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("symbol_id"), F.row_number().over(w).alias("pos"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("t"), F.col("l_quantity").alias("q"))
    p, fresh = F.col("p"), F.col("p") % 7 == 0
    row = lambda pos, name, kind, opt: x.select("symbol_id", pos.alias("pos"), F.concat_ws("-", name, F.col("pos")).alias("name"), kind.alias("type"), opt.alias("optional"), F.lit(False).alias("has_default"), F.lit(False).alias("rest"))
    old = row(F.col("pos"), p, F.col("t"), F.col("q") < 25)
    new = row(F.col("pos") + F.when(F.col("symbol_id") % 3 == 0, 1).otherwise(0), p + F.when(fresh, 1_000_000).otherwise(0), F.when(p % 5 == 0, "X").otherwise(F.col("t")), F.col("q") < 20)
    return diff.parameter_changes(old, new).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT l_orderkey AS document_id, 's' || l_partkey AS symbol_id, l_partkey, md5(l_partkey::VARCHAR) AS h FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
SELECT document_id, count(*) AS cited, count(*) FILTER (WHERE l_partkey % 10 IN (1, 2, 3)) AS stale, round(count(*) FILTER (WHERE l_partkey % 10 IN (1, 2, 3)) / count(*), 6) AS score FROM p GROUP BY document_id
""")
def document_staleness(spark, d):
    """Cited symbols that are gone, renamed or changed."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    prov = x.select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("symbol_id"), F.md5(F.col("l_partkey").cast("string")).alias("signature_hash"))
    p, k = table(spark, d, "part"), F.col("p_partkey")
    sym = p.where(k % 10 != 1).select(F.concat(F.when(k % 10 == 2, "n").otherwise("s"), k.cast("string")).alias("symbol_id"), F.md5(F.concat(k.cast("string"), F.when(k % 10 == 3, "!").otherwise(""))).alias("signature_hash"), F.lit(None).cast("string").alias("http"))
    alias = p.where(k % 10 == 2).select(F.concat(F.lit("s"), k.cast("string")).alias("previous_id"), F.concat(F.lit("n"), k.cast("string")).alias("symbol_id"))
    return diff.staleness_score(diff.staleness(prov, sym, alias))


@query("SELECT o.o_custkey AS dst, list_sort(list(DISTINCT l.l_partkey)) AS users, count(DISTINCT l.l_partkey) AS n_users FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey")
def reverse_edges(spark, d):
    """Users of each target, distinct and sorted."""
    e = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("src"), F.col("o_custkey").alias("dst"))
    return graph.used_by(e)


@query("""
WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem), c AS (SELECT dst, count(*) AS centrality FROM e GROUP BY dst), n AS (SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT s_suppkey FROM supplier))
SELECT src AS seed_id, dst, centrality, row_number() OVER (PARTITION BY src ORDER BY centrality, dst) AS place FROM n JOIN c USING (dst) QUALIFY place <= 12
""")
def graph_neighbours(spark, d):
    """The twelve least central neighbours of each seed."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("callee").alias("relation"))
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seed_id"))
    return graph.top_neighbours(e, seeds).select("seed_id", "dst", "centrality", "place")


#: Pairs of the three kinds of links, for the SQL only: the library never makes them.
CONTRACT_PAIRS = "SELECT lower(substr(s_name, -4)) AS key, s_suppkey::VARCHAR AS src, c_custkey::VARCHAR AS dst FROM supplier JOIN customer ON substr(lower(s_name), -4) = substr(lower(c_name), -4) AND s_nationkey <> c_nationkey"
TYPE_PAIRS = """SELECT a.k AS key, a.id::VARCHAR AS src, b.id::VARCHAR AS dst FROM (SELECT p_partkey AS id, p_type AS repo, p_brand AS language, md5(array_to_string(list_sort(string_split(lower(p_name), ' ')), ',')) AS k FROM part WHERE len(string_split(p_name, ' ')) >= 2) a
 JOIN (SELECT p_partkey AS id, p_type AS repo, p_brand AS language, md5(array_to_string(list_sort(string_split(lower(p_name), ' ')), ',')) AS k FROM part WHERE len(string_split(p_name, ' ')) >= 2) b ON a.k = b.k AND a.repo < b.repo AND a.language <> b.language"""
PACKAGE_PAIRS = """SELECT DISTINCT p.p_brand || ':' || p.p_name AS key, concat_ws(':', u.l_orderkey, u.l_linenumber, u.l_partkey, u.l_suppkey) AS src, p.p_partkey::VARCHAR AS dst FROM lineitem u JOIN part q ON q.p_partkey = u.l_partkey
 JOIN part p ON p.p_name = q.p_name AND p.p_brand = 'Brand#' || (u.l_suppkey % 25 + 1) WHERE p.p_type <> q.p_type"""
#: The same with the repositories (and languages) of both ends, so that members with them say which pairs there are.
TYPE_LINKS = TYPE_PAIRS.replace("b.id::VARCHAR AS dst FROM", "b.id::VARCHAR AS dst, a.repo AS src_repo, b.repo AS dst_repo, a.language AS src_language, b.language AS dst_language FROM", 1)
PACKAGE_LINKS = PACKAGE_PAIRS.replace("p.p_partkey::VARCHAR AS dst FROM", "p.p_partkey::VARCHAR AS dst, q.p_type AS src_repo, p.p_type AS dst_repo FROM", 1)
_MEMBERS = "WITH e AS ({0}) SELECT key, src AS id, src_repo AS repo, {1}'source' AS side, count(*) AS links FROM e GROUP BY ALL UNION ALL SELECT key, dst, dst_repo, {2}'target', count(*) FROM e GROUP BY ALL"


def contract_sides(spark, d, letters: int = 4):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.expr(f"right(s_name, {letters})").alias("name"), F.col("s_nationkey").alias("repo"))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.expr(f"upper(right(c_name, {letters}))").alias("name"), F.col("c_nationkey").alias("repo"))
    return cross_repo.contract_sides(s, c)


def types(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("repo"), F.col("p_brand").alias("language"), F.split("p_name", " ").alias("fields"))
    return cross_repo.typed(t, 2)


def package_sides(spark, d):
    p = table(spark, d, "part")
    line = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    module = F.concat_ws("@", "p_type", F.col("l_suppkey") % 25 + 1)
    u = table(spark, d, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select(line.alias("src"), module.alias("module"), F.col("p_name").alias("name"), F.col("p_type").alias("repo"), (F.col("l_suppkey") % 25 + 1).alias("b"))
    depends = u.select("module", F.concat(F.lit("Brand#"), F.col("b").cast("string")).alias("package"))
    owner = F.concat_ws("#", "p_brand", "p_type").alias("module")
    symbols = p.select(owner, F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("symbol_id"), F.col("p_type").alias("repo"))
    return cross_repo.package_sides(depends, p.select(F.col("p_brand").alias("package"), owner), u.drop("b"), symbols)


@query("SELECT s.s_suppkey AS src, c.c_custkey AS dst, s.s_nationkey AS src_repo, c.c_nationkey AS dst_repo FROM supplier s JOIN customer c ON substr(lower(s.s_name), -4) = substr(lower(c.c_name), -4) AND s.s_nationkey <> c.c_nationkey")
def contract_edges(spark, d):
    """Equal names in different repositories."""
    kind = dict(table(spark, d, "supplier").dtypes)["s_suppkey"]
    return cross_repo.pairs(*contract_sides(spark, d)).select(F.col("src").cast(kind), F.col("dst").cast(kind), "src_repo", "dst_repo")


@query(_MEMBERS.format(TYPE_LINKS, "src_language AS language, ", "dst_language, "))
def shared_type_edges(spark, d):
    """Types with the same fields in two repositories and languages: each with its repository, language and links."""
    return cross_repo.other_language(types(spark, d))[1].select("key", "id", "repo", "language", "side", "links")


@query(_MEMBERS.format(PACKAGE_LINKS, "", ""))
def package_edges(spark, d):
    """Unresolved names and the symbols that the packages of their modules have for them, with repositories and links."""
    return cross_repo.other_repository(*package_sides(spark, d))[1].select("key", "id", "repo", "side", "links")


@query("""
WITH d AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber % 2 = 1), c AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber % 2 = 0), u AS (SELECT src, dst, 'direct' AS via FROM d UNION ALL SELECT src, dst, 'cross-repo' FROM c)
SELECT src, dst, via, count(*) OVER (PARTITION BY dst) AS total FROM u
""")
def find_usages(spark, d):
    """Direct and cross-repository usages with totals."""
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    return graph.usages(x.where("l_linenumber % 2 = 1"), x.where("l_linenumber % 2 = 0")).select("src", "dst", "via", "total")


@query("""
SELECT 'order-without-lines' AS violation, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'document-without-vector', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'thin-module', count(*) FROM (SELECT source FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(labels.doc_id) < 0.4 * count(*))
""")
def invariants(spark, d):
    """Orphans, dangling rows and thin coverage."""
    o, docs = table(spark, d, "orders"), table(spark, d, "documents")
    count = lambda df, name: df.agg(F.lit(name).alias("violation"), F.count("*").alias("n"))
    a = graph.dangling(o, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    b = graph.dangling(docs, table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    sym = docs.select(F.col("source").alias("module"), F.col("doc_id").alias("symbol_id"))
    chunks = sym.join(table(spark, d, "labels").select(F.col("doc_id").alias("symbol_id")), "symbol_id")
    return count(a, "order-without-lines").unionByName(count(b, "document-without-vector")).unionByName(count(graph.coverage(sym, chunks), "thin-module"))


@query("""
WITH e AS (SELECT event_id AS item, [event_id, event_id + 3] AS expected FROM events), m AS (SELECT item, unnest(expected) AS sym FROM e)
SELECT DISTINCT item FROM m WHERE sym NOT IN (SELECT event_id FROM events WHERE event_type <> 'click') AND sym NOT IN (SELECT event_id + 1 FROM events WHERE user_id % 2 = 0)
""")
def eval_quarantine(spark, d):
    """Items that expect what is neither a symbol nor an alias."""
    ev = table(spark, d, "events")
    m = ev.select(F.col("event_id").alias("item"), F.explode(F.array("event_id", F.col("event_id") + 3)).alias("sym"))
    symbols = ev.where("event_type <> 'click'").select(F.col("event_id").alias("sym"))
    aliases = ev.where("user_id % 2 = 0").select((F.col("event_id") + 1).alias("sym"))
    return m.join(symbols, "sym", "left_anti").join(aliases, "sym", "left_anti").select("item").distinct()


@query("""
WITH g AS (SELECT p_name AS name, min(p_partkey) AS g FROM part GROUP BY p_name), l AS (SELECT p_type AS module, p_name AS name, max(p_partkey) AS l FROM part GROUP BY ALL)
SELECT x.p_partkey AS src, coalesce(l.l, g.g) AS dst FROM part x LEFT JOIN l ON l.module = CASE WHEN x.p_size % 2 = 0 THEN x.p_type ELSE 'none' END AND l.name = x.p_name LEFT JOIN g ON g.name = x.p_name
""")
def resolve_names(spark, d):
    """Names to symbols: the module's last, else the first of all."""
    p = table(spark, d, "part")
    refs = p.select(F.col("p_partkey").alias("src"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("none").alias("module"), F.col("p_name").alias("name"))
    sym = p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("module"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"))
    return graph.resolve_names(refs, sym).select("src", "dst")


@query("""
SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, list_sort(list(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal > 0)) AS segments FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_name ILIKE '%a%' OR n_name ILIKE '%1%' GROUP BY ALL
""")
def list_repositories(spark, d):
    """Left joins with distinct counts and filtered sorted sets."""
    n = table(spark, d, "nation").where(F.col("n_name").ilike("%a%") | F.col("n_name").ilike("%1%"))
    x = n.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return x.groupBy("n_name", "r_name").agg(F.countDistinct("c_custkey").alias("customers"), F.sort_array(F.collect_set(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))).alias("segments"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_per_key(spark, d):
    """The last row of each key."""
    return store.latest(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 3 = 0")
def table_upsert(spark, d):
    """Rows over those with the same keys."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    third = c.where("c_custkey % 3 = 0")
    new = third.withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(third.withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return store.upsert(c, new, ["c_custkey"])


@query("SELECT doc_id, source, doc_id % 4 = 0 AS gone FROM documents")
def document_tombstones(spark, d):
    """Soft deletes of what was not seen."""
    x = table(spark, d, "documents").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return store.tombstones(x, x.where("doc_id % 4 <> 0").select("doc_id"), "doc_id", F.to_timestamp(F.lit("2024-01-01"))).select("doc_id", "source", F.col("deleted_at").isNotNull().alias("gone"))


@query("SELECT url, concat('http', CASE WHEN page_id % 2 = 0 THEN '' ELSE 's' END) AS base, page_id FROM pages WHERE page_id >= 20 ORDER BY page_id LIMIT 20".replace("url, concat('http', CASE WHEN page_id % 2 = 0 THEN '' ELSE 's' END) AS base, ", "url, "))
def cursor_page(spark, d):
    """A page of rows in a total order."""
    from corpusloom.sources.repository import page

    return page(table(spark, d, "pages").select("url", "page_id"), "page_id", 20, 20)


@query("SELECT date_trunc('hour', ts) AS hour, user_id AS principal, count(*) AS calls, count(DISTINCT event_type) AS repos FROM events GROUP BY ALL")
def hourly_breadth(spark, d):
    """Calls and distinct repositories by hour and caller (ST1, F-D1, Q22)."""
    return streams.exact_hourly_breadth(table(spark, d, "events").select("ts", F.col("user_id").alias("principal"), F.col("event_type").alias("repo")))


@query("""
WITH x AS (SELECT user_id, event_type, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id AS repo, event_type AS ref, min(ts) AS first, count(*) AS pushes FROM s GROUP BY user_id, event_type, run
""")
def coalesced_pushes(spark, d):
    """Runs of pushes without a gap (ST3)."""
    p = table(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("ref"), "ts", F.col("event_id").alias("sha"))
    return streams.coalesced_pushes(p, "1 hour").select("repo", "ref", "first", "pushes")


@query("""
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id AS principal, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS events FROM s GROUP BY user_id, run
""")
def access_sessions(spark, d):
    """Sessions by idle time (ST6)."""
    return streams.sessions(table(spark, d, "events").select(F.col("user_id").alias("principal"), "ts"))


@query("SELECT event_type, count(*) FILTER (WHERE value < 20) AS waiting, count(*) FILTER (WHERE value >= 20) AS active, CAST(max(epoch(TIMESTAMP '2030-01-01' - ts)) AS BIGINT) AS oldest FROM events GROUP BY event_type")
def queue_stats(spark, d):
    """Waiting and active jobs and the oldest age (A21, F-D3)."""
    age = (F.unix_micros(F.lit("2030-01-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 20).alias("waiting"), F.count_if(F.col("value") >= 20).alias("active"), F.rint(F.max(age)).cast("long").alias("oldest"))


@query("SELECT least(n_chars // 500, 10) AS bucket, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english, round(count(*) FILTER (WHERE n_chars > 1000) / count(*), 6) AS long_share FROM documents GROUP BY 1")
def token_histogram(spark, d):
    """Histogram with filtered counts."""
    b = F.least(F.floor(F.col("n_chars") / 500), F.lit(10)).alias("bucket")
    return table(spark, d, "documents").groupBy(b).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.round(F.count_if(F.col("n_chars") > 1000) / F.count("*"), 6).alias("long_share"))


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text FROM conversations),
c AS (SELECT conv_id, turn, n, '' AS prev_hash, sha256('' || chr(10) || conv_id || chr(10) || role || chr(10) || text) AS hash FROM t WHERE n = 1
 UNION ALL SELECT t.conv_id, t.turn, t.n, c.hash, sha256(c.hash || chr(10) || t.conv_id || chr(10) || t.role || chr(10) || t.text) FROM c JOIN t ON t.conv_id = c.conv_id AND t.n = c.n + 1)
SELECT conv_id, turn, n, prev_hash, hash FROM c
""")
def audit_chain(spark, d):
    """Each tenant's chain of hashes, every link over the one before (W6, F-H7)."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return graph.chain(rows, "conv_id", "turn", ["conv_id", "role", "text"]).select("conv_id", "turn", "n", "prev_hash", "hash")


@query("""
WITH t AS (SELECT conv_id, turn, md5(text) AS hash, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn FROM t WHERE before IS NOT NULL AND turn % 3 = 2
""")
def audit_breaks(spark, d):
    """Links that do not hold the hash before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("hash"))
    x = x.withColumn("prev_hash", F.when(F.col("turn") % 3 == 2, "forged").otherwise(F.lag("hash").over(w)))
    return graph.chain_breaks(x, "conv_id", "turn").select("conv_id", "turn")
