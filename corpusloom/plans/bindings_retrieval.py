"""Queries over the driver's tables: arms, fusion, budgets, access, evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import access, chunking, dedupe, evaluation, lexical, retrieval, vectors
from corpusloom.operators.tables import written
from corpusloom.plans.bindings_scan import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: The stated batch of vector queries: every vector whose id is divisible by 20.
_PROBES = "SELECT vec_id AS query_id, embedding AS query_vector FROM embeddings WHERE vec_id % 20 = 0"
_DENSE = f"""
d AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, score FROM (
  SELECT q.query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.query_vector::DOUBLE[]), 6) AS score FROM embeddings e, ({_PROBES}) q))"""
_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 2))"


def _probes(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM d WHERE rank <= 50")
def dense_topk(spark, d):
    """Nearest 50 vectors of a batch of vector queries (T1, F-V1, F-V2, W4)."""
    return retrieval.dense_topk(table(spark, d, "embeddings"), _probes(spark, d))


#: Cells of the index and cells that a query probes.
CELLS, PROBES = 24, 18


@query()
def vector_search(spark, d):
    """The 50 nearest vectors that the probed cells hold."""
    index = vectors.build_cells(table(spark, d, "embeddings"), CELLS)
    return vectors.search_cells(index, _probes(spark, d), 50, PROBES)


@query("SELECT count(*) AS queries, true AS recall_is_090 FROM embeddings WHERE vec_id % 20 = 0")
def vector_recall(spark, d):
    """Whether the probed cells hold nine tenths of the exact neighbours, over all queries (T1, F-V1)."""
    e = table(spark, d, "embeddings")
    found = vectors.recall(vectors.search_cells(vectors.build_cells(e, CELLS), _probes(spark, d), 50, PROBES), vectors.dense_topk(e, _probes(spark, d)))
    return found.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_is_090"))


_QUERIES = "SELECT item_id AS query_id, text AS query, " + _TERMS + " AS asked FROM benchmark"


def _asked(spark, d):
    """Every passage of the benchmark, with all its terms."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"""
WITH q AS ({_QUERIES}), c AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
m AS (SELECT q.query_id, c.doc_id, len(q.asked) / len(c.terms) AS share FROM c, q WHERE len(q.asked) > 0 AND len(list_intersect(q.asked, c.terms)) = len(q.asked))
SELECT query_id, count(*) AS matches FROM m GROUP BY query_id
""")
def lexical_match(spark, d):
    """Documents that hold all terms of each query (F-S17)."""
    out = retrieval.term_matches(table(spark, d, "documents"), _asked(spark, d), "doc_id", "text", "query_id", "query")
    return out.groupBy("query_id").agg(F.count("*").alias("matches"))


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


#: Minimal covers: for each occurrence the latest place of every asked term up to it; the earliest of these is where a cover starts.
_COVERS = f"""
q AS ({_QUERIES}), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT q.query_id, w.doc_id, q.asked, w.ws FROM w, q WHERE len(q.asked) > 0 AND len(list_intersect(q.asked, w.ws)) = len(q.asked)),
o AS (SELECT query_id, doc_id, asked, ws[p] AS term, p, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY p) AS k FROM (SELECT query_id, doc_id, asked, ws, unnest(range(1, len(ws) + 1)) AS p FROM c) WHERE list_contains(asked, ws[p])),
t AS (SELECT query_id, doc_id, p, k, len(asked) AS n, max(CASE WHEN term = a THEN p END) OVER (PARTITION BY query_id, doc_id, a ORDER BY p) AS latest FROM (SELECT *, unnest(asked) AS a FROM o)),
s AS (SELECT query_id, doc_id, p, k, CASE WHEN count(latest) = any_value(n) THEN min(latest) END AS start FROM t GROUP BY ALL),
m AS (SELECT *, lag(start) OVER (PARTITION BY query_id, doc_id ORDER BY p) AS was FROM s),
x AS (SELECT m.query_id, m.doc_id, sum(0.1::DOUBLE / (1 + m.p - m.start - (m.k - o.k))) AS density FROM m JOIN o ON o.query_id = m.query_id AND o.doc_id = m.doc_id AND o.p = m.start WHERE m.start IS NOT NULL AND (m.was IS NULL OR m.start > m.was) GROUP BY ALL)"""


@query(f"WITH {_COVERS} SELECT query_id, doc_id, round(density, 6) AS density FROM x")
def cover_density(spark, d):
    """Minimal covers of the asked terms in the documents that hold them all (F-S17)."""
    out = lexical.cover_density(table(spark, d, "documents"), _asked(spark, d))
    return out.select("query_id", "doc_id", F.round("density", 6).alias("density"))


@query(f"""
WITH {_COVERS}, g AS (SELECT x.query_id, x.doc_id, x.density, {_TRIGRAMS.format('d.text')} AS a, {_TRIGRAMS.format('b.text')} AS b FROM x JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = x.query_id),
z AS (SELECT query_id, doc_id, round(density + 0.3 * len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS score FROM g)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z QUALIFY rank <= 50
""")
def lexical_topk(spark, d):
    """The 50 best documents by cover density and trigram likeness (T2, F-S16, F-S17)."""
    return retrieval.lexical_topk(table(spark, d, "documents"), _asked(spark, d))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 2) AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS al FROM w), q AS (SELECT query_id, unnest(asked) AS term FROM ({_QUERIES})),
t AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM w), tf AS (SELECT doc_id, l, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 20
""")
def bm25_topk(spark, d):
    """The 20 best documents by BM25 (Q17)."""
    return retrieval.bm25_topk(table(spark, d, "documents"), _asked(spark, d), k=20)


@query(f"""
WITH t AS (SELECT lang, doc_id, unnest({_TERMS}) AS term FROM documents), n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
SELECT lang, term, count(*) AS ndoc, any_value(docs) AS docs, round(ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5) + 1.0), 6) AS idf FROM t JOIN n USING (lang) GROUP BY lang, term HAVING count(*) > 1
""")
def document_frequency(spark, d):
    """Document frequencies by language."""
    return retrieval.document_frequency(table(spark, d, "documents"), "lang", "doc_id", "text")


@query("""
SELECT query_id, symbol_id, score, rank FROM (SELECT c.query_id, p_partkey AS symbol_id, CASE WHEN lower(p_name) = c.id THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(p_name) = c.id THEN 1.0 ELSE 0.5 END DESC, length(p_name), p_partkey) AS rank
  FROM part JOIN (SELECT p_partkey AS query_id, lower(CASE WHEN p_partkey % 40 = 0 THEN p_name ELSE list_last(string_split(p_name, ' ')) END) AS id FROM part WHERE p_partkey % 20 = 0) c ON ends_with(lower(p_name), c.id)) WHERE rank <= 10
""")
def symbol_topk(spark, d):
    """Names that end with an identifier."""
    last = F.element_at(F.split("p_name", " "), -1)
    asked = table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 40 == 0, F.col("p_name")).otherwise(last).alias("identifier"))
    return retrieval.symbol_topk(table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name")), asked)


_ARMS = """
a AS (SELECT o_custkey AS query_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, 1.2::DOUBLE AS weight FROM orders
 UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey), 1.0::DOUBLE FROM orders)"""


def _arms(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), "o_totalprice", F.col("o_orderdate").cast("timestamp").cast("long").alias("day"))
    dense = retrieval.ranked(o, "query_id", F.col("o_totalprice"), "item", 1 << 30).select("query_id", "item", "rank", F.lit(1.2).alias("weight"))
    recent = retrieval.ranked(o, "query_id", F.col("day"), "item", 1 << 30).select("query_id", "item", "rank", F.lit(1.0).alias("weight"))
    return dense.unionByName(recent)


@query(f"""
WITH {_ARMS}, s AS (SELECT query_id, item, round(sum(weight / (60 + rank)), 9) AS score FROM a GROUP BY ALL)
SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 100
""")
def rrf_fusion(spark, d):
    """Reciprocal rank fusion of two arms for each customer."""
    return retrieval.fuse(_arms(spark, d), "item")


@query("""
WITH RECURSIVE x AS (SELECT o_custkey AS query_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, CAST(floor(o_totalprice / 100) AS BIGINT) AS tokens FROM orders),
f AS (SELECT query_id, item, position, tokens, true AS kept, tokens AS used FROM x WHERE position = 1
 UNION ALL SELECT x.query_id, x.item, x.position, x.tokens, f.used + x.tokens <= 13200, CASE WHEN f.used + x.tokens <= 13200 THEN f.used + x.tokens ELSE f.used END FROM f JOIN x ON x.query_id = f.query_id AND x.position = f.position + 1)
SELECT * FROM f
""")
def budget_fit(spark, d):
    """Orders of each customer that fit a budget, passing over those that do not."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("tokens"))
    o = retrieval.ranked(o, "query_id", -F.col("item"), "item", 1 << 30).join(o, ["query_id", "item"]).select("query_id", "item", F.col("rank").alias("position"), "tokens")
    return retrieval.fit_budget(o, item="item")


def _scored(spark, d):
    near = retrieval.dense_topk(table(spark, d, "embeddings"), _probes(spark, d), k=30).withColumnRenamed("vec_id", "doc_id")
    return near.join(table(spark, d, "documents"), "doc_id").select("query_id", "doc_id", "score", "text", F.col("source").alias("module"), (F.col("doc_id") % 11 == 0).alias("generated"))


@query()
def mmr_diversify(spark, d):
    """Greedy diversity with a cap for each source (T5, Q7, Q8)."""
    return retrieval.diversify(_scored(spark, d), 8)


@query(f"""
WITH {_DENSE}, e AS (SELECT query_id, count(*) AS n, max(score) AS top, count(*) FILTER (WHERE vec_id % 3 = 0) AS shallow FROM d WHERE rank <= 50 AND score > 0.3 GROUP BY query_id)
SELECT query_id, n < 1 OR CASE WHEN query_id % 2 = 0 THEN top IS NULL OR top < 0.35 ELSE n < 3 END AS abstain,
 CASE WHEN n < 1 THEN 'no-evidence' WHEN NOT CASE WHEN query_id % 2 = 0 THEN top < 0.35 ELSE n < 3 END THEN NULL WHEN query_id % 2 = 0 THEN 'weak-score' ELSE 'few-unranked' END AS reason,
 CASE WHEN n < 1 OR CASE WHEN query_id % 2 = 0 THEN top < 0.35 ELSE n < 3 END THEN '' ELSE array_to_string(list_filter([CASE WHEN shallow = n THEN 'all-shallow' END, CASE WHEN query_id % 2 <> 0 THEN 'fusion-order' END], lambda x: x IS NOT NULL), ';') END AS hedges FROM e
""")
def abstention_verdict(spark, d):
    """Whether the evidence carries an answer (C4, Q25)."""
    x = retrieval.dense_topk(table(spark, d, "embeddings"), _probes(spark, d)).where("score > 0.3")
    e = x.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.max("score").alias("top_score"), F.count_if(F.col("vec_id") % 3 == 0).alias("n_shallow")).withColumns({"reranked": F.col("query_id") % 2 == 0, "n_generated": F.lit(-1), "n_stale_repos": F.lit(0)})
    return retrieval.abstention(e)


_NEAR = "SELECT l_orderkey AS seed_id, l_partkey AS symbol_id, CASE l_linenumber % 5 WHEN 0 THEN 'caller' WHEN 1 THEN 'type' WHEN 2 THEN 'callee' WHEN 3 THEN 'parent' ELSE 'implementation' END AS relation, CAST(l_quantity AS BIGINT) AS centrality FROM lineitem"


def _neighbours(spark, d):
    rel = F.element_at(F.array(*[F.lit(x) for x in ("caller", "type", "callee", "parent", "implementation")]), F.col("l_linenumber") % 5 + 1)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seed_id"), F.col("l_partkey").alias("symbol_id"), rel.alias("relation"), F.col("l_quantity").cast("long").alias("centrality"), "l_linenumber")


@query(f"""
SELECT seed_id, symbol_id, relation, centrality, place FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY list_position(['type','parent','callee','implementation','caller'], relation), centrality, symbol_id) AS place FROM ({_NEAR}) WHERE centrality <= 50) WHERE place <= 4
""")
def neighbour_shortlist(spark, d):
    """At most four neighbours a seed, by relation and centrality."""
    return retrieval.neighbour_shortlist(_neighbours(spark, d)).select("seed_id", "symbol_id", "relation", "centrality", "place")


@query(f"""
WITH RECURSIVE n AS (SELECT seed_id, symbol_id, place, centrality AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY list_position(['type','parent','callee','implementation','caller'], relation), centrality, symbol_id) AS place FROM ({_NEAR}) WHERE centrality <= 50) WHERE place <= 4),
x AS (SELECT o_custkey AS query_id, symbol_id, tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY place, seed_id, symbol_id, tokens) AS k FROM n JOIN orders ON o_orderkey = seed_id),
f AS (SELECT query_id, 0::BIGINT AS k, []::BIGINT[] AS taken, 0::BIGINT AS used, NULL::BIGINT AS symbol_id FROM x GROUP BY query_id
 UNION ALL SELECT x.query_id, x.k, CASE WHEN list_contains(taken, x.symbol_id) OR used + x.tokens > 300 THEN taken ELSE list_append(taken, x.symbol_id) END, CASE WHEN list_contains(taken, x.symbol_id) OR used + x.tokens > 300 THEN used ELSE used + x.tokens END, CASE WHEN list_contains(taken, x.symbol_id) OR used + x.tokens > 300 THEN NULL ELSE x.symbol_id END FROM f JOIN x ON x.query_id = f.query_id AND x.k = f.k + 1)
SELECT query_id, symbol_id, len(taken)::INT AS taken_at, used FROM f WHERE symbol_id IS NOT NULL
""")
def graph_expansion(spark, d):
    """Round robin over the seeds of each customer under a budget."""
    n = retrieval.neighbour_shortlist(_neighbours(spark, d)).select("seed_id", "symbol_id", "place", F.col("centrality").alias("tokens"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("seed_id"), F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("seed_rank"))
    return retrieval.expand(n.join(o, "seed_id"), budget=300)


def _chunks(spark, d):
    i = F.col("doc_id")
    tier = F.element_at(F.array(*[F.lit(t) for t in access.TIERS]), (i % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.lit("o1").alias("org"), F.col("source").alias("repo"), F.col("source").alias("module"), F.when(i % 3 == 0, "docs").otherwise("code").alias("corpus"), tier.alias("sensitivity"), (i % 7 != 0).alias("is_representative"), F.when(i % 6 == 0, "inherit").when(i % 9 == 0, "users").alias("doc_mode"), (i % 12 == 0).alias("doc_deleted"), F.lit("v1").alias("version"), (i % 5 != 0).alias("module_approved"), F.array("lang").alias("project_ids"))


_CHUNKS = "SELECT doc_id, source AS repo, CASE WHEN doc_id % 3 = 0 THEN 'docs' ELSE 'code' END AS corpus, ['public','internal','confidential','restricted'][doc_id % 4 + 1] AS sensitivity, doc_id % 7 <> 0 AS rep, CASE WHEN doc_id % 6 = 0 THEN 'inherit' WHEN doc_id % 9 = 0 THEN 'users' END AS mode, doc_id % 12 = 0 AS deleted, doc_id % 5 <> 0 AS approved, lang FROM documents"


@query(f"""
SELECT doc_id, sensitivity FROM ({_CHUNKS}) WHERE rep AND repo IN ('src1','src2','src3') AND repo <> 'src3' AND sensitivity IN ('public','internal') AND (corpus <> 'docs' OR mode IS NULL OR (mode IN ('inherit','public') AND NOT deleted)) AND lang IN ('en','de')
""")
def access_predicate(spark, d):
    """Chunks that a caller may see in a scope."""
    who = access.Access("o1", ["src1", "src2", "src3"], "internal", denied=["src3"])
    return _chunks(spark, d).where(access.allowed(who, "o1") & access.in_scope(access.Scope(projects=["en", "de"]))).select("doc_id", "sensitivity")


@query(f"SELECT doc_id FROM ({_CHUNKS}) WHERE rep AND corpus IN ('docs','spec') AND sensitivity = 'public' AND approved")
def external_access(spark, d):
    """Chunks of the external corpus."""
    return _chunks(spark, d).where(access.allowed(access.Access("o1", [], external=True, version="v1"), "o1")).select("doc_id")


@query("""
WITH g AS (SELECT DISTINCT o_custkey AS principal, o_orderpriority AS repo FROM orders), r AS (SELECT o_custkey AS principal, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderpriority END AS repo FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0)
SELECT principal, repo FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.principal = g.principal AND (r.repo = g.repo OR r.repo IS NULL))
""")
def effective_grants(spark, d):
    """Grants without revoked ones; a revocation without a repository takes all."""
    o = table(spark, d, "orders")
    grants = o.select(F.col("o_custkey").alias("principal"), F.col("o_orderpriority").alias("repo")).distinct()
    now = F.to_timestamp(F.lit("2020-01-01"))
    gone = o.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0").select(F.col("o_custkey").alias("principal"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")).alias("repo"), F.to_timestamp(F.lit("2021-01-01")).alias("expires_at"))
    return access.effective_grants(grants, gone, now).select("principal", "repo")


_RESULTS = """
r AS (SELECT d.doc_id AS item_id, d.lang AS stratum, CASE WHEN l.quality IS NULL THEN [] ELSE [d.doc_id, d.doc_id + 1] END AS expected, [d.doc_id + k, d.doc_id + k * 2, d.doc_id + 1] AS retrieved, d.doc_id % 3 = 0 AS abstained, d.n_chars AS latency_ms
 FROM (SELECT *, doc_id % 3 AS k FROM documents) d LEFT JOIN labels l USING (doc_id))"""


def _results(spark, d):
    k, i = F.col("doc_id") % 3, F.col("doc_id")
    x = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.select(i.alias("item_id"), F.col("lang").alias("stratum"), F.when(F.col("quality").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(i, i + 1)).alias("expected"), F.array(i + k, i + k * 2, i + 1).alias("retrieved"), (k == 0).alias("abstained"), F.col("n_chars").alias("latency_ms"))


@query(f"""
WITH {_RESULTS}, m AS (SELECT *, len(expected) > 0 AS ans, len(list_intersect(expected, retrieved)) / len(expected) AS rec, len(list_filter(retrieved, lambda x: list_contains(expected, x))) / 3 AS prec,
 coalesce(1 / list_position(list_transform(retrieved, lambda x: list_contains(expected, x)), true), 0) AS rr FROM r)
SELECT stratum, count(*) AS n, round(coalesce(avg(rec) FILTER (WHERE ans), 0), 6) AS recall_10, round(coalesce(avg(rr) FILTER (WHERE ans), 0), 6) AS mrr, round(coalesce(avg(prec) FILTER (WHERE ans), 0), 6) AS precision_5,
 round(avg((NOT abstained)::INT) FILTER (WHERE NOT ans), 6) AS false_answer_rate, round(avg(abstained::INT), 6) AS abstention_rate,
 list_sort(list(latency_ms))[least(floor(0.5 * count(*)), count(*) - 1)::INT + 1] AS p50_ms, list_sort(list(latency_ms))[least(floor(0.95 * count(*)), count(*) - 1)::INT + 1] AS p95_ms FROM m GROUP BY stratum
""")
def eval_summary(spark, d):
    """Metrics by stratum."""
    return evaluation.summary(_results(spark, d))


@query(f"WITH {_RESULTS} SELECT stratum, count(*) AS n, round(2.8 * stddev_samp(coalesce(1 / list_position(list_transform(retrieved, lambda x: list_contains(expected, x)), true), 0)) / sqrt(count(*)), 6) AS mde FROM r GROUP BY stratum")
def detectable_effect(spark, d):
    """The smallest change that a stratum can show."""
    return evaluation.detectable_effect(_results(spark, d), evaluation.reciprocal_rank())


def _paired(spark, d):
    r = _results(spark, d)
    return r.select("stratum", "item_id", evaluation.recall_at(1).alias("base"), evaluation.recall_at(10).alias("cand"))


@query()
def paired_bootstrap(spark, d):
    """95% interval of the change of recall."""
    return evaluation.paired_bootstrap(_paired(spark, d))


_GATED = """
g AS (SELECT d.doc_id AS item_id, CASE WHEN l.quality IS NULL THEN 'unanswerable' WHEN d.n_chars > 4000 THEN 'long-' || coalesce(d.lang, 'none') ELSE coalesce(d.lang, 'none') END AS stratum, CASE WHEN l.quality IS NULL THEN [] ELSE [d.doc_id, d.doc_id + 1] END AS expected, d.doc_id % 12 > 0 AS abstained, d.n_chars AS latency_ms
 FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _gated(spark, d):
    """Two runs over the documents: the candidate finds less in long texts and more in others."""
    i = F.col("doc_id")
    x = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    long = F.col("n_chars") > 4000
    lang = F.coalesce("lang", F.lit("none"))
    stratum = F.when(F.col("quality").isNull(), "unanswerable").when(long, F.concat(F.lit("long-"), lang)).otherwise(lang)
    base = x.select(i.alias("item_id"), stratum.alias("stratum"), F.when(F.col("quality").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(i, i + 1)).alias("expected"), F.when(i % 3 == 0, F.array(i + 1, i + 5)).otherwise(F.array(i + 7, i)).alias("retrieved"), (i % 12 > 0).alias("abstained"), F.col("n_chars").alias("latency_ms"))
    return base, base.withColumn("retrieved", F.when(F.col("latency_ms") > 4000, F.array(F.col("item_id") + 9)).otherwise(F.array("item_id", F.col("item_id") + 1)))


@query(f"""
WITH {_GATED}, s AS (SELECT stratum, count(*) AS n, round(avg((NOT abstained)::INT) FILTER (WHERE len(expected) = 0), 6) AS rate, list_sort(list(latency_ms))[least(floor(0.95 * count(*)), count(*) - 1)::INT + 1] AS p95 FROM g GROUP BY stratum)
SELECT 'warning' AS level, stratum, metric, 'few-items' AS rule, n::DOUBLE AS value FROM s, (VALUES ('recall@10'), ('mrr')) m(metric) WHERE n < 30
 UNION ALL SELECT 'failure', stratum, metric, 'regressed', NULL FROM s, (VALUES ('recall@10'), ('mrr')) m(metric) WHERE n >= 30 AND stratum LIKE 'long-%'
 UNION ALL SELECT 'failure', stratum, NULL, 'false-answers', rate FROM s WHERE stratum = 'unanswerable' AND rate > 0.1
 UNION ALL SELECT 'warning', NULL, NULL, 'no-unanswerable', NULL WHERE NOT EXISTS (SELECT 1 FROM s WHERE stratum = 'unanswerable' AND rate IS NOT NULL)
 UNION ALL SELECT 'warning', stratum, NULL, 'slow', p95::DOUBLE FROM s WHERE p95 > 2500
""")
def eval_findings(spark, d):
    """Failures and warnings of a candidate; the value of a regression hangs on draws and is left out."""
    base, new = _gated(spark, d)
    out = evaluation.findings(evaluation.compared(base, new), evaluation.summary(new))
    return out.withColumn("value", F.when(F.col("rule") != "regressed", F.col("value")))


@query()
def eval_gate(spark, d):
    """The verdict over two runs, one row (C14)."""
    base, new = _gated(spark, d)
    return evaluation.gate(evaluation.compared(base, new), evaluation.summary(new))


@query()
def document_chunks(spark, d):
    """Documents cut by headings and paragraphs (X11, F-H4, Q28, C15)."""
    return chunking.chunk_documents(table(spark, d, "documents"), title=F.col("source")).select("doc_id", "ordinal", "heading", "tokens", "chunk_id")


def _sized(spark, d):
    from corpusloom.functions.text import estimate_tokens

    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("chunk_id"), "text", estimate_tokens(F.col("text")).alias("tokens"), (F.col("doc_id") % 13 == 0).alias("generated"))


_PRINTS = """
w AS (SELECT doc_id, list_filter(string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '//[^\\n]*', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'), '#[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS ws FROM documents WHERE ceil(length(text) / 3.5) >= 40),
s AS (SELECT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) END AS sh FROM w),
h AS (SELECT doc_id, substr(sha256(unnest(sh)), 1, 16) AS hx FROM s),
b AS (SELECT doc_id, k, sum(CASE WHEN (('0x' || substr(hx, 16 - k // 4, 1))::INT >> (k % 4)) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(0, 64) t(k) GROUP BY doc_id, k),
p AS (SELECT doc_id, sum(CASE WHEN v > 0 AND k < 32 THEN 1::BIGINT << k::INT ELSE 0 END)::BIGINT AS low, sum(CASE WHEN v > 0 AND k >= 32 THEN 1::BIGINT << (k::INT - 32) ELSE 0 END)::BIGINT AS high FROM b GROUP BY doc_id)"""


@query(f"""
WITH RECURSIVE {_PRINTS}, f AS (SELECT low, high, min(doc_id) AS doc_id FROM p GROUP BY low, high), o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM f),
near AS (SELECT a.doc_id AS late, b.doc_id AS early FROM f a JOIN f b ON b.doc_id < a.doc_id AND bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)) <= 3),
heads AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS hs UNION ALL SELECT o.n, CASE WHEN EXISTS (SELECT 1 FROM near WHERE late = o.doc_id AND list_contains(hs, early)) THEN hs ELSE list_append(hs, o.doc_id) END FROM heads JOIN o ON o.n = heads.n + 1),
l AS (SELECT hs FROM heads ORDER BY n DESC LIMIT 1), led AS (SELECT f.doc_id, f.low, f.high, coalesce((SELECT min(early) FROM near, l WHERE late = f.doc_id AND list_contains(hs, early)), f.doc_id) AS leader FROM f),
m AS (SELECT p.doc_id AS chunk_id, led.leader, ceil(length(d.text) / 3.5)::BIGINT AS tokens FROM p JOIN led ON led.low = p.low AND led.high = p.high JOIN documents d ON d.doc_id = p.doc_id),
c AS (SELECT leader, count(*) AS cluster_size, first(chunk_id ORDER BY chunk_id % 13 = 0, tokens DESC, chunk_id) AS representative FROM m GROUP BY leader HAVING count(*) > 1)
SELECT chunk_id, leader, cluster_size, representative FROM m JOIN c USING (leader)
""")
def near_dup_clusters(spark, d):
    """Leader clusters of near-equal fingerprints."""
    from corpusloom.plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    return dedupe.leader_clusters(_sized(spark, d))


@query(f"""
WITH {_PRINTS}, f AS (SELECT low, high, min(doc_id) AS doc_id FROM p GROUP BY low, high)
SELECT least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b, (bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)))::INT AS distance FROM f a JOIN f b ON a.doc_id < b.doc_id AND bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)) <= 3
""")
def hamming_pairs(spark, d):
    """Pairs of fingerprints within three bits, under their smallest ids (J26, F-H8)."""
    prints = written(dedupe.fingerprints(_sized(spark, d)), "fingerprints")
    first = prints.groupBy("simhash").agg(F.min("chunk_id").alias("first"))
    f = lambda s, name: first.select(F.col("simhash").alias(s), F.col("first").alias(name))
    x = dedupe.hamming_pairs(prints).join(f("simhash_a", "x"), "simhash_a").join(f("simhash_b", "y"), "simhash_b")
    return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


@query("""
WITH c AS (SELECT doc_id AS chunk_id, sha256(text) AS content_hash FROM documents), k AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0)
SELECT min(chunk_id) AS chunk_id, content_hash FROM c WHERE content_hash NOT IN (SELECT content_hash FROM k) GROUP BY content_hash
""")
def embedding_cache_misses(spark, d):
    """One chunk for each text that the cache lacks."""
    x = table(spark, d, "documents")
    c = x.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))
    return dedupe.cache_split(c, c.where("chunk_id % 3 = 0").select("content_hash").distinct())[1].select("chunk_id", "content_hash")


def search(spark, d, session: list[int] | None = None, rescore=None):
    """(served, verdicts) of the whole retrieval over every passage of the benchmark.

    A passage's vector is the one of its number. Every fifth passage asks for a document by
    name, others start like questions of one intent each.
    """
    from corpusloom.functions.text import estimate_tokens

    who = access.Access("o1", [f"src{i}" for i in range(20)], "confidential")
    i, q = F.col("doc_id"), F.col("item_id")
    open_ = _chunks(spark, d).where(access.allowed(who, "o1")).select("doc_id", "module", F.when(i % 15 == 0, "adr").otherwise(F.col("corpus")).alias("corpus"))
    docs = table(spark, d, "documents").join(open_, "doc_id").select("doc_id", "text", "module", "corpus", F.concat(F.lit("doc_"), i.cast("string")).alias("name"), estimate_tokens(F.col("text")).alias("tokens"), F.when(F.length("text") < 400, "shallow").otherwise("semantic").alias("depth"), (i % 13 == 0).alias("generated"))
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id").join(open_.select("doc_id"), "doc_id", "left_semi")
    start = F.when(q % 5 == 0, F.concat(F.lit("what does doc_"), (q * 3).cast("string"), F.lit(" do "))).when(q % 5 == 1, F.lit("why ")).when(q % 5 == 2, F.lit("how to ")).otherwise(F.lit(""))
    asked = table(spark, d, "benchmark").select(q.alias("query_id"), F.concat(start, F.col("text")).alias("query"))
    asked = asked.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    links = table(spark, d, "documents").select(i.alias("src"), (i * 7 % 50).alias("dst"), F.when(i % 2 == 0, "callee").otherwise("type").alias("relation"))
    return retrieval.hybrid_search(docs, e, asked, links, docs.where("doc_id % 9 = 0").select("doc_id"), session=session, rescored=rescore)


@query()
def hybrid_search(spark, d):
    """Routing, access, five arms, fusion, session boost, diversity, budget, expansion, abstention, for all questions (C1, C2, F-S7)."""
    return search(spark, d, session=[3, 6])[0]


@query()
def search_verdicts(spark, d):
    """What each question's evidence carries."""
    return search(spark, d)[1]


@query()
def search_docs(spark, d):
    """The served documents of the docs and adr corpora; the filter comes after the top, so there may be fewer (C17)."""
    served = search(spark, d)[0]
    docs = _chunks(spark, d).where(F.col("corpus").isin(retrieval.DOCUMENTATION) | (F.col("doc_id") % 15 == 0))
    return served.where("part = 'primary'").join(docs.select("doc_id"), "doc_id", "left_semi")
