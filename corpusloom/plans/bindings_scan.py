"""Queries over the driver's tables: guardrails, text functions and hashes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import checks, hashing, text
from corpusloom.operators import dedupe, scanner
from corpusloom.operators.tables import placed

Q: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(r"""
WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|apikey|secret|password|passwd|token|credential|private[_-]?key|client[_-]?secret)\b["'']?\s*[:=]\s*["'']([^"''\s]{16,})["'']', 1)) AS v FROM documents),
c AS (SELECT doc_id, v, list_reduce(list_transform(list_distinct(string_split(v, '')), lambda ch: -(len(list_filter(string_split(v, ''), lambda x: x = ch)) / len(v)) * log2(len(list_filter(string_split(v, ''), lambda x: x = ch)) / len(v))), lambda a, b: a + b) AS h FROM m)
SELECT doc_id, count(*) AS n FROM c
WHERE h >= 3.5 AND NOT (regexp_full_match(v, '[A-Za-z][A-Za-z0-9_.\-]*') AND len(regexp_extract_all(v, '\d')) / length(v) <= 0.15 AND regexp_matches(v, '[A-Za-z]{6,}') AND len(regexp_extract_all(v, '[_.\-]')) <= 3)
  AND NOT regexp_matches(v, '(?i)\b(?:your|my|the)[_-]?(?:api)?[_-]?(?:key|token|secret|password)\b') GROUP BY doc_id
""")
def scan_assigned_secrets(spark, d):
    """Secrets assigned to a secret-shaped name, by entropy and shape (F-R1, F-R4 to F-R6, F-R9)."""
    rules = [r for r in scanner.RULES if r.id == "generic-assigned-secret"]
    out = scanner.scan(table(spark, d, "documents"), "doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string")), "text", rules, most=None)
    return out.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b((?:\d[ -]?){13,19})\b', 1)) AS v FROM documents),
x AS (SELECT doc_id, regexp_replace(v, '[^0-9]', '', 'g') AS s FROM m),
l AS (SELECT doc_id, s, (SELECT sum(CASE WHEN (length(s) - i) % 2 = 0 THEN CAST(substr(s, i, 1) AS INT) ELSE CAST(substr(s, i, 1) AS INT) * 2 - CASE WHEN CAST(substr(s, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END) FROM range(1, 20) t(i) WHERE i <= length(s)) AS total FROM x WHERE length(s) BETWEEN 13 AND 19 AND s NOT LIKE '0%')
SELECT doc_id, count(*) AS n FROM l WHERE total % 10 = 0 AND (
 (length(s) IN (13, 16, 19) AND s LIKE '4%') OR (length(s) = 16 AND (CAST(substr(s,1,2) AS INT) BETWEEN 51 AND 55 OR CAST(substr(s,1,4) AS INT) BETWEEN 2221 AND 2720))
 OR (length(s) = 15 AND substr(s,1,2) IN ('34','37')) OR (length(s) = 14 AND (CAST(substr(s,1,3) AS INT) BETWEEN 300 AND 305 OR s LIKE '3095%' OR substr(s,1,2) IN ('36','38','39')))
 OR (length(s) IN (16, 19) AND (s LIKE '6011%' OR s LIKE '65%' OR CAST(substr(s,1,3) AS INT) BETWEEN 644 AND 649 OR CAST(substr(s,1,6) AS INT) BETWEEN 622126 AND 622925))
 OR (length(s) BETWEEN 16 AND 19 AND (CAST(substr(s,1,4) AS INT) BETWEEN 3528 AND 3589 OR s LIKE '62%'))) GROUP BY doc_id
""")
def scan_card_numbers(spark, d):
    """Card numbers by issuer, length and check digit (F-R2, F-R7)."""
    rules = [r for r in scanner.RULES if r.id == "credit-card"]
    return scanner.scan(table(spark, d, "documents"), "doc_id", F.lit("data.txt"), "text", rules, most=None).groupBy("doc_id").agg(F.count("*").alias("n"))


_ENTROPY = "list_reduce(list_transform(list_distinct(string_split(v, '')), lambda ch: -(len(list_filter(string_split(v, ''), lambda x: x = ch)) / len(v)) * log2(len(list_filter(string_split(v, ''), lambda x: x = ch)) / len(v))), lambda a, b: a + b)"
_LUHN = """(SELECT sum(CASE WHEN (length(s) - i) % 2 = 0 THEN CAST(substr(s, i, 1) AS INT) ELSE CAST(substr(s, i, 1) AS INT) * 2 - CASE WHEN CAST(substr(s, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END) FROM range(1, 20) t(i) WHERE i <= length(s)) % 10 = 0
 AND s NOT LIKE '0%' AND ((length(s) IN (13, 16, 19) AND s LIKE '4%') OR (length(s) = 16 AND (CAST(substr(s,1,2) AS INT) BETWEEN 51 AND 55 OR CAST(substr(s,1,4) AS INT) BETWEEN 2221 AND 2720))
 OR (length(s) = 15 AND substr(s,1,2) IN ('34','37')) OR (length(s) = 14 AND (CAST(substr(s,1,3) AS INT) BETWEEN 300 AND 305 OR s LIKE '3095%' OR substr(s,1,2) IN ('36','38','39')))
 OR (length(s) IN (16, 19) AND (s LIKE '6011%' OR s LIKE '65%' OR CAST(substr(s,1,3) AS INT) BETWEEN 644 AND 649 OR CAST(substr(s,1,6) AS INT) BETWEEN 622126 AND 622925))
 OR (length(s) BETWEEN 16 AND 19 AND (CAST(substr(s,1,4) AS INT) BETWEEN 3528 AND 3589 OR s LIKE '62%')))"""
#: What DuckDB's expressions lack is said by a plain pattern and a filter behind it.
_PLAIN = {
    "email-address": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r"NOT regexp_matches(v, '^(no-?reply|donotreply|do-not-reply)@|@(example\.|test\.|localhost)|@[A-Za-z0-9.-]*\bnoreply\.')"),
    "us-ssn": (r"\b(\d{3})-(\d{2})-(\d{4})\b", "NOT regexp_matches(v, '^(000|666|9)')"),
    "phone-e164": (r"(?:^|[^\w.-])\+\d{1,3}[\s-]?\d{6,14}(?:$|[^\w.-])", "true"),
}


def _rule_sql(r: scanner.Rule) -> str:
    pattern, keep = _PLAIN.get(r.id, (r.pattern, "true"))
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    if r.category == "secret":
        keep += "".join(f" AND NOT regexp_matches(trim(v), {quote(p)})" for p in checks.PLACEHOLDERS)
    if r.least_entropy is not None:
        keep += rf" AND {_ENTROPY} >= {r.least_entropy} AND NOT (regexp_full_match(v, '[A-Za-z][A-Za-z0-9_.\-]*') AND len(regexp_extract_all(v, '\d')) / length(v) <= 0.15 AND regexp_matches(v, '[A-Za-z]{{6,}}') AND len(regexp_extract_all(v, '[_.\-]')) <= 3)"
    if r.id == "credit-card":
        keep += f" AND {_LUHN}"
    return f"SELECT doc_id, '{r.id}' AS rule, '{r.category}' AS category, '{r.severity}' AS severity FROM (SELECT doc_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS s FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quote(pattern)}, {r.group})) AS v FROM documents)) WHERE {keep}"


_FINDINGS = " UNION ALL ".join(_rule_sql(r) for r in scanner.RULES if r.id != "iban")


@query(f"SELECT doc_id, rule, category, severity, count(*) AS n FROM ({_FINDINGS}) GROUP BY ALL")
def scan_findings(spark, d):
    """All rules over all documents, every finding counted (F-R1 to F-R3, F-R5 to F-R9, F-R11)."""
    found = scanner.scan(table(spark, d, "documents"), "doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string")), "text")
    return found.groupBy("doc_id", "rule", "category", "severity").agg(F.count("*").alias("n"))


@query(f"""
WITH f AS (SELECT f.*, rule = 'email-address' AND source = 'src1' AS hidden FROM ({_FINDINGS}) f JOIN documents USING (doc_id))
SELECT count(*) AS n_all, count(*) FILTER (WHERE NOT hidden AND category = 'secret') AS n_secret, count(*) FILTER (WHERE NOT hidden AND category = 'pii') AS n_pii, count(*) FILTER (WHERE NOT hidden AND category = 'injection') AS n_injection, count(*) FILTER (WHERE hidden) AS n_suppressed,
 count(*) FILTER (WHERE NOT hidden AND category IN ('secret', 'pii')) = 0 AS passed FROM f
""")
def publish_scan_gate(spark, d):
    """The gate over all findings, with one allowlisted folder (C13, F-R10, F-R12, A19)."""
    found = scanner.scan(table(spark, d, "documents"), "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")), "text", allow=[("src1/**", "email-address")])
    return scanner.gate(found)


@query(r"""
WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS v, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS parts, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS vs, unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')))) AS k FROM documents),
p AS (SELECT doc_id, v, array_to_string(list_slice(parts, 1, k + 1), '') AS gaps, array_to_string(list_slice(vs, 1, k), '') AS before, text FROM m),
s AS (SELECT doc_id, v, substr(text, 1, length(gaps) + length(before)) AS head FROM p WHERE NOT regexp_matches(v, '^(no-?reply|donotreply|do-not-reply)@|@(example\.|test\.|localhost)|@[A-Za-z0-9.-]*\bnoreply\.'))
SELECT doc_id, length(head) - length(replace(head, chr(10), '')) + 1 AS line, length(list_last(string_split(head, chr(10)))) + 1 AS column_no, CASE WHEN length(v) <= 8 THEN substr(v, 1, 1) || repeat('*', greatest(length(v) - 1, 3)) ELSE substr(v, 1, 4) || '********' || substr(v, -2) || ' (' || length(v) || ' chars)' END AS preview,
 '::error file=src/' || doc_id || ',line=' || line || ',col=' || column_no || ',title=email-address::pii (' || preview || ')' AS annotation FROM s
""")
def scan_places(spark, d):
    """Lines, columns, previews and annotations of findings of one rule (F-S13, F-S14, O19)."""
    rules = [r for r in scanner.RULES if r.id == "email-address"]
    found = scanner.scan(table(spark, d, "documents"), "doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string")), "text", rules)
    return scanner.annotations(found).select("doc_id", "line", F.col("column").alias("column_no"), "preview", "annotation")


@query(f"""
WITH f AS (SELECT f.*, source FROM ({_FINDINGS}) f JOIN documents USING (doc_id))
SELECT source, rule, severity, count(*) AS n, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, source NULLS FIRST, rule) AS place FROM f GROUP BY source, rule, severity
""")
def findings_report(spark, d):
    """Findings by source in report order: severity, path, rule."""
    docs = table(spark, d, "documents")
    found = scanner.scan(docs, "doc_id", F.col("source"), "text")
    per = found.groupBy(F.col("path").alias("source"), "rule", "severity").agg(F.count("*").alias("n"))
    return placed(per, scanner.rank(F.col("severity"), scanner.SEVERITIES), F.asc("source"), F.asc("rule"))


@query(f"SELECT '{scanner.ruleset_hash()}' AS hash, CASE WHEN doc_id % 4 = 3 THEN 'restricted' WHEN doc_id % 4 = 2 THEN 'confidential' WHEN doc_id % 4 = 1 THEN 'internal' ELSE 'public' END AS tier, count(*) FILTER (WHERE doc_id % 4 <= 1) AS visible, count(*) FILTER (WHERE doc_id % 4 <> 3) AS embeddable, count(*) FILTER (WHERE doc_id % 4 > doc_id % 3) AS downgraded FROM documents GROUP BY ALL")
def visibility_by_tier(spark, d):
    """Documents by tier: visible with the internal clearance, embeddable, and in a lower tier than before (F-R13, F-R15, O21)."""
    tiers = F.array(*[F.lit(t) for t in scanner.TIERS])
    x = table(spark, d, "documents").select(F.get(tiers, (F.col("doc_id") % 4).cast("int")).alias("tier"), F.get(tiers, (F.col("doc_id") % 3).cast("int")).alias("now"))
    return x.groupBy(F.lit(scanner.ruleset_hash()).alias("hash"), "tier").agg(F.count_if(scanner.visible_to(F.col("tier"), F.lit("internal"))).alias("visible"), F.count_if(scanner.embeddable(F.col("tier"))).alias("embeddable"), F.count_if(scanner.is_downgrade(F.col("tier"), F.col("now"))).alias("downgraded"))


@query("""
SELECT category, severity, count(*) AS n FROM (VALUES ('secret','critical',8),('secret','high',6),('pii','critical',2),('pii','high',1),('pii','medium',2),('injection','high',5)) v(category, severity, k), range(v.k) GROUP BY ALL
""")
def scan_rule_table(spark, d):
    """The rules as data."""
    return spark.createDataFrame([(r.category, r.severity) for r in scanner.RULES], "category string, severity string").groupBy("category", "severity").agg(F.count("*").alias("n"))


_PATHS = "concat(p_type, '/', CASE p_size % 6 WHEN 0 THEN '.env' WHEN 1 THEN 'node_modules/x.js' WHEN 2 THEN 'a.pem' WHEN 3 THEN 'app.min.js' WHEN 4 THEN 'secrets/x' ELSE 'src/main.ts' END)"


@query(f"""
SELECT p_partkey, regexp_matches(p, '(^|/)[.]env([.].*)?$|[.](pem|key)$|(^|/)(secrets?|credentials?|private)(/|$)', 'i') AS denied,
       regexp_matches(p, '(^|/)(node_modules|dist|build)(/|$)|[.]min[.](js|css)$', 'i') AS skipped, CASE WHEN p LIKE '%.ts' THEN 'typescript' WHEN p LIKE '%.js' THEN 'javascript' END AS language
FROM (SELECT p_partkey, {_PATHS} AS p FROM part)
""")
def path_policy(spark, d):
    """Denied, skipped and language of paths."""
    p = table(spark, d, "part").select("p_partkey", F.expr(_PATHS).alias("p"))
    return p.select("p_partkey", scanner.any_match(F.col("p"), scanner.DENIED_PATHS).alias("denied"), scanner.any_match(F.col("p"), scanner.SKIPPED_PATHS).alias("skipped"), text.language_of(F.col("p")).alias("language"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'restricted' WHEN doc_id % 4 = 3 OR lang = 'de' THEN 'confidential' ELSE 'internal' END AS tier FROM documents
""")
def sensitivity_tier(spark, d):
    """The highest of default, path rule, markers and configuration (F-R14)."""
    i = F.col("doc_id")
    markers = F.when(F.col("lang") == "de", F.array(F.lit("[Sensitive]"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", scanner.tier(F.lit("internal"), [F.when(i % 4 == 3, "confidential")], markers, F.when(i % 10 == 0, "restricted").otherwise("public")).alias("tier"))


@query("""
WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 2)) AS s, length(text) AS n FROM documents)
SELECT doc_id, CAST(ceil(n / 3.5) AS BIGINT) AS tokens, len(s) AS terms FROM t
""")
def token_estimates(spark, d):
    """Token estimates and term sets (F-S1, F-S2)."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(t).alias("tokens"), F.size(text.token_set(t)).cast("long").alias("terms"))


@query("""
WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 2)) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS similarity
FROM q a JOIN q b ON b.item_id = a.item_id + 1
""")
def term_jaccard(spark, d):
    """Likeness of neighbouring passages (F-S3)."""
    q = table(spark, d, "benchmark").select("item_id", text.token_set(F.col("text")).alias("s"))
    a, b = q.alias("a"), q.alias("b")
    return a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(text.jaccard(F.col("a.s"), F.col("b.s")), 6).alias("similarity"))


@query("""
WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
w AS (SELECT *, regexp_split_to_array(trim(text), '\\s+') AS ws, lower(text) AS l FROM q)
SELECT conv_id, turn, CASE WHEN regexp_matches(l, '\\b(why|rationale|decision|chose|instead of|trade-?off|design)\\b') THEN 'why-rationale'
 WHEN regexp_matches(l, '\\b(how do i|how to|integrate|authenticate|get started|example|sdk|client|endpoint)\\b') THEN 'how-to-integrate'
 WHEN regexp_matches(l, '\\b(call|calls|calling|flow|end.to.end|which service|talks to|depends on|upstream|downstream)\\b') THEN 'cross-repo-call-path'
 WHEN (regexp_matches(text, '[`''"]([^`''"]{2,80})[`''"]') OR regexp_matches(text, '\\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*)\\b')) AND (len(ws) <= 6 OR regexp_matches(l, '\\bwhat does .* do\\b')) THEN 'exact-identifier'
 ELSE 'conceptual' END AS intent FROM w
""".replace("\\\\", "\\"))
def query_intent(spark, d):
    """Intent of user turns (F-S4, F-S5)."""
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


@query("""
WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN before IS NULL THEN text ELSE substr(before, 1, 200) || ' — ' || text END AS stitched FROM u
""")
def rewrite_fallback(spark, d):
    """A follow-up behind the user turn before it (F-S6)."""
    from pyspark.sql.window import Window

    u = table(spark, d, "conversations").where("role = 'user'")
    return u.select("conv_id", "turn", text.stitched(F.col("text"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("stitched"))


@query("""
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
       rtrim(lower(regexp_replace(url, '^https?://', '')), './') AS remote FROM pages
""")
def slugs_and_remotes(spark, d):
    """Slugs and canonical remotes of addresses (F-S10, F-S18)."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.slug(F.regexp_replace(u, "^https?://", "")).alias("slug"), text.canonical_remote(u).alias("remote"))


_KEY = "CASE WHEN p_size % 3 > 0 AND p_size % 2 = 0 THEN 'pkg:npm/' || p_name ELSE 'path:r' || p_size || '/' || p_type END"


@query(rf"""
WITH x AS (SELECT *, chr(10) AS n, {_KEY} AS key, CASE p_partkey % 3 WHEN 0 THEN 'own.host/22/' || lower(p_brand) || '/x' WHEN 1 THEN 'own.host/' || lower(p_brand) ELSE 'own.host/' || lower(p_brand) || '.git' END AS remote FROM part),
m AS (SELECT *, 'sym_' || substr(sha256('v2' || n || p_brand || n || key || n || 'python' || n || 'function' || n || p_name || n || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'int' END), 1, 40) AS symbol_id, 'doc_' || substr(sha256(p_brand || n || p_type || n || 'repo-markdown' || n || p_name), 1, 32) AS document_id FROM x)
SELECT p_partkey, 'repo_' || substr(sha256(p_brand || n || remote), 1, 32) AS repository_id, key AS module_key, 'mod_' || substr(sha256('v2' || n || p_brand || n || key), 1, 32) AS module_id, symbol_id,
 'chk_' || substr(sha256(symbol_id || n || p_size || n || sha256(p_name)), 1, 40) AS chunk_id, document_id, 'dch_' || substr(sha256(document_id || n || p_size || n || sha256(p_name)), 1, 32) AS document_chunk_id, 'dsrc_' || substr(sha256(p_brand || n || p_type || n || p_partkey), 1, 32) AS source_id,
 'das_' || substr(sha256(p_brand || n || document_id || n || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END || n || n || n || symbol_id || n || 'about'), 1, 32) AS association_id FROM m
""")
def entity_ids(spark, d):
    """Ids of repositories, modules, symbols, documents and their parts (F-H3, F-H4)."""
    from corpusloom.functions import ids

    k, z = F.col("p_partkey"), F.col("p_size")
    org, name, type_ = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    remote = F.when(k % 3 == 0, F.concat(F.lit("ssh://git@own.host:22/"), org, F.lit("/X.git/"))).when(k % 3 == 1, F.concat(F.lit(" git@Own.host:"), org, F.lit(".git."))).otherwise(F.concat(F.lit("https://user@own.host/"), org, F.lit(".git.GIT")))
    x = table(spark, d, "part").select("*", ids.module_key(F.concat(F.lit("r"), z.cast("string")), F.concat(F.lit("./"), type_, F.lit("\\")), F.when(z % 3 > 0, "npm").otherwise("none"), F.when(z % 2 == 0, name)).alias("module_key"))
    x = x.withColumn("symbol_id", ids.symbol_id(org, F.col("module_key"), F.lit("python"), F.lit("function"), name, F.when(z % 2 > 0, "int"))).withColumn("document_id", ids.document_id(org, type_, name))
    symbol, document, none, hash_ = F.col("symbol_id"), F.col("document_id"), F.lit(None).cast("string"), F.sha2("p_name", 256)
    return x.select(
        "p_partkey", ids.repository_id(org, remote).alias("repository_id"), "module_key", ids.module_id(org, F.col("module_key")).alias("module_id"), "symbol_id", ids.chunk_id(symbol, z, hash_).alias("chunk_id"), "document_id",
        ids.document_chunk_id(document, z, hash_).alias("document_chunk_id"), ids.source_id(org, type_, k).alias("source_id"), ids.association_id(org, document, F.when(z % 2 > 0, type_), none, none, symbol, F.lit("about")).alias("association_id"),
    )


@query("""
SELECT doc_id, 'doc_' || substr(sha256(coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || doc_id), 1, 40) AS id, substr(sha256(text), 1, 12) AS short FROM documents
""")
def stable_ids(spark, d):
    """Prefixed ids and short hashes (F-H1, F-H3, F-H4)."""
    return table(spark, d, "documents").select("doc_id", hashing.stable_id("doc_", F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"), hashing.short_sha(F.col("text"), 12).alias("short"))


@query("""
SELECT c_nationkey, substr(sha256(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey::VARCHAR)), 1, 32) AS hash FROM customer GROUP BY c_nationkey
""")
def permission_set_hash(spark, d):
    """A key of a permission set, whatever its order."""
    return table(spark, d, "customer").groupBy("c_nationkey").agg(hashing.permission_hash(F.collect_list(F.col("c_custkey").cast("string"))).alias("hash"))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '//[^\\n]*', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'), '#[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) END AS sh FROM w),
h AS (SELECT doc_id, substr(sha256(unnest(sh)), 1, 16) AS hx FROM s),
b AS (SELECT doc_id, k, sum(CASE WHEN (('0x' || substr(hx, 16 - k // 4, 1))::INT >> (k % 4)) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(0, 64) t(k) GROUP BY doc_id, k)
SELECT doc_id, CAST(sum(CASE WHEN v > 0 AND k < 32 THEN 1::BIGINT << k::INT ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN v > 0 AND k >= 32 THEN 1::BIGINT << (k::INT - 32) ELSE 0 END) AS BIGINT) AS high FROM b GROUP BY doc_id
""".replace("\\\\", "\\"))
def simhash_prints(spark, d):
    """SimHash fingerprints of all texts, in halves."""
    x = dedupe.fingerprints(table(spark, d, "documents").select("doc_id", "text", F.length("text").alias("tokens")), "doc_id", least=0)
    half = F.lit((1 << 32) - 1)
    return x.select("doc_id", F.col("simhash").bitwiseAND(half).alias("low"), F.shiftrightunsigned("simhash", 32).bitwiseAND(half).alias("high"))


@query("""
SELECT p_partkey, round(-(SELECT sum(n / length(p_name) * log2(n / length(p_name))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS c) GROUP BY c)), 6) AS bits FROM part
""")
def name_entropy(spark, d):
    """Entropy of names (F-R4)."""
    return table(spark, d, "part").select("p_partkey", F.round(checks.entropy(F.col("p_name")), 6).alias("bits"))
