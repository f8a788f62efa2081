"""Queries over the driver's tables: normal forms, declarations, assembly, documents out, sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import normalize
from corpusloom.operators import api_guide, assembly, chunking, diff
from corpusloom.operators.tables import spread
from corpusloom.plans.bindings_scan import table
from corpusloom.sources import repository, rules, services, store
from corpusloom.streaming import access, sessions

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _fill(template: str, **columns):
    """A template as an expression, with {name} replaced by columns."""
    parts, rest = [], template
    while "{" in rest and any("{" + c + "}" in rest for c in columns):
        name, at = min(((c, rest.find("{" + c + "}")) for c in columns if "{" + c + "}" in rest), key=lambda x: x[1])
        parts += [F.lit(rest[:at]), columns[name].cast("string")]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))


@query("""
SELECT p_partkey, 'function f_' || p_partkey || '(a: string, b?: number): Promise<"x  ,y">' AS ts, 'def f_' || p_partkey || '(a: int = 1, *args)' AS py, 'type T' || p_partkey || ' = A | ''b|c'' | (() => D)' AS alias FROM part
""")
def normal_signatures(spark, d):
    """Signatures that no formatting changes (F-S8)."""
    k = F.col("p_partkey")
    ts = _fill('function  f_{k}( a :string, // one\n  b ? : number,\n)  : Promise< "x  ,y" >  {', k=k)
    py = _fill("def f_{k}(a :int=1,  # note\n   *args )", k=k)
    alias = _fill("type T{k}=A|/* x */'b|c'|(()=>D);", k=k)
    f = normalize.normal_signature
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", f(ts, F.lit("typescript")).alias("ts"), f(py, F.lit("python")).alias("py"), f(alias, F.lit("typescript")).alias("alias"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || '@see ' || p_brand AS doc FROM part")
def normal_docs(spark, d):
    """Documentation without comment marks (F-S9)."""
    raw = _fill("/**\n   * {n}  \n *\n *\n *\n   * @see {b}\n   */", n=F.col("p_name"), b=F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", normalize.normal_doc(raw).alias("doc"))


@query("""
WITH w AS (SELECT p_partkey, list_sort(list_concat(string_split(p_name, ' '), ['"z | y"', 'Array<a' || p_size % 3 || ' | b>'])) AS ms FROM part)
SELECT p_partkey, '(x: ' || array_to_string(ms, ' | ') || ', y?: {k: ' || array_to_string(ms, ' | ') || '; }) => M & L' AS type FROM w
""")
def normal_types(spark, d):
    """Union members in order at every depth, and nothing else moved (F-S12)."""
    words = F.concat(F.split("p_name", " "), F.array(F.lit('"z | y"'), _fill("Array<b | a{k}>", k=F.col("p_size") % 3)))
    union = F.array_join(F.reverse(words), " | ")
    text = F.concat(F.lit("(x: "), union, F.lit(", y?: {k: "), union, F.lit("; }) => M & L"))
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", normalize.normal_type(text).alias("type"))


@query("""
SELECT p_partkey, unnest(['a', 'b', 'c', 'd']) AS name, unnest(['Map<string, ' || p_brand || '>', 'number', NULL, 'T[]']) AS type, unnest([false, true, true, false]) AS optional, unnest([NULL, NULL, '"x, y"', NULL]) AS "default", unnest([false, false, false, true]) AS rest FROM part
""")
def signature_parameters(spark, d):
    """Parameters of a signature, brackets and quotes respected (F-S15)."""
    sig = _fill('f(a: Map<string, {b}>, b?: number, c = "x, y", ...d: T[]): void', b=F.col("p_brand"))
    x = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.explode(normalize.parameters(sig, F.lit("typescript"))).alias("p"))
    return x.select("p_partkey", "p.*")


@query("""
WITH c AS (SELECT p_brand AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, p_partkey AS k, p_size FROM part)
SELECT path, (n - 1) * 6 + 2 AS line, 'class' AS kind, 'C' || k AS qualified_name, CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'internal' END AS visibility, 'About ' || k AS doc FROM c
UNION ALL SELECT path, (n - 1) * 6 + 3, 'method', 'C' || k || '.run', 'public', NULL FROM c UNION ALL SELECT path, (n - 1) * 6 + 6, 'function', 'f' || k, 'public', NULL FROM c
""")
def lexical_declarations(spark, d):
    """Declarations found by lines, with owners, visibility and documentation."""
    k = F.col("p_partkey")
    block = F.concat(_fill("/** About {k} */\n", k=k), F.when(F.col("p_size") % 2 == 0, "export ").otherwise(""), _fill("class C{k} {\n  run(a: string) {\n  }\n}\nexport function f{k}(x: number) { return 1 }", k=k))
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("t")))), lambda x: x["t"]), "\n").alias("text")).withColumn("language", F.lit("typescript"))
    return assembly.declarations(files).select("path", "line", "kind", "qualified_name", "visibility", "doc")


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN 'Does ' || p_name ELSE 'Does ' || p_name || '.' END AS summary, 'the ' || p_brand AS a, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 'a value' END AS returns, p_partkey % 5 = 0 AS deprecated FROM part
""")
def doc_comment_parts(spark, d):
    """Summary, parameters and return value of documentation in five forms."""
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 5
    forms = [
        "Does {n}.\n\n@param {string} a - the {b}\n@returns {T} a value\n@deprecated since 2",
        "Does {n}.\n\n:param str a: the {b}\n:return: a value",
        "<summary>Does {n}.</summary>\n<param name=\"a\">the {b}</param>\n<returns>a value</returns>",
        "Does {n}.\n\nArgs:\n    a (str): the {b}\n\nReturns:\n    a value",
    ]
    raw = F.when(k == 4, _fill("Does {n}\n\nParameters\n----------\na : str\n    the {b}\n\n", n=n, b=b))
    for i, form in enumerate(forms):
        raw = raw.when(k == i, _fill(form, n=n, b=b))
    x = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", assembly.doc_parts(raw).alias("p"))
    return x.select("p_partkey", "p.summary", F.try_element_at("p.params", F.lit("a")).alias("a"), "p.returns", "p.deprecated")


_RAW = """
r AS (SELECT p_partkey AS ordinal, p_type AS module, CASE WHEN p_size % 5 = 0 THEN 'python' ELSE 'typescript' END AS language, 'function' AS kind, p_name AS name, (p_size % 2)::VARCHAR AS overload, CASE p_size % 3 WHEN 0 THEN 'artifact' WHEN 1 THEN 'semantic' ELSE 'shallow' END AS depth FROM part),
i AS (SELECT *, 'sym_' || substr(sha256(array_to_string(['v2', 'o1', module, language, kind, name, overload], chr(10))), 1, 40) AS id FROM r),
s AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1),
u AS (SELECT i.id AS src, i.module, coalesce(q.p_name, 'nobody') AS name, CASE WHEN i.ordinal % 2 = 0 THEN 'call' ELSE 'extends' END AS kind FROM i LEFT JOIN part q ON q.p_partkey = i.ordinal + 1),
l AS (SELECT module, name, last(id ORDER BY ordinal) AS l FROM i GROUP BY ALL), g AS (SELECT name, first(id ORDER BY ordinal) AS g FROM i GROUP BY ALL),
e AS (SELECT DISTINCT u.src, u.name, u.kind, coalesce(l.l, g.g) AS dst FROM u LEFT JOIN l USING (module, name) LEFT JOIN g ON g.name = u.name)"""


def _assembled(spark, d):
    p = table(spark, d, "part")
    z = F.col("p_size")
    raw = p.select(F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("module"), F.when(z % 5 == 0, "python").otherwise("typescript").alias("language"), F.lit("function").alias("kind"), F.col("p_name").alias("qualified_name"), (z % 2).cast("string").alias("overload"), F.concat("p_name", F.lit("( )")).alias("signature"), F.col("p_brand").alias("doc"), F.when(z % 3 == 0, "artifact").when(z % 3 == 1, "semantic").otherwise("shallow").alias("depth"))
    next_ = p.select((F.col("p_partkey") - 1).alias("ordinal"), F.col("p_name").alias("n"))
    calls = p.select(F.col("p_partkey").alias("ordinal")).join(next_, "ordinal", "left").select("ordinal", F.coalesce("n", F.lit("nobody")).alias("name"), F.when(F.col("ordinal") % 2 == 0, "call").otherwise("extends").alias("kind"))
    return assembly.assemble(raw, calls, "o1")


@query(f"WITH {_RAW} SELECT s.id AS symbol_id, sha256(s.language || chr(10) || 'function' || chr(10) || s.name || '()') AS signature_hash, (SELECT count(DISTINCT src) FROM e WHERE e.dst = s.id AND e.kind = 'call') AS n_users FROM s")
def assemble_symbols(spark, d):
    """Symbols with ids, hashes and users; the first of equal ids stays (C16, F-H3, W5, A13)."""
    symbols = _assembled(spark, d)[0]
    return symbols.select("symbol_id", "signature_hash", F.size("users").cast("long").alias("n_users"))


@query(f"WITH {_RAW} SELECT src, name, kind, dst FROM e")
def assemble_edges(spark, d):
    """Edges by name: the module's last symbol, else the first of all; none is unresolved."""
    return _assembled(spark, d)[1]


@query(f"""
WITH {_RAW} SELECT module, count(*) AS n_symbols, CASE WHEN bool_or(depth = 'shallow') THEN 'shallow' WHEN bool_or(depth = 'semantic') THEN 'semantic' ELSE 'artifact' END AS depth, list_sort(list(DISTINCT language)) AS languages, (SELECT count(*) FROM i WHERE i.module = s.module) - count(*) AS n_dropped FROM s GROUP BY module
""")
def assemble_modules(spark, d):
    """Symbols, least depth, languages and dropped duplicates of each module."""
    return _assembled(spark, d)[2]


@query("""
WITH s AS (SELECT p_brand AS module, p_partkey::VARCHAR AS name, '## ' || p_partkey || chr(10) || chr(10) || '```' || chr(10) || p_name || '()' || chr(10) || '```' || chr(10) || CASE WHEN p_size % 2 = 0 THEN chr(10) || p_type || chr(10) ELSE '' END AS s FROM part WHERE p_size % 3 > 0)
SELECT module, count(*) AS n, md5('# ' || module || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY name)) AS page FROM s GROUP BY module
""")
def module_pages(spark, d):
    """Reference pages of modules."""
    z = F.col("p_size")
    x = table(spark, d, "part").select(F.col("p_brand").alias("module"), F.col("p_partkey").cast("string").alias("name"), F.concat("p_name", F.lit("()")).alias("signature"), F.when(z % 2 == 0, F.col("p_type")).alias("doc"), F.when(z % 3 > 0, "public").otherwise("private").alias("visibility"))
    return assembly.module_reference(x).select("module", "n", F.md5("page").alias("page"))


@query("SELECT 'graph LR' || chr(10) || string_agg(l, chr(10) ORDER BY a, b) AS diagram FROM (SELECT DISTINCT p_type AS a, p_brand AS b, '  ' || p_type || ' --> ' || p_brand AS l FROM part)")
def dependency_diagram(spark, d):
    """A diagram of module edges."""
    return assembly.dependency_diagram(table(spark, d, "part").select(F.col("p_type").alias("src"), F.col("p_brand").alias("dst")))


@query("""
SELECT 'm' || p_partkey AS dir, 'npm' AS ecosystem, p_name AS name, '1.' || p_size AS version, list_sort(['dev-x', p_brand, p_type]) AS dependencies FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'm' || p_partkey, 'npm', NULL, NULL, [] FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 'm' || p_partkey, 'pypi', p_type, '2.' || p_size, list_sort(['numpy', 'pandas']) FROM part WHERE p_partkey % 3 = 2
""")
def manifests(spark, d):
    """Names, versions and dependencies of manifests; malformed ones have none (S3)."""
    k = F.col("p_partkey")
    npm = F.to_json(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version"), F.create_map(F.col("p_brand"), F.lit("1"), F.col("p_type"), F.lit("2")).alias("dependencies"), F.create_map(F.lit("dev-x"), F.lit("3")).alias("devDependencies")))
    toml = _fill('[project]\nname = "{n}"\nversion = "2.{v}"\ndependencies = ["pandas>=2", "numpy"]\n', n=F.col("p_type"), v=F.col("p_size"))
    text = F.when(k % 3 == 0, npm).when(k % 3 == 1, "{not json").otherwise(toml)
    files = table(spark, d, "part").select(F.concat(F.lit("m"), k.cast("string"), F.when(k % 3 == 2, "/pyproject.toml").otherwise("/package.json")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    return repository.manifests(files)


_OWNERS = "* @all\n/docs/ @writers\n*.ts @web # front\n/src/api/ @api @core\nsrc/api/*.md @docs\n"


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ['@writers'] WHEN 1 THEN ['@web'] WHEN 2 THEN ['@api', '@core'] WHEN 3 THEN ['@docs'] WHEN 4 THEN ['@all'] ELSE ['@writers'] END AS owners FROM part
""")
def code_owners(spark, d):
    """Owners by the longest pattern, of equal ones the last."""
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("docs/a{k}.md", "web/x{k}.ts", "src/api/y{k}.py", "src/api/z{k}.md", "other/{k}.py", "docs/deep/er/{k}.txt")])
    x = table(spark, d, "part").select("p_partkey", F.replace(F.get(names, (k % 6).cast("int")), F.lit("{k}"), k.cast("string")).alias("path"))
    # Path columns compress well, so that sizes after a shuffle would have the join send millions of rows through the driver.
    return x.join(rules.owners(x.select("path").distinct(), _OWNERS).hint("merge"), "path").select("p_partkey", "owners")


@query("""
WITH f AS (SELECT p_partkey, p_partkey % 3 AS d, p_partkey % 2 AS keep, p_size % 2 AS ts, right(p_brand, 1)::INT AS b FROM part)
SELECT p_partkey FROM f WHERE NOT (CASE WHEN d = 1 AND b % 2 = 0 THEN true WHEN d = 2 AND b % 3 = 0 AND keep = 1 THEN true WHEN d = 1 AND ts = 1 THEN true WHEN ts = 0 THEN NOT (keep = 1 AND b % 2 = 0) ELSE false END)
""")
def nested_ignores(spark, d):
    """Files that the ignore files of their folders leave in: the nearest file, the last line, folders as wholes."""
    k, z = F.col("p_partkey"), F.col("p_size")
    digit = F.right("p_brand", F.lit(1)).cast("int")
    x = table(spark, d, "part")
    pick = lambda names, n: F.get(F.array(*[F.lit(v) for v in names]), (n % len(names)).cast("int"))
    files = x.select("p_partkey", F.concat_ws("/", "p_brand", pick(["src", "tmp", "lib"], k), F.concat(pick(["a", "keep"], k), k.cast("string"), pick([".log", ".ts"], z))).alias("path"))
    brands = x.select("p_brand", digit.alias("b")).distinct()
    top = brands.select(F.concat("p_brand", F.lit("/.gitignore")).alias("path"), F.when(F.col("b") % 2 == 0, "# kept\n!keep*.log\n/tmp/\n").otherwise("tmp/*.ts\n").alias("text"))
    deep = brands.where("b % 3 = 0").select(F.concat("p_brand", F.lit("/lib/.gitignore")).alias("path"), F.lit("[k-m]eep*\n").alias("text"))
    root = brands.limit(1).select(F.lit(".gitignore").alias("path"), F.lit("*.log\n").alias("text"))
    return rules.not_ignored(files, rules.rules_of(top.unionByName(deep).unionByName(root))).select("p_partkey")


@query("""
SELECT 'doc_' || substr(sha256('o1' || chr(10) || 'r1' || chr(10) || 'repo-markdown' || chr(10) || p), 1, 32) AS document_id, p AS path,
 CASE p_partkey % 4 WHEN 0 THEN 'T' || p_partkey WHEN 1 THEN p_name ELSE CASE p_size % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'adr' ELSE 'docs' END || ' README' WHEN 1 THEN 'The File' ELSE 'User Guide' END END AS title,
 CASE WHEN p_partkey % 4 = 0 THEN 'memo' WHEN p_partkey % 4 <> 1 AND p_size % 3 = 0 THEN 'readme' WHEN p_partkey % 2 = 0 THEN 'adr' WHEN p_size % 3 = 2 AND p_partkey % 4 <> 1 THEN 'user-guide' ELSE 'technical-documentation' END AS document_type,
 CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'end-user' ELSE 'developer' END AS audience, CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'historical' WHEN p_partkey % 4 > 1 AND p_size % 3 = 0 THEN 'canonical' ELSE 'supporting' END AS authority, CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'public' ELSE 'internal' END AS sensitivity, 'body ' || p_brand AS body
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '/docs/adr/' ELSE p_partkey || '/docs/' END || CASE WHEN p_partkey % 4 < 2 THEN 'page' WHEN p_size % 3 = 0 THEN 'ReadMe' WHEN p_size % 3 = 1 THEN 'the-_file' ELSE 'user-guide' END || '.md' AS p FROM part WHERE p_partkey % 7 <> 0)
""")
def markdown_sources(spark, d):
    """Markdown files as documents: heads of files, titles, types and authority; excluded paths are left out (S6, S7, F-S19, F-H4)."""
    k, z = F.col("p_partkey"), F.col("p_size")
    folder = F.when(k % 7 == 0, "/docs/private/").when(k % 2 == 0, "/docs/adr/").otherwise("/docs/")
    name = F.when(k % 4 < 2, "page").when(z % 3 == 0, "ReadMe").when(z % 3 == 1, "the-_file").otherwise("user-guide")
    head = _fill("---\r\ntitle: \"T{k}\"\r\ndocumentType:  memo \naudience: {a}\nauthority: {h}\nsensitivity: {s}\n---\nbody {b}", k=k, b=F.col("p_brand"), a=F.when(z % 2 == 0, "'end-user'").otherwise("nobody"), h=F.when(z % 2 == 0, "historical").otherwise(""), s=F.when(z % 2 == 0, "public").otherwise("Public"))
    text = F.when(k % 4 == 0, head).when(k % 4 == 1, _fill("# {n} #\nbody {b}", n=F.col("p_name"), b=F.col("p_brand"))).otherwise(_fill("body {b}", b=F.col("p_brand")))
    files = table(spark, d, "part").select(F.concat(k.cast("string"), folder, name, F.lit(".md")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    out = repository.markdown_documents(files, include=["*/docs/**"], exclude=["**/private/**"], org="o1", repository="r1")
    return out.select("document_id", "path", "title", "document_type", "audience", "authority", "sensitivity", F.regexp_replace("body", "(?s)^# [^\n]*\n", "").alias("body"))


_SPEC = '{{"openapi": "3.0.1", "paths": {{"/a/{k}": {{"parameters": [{{"name": "id", "in": "path", "required": true}}], "get": {{"operationId": "get{k}", "responses": {{"404": {{}}, "200": {{}}}}, "security": [{{"key": []}}]}}, "post": {{"responses": {{}}}}}}}}}}'.replace("{{", "{").replace("}}", "}")


@query("""
SELECT 's' || p_partkey AS spec, 'GET' AS method, '/a/' || p_partkey AS route, 'get' || p_partkey AS operation_id, ['200', '404'] AS statuses, 1 AS n_params, ['key'] AS schemes FROM part WHERE p_partkey % 4 <> 3
UNION ALL SELECT 's' || p_partkey, 'POST', '/a/' || p_partkey, NULL, [], 1, [] FROM part WHERE p_partkey % 4 <> 3
""")
def openapi_operations(spark, d):
    """Operations of specifications; what is none has none (S8, F-A5)."""
    k = F.col("p_partkey")
    text = F.when(k % 8 == 3, "not: [json").when(k % 4 == 3, '{"paths": {"/x": {"get": {}}}}').otherwise(_fill(_SPEC, k=k))
    specs = table(spark, d, "part").select(F.concat(F.lit("s"), k.cast("string")).alias("path"), text.alias("text"))
    return repository.openapi_operations(specs).select("spec", "method", "route", "operation_id", "statuses", F.size("params").alias("n_params"), "schemes")


@query("""
SELECT 's' || p_partkey AS symbol_id, CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method, CASE WHEN p_partkey % 3 = 2 THEN 'shallow' ELSE 'artifact' END AS depth FROM part
""")
def bound_operations(spark, d):
    """Operations bound to symbols by qualified name, else by name; those are artifacts."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    ops = p.where(k % 3 == 0).select(F.concat(F.lit("C."), k.cast("string")).alias("operation_id"), F.lit("x").alias("spec"), F.lit("GET").alias("method"), F.lit("/").alias("route")).unionByName(p.where(k % 3 == 1).select(k.cast("string").alias("operation_id"), F.lit("x").alias("spec"), F.lit("POST").alias("method"), F.lit("/").alias("route")))
    symbols = p.select(F.concat(F.lit("s"), k.cast("string")).alias("symbol_id"), F.concat(F.lit("C."), k.cast("string")).alias("qualified_name"), k.cast("string").alias("name"), F.lit("shallow").alias("depth"))
    return assembly.attach_operations(symbols, repository.bind_operations(ops, symbols)).select("symbol_id", "method", "depth")


@query("""
SELECT 'svc' || p_size AS name, count(*) AS n, list_sort(list(DISTINCT p_brand)) AS depends_on, first('img' || p_partkey ORDER BY 'f' || p_partkey) FILTER (WHERE p_partkey % 3 <> 0) AS image FROM part GROUP BY p_size
""")
def merged_services(spark, d):
    """Services by name: united dependencies, the first image by path."""
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(F.concat(F.lit("svc"), F.col("p_size").cast("string")).alias("name"), F.when(k % 3 != 0, F.concat(F.lit("img"), k.cast("string"))).alias("image"), F.array("p_brand").alias("depends_on"), F.array(k.cast("string")).alias("ports"), F.concat(F.lit("f"), k.cast("string")).alias("path"))
    return repository.merge_services(x).select("name", F.size("ports").cast("long").alias("n"), "depends_on", "image")


@query("SELECT p_name AS name, 'aws_' || p_type AS type, 'f' || p_partkey || '.tf' AS path FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'r' || p_partkey, 'Microsoft.Web/sites', 'f' || p_partkey || '.bicep' FROM part WHERE p_partkey % 2 = 1")
def declared_services(spark, d):
    """Resources of Terraform and Bicep files."""
    k = F.col("p_partkey")
    tf = _fill('# x\nresource "aws_{t}" "{n}" {\n}\n', t=F.col("p_type"), n=F.col("p_name"))
    bicep = _fill("resource r{k} 'Microsoft.Web/sites@2022-01-01' = {\n}\n", k=k)
    x = table(spark, d, "part").select(F.concat(F.lit("f"), k.cast("string"), F.when(k % 2 == 0, ".tf").otherwise(".bicep")).alias("path"), F.when(k % 2 == 0, tf).otherwise(bicep).alias("text"))
    return repository.terraform_services(x).unionByName(repository.bicep_services(x))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'too-large' WHEN p_partkey % 8 = 1 THEN 'hash-mismatch' WHEN p_partkey % 8 = 2 THEN 'scan-failed' WHEN p_partkey % 8 = 3 THEN 'expired' WHEN p_partkey % 8 = 4 THEN 'replayed' WHEN p_partkey % 8 = 5 THEN 'commit-mismatch' END AS failure FROM part
""")
def verified_bundles(spark, d):
    """Envelopes by the first check that fails."""
    k = F.col("p_partkey") % 8
    e = table(spark, d, "part").select("p_partkey", F.when(k == 0, F.lit(1 << 40)).otherwise(10).alias("size"), F.col("p_name").alias("payload"), F.when(k <= 1, "x").otherwise(F.sha2("p_name", 256)).alias("payload_hash"), (k != 2).alias("scan_passed"), F.when(k == 3, F.to_timestamp(F.lit("2020-01-01"))).otherwise(F.to_timestamp(F.lit("2030-01-01"))).alias("expires_at"), F.concat(F.lit("n"), F.when(k == 4, F.lit(0)).otherwise(F.col("p_partkey") + 1).cast("string")).alias("nonce"), F.lit("s").alias("signature"), F.lit("c").alias("commit"), F.when(k == 5, "d").otherwise("c").alias("expected_commit"))
    return store.verify(e, spark.createDataFrame([("n0",)], "nonce string"), F.to_timestamp(F.lit("2025-01-01"))).select("p_partkey", "failure")


@query("""
SELECT p_partkey, '2.0' AS version, CASE p_partkey % 5 WHEN 0 THEN p_type || '!' WHEN 1 THEN p_type || '!' ELSE p_type END AS kind, CASE WHEN p_partkey % 5 = 0 THEN p_brand || '?' ELSE p_brand END AS brand FROM part WHERE p_partkey % 5 < 3
""")
def upcast_bundles(spark, d):
    """Older bundles brought to the newest version step by step; newer ones are refused."""
    versions = F.array(*[F.lit(v) for v in ("0.9", "1.4", "2.0", "2.1", "3.0")])
    x = table(spark, d, "part").select("p_partkey", F.get(versions, (F.col("p_partkey") % 5).cast("int")).alias("version"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))
    return store.upcast(x, {0: {"brand": F.concat("brand", F.lit("?"))}, 1: {"kind": F.concat("kind", F.lit("!"))}})


@query("SELECT p_partkey, '---' || chr(10) || 'title: \"' || p_name || '\"' || chr(10) || 'type: \"memo\"' || chr(10) || '---' || chr(10) || chr(10) || p_brand AS text FROM part")
def front_matter_pages(spark, d):
    """Documents with their fields in front."""
    return table(spark, d, "part").select("p_partkey", store.front_matter_text({"title": F.col("p_name"), "type": F.lit("memo")}, F.col("p_brand")).alias("text"))


@query("""
WITH r AS (SELECT p_partkey, p_name, p_brand, p_partkey % 3 AS k, '<!-- region:a hash:' || substr(sha256(p_name), 1, 12) || ' -->' || chr(10) AS head, chr(10) || '<!-- /region:a -->' AS foot FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'top' || chr(10) || '<!-- region:a hash:' || substr(sha256(p_brand), 1, 12) || ' -->' || chr(10) || p_brand || foot
 WHEN 1 THEN 'top' || chr(10) || head || 'by hand' || foot ELSE 'plain' || chr(10) || chr(10) || '<!-- region:a hash:' || substr(sha256(p_brand), 1, 12) || ' -->' || chr(10) || p_brand || foot || chr(10) END AS text, CASE WHEN k = 1 THEN ['a'] ELSE [] END AS kept FROM r
""")
def merged_regions(spark, d):
    """Generated regions renewed, but for those that were edited by hand."""
    k = F.col("p_partkey") % 3
    old = F.concat(F.lit("top\n<!-- region:a hash:"), F.substring(F.sha2("p_name", 256), 1, 12), F.lit(" -->\n"), F.when(k == 1, "by hand").otherwise(F.col("p_name")), F.lit("\n<!-- /region:a -->"))
    x = table(spark, d, "part").select("p_partkey", F.when(k == 2, "plain").otherwise(old).alias("text"), F.create_map(F.lit("a"), F.col("p_brand")).alias("made"))
    return store.merged_documents(x).select("p_partkey", "merged.text", "merged.kept")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'route-changed' WHEN p_partkey % 4 = 1 THEN 'response-removed' WHEN p_partkey % 4 = 2 THEN 'request-field-required-added' ELSE 'endpoint-removed' END AS kind FROM part")
def breaking_http(spark, d):
    """Breaking changes of HTTP bindings."""
    k = F.col("p_partkey")
    row = lambda route, statuses, required: [k.alias("symbol_id"), F.lit("GET").alias("method"), route.alias("route"), statuses.alias("statuses"), F.array(F.struct(F.lit("query:q").alias("key"), required.alias("required"))).alias("params"), F.array(F.lit("key")).alias("schemes")]
    both = F.array(F.lit("200"), F.lit("404"))
    p = table(spark, d, "part")
    old = p.select(*row(F.lit("/a"), both, F.lit(False)))
    new = p.where(k % 4 != 3).select(*row(F.when(k % 4 == 0, "/b").otherwise("/a"), F.when(k % 4 == 1, F.array(F.lit("200"))).otherwise(both), k % 4 == 2))
    return diff.http_changes(old, new).select(F.col("symbol_id").alias("p_partkey"), "kind")


@query("""
SELECT count(*) AS n FROM part WHERE p_size % 4 <> 3 AND p_partkey % 5 <> 0 AND NOT (p_partkey % 5 IN (1, 2) AND p_size % 3 <> 0)
""")
def eligible_symbols(spark, d):
    """Symbols worth a chunk."""
    kinds, tiers = F.array(*[F.lit(x) for x in ("enum-member", "field", "property", "function", "class")]), F.array(*[F.lit(x) for x in ("public", "internal", "confidential", "restricted")])
    x = table(spark, d, "part").select(F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("kind"), F.get(tiers, F.col("p_size").cast("int") % 4).alias("sensitivity"), F.when(F.col("p_size") % 3 == 0, "says").otherwise(" ").alias("doc"))
    return chunking.eligible(x).agg(F.count("*").alias("n"))


@query()
def session_ends(spark, d):
    """Sessions of users that end by idle time, lifetime or for a sixth one (ST6); SQL has no such fold, a plain loop checks it."""
    e = table(spark, d, "events").select(F.col("user_id").alias("principal"), (F.col("event_id") % 9).alias("session_id"), "ts")
    return sessions.session_ends(e, 24 * 3_600_000, 5 * 24 * 3_600_000)


@query("""
WITH RECURSIVE x AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
f AS (SELECT user_id, ts, n, ts AS start FROM x WHERE n = 1 UNION ALL SELECT x.user_id, x.ts, x.n, CASE WHEN x.fresh = 1 OR x.ts - f.start >= INTERVAL 8 HOUR THEN x.ts ELSE f.start END FROM f JOIN x ON x.user_id = f.user_id AND x.n = f.n + 1)
SELECT user_id AS principal, start, count(*) AS events FROM f GROUP BY ALL
""")
def bounded_sessions(spark, d):
    """Sessions by idle time that also end eight hours after they began (ST6)."""
    return access.bounded_sessions(table(spark, d, "events").select(F.col("user_id").alias("principal"), "ts"), "6 hours")


@query("""
WITH s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), r AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'view'),
j AS (SELECT r.event_id, r.user_id, r.ts, s.ts AS at0, s.event_id AS perms FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.ts >= s.ts)
SELECT event_id AS request_id, user_id AS principal, CASE WHEN at0 IS NULL OR ts - at0 > INTERVAL 24 HOUR THEN 'expired' WHEN ts - at0 > INTERVAL 1 HOUR THEN 'stale' ELSE 'fresh' END AS state, CASE WHEN at0 IS NOT NULL AND ts - at0 <= INTERVAL 24 HOUR THEN perms END AS permissions FROM j
""")
def cached_permissions(spark, d):
    """Permissions of the last snapshot before a request, by its age (ST5)."""
    e = table(spark, d, "events").select(F.col("user_id").alias("principal"), "ts", "event_id", "event_type")
    return access.cached_permissions(e.where("event_type <> 'view'").withColumnRenamed("event_id", "request_id"), e.where("event_type = 'view'").withColumnRenamed("event_id", "permissions"), 3600, 86400)


def _part_specs(spark, d):
    """A specification for each five parts: an operation and a component a part, components that refer to the next or an earlier one, some to nothing."""
    k, z = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    ref = lambda c: F.struct(F.concat(F.lit("#/components/schemas/C"), text(c)).alias("$ref"))
    said = lambda c: F.struct(c.alias("description"))
    answers = F.map_concat(F.create_map(F.lit("404"), said(F.concat(F.lit("no "), "p_brand")), F.lit("200"), said(F.lit("fine"))), F.when(z % 2 == 0, F.create_map(F.lit("409"), said(F.lit("")))).otherwise(F.create_map().cast("map<string,struct<description:string>>")))
    asked = F.when(z % 4 > 0, F.create_map(F.lit("application/json"), F.struct(ref(k).alias("schema"))))
    op = F.struct(F.when(z % 3 == 0, F.concat(F.lit("op"), text(k))).alias("operationId"), F.col("p_name").alias("summary"), F.array("p_type").alias("tags"), F.struct(asked.alias("content")).alias("requestBody"), answers.alias("responses"))
    item = F.when(z % 4 > 0, F.create_map(F.lit("post"), op)).otherwise(F.create_map(F.lit("get"), op))
    props = F.struct(F.when(z % 3 != 0, ref(k + 1)).alias("next"), ref(k - z % 4).alias("back"), F.struct(F.lit("string").alias("type")).alias("name"))
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.floor(k / 5).alias("g"))
    per = rows.repartition("g").groupBy("g").agg(  # rows move before texts are made of them: a file of few row groups is few tasks
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("/x"), text(k)), item))).alias("paths"),
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("C"), text(k)), F.struct(props.alias("properties"))))).alias("schemas"),
    )
    name = F.concat(F.lit("s"), text(F.col("g")))
    schemes = F.create_map(F.lit("key"), F.struct(F.lit("apiKey").alias("type"), F.lit("header").alias("in"), F.lit("X-Key").alias("name")))
    doc = F.struct(F.lit("3.0.1").alias("openapi"), F.struct(name.alias("title"), F.lit("1").alias("version")).alias("info"), "paths", F.struct("schemas", F.when(F.col("g") % 2 == 0, schemes).alias("securitySchemes")).alias("components"))
    return per.select(name.alias("path"), F.when(F.col("g") % 7 == 0, "{").otherwise(F.to_json(doc)).alias("text"))


@query("""
WITH RECURSIVE p AS (SELECT 's' || p_partkey // 5 AS spec, p_partkey AS k, p_size AS z FROM part WHERE p_partkey // 5 % 7 <> 0),
e AS (SELECT a.spec, a.k, b.k AS t FROM p a JOIN p b ON a.spec = b.spec AND ((a.z % 3 <> 0 AND b.k = a.k + 1) OR b.k = a.k - a.z % 4)),
c AS (SELECT spec, k AS root, k AS n FROM p UNION SELECT c.spec, c.root, e.t FROM c JOIN e ON c.spec = e.spec AND c.n = e.k)
SELECT spec, 'C' || root AS root, 'C' || n AS name FROM c
""")
def spec_closures(spark, d):
    """What each component of a specification reaches by references (F-A5, X13)."""
    return api_guide.component_closure(api_guide.components(api_guide.read_specs(_part_specs(spark, d)))).select("spec", "root", "name")


@query("""
WITH o AS (SELECT 's' || p_partkey // 5 AS spec, '/x' || p_partkey AS route, CASE WHEN p_size % 3 = 0 THEN 'op' || p_partkey ELSE CASE WHEN p_size % 4 > 0 THEN 'POST' ELSE 'GET' END || ' /x' || p_partkey END AS label, 'no ' || p_brand AS said, p_size FROM part WHERE p_partkey // 5 % 7 <> 0),
m AS (SELECT spec, string_agg(said, ' / ' ORDER BY route) AS meaning FROM (SELECT spec, said, min(route) AS route FROM o GROUP BY ALL) GROUP BY spec)
SELECT spec, '404' AS status, meaning, count(*) AS n, list(label ORDER BY route)[1:4] AS operations FROM o JOIN m USING (spec) GROUP BY spec, meaning
UNION ALL SELECT spec, '409', '', count(*), list(label ORDER BY route)[1:4] FROM o WHERE p_size % 2 = 0 GROUP BY spec
""")
def guide_error_rows(spark, d):
    """The error catalogue of each specification: a status once, what it means and who returns it."""
    return api_guide.error_catalogue_rows(api_guide.operations(api_guide.read_specs(_part_specs(spark, d))))


@query("""
WITH p AS (SELECT 's' || p_partkey // 5 AS spec, p_partkey // 5 AS g, p_type AS tag FROM part WHERE p_partkey // 5 % 7 <> 0),
t AS (SELECT spec, tag, 2 + row_number() OVER (PARTITION BY spec ORDER BY tag) AS place FROM (SELECT DISTINCT spec, tag FROM p)),
s AS (SELECT spec, g, count(DISTINCT tag) AS n_tags, count(*) AS n FROM p GROUP BY ALL)
SELECT spec, 0 AS place, 'guide.overview' AS section, 0 AS n_calls FROM s UNION ALL SELECT spec, 1, 'guide.authentication', 0 FROM s UNION ALL SELECT spec, 2, 'guide.quickstart', 1 FROM s
UNION ALL SELECT spec, t.place, 'guide.endpoints.' || regexp_replace(lower(tag), '[^a-z0-9]+', '-', 'g'), count(*) FROM t JOIN p USING (spec, tag) GROUP BY ALL
UNION ALL SELECT spec, 3 + n_tags, 'guide.errors', 0 FROM s
""")
def integration_guides(spark, d):
    """Guides of specifications as sections in their order, with the calls that each shows; their texts are held in test_api_guide.py."""
    out = api_guide.guide_sections(_part_specs(spark, d))
    return out.select("spec", "place", "section", (F.size(F.split("body", "```bash\n")) - 1).alias("n_calls"))


@query("""
WITH f AS (SELECT 'c' || p_partkey % 50 AS name, p_partkey AS k, p_size AS z, p_brand, p_type, CASE p_partkey % 4 WHEN 0 THEN 'docker-compose.yml' WHEN 1 THEN 'Chart.yaml' WHEN 2 THEN 'main.tf' ELSE 'main.bicep' END AS base FROM part),
r AS (SELECT name, 'service' AS kind, k, lower(p_type) AS dep, '80' AS port, 'own/' || z % 3 AS image, 'd' || k || '/' || base AS path FROM f WHERE k % 4 = 0
UNION ALL SELECT name, 'service', k, lower(p_type), NULL, NULL, 'd' || k || '/' || base FROM f WHERE k % 4 = 1
UNION ALL SELECT name, 'service', k, 'base', NULL, NULL, 'd' || k || '/' || base FROM f WHERE k % 4 = 1
UNION ALL SELECT name, 'queue', k, 't' || z, NULL, NULL, 'd' || k || '/' || base FROM f WHERE k % 4 = 2 AND z % 3 <> 0
UNION ALL SELECT name, 'cache', k, NULL, NULL, NULL, 'd' || k || '/' || base FROM f WHERE k % 4 = 3)
SELECT name, arg_min(kind, path) AS kind, arg_min(image, path) FILTER (WHERE image IS NOT NULL) AS image, coalesce(list_sort(list(DISTINCT dep) FILTER (WHERE dep IS NOT NULL)), []) AS depends_on, coalesce(list_sort(list(DISTINCT port) FILTER (WHERE port IS NOT NULL)), []) AS ports FROM r GROUP BY name
""")
def service_maps(spark, d):
    """Services of compose files, charts, Terraform and Bicep, one row a name (S9, S10, F-S21)."""
    k, z = F.col("p_partkey"), F.col("p_size")
    n, dep = F.concat(F.lit("c"), (k % 50).cast("string")), F.lower("p_type")
    compose = _fill("services:\n  {n}:\n    image: own/{z}\n    depends_on: [{d}]\n    ports: ['8080:80']\n", n=n, z=z % 3, d=dep)
    chart = _fill("# chart\napiVersion: v2\nname: \"{n}\"\ndependencies:\n  - version: 1\n    name: {d} # own\n    import-values:\n      - name: deeper\n\n  - name: 'base'\nmaintainers:\n  - name: nobody\n", n=n, d=dep)
    tf = _fill('resource "{t}" "{n}" {\n  q = aws_sns.t{z}.arn\n  self = aws_x.{n}.id\n}\n', t=F.when(z % 3 == 0, "aws_iam_role").otherwise("aws_sqs_queue"), n=n, z=z)
    bicep = _fill("resource {n} 'Microsoft.Cache/Redis@2023-04-01' = {\n}\n", n=n)
    kind = (k % 4).cast("int")
    base = F.get(F.array(*[F.lit(x) for x in ("docker-compose.yml", "Chart.yaml", "main.tf", "main.bicep")]), kind)
    files = table(spark, d, "part").select(F.concat(F.lit("d"), k.cast("string"), F.lit("/"), base).alias("path"), F.get(F.array(compose, chart, tf, bicep), kind).alias("text"))
    return services.service_map(services.infra_services(files))
