"""Integration guides of API specifications: operations, component closures, sections and pages.

A specification is read once into tables of operations and components; sections are grouped
from these by specification and tag, so a group is never larger than one file says. Order is
by code points throughout, and nothing hangs on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.indexing import FORMATS, with_examples
from corpusloom.operators.tables import written

# Methods of operations, and what stands where a specification says nothing.
METHODS = ("get", "put", "post", "patch", "delete", "head", "options")
NO_TAG, NO_SERVER = "Endpoints", "https://api.example.com"
#: Operations that a row of the error catalogue names.
NAMED = 4

_SPEC = "openapi string, swagger string, info struct<title:string,version:string,description:string>, servers array<struct<url:string,description:string>>, security array<map<string,string>>, paths map<string,map<string,string>>, components struct<schemas:map<string,string>,securitySchemes:map<string,struct<type:string,scheme:string,`in`:string,name:string,description:string>>>"
_PARAMETERS = "array<struct<name:string,`in`:string,required:boolean,schema:string,description:string>>"
_OPERATION = f"operationId string, summary string, description string, tags array<string>, deprecated boolean, parameters {_PARAMETERS}, requestBody struct<content:map<string,struct<schema:string>>>, responses map<string,struct<description:string>>, security string"
_SCHEMA = "`$ref` string, type string, format string, `enum` array<string>, example string, items string, description string, required array<string>, properties map<string,string>"
_NONE = "array<string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _tick(c: Column) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _cell(c: Column) -> Column:
    """Text for a cell of a table: one line, bars escaped; null is empty."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " "))


def _literal(c: Column) -> Column:
    """c as a literal in double quotes, as JSON, Python, TypeScript and C# read it."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))  # quotes stand at both ends


def _lines(*parts: Column | str) -> Column:
    """The parts that are not null, one below the other."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _table(head: str, rows: Column) -> Column:
    """Rows below a head of columns; null where there are none."""
    rule = "|" + "---|" * head.count(" | ") + "---|"
    return _let(rows, lambda r: F.when(F.size(r) > 0, F.concat(F.lit(f"| {head} |\n{rule}\n"), F.array_join(r, "\n"), F.lit("\n"))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def _last(ref: Column) -> Column:
    return F.element_at(F.split(ref, "/"), -1)


def _typed(schema: Column, p: Column, levels: int = 4) -> Column:
    """type_of a schema whose JSON has been read as p."""

    def named(p: Column, left: int) -> Column:
        inner = F.when(p["items"].isNotNull(), _let(F.from_json(p["items"], _SCHEMA), lambda q: named(q, left - 1))) if left else F.lit("array")
        listed = F.concat(F.coalesce(inner, F.lit("object")), F.lit("[]"))
        return F.when(p["$ref"].isNotNull(), _last(p["$ref"])).when(F.size(p["enum"]) > 0, F.array_join(p["enum"], " \\| ")).when(p["type"] == "array", listed).otherwise(F.coalesce(p["type"], F.lit("object")))

    choices = F.when(p["$ref"].isNull() & (F.size(p["enum"]) > 0), F.array_join(F.transform(p["enum"], _tick), " \\| "))
    return F.when(schema.isNotNull(), F.coalesce(choices, _tick(named(p, levels)))).otherwise("—")


def type_of(schema: Column, levels: int = 4) -> Column:
    """What a table shows as the type of a schema's JSON: a component, the choices, or the type; arrays within arrays to a depth of ``levels``."""
    return _let(F.from_json(schema, _SCHEMA), lambda p: _typed(schema, p, levels))


def scalar_example(schema: Column, name: Column) -> Column:
    """A value to stand for a parameter: its example, first choice, format's or type's value, else its name in angle brackets."""

    def said(p: Column) -> Column:
        formats = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
        typed = F.when(p["type"].isin("integer", "number"), "0").when(p["type"] == "boolean", "true")
        return F.coalesce(p["example"], F.get(p["enum"], 0), F.try_element_at(formats, p["format"]), typed)

    return F.coalesce(F.when(schema.isNotNull(), _let(F.from_json(schema, _SCHEMA), said)), F.concat(F.lit("<"), name, F.lit(">")))


def read_specs(specs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """spec and document (a struct) of the JSON texts that are OpenAPI 3 or Swagger 2; null and other texts have no row.

    Of equal paths the least text counts.
    """
    one = specs.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("spec")).agg(F.min(text).alias("text"))
    # Both versions are read at once; a text that is cut short has none, though a part of it could be read.
    known = F.exists(F.array(F.from_json("text", "openapi string, swagger string")), lambda d: d["openapi"].like("3.%") | (d["swagger"] == "2.0"))
    return one.where(known).select("spec", F.sha2("text", 256).alias("document_hash"), F.from_json("text", _SPEC).alias("document"))


def operations(read: DataFrame, *more: str) -> DataFrame:
    """A row for each operation: spec, route, method, operation_id, label, summary, description, tag, deprecated, open, parameters, request, responses, and more columns of its specification.

    label is the id, else method and route; open says that the operation asks for no
    authentication; request is the JSON of the first content type's schema. Parameters of a
    path come before the operation's own; those without a name are references and left out.
    """
    items = read.select("spec", *more, F.explode("document.paths").alias("route", "item")).select("spec", *more, "route", F.from_json(F.try_element_at("item", F.lit("parameters")), _PARAMETERS).alias("shared"), F.explode("item").alias("key", "raw"))
    ops = items.where(F.col("key").isin(*METHODS)).withColumn("op", F.from_json("raw", _OPERATION)).where("raw like '{%'")
    none = F.array().cast(_PARAMETERS)
    given = F.filter(F.concat(F.coalesce("shared", none), F.coalesce("op.parameters", none)), lambda p: p["name"].isNotNull())
    # An example for every parameter is made here, once.
    params = F.transform(given, lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["in"], F.lit("query")).alias("place"), F.coalesce(p["required"], F.coalesce(p["in"], F.lit("query")) == "path").alias("required"), type_of(p["schema"]).alias("type"), _cell(p["description"]).alias("description"), scalar_example(p["schema"], p["name"]).alias("example")))
    request = F.get(F.map_values("op.requestBody.content"), 0)["schema"]
    answers = F.array_sort(F.transform(F.map_entries("op.responses"), lambda r: F.struct(r["key"].alias("status"), F.coalesce(r["value"]["description"], F.lit("")).alias("description"))))
    method = F.upper("key")
    return ops.select(
        "spec", "route", method.alias("method"), F.col("op.operationId").alias("operation_id"), F.coalesce("op.operationId", F.concat_ws(" ", method, "route")).alias("label"), "op.summary", "op.description",
        F.coalesce(F.get("op.tags", 0), F.lit(NO_TAG)).alias("tag"), F.coalesce("op.deprecated", F.lit(False)).alias("deprecated"), F.coalesce(F.col("op.security") == "[]", F.lit(False)).alias("open"),
        params.alias("parameters"), request.alias("request"), F.coalesce(answers, F.array().cast("array<struct<status:string,description:string>>")).alias("responses"), *more,
    )


def components(read: DataFrame) -> DataFrame:
    """spec, name and schema (JSON) of every component schema."""
    return read.select("spec", F.explode("document.components.schemas").alias("name", "schema")).where("schema is not null")


def references(schema: Column) -> Column:
    """The names of the components that a schema's JSON refers to, each once."""
    found = F.regexp_extract_all(schema, F.lit(r'"\$ref"\s*:\s*"(?:[^"]*/)?(?!")([^"/\\]*+(?:\\.[^"/\\]*+)*+)"'), F.lit(1))
    told = lambda n: F.when(n.contains("\\"), F.get(F.from_json(F.concat(F.lit('["'), n, F.lit('"]')), _NONE), 0)).otherwise(n)
    return F.array_distinct(F.transform(found, told))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with a number for each row as id: rounds of joins carry two numbers instead of names."""
    return written(df.withColumn("id", F.monotonically_increasing_id()), name)


def _edges(parts: DataFrame) -> DataFrame:
    """(at, to): the ids of components and of those that they refer to. parts: (spec, name, schema, id)."""
    refers = parts.select("spec", F.col("id").alias("at"), F.explode(references(F.col("schema"))).alias("name"))
    return written(refers.join(parts.select("spec", "name", F.col("id").alias("to")), ["spec", "name"]).select("at", "to"), "guide-edges")


def _reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(of, at): the seeds' pairs and every component that theirs reach.

    Each round follows the references of the pairs found last, and ends when none is new, so
    components that hold each other end too. As many rounds as the longest chain of
    references; each round's pairs are written.
    """
    found = new = written(seeds, "guide-pairs")
    while True:
        step = new.join(edges, "at").select("of", F.col("to").alias("at")).distinct()
        new = written(step.join(found, ["of", "at"], "left_anti"), "guide-pairs")
        if new.isEmpty():
            return found
        found = found.unionByName(new)


def component_closure(parts: DataFrame) -> DataFrame:
    """(spec, root, name): every component that a component reaches by references, itself included.

    References to nothing have no row. parts: (spec, name, schema).
    """
    parts = _numbered(parts.select("spec", "name", "schema"), "guide-components")
    pairs = _reached(parts.select(F.col("id").alias("of"), F.col("id").alias("at")), _edges(parts))
    named = pairs.join(parts.select(F.col("id").alias("at"), "name"), "at")
    return named.join(parts.select(F.col("id").alias("of"), "spec", F.col("name").alias("root")), "of").select("spec", "root", "name")


def _with_requests(ops: DataFrame, parts: DataFrame) -> DataFrame:
    """ops with fields (rows of the request's table) and example (JSON); each gets just the components that its request reaches.

    ops and parts have an id.
    """
    direct = ops.where("request is not null").select("spec", F.col("id").alias("of"), F.explode(references(F.col("request"))).alias("name"))
    seeds = direct.join(parts.select("spec", "name", F.col("id").alias("at")), ["spec", "name"]).select("of", "at")
    reached = _reached(seeds, _edges(parts)).join(parts.select(F.col("id").alias("at"), "name", "schema"), "at")
    carried = reached.groupBy(F.col("of").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "schema"))).alias("parts"))
    entry = lambda p: F.concat(_literal(p["name"]), F.lit(":"), p["schema"])
    held = F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform("parts", entry), ","), F.lit("")), F.lit("}"))
    shown = with_examples(ops.join(carried, "id", "left").withColumn("components", held), "request", "components")
    # The request's own fields, through a reference if it is one; then each field's description, through its own.
    target = lambda p: F.get(F.filter("parts", lambda x: x["name"] == _last(p["$ref"])), 0)["schema"]

    def row(e: Column, p: Column, needed: Column) -> Column:
        about = F.coalesce(F.from_json(target(p), "description string"), F.struct(p["description"].alias("description")))["description"]
        return F.concat(F.lit("| "), _tick(e["key"]), F.lit(" | "), _typed(e["value"], p), F.lit(" | "), F.when(F.array_contains(needed, e["key"]), "**yes**").otherwise("no"), F.lit(" | "), _cell(about), F.lit(" |"))

    def rows(s: Column) -> Column:
        needed = F.coalesce(s["required"], F.array().cast(_NONE))
        return F.transform(F.map_entries(s["properties"]), lambda e: _let(F.from_json(e["value"], _SCHEMA), lambda p: row(e, p, needed)))

    own = _let(_let(F.from_json("request", _SCHEMA), lambda p: F.coalesce(F.from_json(target(p), _SCHEMA), p)), rows)
    return shown.withColumn("fields", F.coalesce(own, F.array().cast(_NONE))).drop("components", "parts")


def schemes(read: DataFrame, *more: str) -> DataFrame:
    """spec, more columns and schemes: its security schemes by name, each with the header that carries it and what stands for the credential."""

    def made(e: Column) -> Column:
        s = e["value"]
        keyed = F.coalesce(s["type"] == "apiKey", F.lit(False))
        header = F.when(keyed & (s["in"] == "header"), F.coalesce(s["name"], F.lit("X-API-Key"))).otherwise("Authorization")
        basic = F.coalesce((s["type"] == "http") & (s["scheme"] == "basic"), F.lit(False))
        bearer = F.coalesce((s["type"] == "oauth2") | ((s["type"] == "http") & (s["scheme"] == "bearer")), F.lit(False))
        word = F.when(basic, "BASIC_CREDENTIALS").when(keyed, F.regexp_replace(F.upper(F.coalesce(s["name"], e["key"])), "[^A-Z0-9]+", "_")).otherwise("ACCESS_TOKEN")
        prefix = F.when(basic, "Basic ").when(bearer, "Bearer ").otherwise("")
        return F.struct(e["key"].alias("name"), F.coalesce(s["type"], F.lit("unknown")).alias("type"), s["scheme"].alias("scheme"), s["description"].alias("description"), header.alias("header"), prefix.alias("prefix"), word.alias("word"))

    found = F.transform(F.map_entries("document.components.securitySchemes"), made)
    empty = F.array().cast("array<struct<name:string,type:string,scheme:string,description:string,header:string,prefix:string,word:string>>")
    return read.select("spec", *more, F.coalesce(F.array_sort(found), empty).alias("schemes"))


def _snippets(ops: DataFrame) -> DataFrame:
    """ops with curl and code: the call in the shell and in TypeScript, Python and C#. Needs base, first (scheme) and example."""
    of = lambda place: F.filter("parameters", lambda p: p["place"] == place)
    route = F.aggregate(of("path"), F.col("route"), lambda got, p: F.replace(got, F.concat(F.lit("{"), p["name"], F.lit("}")), p["example"]))
    asked = F.transform(F.filter(of("query"), lambda p: p["required"]), lambda p: F.concat(p["name"], F.lit("="), p["example"]))
    url = F.concat("base", route, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(""))
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    pair = F.when(F.col("first").isNotNull() & ~F.col("open"), F.array(F.struct(F.col("first.header").alias("name"), F.concat("first.prefix", F.lit("$"), "first.word").alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    body = F.col("example").isNotNull()
    typed = F.when(body, F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("application/json").alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    own = F.transform(of("header"), lambda p: F.struct(p["name"].alias("name"), p["example"].alias("value")))
    ops = ops.withColumns({"url": url, "headers": F.concat(pair, own, typed)})
    flags = F.transform("headers", lambda h: F.concat(F.lit("  -H "), F.when(h["value"].contains("$"), F.concat(F.lit('"'), h["name"], F.lit(": "), h["value"], F.lit('"'))).otherwise(quoted(F.concat(h["name"], F.lit(": "), h["value"])))))
    curl = F.array_join(F.concat(F.array(F.concat(F.lit("curl -X "), "method", F.lit(" "), quoted(F.col("url")))), flags, F.when(body, F.array(F.concat(F.lit("  -d "), quoted(F.col("example"))))).otherwise(F.array().cast(_NONE))), " \\\n")
    named = lambda sep: F.array_join(F.transform("headers", lambda h: F.concat(_literal(h["name"]), F.lit(": "), _literal(h["value"]))), sep)
    has = F.size("headers") > 0
    ts = F.concat(F.lit("const answer = await fetch("), _literal(F.col("url")), F.lit(", {\n  method: "), _literal(F.col("method")), F.when(has, F.concat(F.lit(",\n  headers: { "), named(", "), F.lit(" }"))).otherwise(""), F.when(body, F.concat(F.lit(",\n  body: JSON.stringify("), F.col("example"), F.lit(")"))).otherwise(""), F.lit("\n});\nif (!answer.ok) throw new Error(String(answer.status));"))
    py = F.concat(F.when(body, "import json\n\n").otherwise(""), F.lit("import requests\n\nanswer = requests.request(\n    "), _literal(F.col("method")), F.lit(",\n    "), _literal(F.col("url")), F.when(has, F.concat(F.lit(",\n    headers={"), named(", "), F.lit("}"))).otherwise(""), F.when(body, F.concat(F.lit(",\n    json=json.loads("), _literal(F.col("example")), F.lit(")"))).otherwise(""), F.lit(",\n)\nanswer.raise_for_status()"))
    adds = F.array_join(F.transform(F.filter("headers", lambda h: h["name"] != "Content-Type"), lambda h: F.concat(F.lit("call.Headers.TryAddWithoutValidation("), _literal(h["name"]), F.lit(", "), _literal(h["value"]), F.lit(");\n"))), "")
    cs = F.concat(F.lit("using var client = new HttpClient();\nvar call = new HttpRequestMessage(new HttpMethod("), _literal(F.col("method")), F.lit("), "), _literal(F.col("url")), F.lit(");\n"), adds, F.when(body, F.concat(F.lit("call.Content = new StringContent("), _literal(F.col("example")), F.lit(', Encoding.UTF8, "application/json");\n'))).otherwise(""), F.lit("var answer = await client.SendAsync(call);\nanswer.EnsureSuccessStatusCode();"))
    code = F.concat(F.lit("```typescript\n"), ts, F.lit("\n```\n\n```python\n"), py, F.lit("\n```\n\n```csharp\n"), cs, F.lit("\n```\n"))
    return ops.withColumns({"curl": F.concat(F.lit("```bash\n"), curl, F.lit("\n```\n")), "code": code})


def error_catalogue_rows(ops: DataFrame) -> DataFrame:
    """spec, status, meaning, n and operations: each status that is no success once, with the first operations that return it by route and method."""
    told = ops.select("spec", "route", "method", "label", F.explode("responses").alias("r")).where("not startswith(r.status, '2')")
    per = told.groupBy("spec", F.col("r.status").alias("status")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("route", "method", "label", F.col("r.description").alias("said")))).alias("xs"))
    meaning = F.array_join(F.array_distinct(F.filter(F.transform("xs", lambda x: x["said"]), lambda s: s != "")), " / ")
    return per.select("spec", "status", _cell(meaning).alias("meaning"), "n", F.transform(F.slice("xs", 1, NAMED), lambda x: x["label"]).alias("operations"))


def guide_sections(specs: DataFrame, handlers: DataFrame | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """spec, place (from 0), section and body: the sections of each specification's guide.

    overview, authentication and quickstart, then one section a tag (an operation is under
    its first tag), then the errors. handlers: (operation_id, qualified_name, file, line)
    of the code behind operations, of which the least name is linked; leave it out for
    guides that others read. A specification without operations has a guide that says so,
    a text that is no specification has none.
    """
    read = written(read_specs(specs, path, text), "guide-specs")
    parts = _numbered(components(read), "guide-components")
    keys = schemes(read, "document")
    base, first = F.coalesce(F.get("document.servers", 0)["url"], F.lit(NO_SERVER)), F.get("schemes", 0)
    ops = operations(keys.select("spec", "document", base.alias("base"), first.alias("first")), "base", "first")
    if handlers is None:
        ops = ops.withColumn("handler", F.lit(None).cast("string"))
    else:
        linked = handlers.where("operation_id is not null").groupBy("operation_id").agg(F.min(F.struct("qualified_name", "file", "line")).alias("h"))
        ops = ops.join(linked.select("operation_id", F.concat(F.lit("Implemented by "), _tick(F.col("h.qualified_name")), F.lit(" in "), _tick(F.concat_ws(":", "h.file", "h.line")), F.lit(".\n")).alias("handler")), "operation_id", "left")
    ops = _numbered(ops, "guide-operations")
    told = error_catalogue_rows(ops)

    fields = F.coalesce(_table("Field | Type | Required | Description", F.col("fields")), F.concat(F.lit("```json\n"), "example", F.lit("\n```\n")))
    cells = lambda p: F.concat(F.lit("| "), _tick(p["name"]), F.lit(" | "), p["place"], F.lit(" | "), F.when(p["required"], "**yes**").otherwise("no"), F.lit(" | "), p["type"], F.lit(" | "), p["description"], F.lit(" |"))
    answer = lambda r: F.concat(F.lit("| "), _tick(r["status"]), F.lit(" | "), _cell(r["description"]), F.lit(" |"))
    head = _lines(
        F.concat(F.lit("### "), _tick(F.concat_ws(" ", "method", "route")), F.lit("\n")), F.concat(F.lit("**"), "summary", F.lit("**\n")), F.concat("description", F.lit("\n")),
        F.when(F.col("deprecated"), "> **Deprecated**: a later version will not have it.\n"), F.when(F.col("open"), "_No authentication._\n"),
        _table("Parameter | In | Required | Type | Description", F.transform("parameters", cells)), F.when(F.col("request").isNotNull(), F.concat(F.lit("**Request body**\n\n"), fields)),
        _table("Status | Meaning", F.transform("responses", answer)),
    )
    rank = F.when((F.col("method") == "POST") & F.col("request").isNotNull(), 0).when(F.col("method") != "GET", 1).otherwise(2)
    shown = _snippets(_with_requests(ops, parts)).select("spec", "tag", "route", "method", rank.alias("rank"), F.when(F.col("open"), F.col("label")).alias("opened"), head.alias("head"), "curl", "code", "handler")
    # Operations move once, to their specification; the groups by tag and by specification are made there.
    block = F.struct("route", "method", _lines(F.col("head"), F.col("curl"), F.col("code"), F.col("handler")).alias("b"))
    start = F.struct("rank", "route", "method", "curl", "code")
    tagged = shown.repartition("spec").groupBy("spec", "tag").agg(F.count("*").alias("n"), F.collect_list("opened").alias("opened"), F.min(start).alias("q"), F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n---\n\n").alias("b"))
    endpoint = F.struct("tag", F.concat(F.lit("guide.endpoints."), slug(F.col("tag"))).alias("section"), F.concat(F.lit("## "), "tag", F.lit("\n\n"), "b").alias("body"))
    counted = tagged.groupBy("spec").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("opened"))).alias("opened"), F.min("q").alias("q"), F.array_sort(F.collect_list(endpoint)).alias("endpoints"))
    base = keys.select("spec", "schemes", *[F.col(f"document.{x}").alias(x) for x in ("info", "servers", "security")])
    base = base.join(counted, "spec", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hosts = F.array_join(F.transform("servers", lambda s: F.concat(_tick(s["url"]), F.coalesce(F.concat(F.lit(" ("), s["description"], F.lit(")")), F.lit("")))), "<br/>")
    fact = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    overview = _lines(F.concat("info.description", F.lit("\n")), "| | |", "|---|---|", fact("Version", _tick(F.col("info.version"))), fact("Operations", F.col("n").cast("string")), fact("Base URL", F.nullif(hosts, F.lit(""))), fact("Specification", _tick(F.col("spec"))), "\nRoutes, fields and statuses are those of the specification; where other text disagrees, it is the specification that holds.")

    global_ = F.flatten(F.transform("security", F.map_keys))
    scheme = lambda s: F.concat(_lines(F.concat(F.lit("### "), _tick(s["name"]), F.lit("\n")), F.concat(s["description"], F.lit("\n")), F.concat(F.lit("Type: **"), s["type"], F.lit("**"), F.coalesce(F.concat(F.lit(" ("), s["scheme"], F.lit(")")), F.lit(""))), F.when(F.array_contains(global_, s["name"]), "Holds for every operation that does not say otherwise.")), F.lit("\n\n```http\n"), s["header"], F.lit(": "), s["prefix"], F.lit("$"), s["word"], F.lit("\n```\n"))
    opened = F.when(F.size("opened") > 0, F.concat(F.size("opened").cast("string"), F.lit(" operation(s) ask for no authentication: "), F.array_join(F.transform("opened", _tick), ", "), F.lit(".\n")))
    bare = "No security scheme is declared.\n\n> A gateway before the service may ask for one. Confirm it; do not take the API to be open.\n"
    authentication = F.when(F.size("schemes") == 0, F.lit(bare)).otherwise(_lines(F.array_join(F.transform("schemes", scheme), "\n"), opened))

    quick = _lines(F.concat(F.lit("The shortest way to a call that works is "), _tick(F.concat_ws(" ", "q.method", "q.route")), F.lit(".\n")), F.col("q.curl"), F.col("q.code"), "> These calls are built from the specification and were neither compiled nor run.\n")
    quickstart = F.when(F.col("q").isNull(), "_The specification has no operations._\n").otherwise(quick)

    more = F.when(F.col("n") > NAMED, F.concat(F.lit(", +"), (F.col("n") - NAMED).cast("string"), F.lit(" more"))).otherwise("")
    line = F.concat(F.lit("| "), _tick(F.col("status")), F.lit(" | "), F.col("meaning"), F.lit(" | "), F.array_join(F.transform("operations", _tick), ", "), more, F.lit(" |"))
    told = told.groupBy("spec").agg(F.transform(F.array_sort(F.collect_list(F.struct("status", line.alias("l")))), lambda x: x["l"]).alias("errors"), F.max(F.col("status") == "429").alias("limited"))
    base = base.join(told, "spec", "left")
    silent = "The specification declares no error responses.\n\n> Every API has some, so it is incomplete. Expect errors of any kind.\n"
    errors = F.when(F.col("errors").isNull(), silent).otherwise(_lines(_table("Status | Meaning | Returned by", F.col("errors")), F.when(F.col("limited"), "Wait as long as the `Retry-After` of a `429` says before the next call.\n")))

    section = lambda name, body: F.array(F.struct(F.lit(f"guide.{name}").alias("section"), body.alias("body")))
    tags = F.coalesce(F.transform("endpoints", lambda x: F.struct(x["section"].alias("section"), x["body"].alias("body"))), F.array().cast("array<struct<section:string,body:string>>"))
    whole = F.concat(section("overview", overview), section("authentication", authentication), section("quickstart", quickstart), tags, section("errors", errors))
    return base.select("spec", F.posexplode(whole).alias("place", "x")).select("spec", "place", "x.section", "x.body")


def guide_pages(specs: DataFrame, handlers: DataFrame | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """spec, slug, title, document_hash, operation_ids and page: one Markdown page a specification; the hash says which text it was made of."""
    read = read_specs(specs, path, text)
    ids = operations(read).groupBy("spec").agg(F.array_sort(F.collect_list("operation_id")).alias("operation_ids"))
    page = guide_sections(specs, handlers, path, text).groupBy("spec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), "\n").alias("text"))
    title = F.concat(F.coalesce("document.info.title", "spec"), F.lit(" integration guide"))
    out = read.join(ids, "spec", "left").join(page, "spec")
    return out.select("spec", F.concat(F.lit("integration/"), slug(F.col("spec"))).alias("slug"), title.alias("title"), "document_hash", F.coalesce("operation_ids", F.array().cast(_NONE)).alias("operation_ids"), F.concat(F.lit("# "), title, F.lit("\n\n"), "text").alias("page"))
