"""Integration guides: closures beside plain searches, sections of a made specification, odd texts."""

import ast
import json
import random
import re

import pytest

from corpusloom.operators import api_guide

BILLING = {
    "openapi": "3.0.3",
    "info": {"title": "Billing", "version": "2.1.0", "description": "Bills | sends"},
    "servers": [{"url": "https://api.acme.test", "description": "live"}],
    "security": [{"token": []}],
    "paths": {
        "/invoices/{invoiceId}": {"parameters": [{"name": "invoiceId", "in": "path", "schema": {"type": "string"}}], "get": {"operationId": "getInvoice", "tags": ["Invoices"], "responses": {"200": {"description": "ok"}, "404": {"description": "no such"}, "429": {}}}},
        "/invoices": {
            "post": {
                "operationId": "createInvoice", "tags": ["Invoices", "Other"], "deprecated": True,
                "parameters": [{"name": "Idempotency-Key", "in": "header", "required": True, "description": "a | b\n c"}, {"name": "dry", "in": "query", "required": True, "schema": {"type": "boolean"}}, {"$ref": "#/components/parameters/X"}],
                "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Create"}}}},
                "responses": {"201": {"description": "made"}, "401": {"description": "who?"}, "404": {"description": "none"}},
            },
        },
        "/health": {"get": {"operationId": "health", "security": [], "tags": ["Ops & more"], "responses": {"200": {}}}},
    },
    "components": {
        "securitySchemes": {"token": {"type": "http", "scheme": "bearer"}, "sig": {"type": "apiKey", "in": "header", "name": "X-Acme-Signature"}},
        "schemas": {
            "Create": {"required": ["customerId"], "properties": {"customerId": {"type": "string"}, "note": {"type": "string", "default": "it's"}, "lines": {"type": "array", "items": {"$ref": "#/components/schemas/Line"}}, "unit": {"$ref": "#/components/schemas/Money"}, "mode": {"enum": ["a", "b"]}, "grid": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}}},
            "Line": {"properties": {"price": {"$ref": "#/components/schemas/Money"}, "parent": {"$ref": "#/components/schemas/Create"}}},
            "Money": {"description": "an amount", "properties": {"amountMinor": {"type": "integer"}, "currency": {"type": "string"}}},
            "Alone": {"type": "string"},
        },
    },
}
BARE = {"swagger": "2.0", "info": {"title": "Bare", "version": "1"}, "paths": {}}


@pytest.fixture(scope="module")
def guide(spark):
    specs = spark.createDataFrame([("api/billing.json", json.dumps(BILLING)), ("bare.json", json.dumps(BARE)), ("broken", "{"), ("none", None), ("other", '{"paths": {"/x": {"get": {}}}}'), (None, json.dumps(BARE)), ("bare.json", json.dumps(BARE))], "path string, text string")
    handlers = spark.createDataFrame([("createInvoice", "Invoices.create", "src/a.ts", 7), ("createInvoice", "Z.create", "src/z.ts", 1), (None, "N", "n", 0)], "operation_id string, qualified_name string, file string, line int")
    rows = api_guide.guide_sections(specs, handlers).collect()
    plain = {(r.spec, r.section): r.body for r in api_guide.guide_sections(specs).collect()}
    return rows, {(r.spec, r.section): r.body for r in rows}, plain, {r.spec: r for r in api_guide.guide_pages(specs).collect()}


def test_sections_stand_in_order(guide):
    rows = guide[0]
    assert [r.section for r in sorted(rows, key=lambda r: r.place) if r.spec == "api/billing.json"] == ["guide.overview", "guide.authentication", "guide.quickstart", "guide.endpoints.invoices", "guide.endpoints.ops-more", "guide.errors"]
    assert sorted({r.spec for r in rows}) == ["api/billing.json", "bare.json"]
    assert len(rows) == 10


def test_authentication(guide):
    body = guide[1]["api/billing.json", "guide.authentication"]
    assert "Authorization: Bearer $ACCESS_TOKEN" in body and "X-Acme-Signature: $X_ACME_SIGNATURE" in body
    assert "1 operation(s)" in body and "`health`" in body
    assert body.count("Holds for every operation") == 1
    assert "do not take the API to be open" in guide[1]["bare.json", "guide.authentication"]


def test_endpoints(guide):
    body = guide[1]["api/billing.json", "guide.endpoints.invoices"]
    assert body.index("POST /invoices`") < body.index("GET /invoices/{invoiceId}`")
    assert "| `Idempotency-Key` | header | **yes** | — | a \\| b c |" in body
    assert "| `dry` | query | **yes** | `boolean` |  |" in body
    assert "| `lines` | `Line[]` | no |  |" in body and "| `grid` | `integer[][]` | no |  |" in body
    assert "| `unit` | `Money` | no | an amount |" in body and "| `mode` | `a` \\| `b` | no |  |" in body
    assert "| `customerId` | `string` | **yes** |  |" in body
    assert "https://api.acme.test/invoices/<invoiceId>" in body and "/invoices?dry=true" in body
    assert "Implemented by `Invoices.create` in `src/a.ts:7`" in body
    assert "Implemented by" not in guide[2]["api/billing.json", "guide.endpoints.invoices"]
    assert "**Deprecated**" in body and "_No authentication._" in guide[1]["api/billing.json", "guide.endpoints.ops-more"]
    assert "-H" not in guide[1]["api/billing.json", "guide.endpoints.ops-more"]


def test_code(guide):
    text = "\n".join(guide[1].values())
    [sent] = set(re.findall(r"-d '(\{.*\})'\n", text))
    made = json.loads(sent.replace("'\\''", "'"))
    assert made["note"] == "it's" and made["lines"][0]["price"] == {"amountMinor": 0, "currency": "<currency>"}
    code = re.findall(r"```python\n(.*?)```", text, re.S)
    assert len(code) == 4
    for c in code:
        loads = [n for n in ast.walk(ast.parse(c)) if isinstance(n, ast.Call) and getattr(n.func, "attr", "") == "loads"]
        assert all(json.loads(n.args[0].value) == made for n in loads)
    for block in re.findall(r"```(?:typescript|python|csharp|json)\n(.*?)```", text, re.S):
        assert all(block.count(a) == block.count(b) for a, b in ("{}", "[]", "()"))


def test_quickstart_and_errors(guide):
    assert "`POST /invoices`" in guide[1]["api/billing.json", "guide.quickstart"]
    assert "no operations" in guide[1]["bare.json", "guide.quickstart"]
    errors = guide[1]["api/billing.json", "guide.errors"]
    assert "| `401` | who? | `createInvoice` |\n| `404` | none / no such | `createInvoice`, `getInvoice` |\n| `429` |" in errors and "Retry-After" in errors
    assert "incomplete" in guide[1]["bare.json", "guide.errors"]


def test_pages(guide):
    page = guide[3]["api/billing.json"]
    assert page.slug == "integration/api-billing-json" and page.title == "Billing integration guide"
    assert page.operation_ids == ["createInvoice", "getInvoice", "health"]
    assert page.page.index("| Version | `2.1.0` |") < page.page.index("## Invoices") < page.page.index("| `401`")


def test_closure_is_a_search(spark):
    rng = random.Random(5)
    graph = {(s, f"C{i}"): [f"C{rng.randrange(14)}" for _ in range(rng.choice([0, 0, 1, 1, 2]))] for s in ("a", "b", "c") for i in range(12)}
    rows = [(s, n, json.dumps({"properties": {f"p{k}": {"$ref": f"#/components/schemas/{t}"} for k, t in enumerate(ts)}, "description": '"$ref":"C1"'})) for (s, n), ts in graph.items()]
    want = set()
    for s, root in graph:
        todo, seen = [root], set()
        while todo:
            n = todo.pop()
            if n not in seen and (s, n) in graph:
                seen.add(n)
                todo += graph[s, n]
        want |= {(s, root, n) for n in seen}
    got = [tuple(r) for r in api_guide.component_closure(spark.createDataFrame(rows, "spec string, name string, schema string")).select("spec", "root", "name").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nothing_in(spark):
    empty = spark.createDataFrame([], "path string, text string")
    assert api_guide.guide_sections(empty).count() == 0 and api_guide.guide_pages(empty).count() == 0


def test_operations_are_read_once_and_rounds_carry_numbers(spark, monkeypatch):
    made = []
    write = api_guide.written
    monkeypatch.setattr(api_guide, "written", lambda df, name, *by: made.append((name, [t for _, t in df.dtypes])) or write(df, name, *by))
    out = api_guide.guide_sections(spark.createDataFrame([("billing.json", json.dumps(BILLING))], "path string, text string"))
    assert [n for n, _ in made].count("guide-operations") == 1
    rounds = [types for n, types in made if n in ("guide-edges", "guide-pairs")]
    assert len(rounds) > 3 and all(types == ["bigint", "bigint"] for types in rounds)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The joins: an operation's components, then what a specification's operations say and its errors.
    assert len(re.findall(r"\bJoin ", plan)) <= 4 and "document.paths" not in plan


def test_names_that_json_escapes_are_found(spark):
    names = ["a\\b", 'say "x"', "plain"]
    schemas = {n: {"description": f"about {i}", "properties": {"next": {"$ref": f"#/components/schemas/{names[(i + 1) % 3]}"}}} for i, n in enumerate(names)}
    rows = [("s", n, json.dumps(s)) for n, s in schemas.items()]
    got = api_guide.component_closure(spark.createDataFrame(rows, "spec string, name string, schema string")).collect()
    assert {tuple(r) for r in got} == {("s", a, b) for a in names for b in names}
    asked = {"post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/a\\b"}}}}, "responses": {}}}
    spec = {"openapi": "3.0.0", "info": {"title": "T", "version": "1"}, "paths": {"/x": asked}, "components": {"schemas": schemas}}
    bodies = [r.body for r in api_guide.guide_sections(spark.createDataFrame([("s", json.dumps(spec))], "path string, text string")).collect() if r.section == "guide.endpoints.endpoints"]
    assert len(bodies) == 1 and '| `next` | `say "x"` | no | about 1 |' in bodies[0]
    assert '{"next":{"next":{"next":{"next":{"next":null}}}}}' in bodies[0]


def test_texts_cut_short_have_no_guide(spark):
    whole = json.dumps({"openapi": "3.0.0", "info": {}, "paths": {}, "security": [{"a": []}]})
    rows = [("whole", whole), ("cut", whole[: whole.index("[{") + 4])]
    assert {r.spec for r in api_guide.guide_sections(spark.createDataFrame(rows, "path string, text string")).collect()} == {"whole"}
