"""Conformance of raw declarations, work lists, indexing end to end, cross-repository passes, examples of schemas."""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import estimate_tokens
from corpusloom.operators import chunking, dedupe


def conformance(symbols: DataFrame, emission: str = "emission") -> DataFrame:
    """(emission, rule, n): violations of what every analyser must keep to; an emission without rows here passes.

    symbols: (name, qualified_name, start_line, end_line, depth, parameter_types, source_text,
    kind, overload, parent). Each rule is a filter, a count by key or an anti-join.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "empty-name": blank("name") | blank("qualified_name"),
        "name-not-last": ~F.col("qualified_name").endswith(F.col("name")),
        "bad-range": (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")),
        "depth-overclaimed": (F.col("depth") != "shallow") & (F.size("parameter_types") > 0) & F.forall("parameter_types", lambda t: t.isNull()),
        "source-text": F.col("source_text").isNotNull(),
    }
    rows = symbols.select(emission, F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    twice = symbols.groupBy(emission, "qualified_name", "kind", F.coalesce("overload", F.lit("")).alias("o")).agg(F.count("*").alias("k")).where("k > 1").select(emission, F.lit("same-identity").alias("rule"))
    names = symbols.select(F.col(emission), F.col("qualified_name").alias("parent")).distinct()
    orphans = symbols.where("parent is not null").join(names, [emission, "parent"], "left_anti").select(emission, F.lit("missing-parent").alias("rule"))
    return rows.unionByName(twice).unionByName(orphans).groupBy(emission, "rule").agg(F.count("*").alias("n"))


def blurb_worklist(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """One request (ordinal, signature_hash, sensitivity) for each signature that is neither cached nor restricted, the first by ordinal."""
    left = requests.where("sensitivity <> 'restricted'").join(cached.select("signature_hash").distinct(), "signature_hash", "left_anti")
    w = Window.partitionBy("signature_hash").orderBy("ordinal")
    return left.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def index_documents(docs: DataFrame, cache: DataFrame, item: str = "doc_id", title: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunks of documents with content_hash and whether their vector is cached, and the chunks to embed, one a hash."""
    chunks = chunking.chunk_documents(docs, item, title).withColumn("content_hash", F.sha2("content", 256))
    hits, misses = dedupe.cache_split(chunks, cache)
    known = cache.select("content_hash", F.lit(True).alias("cached")).distinct()
    return chunks.join(known, "content_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False))), misses


def index_symbols(symbols: DataFrame, cache: DataFrame, budget: int = chunking.MOST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The same of declarations: those that are worth a chunk are cut, near copies get their cluster's representative.

    A chunk of a cluster that is not its representative is kept but is not embedded.
    """
    chunks = chunking.chunk_symbols(chunking.eligible(symbols), budget).withColumn("content_hash", F.sha2("content", 256))
    chunks = chunks.withColumn("chunk_id", F.concat(F.lit("chk_"), F.substring(F.sha2(F.concat_ws("\n", "symbol_id", F.col("ordinal").cast("string"), "content_hash"), 256), 1, 40)))
    clusters = dedupe.leader_clusters(chunks.select("chunk_id", F.col("content").alias("text"), estimate_tokens(F.col("content")).alias("tokens"), F.lit(False).alias("generated")))
    out = chunks.join(clusters.select("chunk_id", F.col("leader").alias("cluster"), "representative"), "chunk_id", "left")
    out = out.withColumn("is_representative", F.col("representative").isNull() | (F.col("representative") == F.col("chunk_id")))
    return out, dedupe.cache_split(out.where("is_representative"), cache)[1]


def neighbour_edges(symbols: DataFrame, cross: DataFrame) -> DataFrame:
    """(seed_id, symbol_id, relation): what a symbol calls, its types, what calls it, and its edges to other repositories.

    symbols: (symbol_id, calls, references, users); cross: (src, dst).
    """
    of = lambda column, relation: symbols.select(F.col("symbol_id").alias("seed_id"), F.explode(column).alias("symbol_id"), F.lit(relation).alias("relation"))
    return of("calls", "callee").unionByName(of("references", "type")).unionByName(of("users", "caller")).unionByName(cross.select(F.col("src").alias("seed_id"), F.col("dst").alias("symbol_id"), F.lit("callee").alias("relation"))).distinct()


def reconcile(memberships: DataFrame, wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """Memberships (module, project) after a run: those of the run's modules are just the wanted ones, others stay."""
    return memberships.join(modules.select("module"), "module", "left_anti").unionByName(wanted.join(modules.select("module"), "module", "left_semi")).distinct()


def redirects(stored: DataFrame, renames: DataFrame) -> DataFrame:
    """Aliases (org, previous_id, symbol_id): new ones over stored ones of the same previous id, the last by ordinal."""
    last = renames.groupBy("org", "previous_id").agg(F.max_by("symbol_id", "ordinal").alias("symbol_id"))
    return last.unionByName(stored.join(last.select("org", "previous_id"), ["org", "previous_id"], "left_anti"))


# Examples by type and by format.
PLAIN = {"integer": 0, "number": 0, "boolean": True}
FORMATS = {"date-time": "2026-08-20T09:00:00Z", "uuid": "00000000-0000-0000-0000-000000000000"}
#: Levels of a schema that an example shows.
LEVELS = 5


def schema_rows(schema: dict, components: dict) -> list[tuple[tuple, object]]:
    """A schema as rows (path, value), parents first: containers are empty, leaves have their example.

    A node says its value itself, by an example, its first choice or its default; else the
    value follows from its type. References are looked up by their last part. What lies
    deeper than LEVELS is null, so a schema that holds itself ends.
    """
    rows, waiting = [], deque([((), "value", schema)])
    while waiting:
        path, name, node = waiting.popleft()
        if not node or len(path) >= LEVELS:
            rows.append((path, None))
            continue
        ref = node.get("$ref")
        if ref:
            node = components.get(ref.rsplit("/", 1)[-1], node)
        kind = node.get("type", "object")
        if "example" in node:
            rows.append((path, node["example"]))
        elif node.get("enum"):
            rows.append((path, node["enum"][0]))
        elif "default" in node:
            rows.append((path, node["default"]))
        elif kind == "object":
            rows.append((path, {}))
            for k, v in (node.get("properties") or {}).items():
                waiting.append(((*path, k), k, v))
        elif kind == "array":
            rows.append((path, []))
            waiting.append(((*path, 0), name, node.get("items")))
        else:
            rows.append((path, PLAIN.get(kind, FORMATS.get(node.get("format"), f"<{name}>"))))
    return rows


def example_of(schema: dict, components: dict):
    """The rows of a schema put together."""
    made: dict[tuple, object] = {}
    for path, value in schema_rows(schema, components):
        made[path] = value
        if path:
            parent = made[path[:-1]]
            if type(parent) is list:
                parent.append(value)
            else:
                parent[path[-1]] = value
    return made[()]


def with_examples(specs: DataFrame, schema: str = "schema", components: str = "components") -> DataFrame:
    """specs with ``example``, the JSON of an example of their schema; null where it cannot be read."""

    def build(schemas: pd.Series, parts: pd.Series) -> pd.Series:
        out, text = [], json.JSONEncoder(separators=(",", ":")).encode
        for s, c in zip(schemas, parts):
            try:
                out.append(text(example_of(json.loads(s), json.loads(c or "{}"))))
            except (TypeError, ValueError, AttributeError, LookupError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return specs.withColumn("example", F.pandas_udf(build, "string")(F.col(schema), F.col(components)))
