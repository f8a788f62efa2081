"""Repository trees: file walk, languages, manifests, modules, owners, documents, specs and services."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.ids import document_id
from corpusloom.functions.text import glob_regex, language_of, normal_path
from corpusloom.operators.scanner import DENIED_PATHS, SKIPPED_PATHS, any_match
from corpusloom.sources.rules import not_ignored, rules_of

# Manifest names and their ecosystems.
MANIFESTS = {"package.json": "npm", "pyproject.toml": "pypi", "setup.py": "pypi"}


def walk(spark: SparkSession, root: str, exclude: list[str] | None = None, ignore: str = "", names: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """path (below root), size and content of the readable files of a tree.

    Spark's binary file reader lists and reads, so any store that Spark reads will do;
    content is read only by plans that ask for it. Ignore files of any folder, called one
    of ``names``, hold for what is below them; ignore is the text of one more at the top.
    Files come in no order and without a limit; sort and cut what is shown.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z0-9]+:/*", "", root).strip("/")
    below = normal_path(F.regexp_replace("path", rf"^[a-z0-9]+:/*{re.escape(base)}/?", ""))
    found = files.select(below.alias("path"), F.col("length").alias("size"), "content")
    out = found.where(~any_match(F.col("path"), DENIED_PATHS) & ~any_match(F.col("path"), SKIPPED_PATHS))
    for glob in exclude or []:
        out = out.where(~F.col("path").rlike(glob_regex(glob)))
    written = found.where(F.element_at(F.split("path", "/"), -1).isin(*names)).select("path", F.decode("content", "UTF-8").alias("text"))
    given = spark.createDataFrame([(".ignore", ignore)], "path string, text string")
    return not_ignored(out.where(~F.element_at(F.split("path", "/"), -1).isin(*names)), rules_of(written.unionByName(given)))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def manifests(files: DataFrame) -> DataFrame:
    """dir, ecosystem, name, version and dependencies of each manifest; name is null where it cannot be read."""
    text = F.decode("content", "UTF-8")
    base = F.element_at(F.split("path", "/"), -1)
    up = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    dir_ = F.when(up == "", ".").otherwise(up)
    kinds = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    project = base.rlike(r"\.(cs|fs)proj$")
    eco = F.when(project, "nuget").otherwise(F.try_element_at(kinds, base))
    rows = files.withColumn("ecosystem", eco).where("ecosystem is not null").withColumn("t", text)
    npm = F.from_json("t", "name string, version string, dependencies map<string,string>, devDependencies map<string,string>")
    toml = lambda key: F.nullif(F.regexp_extract("t", rf"(?m)^\s*{key}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    setup = lambda key: F.nullif(F.regexp_extract("t", rf"\b{key}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    stem = F.regexp_extract(base, r"^(.*)\.(?:cs|fs)proj$", 1)
    name = F.when(F.col("ecosystem") == "npm", npm["name"]).when(F.col("ecosystem") == "nuget", F.coalesce(F.nullif(F.regexp_extract("t", r"<PackageId>([^<]+)</PackageId>", 1), F.lit("")), stem)).when(base == "setup.py", setup("name")).otherwise(toml("name"))
    version = F.when(F.col("ecosystem") == "npm", npm["version"]).when(F.col("ecosystem") == "nuget", F.nullif(F.regexp_extract("t", r"<Version>([^<]+)</Version>", 1), F.lit(""))).when(base == "setup.py", setup("version")).otherwise(toml("version"))
    none = F.array().cast("array<string>")
    deps = F.when(F.col("ecosystem") == "npm", F.coalesce(F.array_sort(F.concat(F.coalesce(F.map_keys(npm["dependencies"]), none), F.coalesce(F.map_keys(npm["devDependencies"]), none))), none)).when(F.col("ecosystem") == "nuget", F.array_sort(F.regexp_extract_all("t", F.lit(r'<PackageReference\s+Include="([^"]+)"'), F.lit(1)))).otherwise(F.array_sort(F.regexp_extract_all(F.regexp_extract("t", r"(?s)(?:dependencies|install_requires)\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([A-Za-z0-9_.-]+)"), F.lit(1))))
    return rows.select(dir_.alias("dir"), "ecosystem", name.alias("name"), version.alias("version"), deps.alias("dependencies"))


def modules(files: DataFrame, found: DataFrame) -> DataFrame:
    """files with the directory of the deepest manifest above them; the rest belong to ``.``."""
    from corpusloom.operators.graph import longest_prefix

    return longest_prefix(files, found, "path", "dir").withColumn("dir", F.coalesce("dir", F.lit(".")))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The ``key: value`` lines between a first line and a later line of three dashes as a map, and the text behind them.

    Line ends are \\n afterwards. Without both lines of dashes the whole text is body. Of a
    key that stands twice the last value counts; quotes around a whole value go.
    """
    lines = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    head = r"(?s)\A---\n(.*?)\n---\n"
    pairs = F.filter(F.split(F.regexp_extract(lines, head, 1), "\n"), lambda l: l.rlike(r"^[A-Za-z][\w-]*:"))
    key = lambda l: F.regexp_extract(l, r"^([A-Za-z][\w-]*)", 1)
    value = lambda l: F.regexp_replace(F.regexp_extract(l, r"^[^:]*:\s*(.*?)\s*$", 1), r"^(?:\"(.*)\"|'(.*)')$", "$1$2")
    made = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, key)), lambda k: F.struct(k, F.element_at(F.transform(F.filter(pairs, lambda l: key(l) == k), value), -1))))
    return made, F.regexp_replace(lines, head, "")


# Kinds of documents by their lower-cased paths, the first that fits, and what
# the fields of a document's head may say.
DOCUMENT_TYPES = {
    "readme": r"(^|/)readme\.mdx?$",
    "adr": r"(^|/)adrs?/",
    "runbook": r"runbook|operations|incident",
    "integration-guide": r"api|integration",
    "user-guide": r"handbook|user-guide|end-user",
}
OTHER_DOCUMENT = "technical-documentation"
FIELDS = {
    "audience": ["developer", "internal-user", "end-user", "mixed"],
    "authority": ["canonical", "supporting", "historical"],
    "sensitivity": ["public", "internal", "confidential", "restricted"],
}


def document_type(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(*[F.when(low.rlike(pattern), F.lit(kind)) for kind, pattern in DOCUMENT_TYPES.items()], F.lit(OTHER_DOCUMENT))


def default_authority(path: Column) -> Column:
    """canonical for a README, supporting for other documents."""
    return F.when(F.lower(path).rlike(DOCUMENT_TYPES["readme"]), "canonical").otherwise("supporting")


def title_of(path: Column) -> Column:
    """A title from a path: the name with a capital at each word; a README is that of its folder."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.mdx?$", "")
    words = F.split(F.regexp_replace(name, "[-_]+", " "), r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    upper = F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))).otherwise(w)), "")
    return F.when(F.lower(name) == "readme", F.concat(F.coalesce(F.concat(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(" ")), F.lit("")), F.lit("README"))).otherwise(upper)


def markdown_documents(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, org: str = "", repository: str = "", sensitivity: str = "internal") -> DataFrame:
    """document_id, path, title, document_type, audience, authority, sensitivity, meta, body of Markdown files.

    What the head of a file says counts before what its path says: its title before the first
    heading and the path's title, its documentType before the path's. Fields that may only
    have certain values are ignored with others; sensitivity is the default of its field.
    """
    rows = files.where(F.col("path").rlike(r"(?i)\.mdx?$"))
    keep = F.lit(not include)
    for g in include or []:
        keep = keep | F.col("path").rlike(glob_regex(g))
    for g in exclude or []:
        keep = keep & ~F.col("path").rlike(glob_regex(g))
    meta, body = front_matter(F.decode("content", "UTF-8"))
    out = rows.where(keep).select("path", meta.alias("meta"), body.alias("body"))
    heading = F.nullif(F.trim(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*#*\s*$", 1)), F.lit(""))
    said = lambda key: F.nullif(F.trim(F.try_element_at("meta", F.lit(key))), F.lit(""))
    one_of = lambda key: F.when(F.try_element_at("meta", F.lit(key)).isin(*FIELDS[key]), F.try_element_at("meta", F.lit(key)))
    path = F.col("path")
    return out.select(
        document_id(F.lit(org), F.lit(repository), path).alias("document_id"), "path", F.coalesce(said("title"), heading, title_of(path)).alias("title"), F.coalesce(said("documentType"), document_type(path)).alias("document_type"),
        F.coalesce(one_of("audience"), F.lit("developer")).alias("audience"), F.coalesce(one_of("authority"), default_authority(path)).alias("authority"), F.coalesce(one_of("sensitivity"), F.lit(sensitivity)).alias("sensitivity"), "meta", "body",
    )


def page(df: DataFrame, order: str, cursor: int, limit: int) -> DataFrame:
    """The rows from the cursor on, at most limit, in a total order."""
    return df.orderBy(order).offset(cursor).limit(limit)


_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def openapi_operations(specs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row for each operation of JSON specs: spec, method, route, operation_id, statuses, params, schemes.

    Specs that are not OpenAPI 3 or Swagger 2, or not JSON, have none. Keys of paths are
    data, so a spec is walked in the task that reads it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, raw in pdf.itertuples(index=False, name=None):
                try:
                    spec = json.loads(raw)
                except (TypeError, ValueError):
                    continue
                if not isinstance(spec, dict) or not (str(spec.get("openapi", "")).startswith("3.") or str(spec.get("swagger", "")) == "2.0"):
                    continue
                for route, item in (spec.get("paths") or {}).items():
                    for method in _METHODS:
                        op = item.get(method) if isinstance(item, dict) else None
                        if not isinstance(op, dict):
                            continue
                        params = [p for p in [*item.get("parameters", []), *op.get("parameters", [])] if isinstance(p, dict) and "name" in p]
                        security = op.get("security", spec.get("security", []))
                        rows.append((name, method.upper(), route, op.get("operationId"), sorted(map(str, op.get("responses", {}))), [{"key": f"{p.get('in')}:{p['name']}", "required": bool(p.get("required"))} for p in params], sorted({k for s in security for k in s})))
            yield pd.DataFrame(rows, columns=["spec", "method", "route", "operation_id", "statuses", "params", "schemes"])

    return specs.select(path, text).mapInPandas(run, "spec string, method string, route string, operation_id string, statuses array<string>, params array<struct<key:string,required:boolean>>, schemes array<string>")


def bind_operations(operations: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols (symbol_id, qualified_name, name) with the operation named like the qualified name, else like the name; the first spec wins."""
    one = operations.where("operation_id is not null").groupBy("operation_id").agg(F.min_by(F.struct("spec", "method", "route"), F.struct("spec", "route", "method")).alias("op"))
    q = one.select(F.col("operation_id").alias("qualified_name"), F.col("op").alias("q"))
    n = one.select(F.col("operation_id").alias("name"), F.col("op").alias("n"))
    out = symbols.join(q, "qualified_name", "left").join(n, "name", "left").withColumn("op", F.coalesce("q", "n"))
    return out.select("symbol_id", "qualified_name", "name", "op.spec", "op.method", "op.route")


def terraform_services(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """name, type, path of each resource block of Terraform files."""
    found = F.regexp_extract_all(F.col(text), F.lit(r'(?m)^\s*resource\s+"[^"]+"\s+"([^"]+)"'), F.lit(1))
    kind = F.regexp_extract_all(F.col(text), F.lit(r'(?m)^\s*resource\s+"([^"]+)"\s+"[^"]+"'), F.lit(1))
    rows = files.where(F.col(path).endswith(".tf")).select(F.col(path).alias("path"), F.explode(F.arrays_zip(found.alias("name"), kind.alias("type"))).alias("r"))
    return rows.select("r.name", "r.type", "path")


def bicep_services(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """name, type, path of each resource of Bicep files."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*resource\s+(\w+)\s+'[^'@]+"), F.lit(1))
    kind = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*resource\s+\w+\s+'([^'@]+)"), F.lit(1))
    rows = files.where(F.col(path).endswith(".bicep")).select(F.col(path).alias("path"), F.explode(F.arrays_zip(found.alias("name"), kind.alias("type"))).alias("r"))
    return rows.select("r.name", "r.type", "path")


def merge_services(services: DataFrame) -> DataFrame:
    """One row a name: all ports and dependencies, and the first image by path."""
    return services.groupBy("name").agg(F.min_by("image", F.when(F.col("image").isNotNull(), F.col("path"))).alias("image"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("depends_on")))).alias("depends_on"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports")))).alias("ports"))


def supersede(shallow: DataFrame, deep: DataFrame) -> DataFrame:
    """Symbols of the deeper analyser, and the shallower one's of files that the deeper did not cover."""
    return deep.unionByName(shallow.join(deep.select("path").distinct(), "path", "left_anti"))


def first_by_id(rows: DataFrame, item: str, order: str) -> DataFrame:
    w = Window.partitionBy(item).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def compose_services(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """name, image, depends_on, ports and path of the services of compose files.

    Lines are read by their indentation: a service is a key below ``services:``, its keys
    are one level deeper, and lists may stand in brackets, as lines with a dash, or, for
    depends_on, as keys.
    """
    named = files.where(F.col(path).rlike(r"(^|/)(docker-)?compose[^/]*\.ya?ml$"))
    lines = named.select(F.col(path).alias("path"), F.posexplode(F.split(text, r"\r?\n", -1)).alias("no", "line")).where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    lines = lines.withColumn("at", F.length(F.regexp_extract("line", r"^( *)", 1)))
    w = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(F.when(F.col("at") == 0, F.regexp_extract("line", r"^([\w-]+):", 1)), ignorenulls=True).over(w)).where("section = 'services' and at > 0")
    step = lines.groupBy("path").agg(F.min("at").alias("step"))
    lines = lines.join(step, "path").withColumn("level", F.floor(F.col("at") / F.col("step")))
    key = F.regexp_extract("line", r"^\s*[\"']?([\w.-]+)[\"']?:", 1)
    lines = lines.withColumn("name", F.last(F.when(F.col("level") == 1, key), ignorenulls=True).over(w)).withColumn("key", F.last(F.when((F.col("level") == 2) & ~F.col("line").rlike(r"^\s*-"), key), ignorenulls=True).over(w)).where("level > 1")
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*[\w.-]+:\s*(.*)$", 1), r"\s+#.*$", ""))
    plain = lambda c: F.regexp_replace(c, "^[\"']|[\"']$", "")
    item = F.when(F.col("line").rlike(r"^\s*-"), plain(F.regexp_extract("line", r"^\s*-\s*(.*?)\s*$", 1)))
    listed = F.when(value.startswith("["), F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), r"\s*,\s*"), plain)).when(item.isNotNull(), F.array(item)).when((F.col("key") == "depends_on") & (F.col("level") == 3), F.array(key)).otherwise(F.array().cast("array<string>"))
    per = lines.select("path", "name", "key", "no", F.when((F.col("key") == "image") & (F.col("level") == 2), plain(value)).alias("image"), listed.alias("items"))
    gather = lambda k: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("key").isin(k), F.struct("no", "items")))), lambda x: x["items"]))
    out = per.groupBy("path", "name").agg(F.max("image").alias("image"), gather(["depends_on", "links"]).alias("depends_on"), gather(["ports"]).alias("p"))
    return out.select("name", "image", "depends_on", F.filter(F.transform("p", lambda x: F.element_at(F.split(x, ":"), -1)), lambda x: x.rlike(r"^\d+$")).alias("ports"), "path")
