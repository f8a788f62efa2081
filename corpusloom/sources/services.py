"""Services that infrastructure files declare: compose files, charts, Terraform and Bicep, as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.repository import compose_services

# Kinds of services by name and image or type, the first that fits; types of
# resources that are services; folders whose files are not the repository's own.
KINDS = {
    "database": r"postgres|mysql|mariadb|mssql|sqlserver|mongo|cosmos|dynamo|\bdb\b|database",
    "cache": r"redis|memcached|cache",
    "queue": r"rabbit|kafka|sqs|servicebus|queue|topic|pubsub|nats",
    "job": r"job|cron|worker|scheduler",
    "external": r"external|third.?party|vendor",
}
SERVICE_TYPES = r"(?i)service|container|function|app|database|db|queue|topic|cache|redis|sql"
FOREIGN = r"(^|/)(node_modules|\.git|vendor)/"
#: Characters behind the head of a Terraform block in which other resources are looked for.
BLOCK = 2000

_NONE = "array<string>"


def service_kind(name: Column, hint: Column) -> Column:
    """The kind of a service by its name and its image or type; ``service`` where none fits."""
    said = F.lower(F.concat_ws(" ", name, hint))
    return F.coalesce(*[F.when(said.rlike(pattern), F.lit(kind)) for kind, pattern in KINDS.items()], F.lit("service"))


def _none() -> Column:
    return F.array().cast(_NONE)


def _plain(c: Column) -> Column:
    """A YAML scalar without its quotes and the comment behind it."""
    quoted = F.nullif(F.regexp_extract(c, r"^([\"'])(.*)\1\s*(?:#.*)?$", 2), F.lit(""))
    return F.coalesce(quoted, F.trim(F.regexp_replace(c, r"(^|\s)#.*$", "")))


def chart_services(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """name, depends_on and path of Helm charts (Chart.yaml).

    Read by lines: the name at the top level, and below ``dependencies:`` the names of the
    list's own items, wherever in an item they stand; names deeper in an item are not
    dependencies. A chart without a name, an empty or a null text has no row; lists in
    brackets are not read.
    """
    charts = files.where(F.col(path).rlike(r"(^|/)Chart\.ya?ml$") & ~F.col(path).rlike(FOREIGN))
    whole = F.concat(F.lit("\n"), F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\n"))
    rows = charts.select(F.col(path).alias("path"), whole.alias("t"))
    block = F.regexp_extract("t", r"\ndependencies:[ \t]*(?:#[^\n]*)?\n((?:(?:[ \t-][^\n]*|#[^\n]*)?\n)*)", 1)
    rows = rows.select("path", _plain(F.regexp_extract("t", r"\nname:[ \t]*([^\n]*)", 1)).alias("name"), block.alias("block"))
    dash = F.length(F.regexp_extract("block", r"(?m)^([ \t]*)-", 1))
    # Keys of an item stand behind its dash, or where that first key stands, on later lines.
    first = F.length(F.regexp_extract("block", r"(?m)^([ \t]*-[ \t]+)\S", 1))
    lines = F.filter(F.split("block", "\n"), lambda l: l.rlike(r"^[ \t]*(-[ \t]+)?name:") & (F.length(F.regexp_extract(l, r"^([ \t]*(?:-[ \t]+)?)name:", 1)) == F.col("first")) & (~l.rlike(r"^[ \t]*-") | (F.length(F.regexp_extract(l, r"^([ \t]*)-", 1)) == F.col("dash"))))
    names = F.transform(lines, lambda l: _plain(F.regexp_extract(l, r"name:[ \t]*(.*)$", 1)))
    return rows.withColumns({"dash": dash, "first": first}).where("name <> ''").select("name", F.filter(names, lambda n: n != "").alias("depends_on"), "path")


def resource_services(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """name, type, depends_on and path of the resources of Terraform and Bicep files.

    Of Terraform only types that are services count; they depend on the resources whose
    attributes stand within ``BLOCK`` characters behind their head. Bicep's say no dependencies.
    """
    own = files.where(~F.col(path).rlike(FOREIGN))
    head = r'resource\s+"([^"]+)"\s+"([^"]+)"\s*\{(?=([\s\S]{0,' + str(BLOCK) + "}))"
    part = lambda n: F.regexp_extract_all(F.col(text), F.lit(head), F.lit(n))
    tf = own.where(F.col(path).endswith(".tf")).select(F.col(path).alias("path"), F.inline(F.arrays_zip(part(1).alias("type"), part(2).alias("name"), part(3).alias("block"))))
    named = F.regexp_extract_all("block", F.lit(r"\b([a-z][a-z0-9_]*)\.([a-z][a-z0-9_]*)\.[a-z_]+"), F.lit(2))
    tf = tf.where(F.col("type").rlike(SERVICE_TYPES)).select("name", "type", F.filter(F.array_distinct(named), lambda r: r != F.col("name")).alias("depends_on"), "path")
    line = r"resource\s+(\w+)\s+'([^'@]+)@?[^']*'\s*="
    part = lambda n: F.regexp_extract_all(F.col(text), F.lit(line), F.lit(n))
    bicep = own.where(F.col(path).endswith(".bicep")).select(F.col(path).alias("path"), F.inline(F.arrays_zip(part(1).alias("name"), part(2).alias("type"))))
    return tf.unionByName(bicep.select("name", "type", _none().alias("depends_on"), "path"))


def infra_services(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """name, kind, image, depends_on, ports and path of every service that a file declares.

    Other files, and texts that do not have the form of their name, have no rows. A name
    has a row for each file that declares it; ``service_map`` merges them.
    """
    compose = compose_services(files.where(~F.col(path).rlike(FOREIGN)), path, text)
    blank = F.lit(None).cast("string")
    rows = compose.select("name", service_kind(F.col("name"), F.col("image")).alias("kind"), "image", "depends_on", "ports", "path")
    charts = chart_services(files, path, text).select("name", F.lit("service").alias("kind"), blank.alias("image"), "depends_on", _none().alias("ports"), "path")
    resources = resource_services(files, path, text).select("name", service_kind(F.col("name"), F.col("type")).alias("kind"), blank.alias("image"), "depends_on", _none().alias("ports"), "path")
    return rows.unionByName(charts).unionByName(resources)


def service_map(services: DataFrame) -> DataFrame:
    """One row a name: the kind and the first image by path, and all dependencies and ports, sorted.

    Values are made distinct before they meet, so a name that a third of all files declares
    costs what its distinct dependencies take. Of rows of one path the least kind and image count.
    """
    one = services.groupBy("name").agg(F.min_by("kind", F.struct("path", "kind")).alias("kind"), F.min_by("image", F.when(F.col("image").isNotNull(), F.struct("path", "image"))).alias("image"))
    both = services.select("name", F.explode(F.concat(F.transform("depends_on", lambda x: F.struct(F.lit(True).alias("dep"), x.alias("v"))), F.transform("ports", lambda x: F.struct(F.lit(False).alias("dep"), x.alias("v"))))).alias("e")).distinct()
    sets = both.groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.col("e.dep"), F.col("e.v")))).alias("depends_on"), F.array_sort(F.collect_list(F.when(~F.col("e.dep"), F.col("e.v")))).alias("ports"))
    return one.join(sets, "name", "left").select("name", "kind", "image", F.coalesce("depends_on", _none()).alias("depends_on"), F.coalesce("ports", _none()).alias("ports"))
