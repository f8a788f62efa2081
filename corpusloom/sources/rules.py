"""Path rules as tables: ignore files of any folder, and owners, met by equal keys instead of rule by rule."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import glob_regex

#: Letters of a name's start or end that a key holds.
KEY_LETTERS = 3
_WILD = re.compile(r"[*?\[]")


def rule_key(glob: str) -> str:
    """One key that every name matching the glob has among its ``name_keys``: the whole name, its start, its end, or ``any``."""
    low = glob.lower()
    wild = _WILD.search(low)
    if wild is None:
        return "is:" + low
    start, end = low[: wild.start()], re.split(r"[*?\]/]", low)[-1]  # ``**/x`` may match x alone
    if start:
        return "start:" + start[:KEY_LETTERS]
    return "end:" + end[-KEY_LETTERS:] if end else "any"


def name_keys(name: Column) -> Column:
    """All keys under which a rule for this name may stand."""
    low = F.lower(name)
    ends = [F.concat(F.lit("start:"), F.substring(low, 1, k)) for k in range(1, KEY_LETTERS + 1)] + [F.concat(F.lit("end:"), F.right(low, F.lit(k))) for k in range(1, KEY_LETTERS + 1)]
    return F.array_distinct(F.array(F.concat(F.lit("is:"), low), *ends, F.lit("any")))


def class_regex(glob: str) -> str:
    """The expression of a glob that may hold classes of characters in brackets."""
    parts = re.split(r"(\[[^\]]+\])", glob)
    bare = [p.replace("[!", "[^", 1) if k % 2 else glob_regex(p).removeprefix("(?i)^").removesuffix("$") for k, p in enumerate(parts)]
    return "(?i)^" + "".join(bare) + "$"


def ignore_rules(text: str) -> list[tuple[int, str, bool, bool, bool, str]]:
    """(line, key, by name alone, for folders only, ignores, expression) of the lines of an ignore file.

    A pattern with a slash before its end holds from the file's folder on, one without for
    names at any depth. ``!`` takes back, a backslash makes a first ``#`` or ``!`` plain.
    """
    out = []
    for no, line in enumerate(text.splitlines()):
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        body = line[0 if ignores else 1 :]
        body = body[1:] if body[:2] in ("\\#", "\\!") else body
        folder, body = body.endswith("/"), body.rstrip("/")
        if not body:
            continue
        by_name = "/" not in body
        glob = body.lstrip("/")
        out.append((no, rule_key(glob), by_name, folder, ignores, class_regex(glob)))
    return out


_RULE = "array<struct<no:int,key:string,by_name:boolean,folder:boolean,ignores:boolean,re:string>>"


def rules_of(files: DataFrame) -> DataFrame:
    """files (path, text) of ignore files as rules: dir, no, key, by_name, folder, ignores, re; dir is empty at the top.

    Several files of one folder are read in the order of their names, the later over the earlier.
    """
    parse = F.udf(lambda t: ignore_rules(t or ""), _RULE)
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.col("path").alias("file"), F.explode(parse("text")).alias("r"))
    return rows.select("dir", F.struct("file", "r.no").alias("at"), "r.key", "r.by_name", "r.folder", "r.ignores", "r.re")


def _chain() -> Column:
    """The folders above a path, and the path itself: node, is_folder."""
    parts = F.split("path", "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("node"), (k < F.size(parts)).alias("is_folder")))


def _nodes(paths: DataFrame) -> DataFrame:
    """The paths and every folder above them, once: node, is_folder, name. A store may have a file and a folder of one name."""
    return paths.select(F.explode(_chain()).alias("n")).select("n.*").distinct().withColumn("name", F.element_at(F.split("node", "/"), -1))


def not_ignored(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """files that no ignore file leaves out; columns and rows stay, null paths too.

    For a file or folder the nearest ignore file with a matching line decides, in it the
    last such line. What lies in an ignored folder is ignored, whatever is said below it.
    Nodes of the tree meet the rules of the folders above them on (folder, key), so a
    rule is only tried on names that may fit; the verdicts go back down by a join on folders.
    """
    paths = files.select(F.col(path).alias("path")).where("path is not null").distinct()
    nodes = _nodes(paths)
    parts = F.split("node", "/")
    seen = nodes.select("node", "is_folder", "name", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir"), k.alias("depth")))).alias("d")).select("node", "is_folder", "name", "d.dir", "d.depth")
    # Only folders that hold an ignore file go on.
    seen = seen.join(rules.select("dir").distinct(), "dir", "left_semi")
    below = F.when(F.col("dir") == "", F.col("node")).otherwise(F.expr("substring(node, length(dir) + 2)"))
    keyed = seen.withColumn("below", below).withColumn("key", F.explode(F.array_union(F.transform(name_keys(F.col("name")), lambda k: F.concat(F.lit("n/"), k)), F.transform(name_keys(F.col("below")), lambda k: F.concat(F.lit("p/"), k)))))
    wanted = rules.withColumn("key", F.concat(F.when(F.col("by_name"), "n/").otherwise("p/"), "key"))
    met = keyed.join(wanted, ["dir", "key"]).where((~F.col("folder") | F.col("is_folder")) & F.expr("(case when by_name then name else below end) rlike re"))
    out = met.groupBy("node", "is_folder").agg(F.max_by("ignores", F.struct("depth", "at")).alias("ignores")).where("ignores").select("node", "is_folder")
    gone = paths.select("path", F.explode(_chain()).alias("n")).select("path", "n.*").join(out, ["node", "is_folder"], "left_semi").select(F.col("path").alias("_gone")).distinct()
    return files.join(gone, files[path] == gone["_gone"], "left_anti")


def owner_rules(text: str) -> list[tuple[int, int, str, bool, str, str, list[str]]]:
    """(line, length, key, by name alone, expression, expression below, owners) of an owners file."""
    out = []
    for no, line in enumerate(text.splitlines()):
        parts = line.split("#")[0].split()
        if len(parts) < 2:
            continue
        pattern, body = parts[0], parts[0].strip("/")
        by_name = "/" not in body and not pattern.startswith("/")
        folder = pattern.endswith("/")
        glob = body + ("/**" if folder else "")
        out.append((no, len(pattern), rule_key(body.split("/")[0]), by_name, glob_regex(glob), glob_regex(glob + "/**"), parts[1:]))
    return out


def owners(paths: DataFrame, codeowners: str) -> DataFrame:
    """path and owners by the longest pattern that matches, of equal ones the last line; none: an empty list.

    A pattern without a slash may start at any part of a path, others at its first. Each
    part meets the rules whose first part may fit, by key; the whole pattern is tried on these.
    """
    none = F.array().cast("array<string>")
    rows = owner_rules(codeowners)
    if not rows:
        return paths.select("path", none.alias("owners"))
    rules = paths.sparkSession.createDataFrame(rows, "no int, size int, key string, by_name boolean, re string, below string, owners array<string>")
    # Rules are one file's; a path's keys meet them in place, and each path is added up once with the number of its rows.
    once = paths.groupBy("path").agg(F.count("*").alias("_rows"))
    parts = F.split("path", "/")
    starts = once.select("path", "_rows", F.posexplode_outer(parts).alias("at", "part")).withColumn("rest", F.array_join(F.slice(parts, F.col("at") + 1, F.size(parts)), "/"))
    keyed = starts.withColumn("key", F.explode_outer(name_keys(F.col("part"))))
    fits = (F.col("by_name") | (F.col("at") == 0)) & F.expr("rest rlike re or rest rlike below")
    met = keyed.join(F.broadcast(rules), "key", "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    best = met.groupBy("path").agg(F.max_by("owners", F.when(F.col("fits"), F.struct("size", "no"))).alias("owners"), F.first("_rows").alias("_rows"))
    return best.select("path", F.coalesce("owners", none).alias("owners"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_row")).drop("_row")
