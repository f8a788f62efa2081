"""Raw declarations to the assembled representation: lines to declarations, ids, edges by name, rollups, documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.ids import symbol_id
from corpusloom.functions.normalize import normal_doc, normal_signature
from corpusloom.operators.graph import resolve_names, used_by
from corpusloom.operators.tables import spread

DEPTHS = ["shallow", "semantic", "artifact"]
# By language, the kinds of declarations and the lines that open them; group 1 is the name.
OPENERS = {
    "typescript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"), ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)[^=]*="), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)[^=]*=>"), ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(?!if|for|while|switch|catch|return|function\b)([A-Za-z_$][\w$]*)\s*\([^)]*\)[^;{]*\{\s*$")],
    "python": [("class", r"^\s*class\s+([A-Za-z_]\w*)"), ("method", r"^\s+(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)")],
    "csharp": [("class", r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|record|struct)\s+([A-Za-z_]\w*)"), ("interface", r"^\s*(?:(?:public|internal|partial)\s+)*interface\s+([A-Za-z_]\w*)"), ("enum", r"^\s*(?:(?:public|internal)\s+)*enum\s+([A-Za-z_]\w*)"), ("method", r"^\s*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\],.? ]+\s+([A-Za-z_]\w*)\s*\([^)]*\)\s*(?:\{|=>|;)?\s*$")],
}
OPENERS["javascript"] = OPENERS["typescript"]


def _owned(found: DataFrame, path: str) -> DataFrame:
    """found (path, no, kind, name, indent, ...) with the owner: the last class or interface above that is indented less.

    A file's declarations stream through a task in their order, which holds the classes that
    may still own one: a class puts out those above it that are indented as much or more.
    """
    names = found.columns
    places = [names.index(c) for c in (path, "kind", "name", "indent")]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for batch in batches:
            owners = []
            for at, kind, name, indent in zip(*[batch.column(i).to_pylist() for i in places]):
                if at != file:
                    file, open_ = at, []
                owners.append(next((n for i, n in reversed(open_) if i < indent), None))
                if kind in ("class", "interface"):
                    while open_ and open_[-1][0] >= indent:
                        open_.pop()
                    open_.append((indent, name))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owners, pa.string())], names=[*names, "owner"])

    return spread(found, path).sortWithinPartitions(path, "no").mapInArrow(own, ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", owner string")


def declarations(files: DataFrame, path: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """path, line, kind, name, qualified_name, visibility, indent, signature and doc of the lines that open declarations.

    Lines are exploded and matched by the patterns of their language. A declaration belongs
    to the last class or interface above it that is indented less; its documentation is the
    run of comment lines right above it, or for Python the string right below. Found by
    lines alone, so all of it is shallow.
    """
    lines = files.select(path, language, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)).alias("no", "line"))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, openers in OPENERS.items():
        for k, pattern in reversed(openers):
            hit = (F.col(language) == lang) & F.col("line").rlike(pattern)
            kind, name = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract("line", pattern, 1)).otherwise(name)
    lines = spread(lines, path, "no")
    comment = F.col("line").rlike(r"^\s*(//|/\*|\*|#|///)")
    order = Window.partitionBy(path).orderBy("no")
    near = lines.withColumns({"kind": kind, "name": name, "comment": comment, "indent": F.length(F.regexp_extract("line", r"^(\s*)", 1))})
    # Lines of one run of comments share the number of other lines above them.
    near = near.withColumn("others", F.sum(F.when(F.col("comment"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = near.where("comment").groupBy(path, F.col("others").alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("above"), F.max("no").alias("last"))
    near = near.withColumn("below", F.lead("line").over(order)).where("kind is not null")
    near = near.join(runs.select(F.col(path).alias("_p"), (F.col("last") + 1).alias("_n"), "above"), (F.col(path) == F.col("_p")) & (F.col("no") == F.col("_n")), "left")
    out = _owned(near.drop("_p", "_n", "comment", "others"), path)
    above = F.regexp_replace("above", r"\s*\*/\s*$", "")
    string = F.regexp_extract("below", r"^\s*(?:\"\"\"|''')(.*?)(?:\"\"\"|''')?\s*$", 1)
    hidden = F.col("name").startswith("_") | F.col("line").rlike(r"\b(private|protected)\b")
    open_ = F.when(F.col(language) == "python", True).when(F.col("owner").isNotNull(), True).when(F.col(language) == "csharp", F.col("line").rlike(r"\bpublic\b")).otherwise(F.col("line").rlike(r"^\s*export\b"))
    return out.select(
        path,
        (F.col("no") + 1).alias("line"),
        F.when((F.col("kind") == "method") & F.col("owner").isNull(), "function").otherwise(F.col("kind")).alias("kind"),
        "name",
        F.concat_ws(".", "owner", "name").alias("qualified_name"),
        F.when(hidden, "private").when(open_, "public").otherwise("internal").alias("visibility"),
        "indent",
        normal_signature(F.trim("line"), F.col(language)).alias("signature"),
        F.nullif(F.when(F.col(language) == "python", F.coalesce(F.nullif(string, F.lit("")), normal_doc(above))).otherwise(normal_doc(above)), F.lit("")).alias("doc"),
    )


def doc_parts(doc: Column) -> Column:
    """struct(summary, params map, returns, deprecated) of a documentation text in JSDoc, Sphinx, XML, Google or NumPy form."""
    text = F.coalesce(doc, F.lit(""))
    pairs = lambda pattern, a, b: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(a)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(b)).alias("v"))
    jsdoc, sphinx, xml = r"(?m)^\s*@param\s+(?:\{[^}]*\}\s+)?\[?(\w+)[^\s\]]*\]?\s*-?\s*(.*?)\s*$", r"(?m)^\s*:param\s+(?:\w+\s+)?(\w+):\s*(.*?)\s*$", r"<param\s+name=\"(\w+)\">\s*([^<]*?)\s*</param>"
    google = F.regexp_extract(text, r"(?ms)^\s*(?:Args|Arguments|Parameters):\s*\n(.*?)(?:\n\s*\n|\n\S|\z)", 1)
    listed = F.arrays_zip(F.regexp_extract_all(google, F.lit(r"(?m)^\s+(\w+)\s*(?:\([^)]*\))?:\s*(.*?)\s*$"), F.lit(1)).alias("k"), F.regexp_extract_all(google, F.lit(r"(?m)^\s+(\w+)\s*(?:\([^)]*\))?:\s*(.*?)\s*$"), F.lit(2)).alias("v"))
    numpy = F.regexp_extract(text, r"(?ms)^\s*Parameters\s*\n\s*-{3,}\s*\n(.*?)(?:\n\s*\n|\z)", 1)
    ruled = F.arrays_zip(F.regexp_extract_all(numpy, F.lit(r"(?m)^\s*(\w+)\s*:[^\n]*\n\s+([^\n]*?)\s*$"), F.lit(1)).alias("k"), F.regexp_extract_all(numpy, F.lit(r"(?m)^\s*(\w+)\s*:[^\n]*\n\s+([^\n]*?)\s*$"), F.lit(2)).alias("v"))
    all_ = F.concat(pairs(jsdoc, 1, 2), pairs(sphinx, 1, 2), pairs(xml, 1, 2), listed, ruled)
    names = F.array_distinct(F.transform(all_, lambda p: p["k"]))
    params = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.transform(F.filter(all_, lambda p: p["k"] == n), lambda p: p["v"]), 1))))
    first = lambda *ps: F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ps])
    returns = first(r"(?m)^\s*@returns?\s+(?:\{[^}]*\}\s*)?-?\s*(.*?)\s*$", r"(?m)^\s*:returns?:\s*(.*?)\s*$", r"<returns>\s*([^<]*?)\s*</returns>", r"(?m)^\s*Returns:\s*\n\s*(.*?)\s*$", r"(?m)^\s*Returns\s*\n\s*-{3,}\s*\n\s*\S+\n\s+(.*?)\s*$")
    deprecated = text.rlike(r"(?m)^\s*(@deprecated|\.\. deprecated::|:deprecated:|Deprecated:)|<obsolete")
    summary = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)<summary>\s*(.*?)\s*</summary>", 1), F.lit("")), F.trim(F.regexp_extract(text, r"(?s)^\s*(.*?)\s*(?:\n\s*\n|\n\s*[@:]|\n\s*(?:Args|Arguments|Parameters|Returns)\b|<param|\z)", 1)))
    return F.struct(summary.alias("summary"), params.alias("params"), returns.alias("returns"), deprecated.alias("deprecated"))


def weakest_depth(depth: Column) -> Column:
    """Aggregate: the least deep of shallow, semantic and artifact; shallow for none."""
    place = F.array_position(F.array(*[F.lit(d) for d in DEPTHS]), depth)
    return F.coalesce(F.element_at(F.array(*[F.lit(d) for d in DEPTHS]), F.min(place).cast("int")), F.lit("shallow"))


def assemble(raw: DataFrame, calls: DataFrame, org: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, their edges by id, and the rollup of modules, from raw declarations.

    raw: (ordinal, module, language, kind, qualified_name, overload, signature, doc, depth);
    calls: (ordinal, name, kind) names that a declaration uses. Ids are hashes of what names a
    symbol; of equal ids the first by ordinal stays. A name means the module's last symbol
    of that name, else the first of all; names that mean none are unresolved edges.
    """
    parts = [F.col("module"), F.col("language"), F.col("kind"), F.col("qualified_name"), F.col("overload")]
    marked = raw.withColumn("symbol_id", symbol_id(F.lit(org), *parts))
    canonical = normal_signature(F.col("signature"), F.col("language"))
    doc = normal_doc(F.col("doc"))
    marked = marked.withColumns({"signature": canonical, "doc_hash": F.when(doc != "", F.sha2(doc, 256))}).withColumn("signature_hash", F.sha2(F.concat_ws("\n", "language", "kind", "signature"), 256))
    names = marked.select("symbol_id", "module", F.col("qualified_name").alias("name"), "ordinal")
    uses = calls.join(marked.select("ordinal", "module", F.col("symbol_id").alias("src")), "ordinal")
    edges = resolve_names(uses.select("src", "module", "name"), names).join(uses.select("src", "name", "kind").distinct(), ["src", "name"]).select("src", "name", "kind", "dst").distinct()
    first = Window.partitionBy("symbol_id").orderBy("ordinal")
    numbered = marked.withColumn("_n", F.row_number().over(first))
    users = used_by(edges.where("dst is not null and kind in ('call', 'type')").select("src", "dst").distinct()).select(F.col("dst").alias("symbol_id"), "users")
    symbols = numbered.where("_n = 1").drop("_n").join(users, "symbol_id", "left").withColumn("users", F.coalesce("users", F.array().cast("array<string>")))
    per = symbols.groupBy("module").agg(F.count("*").alias("n_symbols"), weakest_depth(F.col("depth")).alias("depth"), F.sort_array(F.collect_set("language")).alias("languages"))
    dropped = numbered.where("_n > 1").groupBy("module").agg(F.count("*").alias("n_dropped"))
    return symbols, edges, per.join(dropped, "module", "left").fillna(0, ["n_dropped"])


def attach_operations(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    """symbols (symbol_id, depth) with the operation bound to them; those that have one are as deep as an artifact."""
    out = symbols.join(bound.select("symbol_id", "method", "route"), "symbol_id", "left")
    return out.withColumn("depth", F.when(F.col("method").isNotNull(), "artifact").otherwise(F.col("depth")))


def module_reference(symbols: DataFrame, most: int | None = None) -> DataFrame:
    """A Markdown page for each module: its public symbols (name, kind, signature, doc) by name, one section each."""
    section = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n```\n"), F.col("signature"), F.lit("\n```\n"), F.coalesce(F.concat(F.lit("\n"), F.nullif(F.col("doc"), F.lit("")), F.lit("\n")), F.lit("")))
    per = symbols.where("visibility = 'public'").groupBy("module").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("name", section.alias("s")))).alias("xs"))
    return per.select("module", "n", F.concat(F.lit("# "), "module", F.lit("\n\n"), F.array_join(F.transform("xs", lambda x: x["s"]), "\n")).alias("page"))


def dependency_diagram(edges: DataFrame) -> DataFrame:
    """One row: a Mermaid graph of module edges (src, dst), in order of their names."""
    lines = F.transform(F.array_sort(F.collect_set(F.struct("src", "dst"))), lambda e: F.concat(F.lit("  "), e["src"], F.lit(" --> "), e["dst"]))
    return edges.agg(F.concat(F.lit("graph LR\n"), F.array_join(lines, "\n")).alias("diagram"))
