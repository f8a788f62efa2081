"""Links between repositories as classes: who is linked, and with how many, without a row for each pair.

A class is a key (an operation's name, a package and a name, a set of fields). Its links are
all pairs of a source and a target of the class that may be linked, so members and counts
say the same as the pairs, in rows that grow with the members. Pairs are listed page by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _counts(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """key, repo, s, t and the key's totals, for links of a source with targets of other repositories."""
    per = lambda df, n: df.groupBy("key", "repo").agg(F.count("*").alias(n))
    both = per(sources, "s").join(per(targets, "t"), ["key", "repo"], "full").fillna(0, ["s", "t"])
    total = both.groupBy("key").agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).where("all_s > 0 and all_t > 0")
    return both.join(total, "key")


def other_repository(sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of sources and targets (key, id, repo) that are linked when their repositories differ.

    classes: key, sources and targets with a link, links. members: key, id, side, links.
    Only counts by key and repository are joined; a key that holds a third of all rows is
    added up before the shuffle, and members get their counts from those small rows. Rows
    with a null key or repository have no links; each row of a repeated id counts.
    """
    sources, targets = (df.where("key is not null and repo is not null").select("key", "id", "repo") for df in (sources, targets))
    both = _counts(sources, targets)
    linked = lambda n, others: F.sum(F.when(F.col(others) > 0, F.col(n)).otherwise(0))
    per = both.withColumns({"to": F.col("all_t") - F.col("t"), "from": F.col("all_s") - F.col("s")})
    classes = per.groupBy("key").agg(linked("s", "to").alias("sources"), linked("t", "from").alias("targets"), F.sum(F.col("s") * F.col("to")).alias("links")).where("links > 0")
    return classes, _members(sources, per, ["key", "repo"], "source", "to").unionByName(_members(targets, per, ["key", "repo"], "target", "from"))


def other_language(types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of types (key, id, repo, language): each is linked with those of later repositories in other languages."""
    types = types.where("key is not null and repo is not null and language is not null").select("key", "id", "repo", "language")
    per = types.groupBy("key", "repo", "language").agg(F.count("*").alias("n"))

    def beyond(direction: Column, *by: str) -> Column:
        """Rows of strictly later (or earlier) repositories."""
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy(direction).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return upto - F.sum("n").over(Window.partitionBy(*by, "repo"))

    later, earlier = F.col("repo").desc(), F.col("repo").asc()
    per = per.withColumns({"to": beyond(later, "key") - beyond(later, "key", "language"), "from": beyond(earlier, "key") - beyond(earlier, "key", "language")})
    linked = lambda others: F.sum(F.when(F.col(others) > 0, F.col("n")).otherwise(0))
    classes = per.groupBy("key").agg(linked("to").alias("sources"), linked("from").alias("targets"), F.sum(F.col("n") * F.col("to")).alias("links")).where("links > 0")
    on = ["key", "repo", "language"]
    return classes, _members(types, per, on, "source", "to").unionByName(_members(types, per, on, "target", "from"))


def pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """key, src, dst, src_repo, dst_repo: every link of ``other_repository``, a row each, for keys that few rows share."""
    side = lambda df, name: df.where("key is not null and repo is not null").select("key", F.col("id").alias(name), F.col("repo").alias(f"{name}_repo"))
    return side(sources, "src").join(side(targets, "dst"), "key").where("src_repo <> dst_repo").select("key", "src", "dst", "src_repo", "dst_repo")


def _members(rows: DataFrame, per: DataFrame, on: list[str], side: str, links: str) -> DataFrame:
    return rows.join(per.where(F.col(links) > 0).select(*on, F.col(links).alias("links")), on).select("key", "id", *on[1:], F.lit(side).alias("side"), "links")


def page(members: DataFrame, size: int, after: Column | None = None) -> DataFrame:
    """The first ``size`` links (key, src, dst) by (src, key, dst), of sources for which ``after`` holds.

    Only sources that the page reaches are joined with their targets: as each has a link,
    they are among the first ``size`` sources, and running sums over these say where to stop.
    """
    mine = members.where("side = 'source'")
    mine = (mine if after is None else mine.where(after)).withColumnRenamed("id", "src").orderBy("src", "key").limit(size)
    upto = Window.orderBy("src", "key").rowsBetween(Window.unboundedPreceding, -1)  # of ``size`` rows at most
    mine = mine.withColumn("_before", F.coalesce(F.sum("links").over(upto), F.lit(0))).where(F.col("_before") < size)
    theirs = members.where("side = 'target'").withColumnRenamed("id", "dst")
    differs = (F.col("m.repo") < F.col("t.repo")) & (F.col("m.language") != F.col("t.language")) if "language" in members.columns else F.col("m.repo") != F.col("t.repo")
    pairs = mine.alias("m").join(theirs.alias("t"), (F.col("m.key") == F.col("t.key")) & differs)
    return pairs.select("m.key", "src", "dst").orderBy("src", "key", "dst").limit(size)


def package_sides(dependencies: DataFrame, packages: DataFrame, unresolved: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and targets of package links, with package and name as the key.

    dependencies (module, package), packages (package, module), unresolved (src, module, name,
    repo), symbols (symbol_id, module, name, repo). A name that a module could not resolve
    meets the packages which the module depends on and which have such a name; others never
    make a row.
    """
    key = F.concat_ws(":", "package", "name").alias("key")
    offers = symbols.join(packages.select("package", "module").distinct(), "module")
    offered = offers.select("package", "name").distinct()
    wanted = unresolved.select("module", "name").distinct().join(dependencies.select("module", "package").distinct(), "module").join(offered, ["package", "name"])
    sources = unresolved.join(wanted, ["module", "name"]).select(key, F.col("src").alias("id"), "repo").distinct()
    return sources, offers.select(key, F.col("symbol_id").alias("id"), "repo").distinct()


def contract_sides(consumers: DataFrame, producers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and targets (id, name, repo) of contract links: equal names, case aside."""
    side = lambda df: df.select(F.lower("name").alias("key"), "id", "repo")
    return side(consumers), side(producers)


def typed(types: DataFrame, least_fields: int = 3) -> DataFrame:
    """Types (id, repo, language, fields) of at least so many fields, with a hash of their sorted field names as the key."""
    shape = F.md5(F.array_join(F.array_sort(F.transform("fields", F.lower)), ","))
    return types.where(F.size("fields") >= least_fields).select(shape.alias("key"), "id", "repo", "language")


#: Kinds of links with the confidence of an edge.
KINDS = {"api-contract": 0.95, "package-dependency": 0.9, "shared-type": 0.7}


def all_links(contract: tuple[DataFrame, DataFrame], package: tuple[DataFrame, DataFrame], types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of the three kinds together, with kind and confidence.

    Members carry their repository, and a type its language: with them and the side, the
    members of a class say which of them are linked.
    """
    each = dict(zip(KINDS, (other_repository(*contract), other_repository(*package), other_language(types))))
    classes = members = None
    for kind, (c, m) in each.items():
        language = F.col("language") if "language" in m.columns else F.lit(None).cast("string")
        c = c.select(F.lit(kind).alias("kind"), "key", "sources", "targets", "links", F.lit(KINDS[kind]).alias("confidence"))
        m = m.select(F.lit(kind).alias("kind"), "key", F.col("id").cast("string").alias("id"), F.col("repo").cast("string").alias("repo"), language.alias("language"), "side", "links", F.lit(KINDS[kind]).alias("confidence"))
        classes = c if classes is None else classes.unionByName(c)
        members = m if members is None else members.unionByName(m)
    return classes, members
