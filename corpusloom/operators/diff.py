"""Snapshot diff: classified and breaking changes, churn, the circuit breaker, staleness of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# By change class, whether to index again, to write documents again, and the priority.
ACTIONS = {
    "unchanged": (False, False, "low"),
    "formatting-only": (False, False, "low"),
    "body-changed": (True, False, "normal"),
    "doc-changed": (True, True, "low"),
    "signature-changed": (True, True, "high"),
    "visibility-changed": (True, True, "high"),
    "deprecation-changed": (True, True, "normal"),
    "http-binding-changed": (True, True, "high"),
    "added": (True, True, "normal"),
    "removed": (True, True, "high"),
    "moved": (True, False, "low"),
    "renamed": (True, True, "high"),
}
VISIBILITIES = ["private", "internal", "protected", "public"]
FIELDS = ["name", "module", "signature_hash", "signature", "visibility", "doc_hash", "body_hash", "deprecated", "http", "path", "line"]


def action(change: Column, k: int) -> Column:
    """Part k of a class's action: 0 index again, 1 write again, 2 priority."""
    return F.element_at(F.create_map(*[x for c, a in ACTIONS.items() for x in (F.lit(c), F.lit(a[k]))]), change)


def snapshot_diff(before: DataFrame, after: DataFrame, item: str = "symbol_id") -> DataFrame:
    """One row a symbol: id, name, module, change, reindex, regenerate, priority, and b_*/a_* fields.

    Both tables hold id, previous_ids and FIELDS. A symbol without a row of its own before
    is a rename if one of its previous ids, the first in their order, had one. An id that
    any symbol names as previous is not removed. The class of the widest effect wins.
    """
    b = before.select(F.col(item).alias("bid"), *[F.col(c).alias(f"b_{c}") for c in FIELDS])
    a = after.select(item, F.coalesce("previous_ids", F.array().cast("array<string>")).alias("prev"), *[F.col(c).alias(f"a_{c}") for c in FIELDS])
    own = a.join(b, F.col(item) == F.col("bid"), "left")
    fresh = own.where("bid is null").select(item, "prev", *[f"a_{c}" for c in FIELDS])
    names = fresh.select(item, F.posexplode("prev").alias("at", "old"))
    first = names.join(before.select(F.col(item).alias("old")), "old").groupBy(item).agg(F.min_by("old", "at").alias("old"))
    renamed = fresh.join(first, item).join(b, F.col("old") == F.col("bid")).drop("old", "prev").withColumn("was", F.lit("renamed"))
    added = fresh.join(first, item, "left_anti").drop("prev").withColumn("bid", F.lit(None).cast("string")).withColumn("was", F.lit("added"))
    same = own.where("bid is not null").drop("prev").withColumn("was", F.lit("same"))
    claimed = a.select(F.explode("prev").alias("bid")).unionByName(a.select(F.col(item).alias("bid"))).distinct()
    removed = b.join(claimed, "bid", "left_anti").withColumn("was", F.lit("removed")).withColumn(item, F.col("bid"))
    both = same.unionByName(renamed).unionByName(added, allowMissingColumns=True).unionByName(removed, allowMissingColumns=True)
    differs = lambda c: ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    text = lambda c: F.coalesce(f"b_{c}", F.lit("")) != F.coalesce(f"a_{c}", F.lit(""))
    change = (
        F.when(F.col("was") != "same", F.col("was"))
        .when(differs("http"), "http-binding-changed")
        .when(differs("signature_hash"), "signature-changed")
        .when(differs("visibility"), "visibility-changed")
        .when(differs("deprecated"), "deprecation-changed")
        .when(text("doc_hash"), "doc-changed")
        .when(text("body_hash"), "body-changed")
        .when(differs("path") | differs("line"), "moved")
        .when(differs("signature"), "formatting-only")
        .otherwise("unchanged")
    )
    out = both.withColumn("change", change)
    return out.select(
        F.col(item),
        F.coalesce("a_name", "b_name").alias("name"),
        F.coalesce("a_module", "b_module").alias("module"),
        "change",
        action(F.col("change"), 0).alias("reindex"),
        action(F.col("change"), 1).alias("regenerate"),
        action(F.col("change"), 2).alias("priority"),
        *[f"{s}_{c}" for s in "ba" for c in FIELDS],
    )


def churn(changes: DataFrame, totals: DataFrame, module: str = "module") -> DataFrame:
    """Counters of each module and touched over its symbols after; totals is (module, total)."""
    quiet = F.col("change").isin("unchanged", "formatting-only")
    edge = F.col("change").isin("added", "removed")
    per = changes.groupBy(module).agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if(~quiet & ~edge).alias("changed"),
        F.count_if(quiet).alias("unchanged"),
        F.count_if("reindex").alias("n_reindex"),
        F.count_if("regenerate").alias("n_regenerate"),
    )
    out = per.join(totals, module, "left")
    touched = F.col("added") + F.col("removed") + F.col("changed")
    total = F.coalesce("total", touched + F.col("unchanged"))
    return out.select(module, "added", "removed", "changed", "unchanged", "n_reindex", "n_regenerate", F.round(F.when(total > 0, touched / total).otherwise(0.0), 6).alias("churn_ratio"))


def circuit_breaker(changes: DataFrame, symbols_after: int, first_index: bool = False, most_changed: int = 2000, most_churn: float = 0.25, most_regenerated: int = 50, floor: int = 50) -> DataFrame:
    """One row: touched, churn_ratio, n_regenerate, the rule that trips (null: none) and what may run."""
    quiet = F.col("change").isin("unchanged", "formatting-only")
    out = changes.agg(F.count_if(~quiet).alias("touched"), F.count_if("regenerate").alias("n_regenerate"))
    ratio = F.col("touched") / F.lit(symbols_after) if symbols_after else F.when(F.col("touched") > 0, 1.0).otherwise(0.0)
    rule = F.when(F.lit(first_index), None).when(F.col("touched") > most_changed, "absolute-count").when(F.lit(symbols_after >= floor) & (ratio > most_churn), "churn-ratio").when(F.col("n_regenerate") > most_regenerated, "regeneration-count")
    out = out.withColumn("churn_ratio", F.round(ratio, 6)).withColumn("rule", rule.cast("string"))
    free = F.col("rule").isNull()
    return out.withColumn("may_reindex", free | F.coalesce(F.col("rule") == "regeneration-count", F.lit(False))).withColumn("may_regenerate", free)


def parameter_changes(before: DataFrame, after: DataFrame, item: str = "symbol_id") -> DataFrame:
    """Breaking changes of parameters: id, kind, detail. Rows are (id, pos, name, type, optional, has_default, rest).

    Parameters meet by name. One that is gone is a rename if a new name of the same type
    stands at its place, else removed. Both sides are gathered by symbol and meet once; a
    signature bounds what is gathered, and all comparisons are made in place.
    """
    cols = ["pos", "name", "type", "optional", "has_default", "rest"]
    gathered = lambda df, name: df.groupBy(item).agg(F.collect_list(F.struct(*cols)).alias(name))
    both = gathered(before.where(F.col(item).isNotNull()), "b").join(gathered(after.where(F.col(item).isNotNull()), "a"), item)
    row = lambda kind, detail: F.struct(kind.alias("kind"), detail.alias("detail"))
    say = lambda c: F.coalesce(c, F.lit("(untyped)"))
    # A null name meets nothing.
    same = lambda x, y: F.coalesce(x["name"] == y["name"], F.lit(False))
    gone = F.filter("b", lambda x: ~F.exists("a", lambda y: same(x, y)))
    new = F.filter("a", lambda y: ~F.exists("b", lambda x: same(x, y)))
    heirs = lambda x: F.filter("new", lambda y: F.coalesce(x["pos"] == y["pos"], F.lit(False)) & x["type"].eqNullSafe(y["type"]))
    lost = lambda x: F.when(F.size(heirs(x)) == 0, F.array(row(F.lit("parameter-removed"), x["name"]))).otherwise(
        F.transform(heirs(x), lambda y: row(F.when(y["name"].isNotNull(), "parameter-renamed").otherwise("parameter-removed"), F.concat(x["name"], F.coalesce(F.concat(F.lit(" → "), y["name"]), F.lit(""))))))
    kept = F.flatten(F.transform("b", lambda x: F.transform(F.filter("a", lambda y: same(x, y)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    typed = F.transform(F.filter("kept", lambda p: ~p["x"]["type"].eqNullSafe(p["y"]["type"])), lambda p: row(F.lit("parameter-type-changed"), F.concat(p["x"]["name"], F.lit(": "), say(p["x"]["type"]), F.lit(" → "), say(p["y"]["type"]))))
    required = F.transform(F.filter("kept", lambda p: p["x"]["optional"] & ~p["y"]["optional"]), lambda p: row(F.lit("parameter-made-required"), p["y"]["name"]))
    wanted = F.transform(F.filter("new", lambda y: ~y["optional"] & ~y["has_default"] & ~y["rest"]), lambda y: row(F.lit("parameter-added-required"), y["name"]))
    found = both.select(item, "b", "a", gone.alias("gone"), new.alias("new"), kept.alias("kept"))
    return found.select(item, F.explode(F.concat(F.flatten(F.transform("gone", lost)), typed, required, wanted)).alias("c")).select(item, "c.kind", "c.detail")


def surface_changes(changes: DataFrame, item: str = "symbol_id") -> DataFrame:
    """Breaking changes of visibility, and of symbols that are gone: id, kind, detail."""
    place = lambda c: F.array_position(F.array(*[F.lit(v) for v in VISIBILITIES]), F.col(c))
    lower = changes.where(F.col("change").isin("signature-changed", "visibility-changed", "http-binding-changed", "renamed") & (place("a_visibility") < place("b_visibility")))
    gone = changes.where("change = 'removed'")
    return lower.select(item, F.lit("visibility-reduced").alias("kind"), F.concat("b_visibility", F.lit(" → "), "a_visibility").alias("detail")).unionByName(gone.select(item, F.lit("symbol-removed").alias("kind"), F.col("name").alias("detail")))


def http_changes(before: DataFrame, after: DataFrame, item: str = "symbol_id") -> DataFrame:
    """Breaking changes of HTTP bindings (id, method, route, statuses, params array<struct<key,required>>, schemes): id, kind, detail."""
    b = before.select(F.col(item).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("method", "route", "statuses", "params", "schemes")])
    a = after.select(F.col(item), *[F.col(c).alias(f"a_{c}") for c in ("method", "route", "statuses", "params", "schemes")])
    gone = b.join(a, F.col("b_id") == F.col(item), "left_anti").select(F.col("b_id").alias(item), F.lit("endpoint-removed").alias("kind"), F.concat_ws(" ", "b_method", "b_route").alias("detail"))
    both = a.join(b, F.col("b_id") == F.col(item))
    row = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    was = F.transform(F.filter("b_params", lambda p: p["required"]), lambda p: p["key"])
    need = F.transform(F.filter("a_params", lambda p: p["required"]), lambda p: p["key"])
    found = F.concat(
        F.when(F.col("b_route") != F.col("a_route"), F.array(row("route-changed", F.concat("b_route", F.lit(" → "), "a_route")))).otherwise(F.array().cast("array<struct<kind:string,detail:string>>")),
        F.when(F.col("b_method") != F.col("a_method"), F.array(row("method-changed", F.concat("b_method", F.lit(" → "), "a_method")))).otherwise(F.array().cast("array<struct<kind:string,detail:string>>")),
        F.transform(F.array_except("b_statuses", "a_statuses"), lambda s: row("response-removed", s)),
        F.transform(F.array_except(need, was), lambda p: row("request-field-required-added", p)),
        F.transform(F.array_except("a_schemes", "b_schemes"), lambda s: row("security-added", s)),
    )
    return gone.unionByName(both.select(item, F.explode(found).alias("x")).select(item, "x.kind", "x.detail"))


def staleness(provenance: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """Findings of each cited symbol: document_id, symbol_id, reason. provenance: (document_id, symbol_id, signature_hash).

    aliases (previous_id, symbol_id) are followed one hop first, so a rename is not a removal.
    """
    old = aliases.select(F.col("previous_id").alias("p"), F.col("symbol_id").alias("now_id"))
    now = symbols.select(F.col("symbol_id").alias("s"), F.col("signature_hash").alias("now_hash"), F.col("http").isNotNull().alias("is_http"))
    x = provenance.join(old, F.col("symbol_id") == F.col("p"), "left").withColumn("at", F.coalesce("now_id", "symbol_id")).join(now, F.col("at") == F.col("s"), "left")
    reason = F.when(F.col("s").isNull(), "symbol-removed").when(F.col("at") != F.col("symbol_id"), "symbol-renamed").when((F.col("signature_hash") != "") & (F.col("signature_hash") != F.col("now_hash")), F.when(F.col("is_http"), "endpoint-changed").otherwise("signature-changed"))
    return x.select("document_id", "symbol_id", reason.alias("reason"))


def staleness_score(findings: DataFrame) -> DataFrame:
    """document_id, cited, stale, score."""
    return findings.groupBy("document_id").agg(F.count("*").alias("cited"), F.count("reason").alias("stale"), F.round(F.count("reason") / F.greatest(F.count("*"), F.lit(1)), 6).alias("score"))
