"""The access predicate that every arm applies before it scores, scopes, and effective permissions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ["public", "internal", "confidential", "restricted"]


class AccessDenied(Exception):
    """Raised before a plan is built; a denied caller never gets an empty filter."""


@dataclass(frozen=True)
class Access:
    org: str
    repos: list[str]
    clearance: str = "internal"
    denied: list[str] = field(default_factory=list)
    external: bool = False
    version: str | None = None


@dataclass(frozen=True)
class Scope:
    modules: list[str] = field(default_factory=list)
    repos: list[str] = field(default_factory=list)
    projects: list[str] = field(default_factory=list)
    version: str | None = None


def any_of(column: Column, values: list) -> Column:
    """In the list; nothing is in an empty one."""
    return column.isin(*values) if values else F.lit(False)


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)


def cleared(clearance: str) -> Column:
    """Tiers up to the clearance; restricted never."""
    return (tier_rank(F.col("sensitivity")) <= TIERS.index(clearance) + 1) & (F.col("sensitivity") != "restricted")


def allowed(access: Access, org: str) -> Column:
    """The predicate over chunks (org, repo, corpus, sensitivity, is_representative, doc_mode, doc_deleted, version, module_approved)."""
    if access.org != org:
        raise AccessDenied("the caller belongs to another organisation")
    base = (F.col("org") == org) & F.col("is_representative")
    if access.external:
        open_ = F.col("corpus").isin("docs", "spec") & (F.col("sensitivity") == "public") & F.col("module_approved")
        return base & open_ & (F.col("version") == access.version if access.version else F.lit(True))
    if not access.repos:
        raise AccessDenied("no repository is granted")
    documents = (F.col("corpus") != "docs") | F.col("doc_mode").isNull() | (F.col("doc_mode").isin("inherit", "public") & ~F.coalesce("doc_deleted", F.lit(False)))
    return base & any_of(F.col("repo"), access.repos) & ~any_of(F.col("repo"), access.denied) & cleared(access.clearance) & documents


def in_scope(scope: Scope) -> Column:
    """The narrowest of modules, repositories and projects that is set, and the version."""
    if scope.modules:
        out = any_of(F.col("module"), scope.modules)
    elif scope.repos:
        out = any_of(F.col("repo"), scope.repos)
    elif scope.projects:
        out = F.arrays_overlap("project_ids", F.array(*[F.lit(p) for p in scope.projects]))
    else:
        out = F.lit(True)
    return out & (F.col("version") == scope.version) if scope.version else out


def effective_grants(grants: DataFrame, revocations: DataFrame, now: Column) -> DataFrame:
    """Grants (principal, repo) without those revoked now; a revocation without a repository takes all."""
    live = revocations.where(F.col("expires_at") > now)
    every = live.where("repo is null").select("principal").distinct()
    return grants.join(live.where("repo is not null").select("principal", "repo"), ["principal", "repo"], "left_anti").join(every, "principal", "left_anti")
