"""Ids of repositories, modules, symbols, documents and their parts, as expressions.

An id is a prefix and the start of a SHA-256 over what names the thing, one part a line.
Null parts count as empty, so every row has an id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.hashing import stable_id
from corpusloom.functions.text import canonical_remote, normal_path

# Fixed value: the version that ids of modules and symbols carry.
VERSION = "v2"


def repository_id(org: Column, remote: Column) -> Column:
    """Of a repository by its remote, however that is written."""
    return stable_id("repo_", org, canonical_remote(remote), digits=32)


def module_key(repository: Column, path: Column, ecosystem: Column, package: Column) -> Column:
    """What names a module: its package where it has one, else where it lies."""
    named = (F.coalesce(package, F.lit("")) != "") & (F.coalesce(ecosystem, F.lit("none")) != "none")
    return F.when(named, F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), package)).otherwise(F.concat(F.lit("path:"), F.coalesce(repository, F.lit("")), F.lit("/"), normal_path(F.coalesce(path, F.lit("")))))


def module_id(org: Column, key: Column) -> Column:
    return stable_id("mod_", F.lit(VERSION), org, key, digits=32)


def symbol_id(org: Column, key: Column, language: Column, kind: Column, name: Column, overload: Column) -> Column:
    """Of a symbol by its module's key and qualified name; overload tells symbols of one name apart."""
    return stable_id("sym_", F.lit(VERSION), org, key, language, kind, name, overload)


def chunk_id(symbol: Column, ordinal: Column, content_hash: Column) -> Column:
    return stable_id("chk_", symbol, ordinal, content_hash)


def document_id(org: Column, repository: Column, path: Column) -> Column:
    """Of a Markdown file of a repository."""
    return stable_id("doc_", org, repository, F.lit("repo-markdown"), path, digits=32)


def document_chunk_id(document: Column, ordinal: Column, content_hash: Column) -> Column:
    return stable_id("dch_", document, ordinal, content_hash, digits=32)


def source_id(org: Column, kind: Column, instance: Column) -> Column:
    """Of a source that documents come from."""
    return stable_id("dsrc_", org, kind, instance, digits=32)


def association_id(org: Column, document: Column, repository: Column, project: Column, module: Column, symbol: Column, kind: Column) -> Column:
    """Of what a document is about: any of a repository, project, module and symbol."""
    return stable_id("das_", org, document, repository, project, module, symbol, kind, digits=32)
