"""Symbols into retrieval units: a header, a block of facts, the source, cut to a budget of tokens."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import stable_id
from corpusloom.functions.text import CHARS_A_TOKEN, estimate_tokens

# Budget and overlap in tokens, and what the mark of a part may take.
MOST_TOKENS, OVERLAP_TOKENS, MARK_TOKENS = 1200, 80, 12
#: A smaller budget could leave no room beside a header of half of it.
LEAST_BUDGET = 152
_ENDS = re.compile(r"[;}]\s*$")


def _sums(lines: list[str]) -> np.ndarray:
    """Tokens of the lines before each line, and of all."""
    return np.concatenate([[0], np.cumsum([math.ceil(len(x) / CHARS_A_TOKEN) for x in lines])])


def statement_pieces(text: str, budget: int, overlap: int) -> list[str]:
    """Runs of lines that reach the budget and end a statement outside of brackets.

    Each run but the first starts with the last lines of the one before that make up the
    overlap; the lines behind the last cut, overlap included, are a run too.
    """
    lines = text.split("\n")
    before = _sums(lines)
    depth = np.cumsum([sum(map(x.count, "{([")) - sum(map(x.count, "})]")) for x in lines])
    ends = np.array([k for k, x in enumerate(lines) if depth[k] <= 0 and _ENDS.search(x)], dtype=np.int64)
    out, start, fresh = [], 0, 0
    while True:
        full = int(np.searchsorted(before, before[start] + budget)) - 1
        k = int(np.searchsorted(ends, max(full, fresh)))
        if k == len(ends):
            break
        fresh = int(ends[k]) + 1
        out.append("\n".join(lines[start:fresh]))
        start = max(start, int(np.searchsorted(before[: fresh + 1], before[fresh] - overlap, "right")) - 1)
    return out + (["\n".join(lines[start:])] if start < len(lines) else [])


def line_pieces(text: str, budget: int) -> list[str]:
    """As many whole lines as fit, at least one."""
    lines = text.split("\n")
    before, out, start = _sums(lines), [], 0
    while start < len(lines):
        stop = max(int(np.searchsorted(before, before[start] + budget, "right")) - 1, start + 1)
        out.append("\n".join(lines[start:stop]))
        start = stop
    return out


def budget_pieces(text: str, budget: int, overlap: int) -> list[str]:
    """Pieces that all fit the budget: by statements, what is too long by lines, and what still is by characters."""
    fits = lambda x: math.ceil(len(x) / CHARS_A_TOKEN) <= budget
    size = int(budget * CHARS_A_TOKEN * 0.9)
    out = []
    for run in statement_pieces(text, budget, overlap):
        for part in [run] if fits(run) else line_pieces(run, budget):
            out += [part] if fits(part) else [part[k : k + size] for k in range(0, len(part), size)]
    return out


def _full(c: Column) -> Column:
    """Null for an empty text, so that it joins with nothing."""
    return F.nullif(c, F.lit(""))


def _listed(title: str, column: str, line) -> Column:
    return F.when(F.size(column) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(column, line), "\n")))


def header() -> Column:
    """What a piece belongs to: module, file, declaring scope, kind, a hedge for shallow analysis, the cached blurb."""
    scope = F.when(F.col("parent_id").isNotNull(), _full(F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("// Module: "), "module", F.coalesce(F.concat(F.lit(" ("), _full(F.col("package")), F.lit(")")), F.lit(""))),
        F.concat(F.lit("// File: "), "path"),
        F.concat(F.lit("// Declared in: "), scope),
        F.concat(F.lit("// Kind: "), "visibility", F.lit(" "), "kind"),
        F.when(F.col("depth") == "shallow", F.lit("// Analysis: shallow — signature as written, types not resolved")),
        F.concat(F.lit("// Context: "), F.trim(F.regexp_replace(_full(F.col("blurb")), r"\s+", " "))),
    )


def facts() -> Column:
    """What the analysers found: name, signature, documentation, parameters, results, errors, binding, attributes."""
    said = lambda c: F.coalesce(F.concat(F.lit(" — "), _full(c)), F.lit(""))
    http = F.col("http")
    return F.concat_ws(
        "\n",
        _full(F.col("qualified_name")),
        _full(F.col("signature")),
        F.concat(F.lit("\n"), _full(F.col("summary"))),
        _full(F.col("description")),
        _listed("Parameters", "parameters", lambda p: F.concat(F.lit("  "), p["name"], F.when(p["optional"], "?").otherwise(""), F.lit(": "), F.coalesce(p["type"], F.lit("unknown")), said(p["description"]))),
        F.concat(F.lit("\nReturns: "), F.col("return_type"), said(F.col("returns"))),
        _listed("Throws", "throws", lambda t: F.concat(F.lit("  "), t["type"], F.lit(": "), F.coalesce(t["description"], F.lit("")))),
        F.concat(F.lit("\nDEPRECATED: "), F.when(F.col("deprecated") == "", "no reason given").otherwise(F.col("deprecated"))),
        F.concat(F.lit("\nHTTP: "), http["method"], F.lit(" "), http["route"]),
        F.concat(F.lit("operationId: "), _full(http["operation_id"])),
        F.when(F.size(http["schemes"]) > 0, F.concat(F.lit("Auth: "), F.array_join(http["schemes"], ", "))),
        F.when(F.size(http["responses"]) > 0, F.concat(F.lit("Responses: "), F.array_join(F.transform(http["responses"], lambda r: F.trim(F.concat_ws(" ", r["status"], r["description"]))), "; "))),
        F.when(F.size("decorators") > 0, F.concat(F.lit("\nAttributes: "), F.array_join("decorators", " "))),
    )


def symbol_chunks(symbols: DataFrame, budget: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS, item: str = "symbol_id") -> DataFrame:
    """item, ordinal, corpus, content, tokens, content_hash, chunk_id of symbols; nothing is shuffled.

    symbols: item, module, package, path, qualified_name, parent_id, visibility, kind, depth,
    blurb, signature, summary, description, parameters, return_type, returns, throws,
    deprecated, http, decorators, source_text. A symbol within the budget is one chunk. Of a
    longer one every piece fits: it has header and facts in front if they take at most half
    the budget, else the header alone, else nothing, and what is not in front is cut too.
    Null sources, empty lists and null bindings add nothing.
    """
    if budget < LEAST_BUDGET:
        raise ValueError(f"a chunk needs at least {LEAST_BUDGET} tokens")
    body = F.concat_ws("\n\n", _full(F.col("_facts")), _full(F.col("source_text")))
    x = symbols.select(item, "source_text", header().alias("_head"), facts().alias("_facts"), F.when(F.col("http").isNotNull(), "spec").otherwise("code").alias("corpus"))
    x = x.withColumn("_body", body).withColumn("_whole", F.concat_ws("\n\n", _full(F.col("_head")), _full(F.col("_body"))))
    both, half = F.concat_ws("\n\n", _full(F.col("_head")), _full(F.col("_facts"))), budget // 2
    with_facts = _full(F.col("source_text")).isNotNull() & (estimate_tokens(both) <= half)
    with_head = estimate_tokens(F.col("_head")) <= half
    x = x.withColumn("_front", F.when(with_facts, both).when(with_head, F.col("_head")).otherwise(""))
    x = x.withColumn("_rest", F.when(estimate_tokens(F.col("_whole")) > budget, F.when(with_facts, F.col("source_text")).when(with_head, F.col("_body")).otherwise(F.col("_whole"))))
    room = (F.lit(budget - MARK_TOKENS) - estimate_tokens(F.col("_front"))).cast("int")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, rooms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else budget_pieces(t, int(r), overlap) for t, r in zip(texts, rooms)], dtype=object)

    x = x.withColumn("_parts", cut("_rest", room))
    mark = lambda p, k: F.concat_ws("\n\n", _full(F.col("_front")), F.concat(F.lit("// part "), (k + 1).cast("string"), F.lit(" of "), F.size("_parts").cast("string"), F.lit("\n"), p))
    made = F.when(F.col("_parts").isNull(), F.array("_whole")).otherwise(F.transform("_parts", mark))
    out = x.select(item, "corpus", F.posexplode(made).alias("ordinal", "content"))
    out = out.withColumn("tokens", estimate_tokens(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))
    return out.withColumn("chunk_id", stable_id("chk_", F.col(item), F.col("ordinal"), F.col("content_hash")))
