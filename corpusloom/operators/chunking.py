"""Documents and declarations into retrieval units."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ids import document_chunk_id
from corpusloom.functions.text import estimate_tokens

MOST_TOKENS, OVERLAP_TOKENS, LEAST_ROOM = 900, 60, 80
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")


def sections(markdown: str, title: str) -> list[tuple[str, int, str, int, int]]:
    """(heading, level, content, first line, last line) by headings outside of fences; sections without content are left out."""
    out, body, fence = [], [], ""
    heading, level, start = title, 1, 1
    lines = markdown.replace("\r\n", "\n").split("\n")

    def close(end: int) -> None:
        content = "\n".join(body).strip()
        if content:
            out.append((heading, level, content, start, end))
        body.clear()

    for no, line in enumerate(lines):
        mark = _FENCE.match(line)
        if mark:
            fence = mark[1][0] if not fence else "" if mark[1][0] == fence else fence
        head = None if fence or mark else _HEADING.match(line)
        if head is None:
            body.append(line)
            continue
        close(no)
        heading, level, start = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"[*_`]", "", head[2])).strip(), len(head[1]), no + 2
    close(len(lines))
    return out


def tokens_of(text: str) -> int:
    return math.ceil(len(text) / 3.5)


def pieces(text: str, budget: int, overlap: int = OVERLAP_TOKENS) -> list[str]:
    """Paragraphs packed up to the budget, each piece starting with the last ones of the piece before that fit the overlap.

    A paragraph over the budget is cut into windows of words on its own.
    """
    if tokens_of(text) <= budget:
        return [text.strip()] if text.strip() else []
    out: list[str] = []
    held: list[str] = []
    for p in (x.strip() for x in re.split(r"\n{2,}", text)):
        if not p:
            continue
        n = tokens_of(p)
        if held and (n > budget or sum(map(tokens_of, held)) + n > budget):
            out.append("\n\n".join(held))
            tail: list[str] = []
            for q in reversed(held):
                if sum(map(tokens_of, tail)) + tokens_of(q) > overlap:
                    break
                tail.insert(0, q)
            held = tail
        if n > budget:
            words, size = p.split(), max(int(budget * 0.7), 40)
            out += [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
            continue
        held.append(p)
    if held:
        out.append("\n\n".join(held))
    return out


def chunk_documents(docs: DataFrame, item: str = "doc_id", title: Column | None = None, text: str = "text", source: str = "document", markdown: bool = True, budget: int = MOST_TOKENS) -> DataFrame:
    """item, ordinal, heading, first_line, last_line, content, tokens, chunk_id.

    Each document is cut in the task that reads it; nothing is shuffled.
    """
    kind = dict(docs.dtypes)[item]
    base = docs.select(F.col(item), (title if title is not None else F.col(item).cast("string")).alias("title"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, name, body in pdf.itertuples(index=False, name=None):
                found = sections(body, name) if markdown else [(name, 1, body, 1, body.count("\n") + 1)]
                n = 0
                for heading, _, content, a, b in found:
                    head = f"Document: {name}\nSection: {heading}\nSource: {source}"
                    for piece in pieces(content, max(budget - tokens_of(head), LEAST_ROOM)):
                        rows.append((i, n, heading, a, b, f"{head}\n\n{piece}"))
                        n += 1
            yield pd.DataFrame(rows, columns=[item, "ordinal", "heading", "first_line", "last_line", "content"])

    out = base.mapInPandas(run, f"{item} {kind}, ordinal int, heading string, first_line int, last_line int, content string")
    return out.withColumn("tokens", estimate_tokens(F.col("content"))).withColumn("chunk_id", document_chunk_id(F.col(item), F.col("ordinal"), F.sha2("content", 256)))


def eligible(symbols: DataFrame) -> DataFrame:
    """Symbols worth a chunk: not restricted, no enum members, no fields or properties without documentation."""
    bare = F.col("kind").isin("field", "property") & (F.coalesce(F.trim("doc"), F.lit("")) == "")
    return symbols.where((F.col("sensitivity") != "restricted") & (F.col("kind") != "enum-member") & ~bare)


def symbol_header(module: Column, name: Column, kind: Column, path: Column) -> Column:
    return F.concat(F.lit("// "), kind, F.lit(" "), name, F.lit("\n// Module: "), module, F.lit("\n// Source: "), path)


def chunk_symbols(symbols: DataFrame, budget: int = MOST_TOKENS, item: str = "symbol_id") -> DataFrame:
    """item, ordinal, content, tokens of symbols (module, name, kind, path, body): a header and as many lines as fit, chunk by chunk.

    A line that is over the budget alone is cut into windows of characters. The fold over
    a symbol's lines is sequential, so it runs in the task that holds the symbol.
    """
    if budget < 128:
        raise ValueError("a chunk needs at least 128 tokens")
    kind = dict(symbols.dtypes)[item]
    base = symbols.select(item, symbol_header(F.col("module"), F.col("name"), F.col("kind"), F.col("path")).alias("head"), F.coalesce("body", F.lit("")).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, head, body in pdf.itertuples(index=False, name=None):
                room = max(int((budget - tokens_of(head)) * 3.5) - 2, 256)
                held, size, parts = [], 0, []
                for line in body.split("\n"):
                    for at in range(0, max(len(line), 1), room):
                        part = line[at : at + room]
                        if held and size + len(part) + 1 > room:
                            parts.append("\n".join(held))
                            held, size = [], 0
                        held.append(part)
                        size += len(part) + 1
                parts.append("\n".join(held))
                rows += [(i, n, f"{head}\n\n{p}") for n, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[item, "ordinal", "content"])

    return base.mapInPandas(run, f"{item} {kind}, ordinal int, content string").withColumn("tokens", estimate_tokens(F.col("content")))
