"""Hashes, ids, fingerprints and distances as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(text: Column, digits: int = 40) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def stable_id(prefix: str, *parts: Column, digits: int = 40) -> Column:
    """prefix and the start of a SHA-256 over the parts, one a line; a null part counts as empty."""
    joined = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), short_sha(joined, digits))


def canonical_json(value: Column) -> Column:
    """JSON with the keys of every level in order, of a struct, map or array, however nested.

    A variant keeps the fields of an object sorted, so no key order of the input is left.
    Nulls stay; a value over the size that a variant may have is an error.
    """
    return F.to_json(F.parse_json(F.to_json(value, {"ignoreNullFields": "false"})))


def canonical_text(text: Column) -> Column:
    """The same of a JSON text; null if it is none, or has a key twice."""
    return F.to_json(F.try_parse_json(text))


def content_hash(value: Column) -> Column:
    """SHA-256 of the canonical JSON: equal for all orders of fields and keys."""
    return F.sha2(canonical_json(value), 256)


def permission_hash(*lists: Column) -> Column:
    """32 hex digits that do not hang on the order inside the lists."""
    return short_sha(F.concat_ws("\n", *[F.array_join(F.array_sort(x), ",") for x in lists]), 32)


def normal_code(text: Column) -> Column:
    """Without line, block and hash comments, white space as one blank, lower case."""
    x = F.regexp_replace(text, r"//[^\n]*", " ")
    x = F.regexp_replace(x, r"(?s)/\*.*?\*/", " ")
    x = F.regexp_replace(x, r"#[^\n]*", " ")
    return F.trim(F.lower(F.regexp_replace(x, r"\s+", " ")))


def shingle_words(text: Column, size: int = 3) -> Column:
    """Runs of size words; a shorter text gives its words."""
    words = F.filter(F.split(text, " "), lambda w: w != "")

    def runs(ws: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(ws) - size + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(size)), " "))
        return F.when(F.size(ws) < size, ws).otherwise(made)

    # The words are bound to a lambda's variable, so that each run does not split the text again.
    return F.element_at(F.transform(F.array(words), runs), 1)


def hash64(text: Column) -> Column:
    """The first 8 bytes of the SHA-256, most significant first, as a signed long."""
    hexed = F.sha2(text, 256)
    high, low = (F.conv(F.substring(hexed, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def audit_hash(previous: Column, *fields: Column) -> Column:
    """The next link of a hash chain."""
    return F.sha2(F.concat_ws("\n", F.coalesce(previous, F.lit("")), *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)
