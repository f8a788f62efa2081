"""Validators of found values: entropy, placeholders, names, card numbers and account numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What cannot be a real credential.
PLACEHOLDERS = [
    r"(?i)^(?:x{4,}|\*{4,}|\.{4,}|-{4,}|0{4,})$",
    r"(?i)\b(?:your|my|the)[_-]?(?:api)?[_-]?(?:key|token|secret|password)\b",
    r"(?i)^(?:changeme|placeholder|example|sample|dummy|fake|test|todo|redacted|none|null|undefined)$",
    r"^\$\{?[A-Z_][A-Z0-9_]*\}?$",
    r"^<[^>]+>$",
    r"^\{\{.*\}\}$",
    r"^%[A-Z_]+%$",
]
# Card schemes as (lengths, prefixes, ranges of the first digits).
CARDS = [
    ((13, 16, 19), ("4",), ()),
    ((16,), (), ((51, 55), (2221, 2720))),
    ((15,), ("34", "37"), ()),
    ((14,), ("3095", "36", "38", "39"), ((300, 305),)),
    ((16, 19), ("6011", "65"), ((644, 649), (622126, 622925))),
    ((16, 17, 18, 19), (), ((3528, 3589),)),
    ((16, 17, 18, 19), ("62",), ()),
]


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits a character; 0 for an empty value."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(letters)
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)))
    bits = F.aggregate(counts, F.lit(0.0), lambda s, c: s - (c / n) * F.log2(c / n))
    return F.when(n == 0, F.lit(0.0)).otherwise(bits)


def is_placeholder(value: Column) -> Column:
    v = F.trim(value)
    found = v == ""
    for pattern in PLACEHOLDERS:
        found = found | v.rlike(pattern)
    return found


def is_natural_name(value: Column) -> Column:
    """A word-like name: few digits, a run of six letters, at most three separators."""
    digits, seps = F.regexp_count(value, F.lit(r"\d")), F.regexp_count(value, F.lit(r"[_.\-]"))
    return value.rlike(r"^[A-Za-z][A-Za-z0-9_.\-]*$") & (digits / F.length(value) <= 0.15) & value.rlike("[A-Za-z]{6,}") & (seps <= 3)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def has_card_issuer(digits: Column) -> Column:
    """Whether length and first digits belong to one card scheme."""
    ok = F.lit(False)
    for lengths, prefixes, ranges in CARDS:
        head = F.lit(False)
        for p in prefixes:
            head = head | digits.startswith(p)
        for lo, hi in ranges:
            head = head | F.substring(digits, 1, len(str(lo))).try_cast("int").between(lo, hi)
        ok = ok | (F.length(digits).isin(*lengths) & head)
    return ok


def is_card_number(value: Column) -> Column:
    """13 to 19 digits of a card scheme whose doubled sum from the right is a multiple of 10."""
    d = _digits(value)
    each = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + x)
    return F.length(d).between(13, 19) & ~d.startswith("0") & has_card_issuer(d) & (total % 10 == 0)


def is_iban(value: Column) -> Column:
    """The account number read as digits, letters as 10 to 35, is 1 modulo 97."""
    moved = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    letters = F.filter(F.split(moved, ""), lambda c: c != "")
    as_number = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(letters, F.lit(0), lambda s, c: (s * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + as_number(c)) % 97)
    return rest == 1
