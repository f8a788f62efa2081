"""Text expressions: token estimates, token sets, identifiers, intents, names. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a token, on average.
CHARS_A_TOKEN = 3.5


def estimate_tokens(text: Column) -> Column:
    """Characters over 3.5, rounded up. Counts code points."""
    return F.ceil(F.length(text) / F.lit(CHARS_A_TOKEN)).cast("long")


def token_set(text: Column) -> Column:
    """Distinct lower-case runs of a-z, 0-9 and _ of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def trigrams(text: Column) -> Column:
    """Distinct letter triples of each word, with two blanks before it and one behind."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    framed = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    triples = F.transform(framed, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(triples))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


# Shapes of quoted spans and of camel, Pascal and snake case names.
QUOTED = r"[`'\"]([^`'\"]{2,80})[`'\"]"
NAME = r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*)\b"


def identifiers(query: Column) -> Column:
    """Quoted spans first, then names, each once, in order of appearance."""
    return F.array_distinct(F.concat(F.regexp_extract_all(query, F.lit(QUOTED), F.lit(1)), F.regexp_extract_all(query, F.lit(NAME), F.lit(1))))


# Words that tell an intent, tested in this order.
INTENTS = [
    ("why-rationale", r"\b(why|rationale|decision|chose|instead of|trade-?off|design)\b"),
    ("how-to-integrate", r"\b(how do i|how to|integrate|authenticate|get started|example|sdk|client|endpoint)\b"),
    ("cross-repo-call-path", r"\b(call|calls|calling|flow|end.to.end|which service|talks to|depends on|upstream|downstream)\b"),
]
ASKS_WHAT = r"\bwhat does .* do\b"
# By intent, the weights of the dense, lexical and symbol arm, and the corpora to search.
ARM_WEIGHTS = {
    "exact-identifier": (0.8, 1.2, 2.0, ["code", "spec"]),
    "cross-repo-call-path": (1.0, 1.0, 1.4, ["code", "spec", "infra"]),
    "why-rationale": (1.4, 0.8, 0.4, ["adr", "docs", "code"]),
    "how-to-integrate": (1.2, 1.0, 0.8, ["docs", "spec", "code"]),
    "conceptual": (1.2, 1.0, 0.8, ["docs", "code", "adr"]),
    "unanswerable": (1.0, 1.0, 1.0, ["code", "docs", "spec", "adr"]),
}
def arm_weights(spark) -> DataFrame:
    """(intent, arm, weight, corpora) as a table to join intents with."""
    rows = [(i, arm, float(w), corpora) for i, (*weights, corpora) in ARM_WEIGHTS.items() for arm, w in zip(("dense", "lexical", "symbol"), weights)]
    return spark.createDataFrame(rows, "intent string, arm string, weight double, corpora array<string>")


# Shapes of follow-ups that need the turn before them.
NEEDS_REWRITE = [
    r"(?i)^\s*(what about|how about|and|also|what if|why not|the same for)\b",
    r"(?i)\b(it|its|that|this|those|these|there|the (async|sync|other|same|latter|former) (one|version|variant))\b",
    r"(?i)^\s*(and|but|so|then)\b",
    r"^\s{0,4}\S{1,25}\s*\?\s*$",
]


def intent(query: Column) -> Column:
    """The first intent whose words occur, then exact-identifier for short or 'what does' questions with a name, else conceptual."""
    low = F.lower(query)
    short = (F.size(F.split(F.trim(query), r"\s+")) <= 6) | low.rlike(ASKS_WHAT)
    out = F.when(low.rlike(INTENTS[0][1]), INTENTS[0][0])
    for name, pattern in INTENTS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.when((F.size(identifiers(query)) > 0) & short, "exact-identifier").otherwise("conceptual")


def needs_rewrite(query: Column) -> Column:
    found = F.lit(False)
    for pattern in NEEDS_REWRITE:
        found = found | query.rlike(pattern)
    return found


def stitched(query: Column, last_user_turn: Column) -> Column:
    """The query behind the first 200 characters of the turn before it, if there is one."""
    return F.when(last_user_turn.isNull(), query).otherwise(F.concat(F.substring(last_user_turn, 1, 200), F.lit(" — "), query))


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical_remote(url: Column) -> Column:
    """host/path of a git remote: no scheme or user, no .git, dots and slashes at its end, colons as slashes, lower case."""
    x = F.regexp_replace(F.trim(url), r"^[a-zA-Z]+://", "")
    x = F.replace(F.regexp_replace(x, r"^(?:git@)?(?:[^@/]+@)?", ""), F.lit(":"), F.lit("/"))
    ends = lambda c: F.regexp_replace(c, r"[./]+$", "")
    return F.lower(ends(F.regexp_replace(ends(x), r"(?i)\.git$", "")))


def normal_path(path: Column) -> Column:
    """Forward slashes, no ./ in front and no slashes at the ends."""
    x = F.regexp_replace(path, r"\\", "/")
    return F.regexp_replace(F.regexp_replace(x, r"^(\./)+", ""), r"^/+|/+$", "")


def redacted(value: Column) -> Column:
    """First four and last two characters and the length; short values keep one character."""
    n = F.length(value)
    short = F.concat(F.substring(value, 1, 1), F.repeat(F.lit("*"), F.greatest(n - 1, F.lit(3))))
    return F.when(n <= 8, short).otherwise(F.concat(F.substring(value, 1, 4), F.lit("********"), F.substring(value, -2, 2), F.lit(" ("), n.cast("string"), F.lit(" chars)")))


# Extensions by language.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "cs": "csharp"}


def language_of(path: Column) -> Column:
    """The language of a path by its extension, null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: ``**/`` any directories, ``**`` anything, ``*`` and ``?`` inside a name."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out, i = "", 0
    while i < len(glob):
        key = next((k for k in parts if glob.startswith(k, i)), None)
        out += parts[key] if key else ("\\" + glob[i] if glob[i] in r"\.+^${}()|[]" else glob[i])
        i += len(key) if key else 1
    return f"(?i)^{out}$"
