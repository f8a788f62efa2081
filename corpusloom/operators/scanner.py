"""Secret, personal-data and instruction-injection scan, path policy, tiers and the publish gate."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import checks
from corpusloom.functions.text import glob_regex, redacted

#: Bytes of a file that is still indexed.
MOST_BYTES = 2 * 1024 * 1024


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    pattern: str
    group: int = 0
    least_entropy: float | None = None
    quiet_in_tests: bool = field(default=False)
    #: Texts in lower case of which every match has one, in whatever case; empty if there are none.
    needs: tuple[str, ...] = ()


# The rules, in the order in which findings are listed.
RULES = [
    Rule("aws-access-key-id", "secret", "critical", r"\b((?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16})\b", 1, needs=("akia", "asia", "abia", "acca")),
    Rule("aws-secret-access-key", "secret", "critical", r"(?i)aws[_.-]?(?:secret[_.-]?)?access[_.-]?key(?:[_.-]?id)?[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9/+=]{40})\b", 1, 3.5, needs=("aws",)),
    Rule("private-key-block", "secret", "critical", r"-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH|PGP|ENCRYPTED)?\s*PRIVATE KEY(?:\s+BLOCK)?-----", needs=("private key",)),
    Rule("github-token", "secret", "critical", r"\b((?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,})\b", 1, needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Rule("slack-token", "secret", "high", r"\b(xox[baprs]-[0-9A-Za-z-]{10,})\b", 1, needs=("xox",)),
    Rule("openai-key", "secret", "critical", r"\b((?:sk|sk-proj|sk-ant)-[A-Za-z0-9_-]{20,})\b", 1, needs=("sk-",)),
    Rule("google-api-key", "secret", "high", r"\b(AIza[0-9A-Za-z_-]{35})\b", 1, needs=("aiza",)),
    Rule("azure-storage-connection-string", "secret", "critical", r"DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=([A-Za-z0-9+/=]{40,})", 1, needs=("accountkey=",)),
    Rule("sql-connection-string", "secret", "critical", r"(?i)(?:Server|Data Source|Host)\s*=[^;]+;[^\n]*?(?:Password|Pwd)\s*=\s*([^;\"'\s]{6,})", 1, needs=("password", "pwd")),
    Rule("url-embedded-credentials", "secret", "high", r"(?i)\b(?:postgres|postgresql|mysql|mongodb|redis|amqp|https?)://[^\s:/@]+:([^\s@/]{6,})@", 1, needs=("://",)),
    Rule("jwt", "secret", "high", r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})\b", 1, None, True, needs=("eyj",)),
    Rule("stripe-key", "secret", "critical", r"\b((?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,})\b", 1, needs=("sk_", "rk_")),
    Rule("npm-token", "secret", "high", r"\b(npm_[A-Za-z0-9]{36})\b", 1, needs=("npm_",)),
    Rule("generic-assigned-secret", "secret", "high", r"(?i)\b(?:api[_-]?key|apikey|secret|password|passwd|token|credential|private[_-]?key|client[_-]?secret)\b[\"']?\s*[:=]\s*[\"']([^\"'\s]{16,})[\"']", 1, 3.5, True, needs=("api", "secret", "passw", "token", "credential", "private")),
    Rule("email-address", "pii", "medium", r"(?<![A-Za-z0-9._%+-])(?!(?:no-?reply|donotreply|do-not-reply)@)[A-Za-z0-9._%+-]+@(?!example\.|test\.|localhost)(?![A-Za-z0-9.-]*\bnoreply\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", needs=("@",)),
    Rule("credit-card", "pii", "critical", r"\b((?:\d[ -]?){13,19})\b", 1),
    Rule("us-ssn", "pii", "critical", r"\b(?!000|666|9\d\d)(\d{3})-(\d{2})-(\d{4})\b", needs=("-",)),
    Rule("iban", "pii", "high", r"\b([A-Z]{2}\d{2}[A-Z0-9]{11,30})\b", 1),
    Rule("phone-e164", "pii", "medium", r"(?<![\w.-])\+\d{1,3}[\s-]?\d{6,14}(?![\w.-])", needs=("+",)),
    Rule("instruction-override", "injection", "high", r"(?i)\b(?:ignore|disregard|forget|override)\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier|system)\s+(?:instructions?|prompts?|rules?|messages?)\b", needs=("ignore", "disregard", "forget", "override")),
    Rule("role-assertion", "injection", "high", r"(?im)^\s*(?:system|developer|assistant)\s*[:>]\s*you\s+(?:are|must|should|will)\b", needs=("system", "developer", "assistant")),
    Rule("exfiltration-directive", "injection", "high", r"(?i)\b(?:list|enumerate|reveal|disclose|print|output|dump)\s+(?:all\s+|every\s+)?(?:repositor|secret|credential|api[_ -]?key|token|environment variable|password)", needs=("repositor", "secret", "credential", "api", "token", "environment variable", "password")),
    Rule("tool-coercion", "injection", "high", r"(?i)\b(?:call|invoke|use)\s+the\s+\w+\s+tool\b|\bset\s+scope\s+to\s+(?:org|all|everything)\b", needs=("tool", "scope")),
    Rule("hidden-unicode-directive", "injection", "high", "[\u200b-\u200f\u202a-\u202e\u2066-\u2069]"),
]
# Test folders; paths that are never read; paths not worth reading; generated files.
TEST_PATH = r"(?i)(^|/)(test|tests|spec|__tests__|fixtures?|testdata)(/|$)"
DENIED_PATHS = [
    r"(?i)(^|/)\.env(\..*)?$",
    r"(?i)(^|/)\.env\.[^/]*$",
    r"(?i)\.(pem|pfx|p12|key|keystore|jks|ppk|asc|gpg)$",
    r"(?i)(^|/)(secrets?|credentials?|private)(/|$)",
    r"(^|/)id_(rsa|dsa|ecdsa|ed25519)(\.pub)?$",
    r"(^|/)\.npmrc$",
    r"(^|/)\.pypirc$",
    r"(^|/)\.netrc$",
    r"(?i)(^|/)appsettings\.(local|development|secrets)\.json$",
    r"(?i)(^|/)local\.settings\.json$",
    r"(^|/)\.aws(/|$)",
    r"(^|/)\.ssh(/|$)",
    r"(^|/)\.docker(/config\.json)?$",
    r"(?i)(^|/)kubeconfig$",
    r"(?i)\.(sqlite3?|db|mdb|bak|dump|sql\.gz)$",
]
SKIPPED_PATHS = [
    r"(^|/)(node_modules|\.git|dist|build|out|bin|obj|target|\.next|\.turbo|coverage|__pycache__|\.venv|venv)(/|$)",
    r"(?i)\.(png|jpe?g|gif|webp|svg|ico|bmp|tiff?|mp4|mov|avi|webm|mp3|wav|ogg|woff2?|ttf|eot|otf)$",
    r"(?i)\.(zip|tar|gz|bz2|xz|7z|rar|jar|war|nupkg|whl|dll|exe|so|dylib|pdb|wasm)$",
    r"(?i)\.(lock|lockb)$",
    r"(^|/)(pnpm-lock\.yaml|package-lock\.json|yarn\.lock|poetry\.lock|Cargo\.lock|packages\.lock\.json)$",
    r"(?i)\.min\.(js|css)$",
    r"(?i)\.map$",
]
GENERATED_PATHS = [r"\.openapi-generator/", r"(?i)\.g\.cs$", r"(?i)\.designer\.cs$", r"_pb2(_grpc)?\.py$", r"\.pb\.go$", r"\.generated\.[tj]sx?$", r"(^|/)generated(/|$)", r"(^|/)__generated__(/|$)", r"\.d\.ts$"]
SEVERITIES = ["critical", "high", "medium"]
TIERS = ["public", "internal", "confidential", "restricted"]
MARKERS = r"(?i)^(sensitive|confidential|restricted|internalonly|pii)$"


def any_match(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(p)
    return found


def readable_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is neither denied nor skipped."""
    return files.where(~any_match(F.col(path), DENIED_PATHS) & ~any_match(F.col(path), SKIPPED_PATHS))


def rank(value: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), value)


def _passes(rule: Rule, value: Column) -> Column:
    """What a match of the rule must stand, in the order of the checks."""
    ok = F.lit(True)
    if rule.category == "secret":
        ok = ok & ~checks.is_placeholder(value)
    if rule.least_entropy is not None:
        ok = ok & ~checks.is_natural_name(value) & (checks.entropy(value) >= rule.least_entropy)
    if rule.id == "credit-card":
        ok = ok & checks.is_card_number(value)
    if rule.id == "iban":
        ok = ok & checks.is_iban(value)
    return ok


_MATCH = "array<struct<rule_no:int,nth:int,value:string,step:int,length:int,lines:int,tail:int,inner:int,end:int>>"


def _may_match(rule: Rule, text: Column, low: Column) -> Column:
    """Whether the rule matches; texts without what a match needs are told by a plain search, which costs far less than the pattern."""
    found = text.rlike(rule.pattern)
    return reduce(or_, [low.contains(n) for n in rule.needs]) & found if rule.needs else found


def _matches(rule_no: int, rule: Rule, text: Column, low: Column) -> Column:
    """Each match of a rule, with what a running sum needs to place it.

    step and length are the characters from the match before and of the match itself;
    lines and inner the line ends in both, tail and end the characters behind the last of
    them. The text between matches is split off by the same pattern. That is only worked
    out for texts with a match, and costs time in proportion to the text.
    """
    wholes = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    tail = lambda c: F.length(F.substring_index(c, "\n", -1))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(wholes))

    def made(x: Column, nth: Column) -> Column:
        w, v, gap = x["w"], x["v"], x["b"]
        value = F.when(v == "", w).otherwise(v)
        return F.struct(F.lit(rule_no).alias("rule_no"), nth.alias("nth"), value.alias("value"), F.length(gap).alias("step"), F.length(w).alias("length"), ends(gap).alias("lines"), tail(gap).alias("tail"), ends(w).alias("inner"), tail(w).alias("end"))

    zipped = F.arrays_zip(wholes.alias("w"), values.alias("v"), between.alias("b"))
    return F.when(_may_match(rule, text, low), F.transform(zipped, made)).otherwise(F.array().cast(_MATCH))


def _placed(rows: DataFrame) -> DataFrame:
    """Matches with at (characters before it), line and column, by running sums over a text's matches of a rule; _text names the text."""
    before = Window.partitionBy("_text", "rule_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(before)
    rows = rows.withColumn("at", run(F.col("step") + F.col("length")) - F.col("length")).withColumn("line", run(F.col("lines") + F.col("inner")) - F.col("inner") + 1)
    # Where the line starts: behind the last line end of the gaps up to here and of the matches before.
    gap = F.when(F.col("lines") > 0, F.col("at") - F.col("tail"))
    own = F.when(F.col("inner") > 0, F.col("at") + F.col("length") - F.col("end"))
    rows = rows.withColumns({"_gap": gap, "_own": own})
    earlier = Window.partitionBy("_text", "rule_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.max("_gap").over(before), F.max("_own").over(earlier), F.lit(0))
    return rows.withColumn("column", F.col("at") - start + 1)


def scan(files: DataFrame, key: str, path: Column, text: str, rules: list[Rule] | None = None, allow: list[tuple[str, str]] | None = None, most: int | None = None) -> DataFrame:
    """Findings of all rules: key, path, rule, category, severity, line, column, preview, suppressed.

    One pass over the texts: each rule's matches become an array of its own, and one
    explode lists them. Every finding of every text is given; ``most`` bounds what is listed
    of a file, in rule order, then by place, and is not for use before a gate. Rules that
    are quiet in test folders find nothing there. allow: (path glob, rule id) pairs whose
    findings stay, suppressed.
    """
    rules = rules or RULES
    base = files.where(F.col(text).isNotNull()).select(F.col(key), path.alias("_path"), F.col(text).alias("_text"), F.lower(text).alias("_low"))
    found = []
    for i, r in enumerate(rules):
        values = _matches(i, r, F.col("_text"), F.col("_low"))
        if r.quiet_in_tests:
            values = F.when(F.coalesce(F.col("_path").rlike(TEST_PATH), F.lit(False)), F.array().cast(_MATCH)).otherwise(values)
        found.append(values)
    # From here on a text is a number, not carried along. The outer form keeps the optimizer
    # from a filter on the array's size, for which it would match every rule twice more.
    rows = _placed(base.select(key, "_path", F.monotonically_increasing_id().alias("_text"), F.concat(*found).alias("ms")).select(key, "_path", "_text", F.inline_outer("ms")).where("rule_no is not null"))
    ok = F.lit(False)
    for i, r in enumerate(rules):
        ok = ok | ((F.col("rule_no") == i) & _passes(r, F.col("value")))
    rows = rows.where(ok)
    name = lambda f: F.element_at(F.array(*[F.lit(getattr(r, f)) for r in rules]), F.col("rule_no") + 1)
    named = [key] if key == "path" else [key, "path"]
    rows = rows.select(*[F.col(key) if c == key else F.col("_path").alias(c) for c in named], "rule_no", "at", name("id").alias("rule"), name("category").alias("category"), name("severity").alias("severity"), F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), redacted(F.col("value")).alias("preview"))
    if most is not None:
        order = Window.partitionBy(key).orderBy("rule_no", "at")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    hidden = F.lit(False)
    for glob, rule in allow or []:
        hidden = hidden | (F.col("path").rlike(glob_regex(glob)) & (F.col("rule") == rule))
    return rows.select(*named, "rule", "category", "severity", "line", "column", "preview", F.coalesce(hidden, F.lit(False)).alias("suppressed"))


def custom_rules(patterns: list[tuple[str, str, str]]) -> list[Rule]:
    """The rules and a repository's own secret patterns (id, pattern, severity) behind them."""
    return [*RULES, *[Rule(name, "secret", severity, pattern) for name, pattern, severity in patterns]]


def skipped_files(files: DataFrame, key: str, path: Column, text: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """key and reason of files that are not indexed: denied-path, binary-or-generated, or too-large."""
    reason = F.when(any_match(path, DENIED_PATHS), "denied-path").when(any_match(path, SKIPPED_PATHS), "binary-or-generated").when(F.octet_length(text) > most_bytes, "too-large")
    return files.select(F.col(key), reason.alias("reason")).where("reason is not null")


def gate(findings: DataFrame) -> DataFrame:
    """One row: counts by category, and whether no open secret or personal data is left. Give it all findings."""
    open_ = ~F.col("suppressed")
    count = lambda c: F.count_if(open_ & (F.col("category") == c)).alias(f"n_{c}")
    return findings.agg(F.count("*").alias("n_all"), count("secret"), count("pii"), count("injection"), F.count_if(F.col("suppressed")).alias("n_suppressed")).withColumn("passed", (F.col("n_secret") == 0) & (F.col("n_pii") == 0))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings in report order: severity, path, line, column, rule."""
    return findings.orderBy(rank(F.col("severity"), SEVERITIES), "path", "line", "column", "rule")


def annotations(findings: DataFrame) -> DataFrame:
    """findings with ``annotation``, a workflow command that marks the place in a change."""
    level = F.when(F.col("category") == "injection", "warning").otherwise("error")
    return findings.withColumn("annotation", F.format_string("::%s file=%s,line=%d,col=%d,title=%s::%s (%s)", level, "path", "line", "column", "rule", "category", "preview"))


def ruleset_hash(rules: list[Rule] | None = None) -> str:
    """32 hex digits that change with any rule's pattern or entropy, and not with their order."""
    lines = sorted(f"{r.id}:{r.pattern}:{'' if r.least_entropy is None else r.least_entropy}" for r in rules or RULES)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:32]


def visible_to(content: Column, clearance: Column) -> Column:
    """Whether content of a tier may be seen with a clearance; restricted never."""
    return (rank(content, TIERS) <= rank(clearance, TIERS)) & (content != "restricted")


def embeddable(content: Column) -> Column:
    """Whether content of a tier may be embedded: all but restricted."""
    return F.coalesce(content != "restricted", F.lit(False))


def is_downgrade(before: Column, after: Column) -> Column:
    """Whether the tier falls."""
    return rank(after, TIERS) < rank(before, TIERS)


def tier(default: Column, raised: list[Column], markers: Column, configured: Column) -> Column:
    """The highest of the default, the rules' tiers, confidential for marked code, and the configured tier. public never rises from rules."""
    marked = F.exists(F.coalesce(markers, F.array().cast("array<string>")), lambda m: F.regexp_replace(m, r"[\[\]()@]", "").rlike(MARKERS))
    ranks = [rank(default, TIERS), *[F.coalesce(rank(r, TIERS), F.lit(0)) for r in raised], F.when(marked, 3).otherwise(0), F.coalesce(rank(configured, TIERS), F.lit(0))]
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.greatest(*ranks).cast("int"))
