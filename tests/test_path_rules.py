"""Ignore files and owners beside plain loops; canonical hashes; places over ranges."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.operators.tables import placed
from corpusloom.sources import rules

PATTERNS = ["*.log", "!keep.log", "/a/", "b", "b/", "a/b", "**/c.ts", "a/**", "!a/b/c.ts", "*.t?", "[ab].log", "[!a].log", "/c.ts", "# note", "", "\\#x", "a*", "*b*", "!*.ts", "d/**/c.ts"]
NAMES = ["a", "b", "d", "x"]
ENDS = ["c.ts", "keep.log", "a.log", "b.log", "#x", "abc", "b"]


def tree(rng):
    return sorted({"/".join([rng.choice(NAMES) for _ in range(rng.randrange(4))] + [rng.choice(ENDS)]) for _ in range(60)})


def one(pattern):
    """A matcher by a plain walk over the pattern's characters."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "[":
            end = pattern.index("]", i)
            out, i = out + pattern[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return re.compile(out, re.I)


def verdict(node, is_folder, files):
    parts = node.split("/")
    for k in range(len(parts) - 1, -1, -1):
        text = files.get("/".join(parts[:k]))
        said = None
        for line in (text or "").split("\n"):
            if not line or line[0] == "#":
                continue
            no, body = line[0] == "!", line.lstrip("!").removeprefix("\\")
            if body.endswith("/") and not is_folder:
                continue
            body = body.rstrip("/")
            against = parts[-1] if "/" not in body else "/".join(parts[k:])
            if one(body.lstrip("/")).fullmatch(against):
                said = not no
        if said is not None:
            return said
    return False


def ignored(path, files):
    parts = path.split("/")
    return any(verdict("/".join(parts[:k]), k < len(parts), files) for k in range(1, len(parts) + 1))


def test_ignore_files_of_all_folders(spark):
    rng = random.Random(5)
    paths, texts, want = [], [], []
    for t in range(12):  # each tree lies in a folder of its own
        files = {d: "\n".join(rng.choices(PATTERNS, k=4)) for d in ["", "a", "b", "a/b", "d"] if rng.random() < 0.7}
        made = tree(rng)
        paths += [(f"t{t}/{p}", len(p)) for p in made]
        texts += [(f"t{t}/{d}/.gitignore".replace("//", "/"), text) for d, text in files.items()]
        want += [f"t{t}/{p}" for p in made if not ignored(p, files)]
    x = spark.createDataFrame(paths + [(None, 1)], "path string, size int")
    found = rules.not_ignored(x, rules.rules_of(spark.createDataFrame(texts, "path string, text string")))
    assert sorted(r.path or "" for r in found.collect()) == sorted([*want, ""])
    none = spark.createDataFrame([], "path string, text string")
    assert rules.not_ignored(x, rules.rules_of(none)).count() == len(paths) + 1
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_owners_meet_rules_by_key(spark):
    rng = random.Random(3)
    shapes = ["/m{}/", "m{}/x", "*.e{}", "f{}.ts", "/m{}/*.ts", "n*{}", "*{}*", "d{}/"]
    lines = [f"{rng.choice(shapes).format(rng.randrange(300))} @o{k}" for k in range(1500)]
    paths = [("/".join([f"m{rng.randrange(300)}", rng.choice(["x", f"d{rng.randrange(300)}", "q"]), rng.choice([f"f{rng.randrange(300)}.ts", f"g.e{rng.randrange(300)}", f"n{rng.randrange(300)}"])]),) for _ in range(150)]
    want = {}
    for (p,) in paths:
        best = (-1, -1, [])
        for no, line in enumerate(lines):
            pattern, owner = line.split()
            body = pattern.strip("/")
            free = "/" not in body and pattern[0] != "/"
            starts = [p] if not free else ["/".join(p.split("/")[k:]) for k in range(p.count("/") + 1)]
            glob = body + ("/**" if pattern.endswith("/") else "")
            if any(one(g).fullmatch(s) for s in starts for g in (glob, glob + "/**")):
                best = max(best, (len(pattern), no, [owner]))
        want[p] = best[2]
    found = rules.owners(spark.createDataFrame(paths, "path string"), "\n".join(lines))
    assert {r.path: r.owners for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_hashes_do_not_hang_on_the_order_of_keys(spark):
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind < 4:
            return [None, rng.randrange(9), f"é\"{rng.randrange(9)}", True][kind]
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {f"k{n}": value(depth - 1) for n in rng.sample(range(20), rng.randrange(5))}

    def shuffled(v):
        if isinstance(v, dict):
            return {k: shuffled(v[k]) for k in rng.sample(list(v), len(v))}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    values = [value(4) for _ in range(80)]
    plain = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    rows = [(i, json.dumps(shuffled(v), ensure_ascii=False)) for i, v in enumerate(values)]
    got = spark.createDataFrame([*rows, (99, "{no"), (98, None)], "i int, t string").select("i", hashing.canonical_text(F.col("t")).alias("j"))
    assert {r.i: r.j for r in got.collect()} == {i: plain(v) for i, v in enumerate(values)} | {99: None, 98: None}
    one = F.struct(F.create_map(F.lit("z"), F.lit(1), F.lit("a"), F.lit(2)).alias("m"), F.array(F.struct(F.lit("x").alias("q"), F.lit(None).cast("string").alias("b"))).alias("l"))
    want = hashlib.sha256(b'{"l":[{"b":null,"q":"x"}],"m":{"a":2,"z":1}}').hexdigest()
    assert spark.range(1).select(hashing.content_hash(one)).first()[0] == want


def test_places_over_ranges(spark):
    x = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v"), (F.col("id") % 10).alias("g"))
    rows = sorted((r.v, r.place) for r in placed(x, F.desc("g"), F.asc("v")).collect())
    order = sorted(((r.v, r.g) for r in x.collect()), key=lambda r: (-r[1], r[0]))
    assert rows == sorted((v, k + 1) for k, (v, _) in enumerate(order))
    assert placed(x.where("v < 0"), "v").count() == 0
