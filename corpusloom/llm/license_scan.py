"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, maybe_broadcast

# Short grants and notices of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may obtain a copy of the License at apache.org licenses LICENSE-2.0",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "GPL-2.0": "This program is free software under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted. Use of this source code is governed by a BSD-style 3-clause license",
    "BSD-2-Clause": "Licensed under the simplified BSD 2-clause license",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted. ISC License",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential. Unauthorized copying is prohibited",
}
# Whole texts of the short licences, without their copyright lines.
FILES = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
        'deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or '
        'sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above '
        'copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", '
        'WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        'NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF '
        'CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. '
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above '
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        'TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, '
        'INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE '
        'OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE. '
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. '
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in '
        'binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. '
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        'IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE '
        'LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE '
        'GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT '
        'LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH '
        'DAMAGE. '
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. '
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in '
        'binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. '
        '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software '
        'without specific prior written permission. '
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        'IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE '
        'LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE '
        'GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT '
        'LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH '
        'DAMAGE. '
    ),
    "Unlicense": (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute '
        'this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions '
        'that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We '
        'make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt '
        'act of relinquishment in perpetuity of all present and future rights to this software under copyright law. '
    ),
}
#: Cosine from which a whole file is the text of a licence.
FILE_COSINE = 0.8
#: Cosine from which a line counts as a statement, and the higher one for the best of many windows.
LEAST_COSINE, WINDOW_COSINE = 0.5, 0.7
#: Share of a file's words in its statements from which the file is a licence file.
FILE_SHARE = 0.2
#: Template sentences of fewer words go with the one before or behind: "Copyright" alone states nothing.
LEAST_WORDS = 4
#: Words on either side of a found term that windows and lines are read from; more than any template sentence has.
REACH = 40
#: The tag that names a licence outright; it counts as one term, so its cosine to its own licence is 1.
SPDX = r"(?i)spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)"
#: Words of any English text: they have the least idf, that of a term in every sentence.
COMMON = "the of and to in a is for as with by this that are you at or any may it not under all can from be".split()
#: Words of any statement: neither these nor numbers tell one licence from another.
GENERIC = ["license", "version", "v"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = "[a-z0-9]+"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({_TERM})"), F.lit(1))


def _parts(text: str) -> list[str]:
    """A template's sentences, those of under LEAST_WORDS words joined to a neighbour."""
    out: list[str] = []
    for part in text.split(". "):
        if out and min(len(re.findall(_TERM, x.lower())) for x in (out[-1], part)) < LEAST_WORDS:
            out[-1] += ". " + part
        else:
            out.append(part)
    return out


def template_weights() -> tuple[list[tuple], dict[str, float], float]:
    """Rows (licence, term, size, weights) to join on, the idf of each term, and that of terms that no template has.

    Each sentence of a template is a vector of length 1; its weights are a map, its size is
    in words. The sentences are the collection that idf is counted over, so a span's score
    hangs on the span alone.

    A span of cosine c shares terms that hold c squared of the sentence's squared weights at
    least. So the terms left out here, common words first and less than LEAST_COSINE squared
    in all, never make a span alone, and a join on the others loses none.
    """
    parts = [(name, re.findall(_TERM, part.lower())) for name, text in TEMPLATES.items() for part in _parts(text)]
    df = Counter(t for _, words in parts for t in set(words))
    idf = {t: 1.0 if t in COMMON else math.log((len(parts) + 1) / (n + 1)) + 1 for t, n in df.items()}
    rows = []
    for name, words in parts:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in Counter(words).items()))
        weights = {t: n * idf[t] / norm for t, n in Counter(words).items()}
        gone = 0.0
        for t in sorted(weights, key=lambda t: (t not in COMMON, weights[t], t)):
            if gone + weights[t] ** 2 < LEAST_COSINE**2 - 1e-9:
                gone += weights[t] ** 2
            else:
                rows.append((name, t, len(words), weights))
    return rows, idf, math.log(len(parts) + 1) + 1


def file_weights() -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """Rows (licence, term, weight) of the whole texts as vectors of length 1, the idf of their terms, and that of other terms."""
    counts = {name: Counter(re.findall(_TERM, text.lower())) for name, text in FILES.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: 1.0 if t in COMMON else math.log((len(counts) + 1) / (n + 1)) + 1 for t, n in df.items()}
    rows = []
    for name, c in counts.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, t, n * idf[t] / norm) for t, n in c.items()]
    return rows, idf, math.log(len(counts) + 1) + 1


def whole_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """id, path, licence and score of the files in found whose whole text is that of a licence.

    A text of a licence holds statements of it, so only files with a statement are cut into
    terms; terms are counted by file and joined to those of the templates. Words of other
    kinds lengthen the file's vector and lower its cosine.
    """
    spark = files.sparkSession
    rows, idf, unseen = file_weights()
    ids = materialize(found.select(F.col("id").alias("fid"), F.col("path").alias("fpath")).distinct(), "licence-files")
    same = F.col("id").eqNullSafe(F.col("fid")) & F.col("path").eqNullSafe(F.col("fpath"))
    held = files.join(maybe_broadcast(ids, ids.count(), 120), same, "left_semi").distinct()
    terms = held.select("id", "path", F.explode(_terms(F.col("text"))).alias("term")).groupBy("id", "path", "term").agg(F.count("*").alias("n"))
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    weighed = materialize(terms.join(known, "term", "left").withColumn("v", F.col("n") * F.coalesce("idf", F.lit(unseen))).drop("idf", "n"), "licence-terms")
    norm = weighed.groupBy("id", "path").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).alias("m")
    templates = F.broadcast(spark.createDataFrame(rows, "licence string, term string, weight double"))
    dots = weighed.join(templates, "term").groupBy("id", "path", "licence").agg(F.sum(F.col("v") * F.col("weight")).alias("dot")).alias("d")
    both = dots.join(norm, F.col("d.id").eqNullSafe(F.col("m.id")) & F.col("d.path").eqNullSafe(F.col("m.path"))).select("d.id", "d.path", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return both.where(F.col("score") >= FILE_COSINE).groupBy("id", "path").agg(F.max_by("licence", F.struct("score", "licence")).alias("licence"), F.max("score").alias("score"))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _places(tokens: Column, terms: list[str]) -> Column:
    """(pos, term, low, near) for each of the terms found: near are the tokens from low on."""

    def place(s: Column, ts: Column) -> Column:
        low = F.greatest(s["pos"] - REACH, F.lit(0))
        return F.struct(s["pos"].alias("pos"), s["term"].alias("term"), low.alias("low"), F.slice(ts, low + 1, F.lit(2 * REACH + 1)).alias("near"))

    def all_(ts: Column) -> Column:
        found = F.filter(F.transform(ts, lambda x, i: F.struct(i.alias("pos"), x.alias("term"))), lambda s: s["term"].isin(terms))
        return F.transform(found, lambda s: place(s, ts))

    return _bound(tokens, all_)


def _cosine(words: Column, weights: Column, idf: Column, unseen: float) -> Column:
    """Cosine of a span's words to a sentence: each word adds its idf times its weight, and to the norm its idf squared times its count."""

    def add(acc: Column, x: Column) -> Column:
        i = F.coalesce(idf[x], F.lit(unseen))
        return F.struct((acc["dot"] + i * F.coalesce(weights[x], F.lit(0.0))).alias("dot"), (acc["sq"] + i * i * F.size(F.filter(words, lambda y: y == x))).alias("sq"))

    return F.aggregate(words, F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("sq")), add, lambda acc: F.when(acc["sq"] > 0, acc["dot"] / F.sqrt(acc["sq"])).otherwise(0.0))


def _spans(size: Column) -> Column:
    """(words, least, from, to) of the line and the windows of size words around ``at``, from its ``near`` tokens."""
    here = F.col("pos") - F.col("low")
    marked = F.transform("near", lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def spans(ts: Column) -> Column:
        words = F.filter(ts, lambda s: s["x"] != "\n")
        start = F.coalesce(F.array_max(F.transform(F.filter(ts, lambda s: (s["x"] == "\n") & (s["i"] < here)), lambda s: s["i"])), F.lit(-1))
        end = F.coalesce(F.array_min(F.transform(F.filter(ts, lambda s: (s["x"] == "\n") & (s["i"] > here)), lambda s: s["i"])), F.lit(1 << 30))
        line = F.filter(words, lambda s: (s["i"] > start) & (s["i"] < end))
        k = F.size(F.filter(words, lambda s: s["i"] < here))
        # Starts that keep the term inside; the last window of a text is cut short by its end.
        windows = F.transform(F.sequence(F.greatest(k - size + 1, F.lit(0)), k), lambda b: F.slice(words, b + 1, size))
        made = lambda w, least: F.struct(w.alias("w"), F.lit(least).alias("least"))
        return F.concat(F.array(made(line, LEAST_COSINE)), F.transform(windows, lambda w: made(w, WINDOW_COSINE)))

    return _bound(marked, spans)


def statements(files: DataFrame) -> DataFrame:
    """id, path, licence and score of each file's best span or whole text, the file's n_words, in_spans, the template words in its statements, and is_file.

    The texts are read for terms and for tags; all that follows works on the surroundings of found terms.
    Spans are the line of a term and each window as long as the template's sentence, over
    line ends, so words around a statement do not dilute it.
    """
    spark = files.sparkSession
    rows, idf, unseen = template_weights()
    terms = sorted({r[1] for r in rows})
    low = F.translate("text", _UPPER, _LOWER)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    # explode_outer, as explode has its array computed a second time, to filter by its size.
    found = files.select("id", "path", words, F.explode_outer(_places(F.regexp_extract_all(low, F.lit(f"({_TERM}|\n)"), F.lit(1)), terms)).alias("a"))
    found = materialize(found.where("a is not null").select("id", "path", "n_words", "a.*"), "licence-terms")
    templates = spark.createDataFrame(rows, "licence string, term string, size int, weights map<string,double>")
    at = found.join(F.broadcast(templates), "term")
    # No span around the term can reach the least cosine if all words near it together do not.
    shared = F.aggregate(F.map_keys("weights"), F.lit(0.0), lambda s, t: s + F.when(F.array_contains("near", t), F.col("weights")[t] * F.col("weights")[t]).otherwise(0.0))
    at = at.where(shared >= LEAST_COSINE**2 - 1e-9)
    table = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])
    rare = F.filter(F.map_keys("weights"), lambda t: ~t.isin([*COMMON, *GENERIC]) & ~t.rlike("^[0-9]+$"))
    # One word in common is no statement, however often it stands there: "mit" is also German.
    two = F.size(F.array_intersect(rare, F.transform("s.w", lambda s: s["x"]))) > 1
    score = F.round(_bound(F.transform("s.w", lambda s: s["x"]), lambda ws: _cosine(ws, F.col("weights"), table, unseen)), 6)
    scored = at.select("id", "path", "n_words", "low", "licence", "weights", F.explode(_spans(F.col("size"))).alias("s")).where(two).select("id", "path", "n_words", "licence", score.alias("score"), "s.least", F.transform(F.filter("s.w", lambda s: F.col("weights")[s["x"]].isNotNull()), lambda s: s["i"] + F.col("low")).alias("covers")).where("score >= least").drop("least")
    tags = files.where(low.contains("spdx-license-identifier:")).select("id", "path", words, F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("said"))
    tags = tags.withColumn("tag", F.regexp_replace(F.lower("said"), r"(-only|-or-later|\+|\.)$", "")).where(~F.col("tag").isin("none", "noassertion"))
    names = spark.createDataFrame([(n.lower(), n) for n in TEMPLATES], "tag string, licence string")
    # A tag without a template names a licence all the same, as it is written.
    named = F.coalesce("licence", F.regexp_replace("said", r"\.$", ""))
    tagged = tags.join(F.broadcast(names), "tag", "left").select("id", "path", "n_words", named.alias("licence"), F.lit(1.0).alias("score"), F.array().cast("array<int>").alias("covers"))
    spans = materialize(scored.unionByName(tagged), "licence-spans")
    best = spans.groupBy("id", "path").agg(F.max_by("licence", F.struct("score", "licence")).alias("licence"), F.max("score").alias("score"), F.max("n_words").alias("n_words"))
    covers = spans.select("id", "path", F.explode("covers").alias("i")).distinct().groupBy("id", "path").agg(F.count("*").alias("in_spans"))
    whole = materialize(whole_files(files, spans), "licence-whole")
    b, c, w = best.alias("b"), covers.alias("c"), whole.alias("w")
    same = lambda x: F.col("b.id").eqNullSafe(F.col(f"{x}.id")) & F.col("b.path").eqNullSafe(F.col(f"{x}.path"))
    out = b.join(c, same("c"), "left").join(maybe_broadcast(whole, whole.count(), 160).alias("w"), same("w"), "left")
    is_file = F.col("w.licence").isNotNull()
    return out.select("b.id", "b.path", F.coalesce("w.licence", "b.licence").alias("licence"), F.coalesce("w.score", "b.score").alias("score"), "b.n_words", F.coalesce("in_spans", F.lit(0)).alias("in_spans"), is_file.alias("is_file"))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", file_share: float = FILE_SHARE) -> DataFrame:
    """id, path, licence, score, origin and from_dir of every file.

    Lines, and windows as long as a template's sentence, are compared to each sentence of
    each template by the cosine of sparse TF-IDF vectors; an SPDX tag names its
    licence, one without a template too. Whole
    texts are compared to those of the short licences in the same way. A file's own licence
    is that of its whole text, else of its best span. A licence's text, a file of whose words file_share stand in
    statements, or that is named like
    one (LICENSE, COPYING, NOTICE), is a licence file and rules its directory; of several,
    the best score rules, then the smallest path. A file without a licence of its own has
    that of the nearest ancestor directory with one, found by joining the ancestors of each
    directory to the ruled ones. origin is ``file``, ``header``, ``inherited`` or ``none``.

    Null and empty texts have no spans; a null path has no directory. Rows with equal id and
    path are one file, whose spans count together; each keeps its row. Of equal scores the
    licence that is last by name is taken. Very long texts are read whole; what is kept of
    them grows with the template terms in them. An empty table gives no rows. Columns other
    than id, path and text are not read, whatever their names.
    """
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    found = materialize(statements(base), "licences")
    small = maybe_broadcast(found, found.count(), 160)
    named = F.element_at(F.split("path", "/"), -1).rlike(r"^(LICEN[CS]E|COPYING|NOTICE)")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    own = found.where(F.col("path").isNotNull() & (F.col("is_file") | named | (F.col("in_spans") >= F.col("n_words") * file_share)))
    best = F.struct(-F.col("score"), F.col("path"))
    rulers = materialize(own.groupBy(directory.alias("dir")).agg(F.min_by("licence", best).alias("licence"), F.max("score").alias("score")), "licence-dirs")
    dirs = base.where("path is not null").select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))).alias("a")).select("dir", "a.depth", "a.up")
    rules = rulers.select(F.col("dir").alias("up"), "licence", "score")
    near = materialize(above.join(maybe_broadcast(rules, rulers.count(), 120), "up").groupBy("dir").agg(F.max_by(F.struct("licence", "score", "up"), "depth").alias("r")), "licence-near")
    out = base.select("id", "path", directory.alias("dir"))
    out = out.join(small.select(F.col("id").alias("lid"), F.col("path").alias("lpath"), "licence", "score", "is_file"), F.col("id").eqNullSafe(F.col("lid")) & F.col("path").eqNullSafe(F.col("lpath")), "left")
    out = out.join(maybe_broadcast(near.select(F.col("dir").alias("ndir"), "r"), near.count(), 200), F.col("path").isNotNull() & (F.col("dir") == F.col("ndir")), "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.when(mine, F.col("licence")).otherwise(F.col("r.licence")).alias("licence"),
        F.when(mine, F.col("score")).otherwise(F.col("r.score")).alias("score"),
        F.when(mine & F.col("is_file"), "file").when(mine, "header").when(F.col("r").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("r.up")).alias("from_dir"),
    )


def document_path() -> Column:
    """Documents have no paths of their own: their source and language stand for directories."""
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
