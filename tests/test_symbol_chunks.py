"""Pieces within their budget beside a plain line by line walk, and the index that is replaced as a whole."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import symbol_chunks as sc
from corpusloom.operators.module_index import index_module, pointers, read_index
from corpusloom.plans.bindings_indexing import _symbols

SF = "/root/testdata/sf0.001"


def tokens(x):
    return math.ceil(len(x) / 3.5)


def walked(text, budget, overlap):
    """The statement cuts, one line after another."""
    out, held, depth = [], [], 0
    for line in text.split("\n"):
        held.append(line)
        depth += sum(line.count(c) for c in "{([") - sum(line.count(c) for c in "})]")
        if depth <= 0 and line.rstrip()[-1:] in (";", "}") and line.rstrip() and sum(map(tokens, held)) >= budget:
            out.append("\n".join(held))
            tail = []
            while len(tail) < len(held) and sum(map(tokens, tail)) < overlap:
                tail = held[len(held) - len(tail) - 1 :]
            held = tail
    return out + (["\n".join(held)] if held else [])


def test_statement_pieces_beside_a_walk():
    rng = random.Random(2)
    words = ["x = 1;", "if (a) {", "}", "call(b,", "  c);", "", "y" * 40, "return [1, 2];", "// note", "z;  "]
    for _ in range(300):
        text = "\n".join(rng.choices(words, k=rng.randrange(1, 60)))
        for budget, overlap in ((5, 0), (12, 4), (30, 9), (9, 40)):
            assert sc.statement_pieces(text, budget, overlap) == walked(text, budget, overlap)


def test_every_piece_fits_and_nothing_is_lost():
    rng = random.Random(4)
    for text in ["a" * 50_000, "", "\n".join(f"  const v{i} = f({i});" for i in range(400)), "\n\n".join("word " * rng.randrange(300) for _ in range(30)), "{\n" * 700 + "x;\n" * 900]:
        for budget in (70, 200):
            out = sc.budget_pieces(text, budget, 0)
            assert all(tokens(p) <= budget for p in out)
            assert "".join("".join(out).split()) == "".join(text.split())


def test_long_symbols_keep_their_front(spark):
    x = _symbols(spark, SF).limit(6)
    source = "\n".join(f"  const value{i} = compute({i});" for i in range(400))
    long = x.withColumn("source_text", F.lit(source))
    rows = sc.symbol_chunks(long, 400).collect()
    assert all(r.tokens <= 400 for r in rows) and all(r.content.startswith("// Module:") and "f(a:" in r.content for r in rows)
    one = sorted((r for r in rows if r.symbol_id == rows[0].symbol_id), key=lambda r: r.ordinal)
    assert [r.ordinal for r in one] == list(range(len(one))) and len(one) > 1 and f"// part 2 of {len(one)}\n" in one[1].content
    assert all(any(f"value{i} =" in r.content for r in one) for i in range(400))
    told = sc.symbol_chunks(x.withColumns({"source_text": F.lit(None).cast("string"), "summary": F.repeat(F.lit("long prose "), 600)}), 400).collect()
    assert all(r.tokens <= 400 for r in told) and len(told) > 6
    headless = sc.symbol_chunks(x.withColumn("blurb", F.repeat(F.lit("blurb "), 900)), 300).collect()
    assert all(r.tokens <= 300 for r in headless)
    with pytest.raises(ValueError):
        sc.symbol_chunks(x, 100)


def test_a_failed_run_leaves_the_old_chunks(spark, tmp_path):
    root, x = str(tmp_path), _symbols(spark, SF).where("sensitivity <> 'restricted'")
    none = spark.createDataFrame([], "content_hash string")
    first = index_module(x.where("symbol_id <= 20"), none, root, "o", "m", "1")
    index_module(x.where("symbol_id between 30 and 40"), none, root, "o", "other", "1")
    held = lambda: sorted((r.module, r.symbol_id) for r in read_index(spark, root).collect())
    before = held()
    assert first.deleted == 0 and first.written == sum(m == "m" for m, _ in before) and first.misses.count() > 0
    # Chunks of a run that never got to its pointer.
    read_index(spark, root).limit(1).drop("generation", "org", "module", "version").write.parquet(f"{root}/chunks/generation=lost")
    assert held() == before
    again = index_module(x.where("symbol_id <= 20"), none, root, "o", "m", "1")
    assert again.skipped and pointers(spark, root).count() == 2
    index_module(x.where("symbol_id = 5"), none, root, "o", "m", "1")
    assert held() == [p for p in before if p[0] == "other" or p[1] == 5]
    index_module(x.where("symbol_id < 0"), none, root, "o", "m", "1")
    assert held() == [p for p in before if p[0] == "other"]


def test_symbols_of_one_file_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A small file of many symbols is one task, and so would be the chunks and their clusters."""
    from corpusloom.operators import module_index

    parts, real = {}, module_index.written
    monkeypatch.setattr(module_index, "written", lambda df, name: parts.setdefault(name, df.rdd.getNumPartitions()) and real(df, name))
    x = _symbols(spark, SF).coalesce(1)
    index_module(x, spark.createDataFrame([], "content_hash string"), str(tmp_path), "o", "m", "1")
    assert parts["chunks"] > 1
