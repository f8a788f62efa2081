"""Each stage of the pipeline against brute force, and the whole on hard tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corpusloom.llm.bpe import WordBpe
from corpusloom.llm.queries import TOKENIZER

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
LONG = " ".join(f"{WORDS[i % 6]}{i % 613}" for i in range(20_000))


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "   ", "123 456 !!", LONG, LONG + " tail"] + [f"{WORDS[i % 6]} says thing number {i} to {WORDS[(i * 7) % 6]} and then some more words {i * 13}" for i in range(40)]
    texts += ["a shared line of more than twenty characters\nbody " + str(i) for i in range(4)]
    out = [(i, t, "en", ["s", "t", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[9], (None, texts[8], None, "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("clash") for c in ("score", "copies", "component_id", "_row", "ids", "row")})


def test_rejects_what_no_language_fits(spark, docs, rows):
    out = pipeline.keep_known_languages(spark, docs, "")
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    lettered = Counter((i, t) for i, t, *_ in rows if t and re.search("[^\\W\\d_]", t))
    assert kept == lettered  # one language is known: every text with a letter is of it


def test_drops_repeated_lines(spark, docs, rows):
    out = {r.doc_id: r for r in pipeline.drop_lines(spark, docs, "").where("doc_id >= 46").collect()}
    assert [out[i].text for i in range(46, 50)] == ["body 0", "body 1", "body 2", "a shared line of more than twenty characters\nbody 3"]
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert pipeline.drop_lines(spark, docs, "").count() == len(rows)


def test_keeps_one_of_each_group(spark, docs):
    out = pipeline.keep_one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    # 5 is a near copy of 4; the repeated row of id 9 stays with it; rows without an id follow no rule and stay.
    assert 5 not in ids and 4 in ids and ids.count(9) == 2 and ids.count(None) == 2


def test_mix_takes_what_the_operator_says(spark, docs, rows):
    from corpusloom.llm.mixing import mix

    want = Counter()
    for r in mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in pipeline.mix_sources(spark, docs, "").collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_encodes_what_is_left(spark, docs, rows):
    own = WordBpe(open(TOKENIZER, encoding="utf-8").read())
    for r in pipeline.encode(spark, docs.where("doc_id > 5"), "").collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert " ".join(map(str, r.ids)) == own.encode(text)[0]


def test_whole_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {i for i, *_ in rows} and 5 not in {r.doc_id for r in out}
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
