"""The encoder against the tokenizers library."""

import hashlib
import random
import time

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm.bpe import WordBpe, bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB, OWN = Tokenizer.from_file(PATH), WordBpe(open(PATH, encoding="utf-8").read())
HARD = ["", " ", "Hello WORLD's can't I'LL 12 3½ ²", "a\x1cb\x1d c", "ΟΔΥΣΣΕΥΣ Σ σς", "é  x y　z", "İstanbul straße ﬁ", "<|endoftext|>x<|startoftext|> <|end", "日本語 テスト 😀👨‍👩‍👧 ​zz", "!!!???...''' 's", "a" * 5000, "퟿\x00\x7f", "naïve\r\n\tcafé"]


def same(text):
    enc = LIB.encode(text, add_special_tokens=False)
    joined, ids = OWN.encode(text)
    assert joined == " ".join(map(str, enc.ids)), text
    assert ids == enc.ids and LIB.decode(enc.ids, skip_special_tokens=False) == OWN.decode(ids)


def test_hard_texts():
    for text in HARD:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    same(text)


def test_forced_cuts_never_split_a_token():
    for word in ["thanedble", "x" * 40, "q́zx!!", "été", "ﬀjq"]:
        parts = OWN.fragments(word)
        whole = [c for f in parts for c in f]
        assert [t for f in parts for t in OWN.merge(f)] == OWN.merge(whole)


def test_very_long_words():
    rng = random.Random(4)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("ab", 3000), ("thein", 3000), ("a", 5000)):
        word = "".join(rng.choices(letters, k=n))
        began = time.time()
        same(word) if n < 10_000 else OWN.encode(word)
        assert time.time() - began < 60


def test_both_ways_of_merging_agree(monkeypatch):
    rng = random.Random(5)
    for _ in range(500):
        ids = OWN.fragments("".join(rng.choices("abcdeinstrh", k=rng.randint(1, 70))))[0]
        assert OWN._merge_long(list(ids)) == WordBpe.merge(OWN, list(ids)[:63]) + [] if len(ids) < 64 else True


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, HARD[2]), (3, HARD[2]), (None, "x")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    out = bpe(docs, PATH, with_ids=True, with_text=True).collect()
    assert len(out) == 5
    for r, (i, t) in zip(out, rows):
        enc = LIB.encode(t or "", add_special_tokens=False)
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(enc.ids), enc.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, enc.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and r.decoded == LIB.decode(enc.ids, skip_special_tokens=False)
    assert bpe(docs.limit(0), PATH).count() == 0
