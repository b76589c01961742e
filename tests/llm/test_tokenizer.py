import json
import os
import random

import pytest
import tiktoken

from convolens.llm import tokenizer as K

pytestmark = pytest.mark.skipif(not os.path.exists(f"{K.FOLDER}/byte_bpe_50k.json"), reason="no tokenizer files")
TEXTS = ["", " ", "Hello world", "  two  spaces\n\n\ttab ", "<|endoftext|> is text", "naïve café 北京的天气 ประวัติรถไฟ रेल का इतिहास 🎧🎧", "a" * 3000, "1234567890" * 40, "don't we'll I'VE", " 　x﻿", "ال" * 200, "".join(chr(c) for c in range(32, 600))]


@pytest.fixture(scope="module")
def enc():
    return K.Encoder(K.FOLDER, "byte_bpe_50k")


def test_against_library(enc):
    ref = K._tiktoken(K.FOLDER, "byte_bpe_50k")
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab c\n.éжあ中9'") for _ in range(r.randint(1, 300))) for _ in range(60)]
    ids, off = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == ref.encode_ordinary(t), t
    assert isinstance(ref, tiktoken.Encoding)


def test_round_trip(enc):
    with open(f"{K.FOLDER}/byte_bpe_50k.json", encoding="utf-8") as f:
        vocab = {v: k for k, v in json.load(f)["model"]["vocab"].items()}
    back = {c: b for b, c in K._byte_chars().items()}
    ids, off = enc.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert bytes(back[c] for x in ids[off[i] : off[i + 1]].tolist() for c in vocab[x]).decode() == t


def test_cut_changes_nothing(enc, monkeypatch):
    words = ["北京的天气很好今天", "ประวัติรถไฟ", "abcabcabcabcabcabcabcabc", "z" * 40]
    cut = [sum((enc.contract([p])[0].tolist() for p in enc.cut(w.encode())), []) for w in words]
    assert cut == [enc.contract([w.encode()])[0].tolist() for w in words]
    assert len(enc.cut("北京的天气很好今天".encode())) > 1


@pytest.mark.parametrize("word", ["a", "=", " ", "中", "ab", "abc", "lol", "xyzzy", "-=", "ацйу"])
def test_long_words(enc, word):
    t = word * (100_000 // len(word)) + word[:1]
    assert enc.encode([t])[0].tolist() == K._tiktoken(K.FOLDER, "byte_bpe_50k").encode_ordinary(t)


def test_words_are_forgotten(enc, monkeypatch):
    monkeypatch.setattr(K, "KEPT_WORDS", 5)
    monkeypatch.setattr(K, "KEPT_IDS", 20)
    ref = K._tiktoken(K.FOLDER, "byte_bpe_50k")
    for t in ["one two three four", "two three five six seven eight nine", "x" * 500 + " two", "", "one two"]:
        ids, off = enc.encode([t, "two six", ""])
        assert ids[: off[1]].tolist() == ref.encode_ordinary(t) and ids[off[1] :].tolist() == ref.encode_ordinary("two six") and off[3] == off[2]


@pytest.mark.parametrize(("part", "seams"), [(3, 2), (7, 4096), (64, 4096)])
def test_seams(monkeypatch, part, seams):
    for name, value in (("PART", part), ("SEAMS", seams), ("BESIDE", 1 + part // 8)):
        monkeypatch.setattr(K, name, value)
    enc = K.Encoder(K.FOLDER, "byte_bpe_50k")
    ref = K._tiktoken(K.FOLDER, "byte_bpe_50k")
    r = random.Random(part)
    tokens = sorted(b.decode() for b in enc.bytes_of.values() if b.isalpha())
    texts = ["".join(r.choice(k) for _ in range(r.randint(60, 400))) for k in ["ab", "abc", "etaoinshrdlu", "=-", "éñ", "аб中"] for _ in range(8)]
    texts += ["".join(r.choice(tokens) for _ in range(r.randint(5, 60))) for _ in range(40)]
    ids, off = enc.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [ref.encode_ordinary(t) for t in texts]


def test_long_text(enc):
    t = "word number 7, " * 20000
    assert enc.encode_long(t, words=1000).tolist() == enc.encode([t])[0].tolist()


def test_query(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.ids) for r in K.encode(docs).collect()), key=repr)
    assert got == sorted([(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995]), (None, [87])], key=repr)
    assert K.encode(docs.limit(0)).count() == 0
