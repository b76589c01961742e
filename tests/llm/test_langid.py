import numpy as np
import pytest

from convolens.llm import langid as L


@pytest.fixture(scope="module")
def split(spark, data):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{data}/langsamples.parquet").orderBy("sample_id").collect()]
    return [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]


def test_held_out_accuracy(split):
    train, test = split
    matrix, langs = L.fit(train)
    letters, *_ = L.shares([t for _, t in test], matrix)
    right = sum(langs[i] == lang for i, (lang, _) in zip(letters.argmax(1), test))
    assert right / len(test) >= 0.97


def test_mixed(split):
    train, _ = split
    matrix, langs = L.fit(train)
    by = {lang: " ".join(t for x, t in train if x == lang) for lang in ("en", "ru", "zh")}
    texts = [by["en"], by["en"][:400] + " " + by["ru"][:400], by["zh"][:90] + by["en"][:300], "", "123 !?", "x"]
    letters, mass, s, lang, conf = L.shares(texts, matrix)
    own = [[langs[j] for j in np.argsort(-row) if row[j] >= 0.1 * row.sum() > 0] for row in letters]
    assert own[0] == ["en"] and set(own[1]) == {"en", "ru"} and set(own[2]) == {"zh", "en"} and own[3] == own[4] == []
    assert ((conf >= 0) & (conf <= 1)).all()


def test_blocks_change_nothing(split, monkeypatch):
    train, test = split
    matrix, langs = L.fit(train)
    texts = ["\n".join(t for _, t in test)] * 3
    whole = L.shares(texts, matrix)[0]
    monkeypatch.setattr(L, "BLOCK", 500)
    cut = L.shares(texts, matrix)[0]
    assert cut.sum() == whole.sum() and (whole.argmax(1) == cut.argmax(1)).all()


@pytest.mark.parametrize("label,code", [("EN", "en"), ("en_GB", "en"), ("Portuguese", "pt"), ("zh-Hans", "zh"), ("deu", "de"), ("en ", "en"), ("??", None), ("", None), (None, None), ("und", None), ("n/a", None), ("Deutsch", "de"), ("日本語", "ja"), ("sv", None)])
def test_declared(label, code):
    assert L.declared(label) == code


def test_queries(spark, data):
    docs = spark.createDataFrame([(1, "en", "The council talked about the new bridge in the valley because the line was bad."), (2, "de", "The council talked about the new bridge in the valley because the line was bad."), (3, None, "short"), (4, "en", None), (None, None, ""), (5, "English", "Der Bürgermeister beschrieb die neue Brücke und das Wetter im Tal trotz des Regens.")], "doc_id bigint, lang string, text string")
    d = L.document_languages(spark, docs, data)
    assert {(r.doc_id, r.lang) for r in L.wrong_labels(d).collect()} == {(2, "en"), (5, "de")}
    assert d.count() == 6 and L.document_languages(spark, docs.limit(0), data).count() == 0
    s = L.language_segments(spark, docs, data).collect()
    for r in s:
        assert 0 <= r.start_char < r.end_char


def test_sample_does_not_depend_on_files(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = []
    for i, df in enumerate((docs, docs.orderBy("text").repartition(5))):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        spark.read.parquet(f"{data}/langsamples.parquet").write.parquet(f"{tmp_path}/{i}/langsamples.parquet")
        made.append(L.model(spark, f"{tmp_path}/{i}", documents=20).value)
    assert made[0][1] == made[1][1] and (made[0][0] == made[1][0]).all()
