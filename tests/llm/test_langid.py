"""Language identification: codes, decoding and held-out accuracy."""

import random
import zlib

import numpy as np

from quillmill.llm import langid as L

WORDS = {"xa": "the and ing thing with".split(), "xb": "der und ung sich mit".split(), "xc": "el que ción para con".split()}


def corpus(draw, n=150):
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(5, 40))), lang, "s"))
    return rows


def test_codewords():
    assert L.codewords(1).shape == (1, 0) and L.codewords(2).shape == (2, 1)
    for n in (3, 4, 5, 9, 40):
        code = L.codewords(n)
        assert len(np.unique(code, axis=0)) == n and len({tuple(c * c[0]) for c in code.T}) == code.shape[1] or n > 5
        apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert apart >= code.shape[1] // 4
    assert (L.codewords(40) == L.codewords(40)).all()


def test_slices_change_nothing(monkeypatch):
    text = " ".join(random.Random(1).choice(["Ünder", "x2", "日本", "🎉", "abc"]) for _ in range(300))
    whole = L.grams(text)
    monkeypatch.setattr(L, "SLICE", 17)
    assert (L.grams(text) == whole).all()


def test_held_out_documents_and_what_is_learned(spark):
    rows = corpus(random.Random(2))
    rows += [(900, None, "xa", "s"), (901, "", "xb", "s"), (902, "12 34 ...", "xc", "s"), (903, "the and with thing", None, None), (None, "und der mit", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.learn(df.where(~L.held_out("doc_id")))
    assert model.languages == ["xa", "xb", "xc"]
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert len(got) == len(rows)
    for i, text, lang, _ in rows[:150]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "xa" and got[None].lang_pred == "xb"
    folds = {r.doc_id: r.h for r in df.select("doc_id", L.held_out("doc_id").alias("h")).collect()}
    assert all(folds[i] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i in folds)


def test_one_language_and_none(spark):
    df = spark.createDataFrame([(1, "abc", "xa"), (2, "zzz", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.identify(df, L.learn(df)).collect()} == {("xa", 1.0)}
    assert L.learn(df.limit(0)) is None
    assert {r.lang_pred for r in L.identify(df, None).collect()} == {"und"}


def test_many_languages_decode_to_their_own(spark):
    draw = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{i:02d}" for i in range(12)]
    own = {n: ["".join(draw.choice(alphabet) for _ in range(4)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(draw.choice(own[n]) for _ in range(30)), n) for i, n in enumerate(names * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.identify(df, L.learn(df)).collect()}
    assert all(got[i] == n for i, _, n in rows)


def test_accuracy_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs, L.learn(docs.where(~L.held_out("doc_id")))).join(docs, "doc_id").where(L.held_out("doc_id"))
    share = got.selectExpr("avg(cast(lang_pred = lang as int)) as share").first().share
    assert share > 0.98
