"""Toxicity: the search against trying every path, restored disguises, planted documents."""

import itertools
import random

import numpy as np
import pytest

from quillmill.llm import toxicity as T


def model(words):
    total = sum((T.trigrams(w) for w in words), np.zeros(T.SYMBOLS ** 3, np.int64))
    three = total.reshape((T.SYMBOLS,) * 3).astype(float)
    p = (three + 0.1) / (three.sum(2, keepdims=True) + 0.1 * T.SYMBOLS)
    return np.log(p)


@pytest.fixture(scope="module")
def restorer():
    return T.Restorer(model(["idiot moron stupid loser clown trash the river ran along"] * 20))


def test_viterbi_finds_the_best_path(restorer):
    draw = random.Random(1)
    for _ in range(200):
        token = "".join(draw.choice("1a0t5o!sd") for _ in range(draw.randint(1, 6)))

        def score(word):
            a = b = 0
            total = 0.0
            for c in word:
                z = restorer.symbol(c)
                total += restorer.logp[a][b][z]
                a, b = b, z
            return total + restorer.logp[a][b][0]

        paths = ["".join(p) for p in itertools.product(*T.lattice(token))]
        assert score(restorer.viterbi(token)) == pytest.approx(max(map(score, paths)))


def test_disguises_are_restored(restorer):
    for shown, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup!d", "stupid"), ("stuuuupid", "stupid"), ("l0$er", "loser"), ("tr@sh", "trash")):
        assert word in restorer.read(f"you {shown}, go")[0], shown
    assert "idiot" in restorer.read("an i d i o t here")[1][0]
    assert any("moron" in s for s in restorer.read("a m-o-r-o-n!")[1])
    words, spaced = restorer.read("The river ran. Plain words, 12 and 3.5!")
    assert words == {"the", "river", "ran", "plain", "words", "and"} and spaced == []


def test_spaced_letters(restorer):
    assert any("moron" in s for s in restorer.read("such a m o r o n today")[1])
    assert any("idiot" in s for s in restorer.read("what an 1.d.1.0.t he is")[1])


def test_planted_documents(spark):
    draw = random.Random(2)
    plain = "river stone house water green field morning light paper window".split()
    rows, labels = [], []
    for i in range(400):
        words = [draw.choice(plain) for _ in range(draw.randint(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["moron", "idiot", "stupid"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    hidden = ["you 1d10t", "such a m0r0n", "so stuuuupid", "an i d i o t he is", "a plain river", None, ""]
    rows += [(1000 + k, t, "x") for k, t in enumerate(hidden)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    given = spark.createDataFrame(labels + [(None, 1), (7777, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score_toxicity(docs, given).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == t for i, t in labels)
    assert [got[1000 + k].predicted for k in range(len(hidden))] == [1, 1, 1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1005].score == got[1006].score
    none = T.score_toxicity(docs, given.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert T.score_toxicity(docs.limit(0), given).count() == 0


def test_copies_have_one_vote(spark):
    """A clean group of copies, labelled toxic by mistake, does not teach its words."""
    draw = random.Random(3)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = [(i, " ".join(draw.choice(plain) for _ in range(40))) for i in range(300)]
    copy = "special phrase of a copied page that many share in full and nobody else has at all"
    rows += [(1000 + i, copy) for i in range(100)]
    labels = [(i, int(i >= 1000 or i % 9 == 0)) for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    listed, _ = T.lexicon(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), T.language_model(docs))
    assert not {"special", "phrase", "copied"} & listed.keys()


def test_held_out_accuracy_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = T.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out")
    t = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert t[1, 1] / (t[1, 1] + t.get((1, 0), 0)) > 0.85 and t[0, 0] / (t[0, 0] + t.get((0, 1), 0)) > 0.97


def test_spaced_letters_of_all_alphabets_and_separators():
    r = T.Restorer(model(["idiot moron stupid scheiße estúpido the river ran along"] * 20))
    for shown, word in (("s c h e i ß e", "scheiße"), ("e s t ú p i d o", "estúpido"), ("i  d  i  o  t", "idiot"), ("i\nd\ti - o\n\nt", "idiot"),
                        ("s + u p | d", "stupid"), ("$ t u p ! d", "stupid"), ("m o r * n", "moron"), ("m * o * r * o * n", "moron"), ("m-o-r-o-n!", "moron")):
        assert any(word in s for s in r.read(f"you {shown}, go")[1]), (shown, r.read(f"you {shown}, go"))


def test_repeated_letters_count_as_fewer(spark):
    draw = random.Random(4)
    plain = "river stone house water green field morning light paper window letter street".split()
    rows, labels = [], []
    for i in range(400):
        words = [draw.choice(plain) for _ in range(draw.randint(10, 60))] + ([draw.choice(["moron", "idiot", "stupid", "asshat"])] if i % 5 == 0 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    hidden = ["so stuupid", "an idiiot", "asshhat", "a sttuupiidd one", "you 1d11ot", "an i  d  i  o  t", "letter street", "asht"]
    docs = spark.createDataFrame(rows + [(1000 + k, t) for k, t in enumerate(hidden)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in T.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[1000 + k] for k in range(len(hidden))] == [1, 1, 1, 1, 1, 1, 0, 0]
