"""Redundant sentences spread over tasks: equal to the pass in the row."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import dedup, redundancy
from tests import brute
from tests.conftest import SMALL
from tests.test_text import corpus


@pytest.mark.parametrize("plain,limit", [(False, 0.55), (False, 0.3), (True, 0.7)])
def test_spread_documents_match_brute_force(docs, texts_of, plain, limit):
    texts = corpus(1, 60)
    got = texts_of(redundancy.drop_redundant_any(docs(*texts), threshold=limit, plain=plain, spread_from=0))
    assert got == [brute.redundant_plain(t) if plain else brute.redundant(t, limit) for t in texts]


def test_spread_documents_match_the_pass_in_the_row(spark, texts_of):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert texts_of(redundancy.drop_redundant_any(df, spread_from=3)) == texts_of(dedup.drop_redundant(df))


def _kept(spark, sets, limit, heads):
    rows = [(0, i, sorted(s), []) for i, s in enumerate(sets)]
    features = spark.createDataFrame(rows, "key long, pos int, w array<bigint>, b array<bigint>")
    return sorted(r.pos for r in redundancy.greedy_kept(features, limit, heads).collect())


def _greedy(sets, limit):
    kept = []
    for i, s in enumerate(sets):
        if s and all(len(s & sets[k]) / len(s | sets[k]) <= limit for k in kept):
            kept.append(i)
    return kept


def test_few_heads_give_the_same_sentences(spark):
    """Many rounds: one head per feature at first, features that most sentences hold, chains of similar ones."""
    rng = random.Random(7)
    sets = [set(rng.sample(range(14), rng.randint(1, 6))) for _ in range(80)]
    sets += [set(range(100 + i, 110 + i)) for i in range(20)]
    assert _kept(spark, sets, 0.5, 1) == _greedy(sets, 0.5)


def test_a_group_of_similar_sentences_is_not_paired(spark, monkeypatch):
    """3,000 sentences alike but for one word, late in the document: pairs grow with them, not with their square."""
    sets = [{1000 + 7 * i + j for j in range(7)} for i in range(50)]
    sets += [set(range(12)) | {10_000 + i} for i in range(3000)]
    pairs, similar = [], redundancy._similar
    monkeypatch.setattr(redundancy, "_similar", lambda *a: pairs.append(similar(*a)) or pairs[-1])
    assert _kept(spark, sets, 0.55, 4) == _greedy(sets, 0.55)
    assert len(pairs) == 1 and pairs[0].count() <= 4 * 3000


def test_defined_results(spark):
    rows = [(1, None, 5), (1, "", 6), (None, "One cat sat here. One cat sat here. A dog ran off.", 7), (None, "! ? .", 8),
            (2, "word " * 200_000 + ". " + "word " * 10 + ". other words here.", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept int")
    got = {r["_kept"]: r["text_out"] for r in redundancy.drop_redundant_any(df, spread_from=0).collect()}
    want = {r["_kept"]: r["text_out"] for r in dedup.drop_redundant(df).collect()}
    assert got == want and got[7] == "One cat sat here. A dog ran off."
    empty = df.where(F.lit(False))
    assert redundancy.drop_redundant_any(empty, spread_from=0).collect() == []


def test_documents_of_one_and_of_several_blocks_give_the_same_sentences(spark, monkeypatch):
    """Features are counted in a task where a document is one block, else over tasks; equal sentences meet across blocks."""
    monkeypatch.setattr(redundancy, "BLOCK", 8)
    rng = random.Random(11)
    docs = {k: [set(rng.sample(range(12), rng.randint(1, 5))) for _ in range(n)] for k, n in enumerate([3, 8, 9, 40, 64])}
    rows = [(k, i, sorted(s), []) for k, sets in docs.items() for i, s in enumerate(sets)]
    features = spark.createDataFrame(rows, "key long, pos int, w array<bigint>, b array<bigint>")
    got = sorted((r.key, r.pos) for r in redundancy.greedy_kept(features, 0.5, 2).collect())
    assert got == [(k, i) for k, sets in docs.items() for i in _greedy(sets, 0.5)]


def test_only_sentences_of_pairs_move_and_only_where_they_are_compared(spark, monkeypatch):
    """One pair among 2,000 unlike sentences: their sets are neither repeated nor shuffled with the pair's."""
    sets = [set(range(20 * i, 20 * i + 10)) for i in range(2000)]
    sets.append(sets[5] - {100} | {-1})
    written, put = [], redundancy._Tables.put
    monkeypatch.setattr(redundancy._Tables, "put", lambda self, df: written.append(put(self, df)) or written[-1])
    assert _kept(spark, sets, 0.55, 4) == _greedy(sets, 0.55)
    assert [t.count() for t in written if t.columns == ["key", "pos", "w", "b"]] == [2]


def test_sentences_of_a_block_move_once(spark):
    """Equal sentences, counts of features and prefixes need no shuffle after the one by block."""
    rows = [(0, 0, 9, i, [i, i + 1], [i]) for i in range(9)]
    sets = spark.createDataFrame(rows, "key long, block long, n int, pos int, w array<bigint>, b array<bigint>")
    one = redundancy._prepared(sets.repartition("key", "block"), 0.55)
    plan = one._jdf.queryExecution().executedPlan().toString()
    one_block = [x for x in plan[plan.index("Union"):].split("\n") if x.startswith("   :")]
    assert one.count() == 9 and sum("Exchange" in x for x in one_block) == 1
