"""Near copies against comparing every pair of five-word sets, and copies planted at 0.80 to 0.95."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillmill.llm import neardup  # noqa: E402

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]


def fives(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i: i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = fives(a), fives(b)
    return len(a & b) / len(a | b)


def kept_ids(texts):
    """The least id of each group that pairs of 0.8 or more connect."""
    root = {i: i for i in texts}
    ids = sorted(texts)
    sets = {i: fives(texts[i]) for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in ids if root[i] == i)


def planted(draw):
    """Texts of own words and copies with words changed until the wanted similarity, more or less."""
    texts = {}
    for i in range(48):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([60, 150, 400]))]
        texts[i] = " ".join(words)
        aim = 0.78 + 0.01 * (i % 18)
        copy, best = list(words), words
        while similarity(texts[i], " ".join(copy)) >= aim:
            best = list(copy)
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**9)}"
        texts[100 + i] = " ".join(best if i % 3 else copy)
    return texts


def test_planted_copies(spark):
    draw = random.Random(5)
    texts = planted(draw)
    line = "one very common line that most of these pages have at their end "
    near = [f"n{draw.randrange(5000)}" for _ in range(120)]
    for i in range(60):  # a large group, each with its own changes; not all pairs are alike
        words = list(near)
        for _ in range(draw.randrange(4)):
            words[draw.randrange(120)] = f"y{draw.randrange(10**9)}"
        texts[300 + i] = " ".join(words)
    for i in range(40):
        texts[400 + i] = line * draw.randint(1, 3) + " ".join(f"z{draw.randrange(5000)}" for _ in range(draw.randint(0, 60)))
    texts |= {500: "", 501: None, 502: " \n", 503: "Short text", 504: "short  TEXT", 505: "short"}
    bands = [similarity(texts[i], texts[100 + i]) for i in range(48)]
    assert sum(0.8 <= b < 0.85 for b in bands) > 5 and sum(0.9 <= b < 0.96 for b in bands) > 3 and sum(b < 0.8 for b in bands) > 2
    rows = [(i, t, "x") for i, t in texts.items()]
    got = STAGE(spark, spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string").repartition(3), "")
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(texts)


def test_sketches_never_differ_more_than_sets():
    draw = np.random.default_rng(4)
    for n in (1, 3, 200, 9000, 40_000):
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], draw.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        one, two = (np.frombuffer(neardup.sketch(x), np.uint8)[None, :] for x in (a, b))
        bits = int(min(one.shape[1], two.shape[1]) * 8).bit_length() - 1
        gap = np.bitwise_count(neardup.folded(one, bits) ^ neardup.folded(two, bits)).sum()
        assert gap <= len(np.setxor1d(a, b))


def test_sketch_comparison_keeps_every_similar_pair():
    draw = np.random.default_rng(5)
    sets = []
    for n in (3, 9, 30, 100, 129, 500):
        base = draw.integers(0, 1 << 63, n).astype(np.uint64)
        for part in (1.0, 0.95, 0.9, 0.85, 0.7):
            own = draw.integers(0, 1 << 63, max(1, n // 20)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[: max(1, int(n * part))], own])))
    n, grp = np.array([len(s) for s in sets]), np.arange(len(sets))
    i, j = neardup.close_pairs(np.arange(len(sets)), n, grp, [neardup.sketch(s) for s in sets])
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if neardup.alike(sets[a], sets[b])}
    assert len(similar) > 20 and similar <= found and len(found) < len(similar) + 40


def test_a_large_group_joins_in_few_pairs(spark, monkeypatch):
    """800 near copies of one text: pairs that reach verification grow with the texts, not with their square."""
    draw = random.Random(8)
    base = [f"b{draw.randrange(5000)}" for _ in range(200)]
    texts = {}
    for i in range(800):
        words = list(base)
        for _ in range(draw.randrange(1, 4)):
            words[draw.randrange(200)] = f"y{draw.randrange(10**9)}"
        texts[i] = " ".join(words)
    made = []
    plain = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, t: made.append(pairs.count()) or plain(pairs, t))
    got = STAGE(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), "")
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(texts)
    assert sum(made) < 10 * len(texts), made


def test_long_lists_are_cut(spark, monkeypatch):
    """Lists over the tile size give the same pairs: every pair of cuts meets."""
    monkeypatch.setattr(neardup, "TILE", 8)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    texts = planted(random.Random(6))
    shared = [f"s{i}" for i in range(90)]
    texts |= {600 + i: " ".join(shared[: 60 + i]) for i in range(30)}
    got = STAGE(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), "")
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(texts)


def test_clashing_columns_nulls_and_empty_table(spark):
    schema = "doc_id long, text string, id long, gram string, root string, mark string, row int, slot int"
    rows = [(1, "a b c d e f", 9, "g", "r", "m", 1, 2), (2, "A b c d e f", 9, "g", "r", "m", 1, 2), (None, None, None, None, None, None, None, None),
            (3, "", 9, "g", "r", "m", 1, 2), (4, "x " * 1_000_000, 1, "g", "r", "m", 3, 4)]
    df = spark.createDataFrame(rows, schema)
    got = STAGE(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
    assert STAGE(spark, df.limit(0), "").count() == 0


def test_given_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in STAGE(spark, docs, "").collect()) == kept_ids(texts)


def test_a_round_of_components_joins_twice_and_is_checked_once(spark, monkeypatch):
    """Small plans and few of them: each join of a small table is a broadcast, which the driver holds."""
    from pyspark.sql.classic.dataframe import DataFrame

    from quillmill.llm.components import components

    joins, checks, join, empty = [], [], DataFrame.join, DataFrame.isEmpty
    monkeypatch.setattr(DataFrame, "join", lambda self, *a: joins.append(1) or join(self, *a))
    monkeypatch.setattr(DataFrame, "isEmpty", lambda self: checks.append(1) or empty(self))
    chain = [(i, i + 1) for i in range(20)] + [(7, 7), (31, 30), (30, 32)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys((30, 31, 32), 30)}
    rounds = len(checks) - 1
    assert rounds > 1 and len(joins) == 2 * rounds
