"""Fingerprints bit by bit, groups by comparing all pairs."""

import random

import numpy as np
import xxhash

from quillmill.llm import simhash as S
from quillmill.llm.components import components


def plain(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(values, radius):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(sorted(v for v in values if find(v) == r) for r in {find(v) for v in values})


def test_fingerprints():
    draw = random.Random(5)
    texts = [None, "", " \n", "one", "One two", "A b C d", "ÀÉ x y z w v", "a " * 50]
    texts += [" ".join(draw.choice("The cat SAT on é mat".split()) for _ in range(draw.randint(0, 40))) for _ in range(200)]
    for t in texts:
        assert S.fingerprint(t) == plain(t), repr(t)


def test_spark_hashes_alike(spark):
    assert spark.sql("select hex(xxhash64('a b c d'))").first()[0].lower() == xxhash.xxh64_hexdigest("a b c d", 42)


def planted(draw, dense=40):
    found = set()
    for _ in range(30):
        x = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 2, 5, dense])):
            y = x
            for _ in range(draw.randint(0, 4)):
                y ^= 1 << draw.randrange(64)
            found.add(S.signed(y))
            x = y if draw.random() < 0.5 else x
    return found | set(range(0, 200, 7))


def test_links_for_every_number_of_segments(spark, monkeypatch):
    draw = random.Random(6)
    for tile, cost in ((20_000, 0.02), (6, 0.02), (20_000, 1e4), (20_000, 1e9)):
        monkeypatch.setattr(S, "CANDIDATE_COST", cost)
        values = planted(draw)
        df = spark.createDataFrame([(v,) for v in values], "fp long")
        root = {r.node: r.root for r in components(S.near_links(df, 4, tile)).collect()}
        by_root = {}
        for v in values:
            by_root.setdefault(root.get(v, v), []).append(v)
        assert sorted(sorted(g) for g in by_root.values()) == groups_of(values, 4)


def test_dense_groups_make_few_edges():
    draw = random.Random(7)
    fps = np.array(sorted({1 << draw.randrange(64) | 1 << draw.randrange(64) for _ in range(1500)}), np.uint64)
    edges = S.star(fps, 4)
    assert len(edges) < len(fps) and {e for p in edges for e in p} == set(fps.tolist())


def test_rows(spark):
    text = " ".join(f"word{i}" for i in range(300))
    near = text.replace("word7 ", "other ")
    rows = [(5, text, "a"), (3, near, "a"), (9, None, "a"), (8, "", None), (None, text, "a"), (5, text, "a"), (20, "quite another text here", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = S.near_duplicates(df).collect()
    values = [S.fingerprint(t) for _, t, _ in rows]
    group = {frozenset(g) for g in map(tuple, groups_of([S.signed(v) for v in values], 4))}
    assert len(got) == len(rows)
    for r in got:
        mine = next(g for g in group if S.signed(int(r.fingerprint, 16)) in g)
        assert r.component_id == min(i for (i, _, _), v in zip(rows, values) if i is not None and S.signed(v) in mine)
    kept = S.one_of_each_group(df).collect()
    assert len(kept) == len({r.component_id for r in got}) and set(kept[0].asDict()) == set(df.columns)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000), (500, 400), (400, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    """An id occurs in two groups: each group keeps one row, and clashing columns stay as they are."""
    a, b = " ".join(f"alpha{i}" for i in range(50)), " ".join(f"beta{i}" for i in range(50))
    rows = [(3, a, "r", 1), (5, a, "r", 2), (5, b, "r", 3), (9, b, "r", 4), (None, "only this", "r", 5), (7, None, "r", 6), (7, "", "r", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, _id long")
    got = S.one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:4]) for r in got.collect()) == [(0, "only"), (3, "alph"), (5, "beta"), (7, "")]
