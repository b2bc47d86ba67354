"""Near copies by sketches inside the tasks: equal to comparing all pairs, with few pairs verified."""

import random

import pytest

from quillmill.operators import dedup, nearcopies


def _brute(rows, threshold=0.7):
    sets = {k: frozenset(t.split()) for k, t in rows}
    firsts = {s: min(k for k in sets if sets[k] == s) for s in set(sets.values())}
    got = {k: (firsts[s], 1.0) for k, s in sets.items() if firsts[s] != k}
    for s, k in firsts.items():
        found = [(-round(len(s & o) / len(s | o), 6), j) for o, j in firsts.items() if j < k]
        if found and -min(found)[0] >= threshold:
            got[k] = (min(found)[1], -min(found)[0])
    return got


def _got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["original"], r["similarity"]) for r in dedup.near_copies(df).collect()}


def _families(rng, families, members):
    rows = []
    for f in range(families):
        base = [f"fam{f}w{rng.randrange(60)}" for _ in range(rng.randrange(3, 90))] + [f"com{rng.randrange(40)}" for _ in range(20)]
        for _ in range(members):
            mine = list(base)
            for _ in range(rng.randrange(0, len(base) // 4)):
                mine[rng.randrange(len(mine))] = f"new{rng.randrange(300)}"
            rows.append((len(rows) * 7 % 1009, " ".join(mine)))
    return rows


@pytest.mark.parametrize("best,tile", [(nearcopies.BEST, nearcopies.TILE), (1, 8)])
def test_all_pairs_by_brute_force(spark, monkeypatch, best, tile):
    """Long lists are cut, and sets whose first candidates do not settle them are looked up again."""
    monkeypatch.setattr(nearcopies, "BEST", best)
    monkeypatch.setattr(nearcopies, "TILE", tile)
    rows = _families(random.Random(best), 12, 25)
    got = _got(spark, rows)
    assert got == _brute(rows) and len(got) > 100


def test_a_family_of_copies_is_not_paired(spark, monkeypatch):
    """400 near copies of one text and 300 texts that share rare words only: at most ``BEST`` pairs of each are verified."""
    base = [f"token{i}" for i in range(80)]
    rows = [(i, " ".join(base[:79] + [f"extra{i}"])) for i in range(400)]
    rows += [(1000 + i, " ".join(["seldom", *[f"w{i}x{j}" for j in range(30)], *[f"often{j}" for j in range(10)]])) for i in range(300)]
    counts, verified = [], nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, *a: counts.append(pairs.count()) or verified(pairs, *a))
    got = _got(spark, rows)
    assert got == {i: (0, round(79 / 81, 6)) for i in range(1, 400)}
    assert sum(counts) <= nearcopies.BEST * 400


def test_no_texts(spark):
    assert _got(spark, [(1, None), (2, ""), (3, "a b")]) == {}
