"""Merkle manifest against a plain construction with hashlib."""

import hashlib
import zlib

import numpy as np
import pytest

from quillmill.llm import merkle as M
from quillmill.llm import midstate as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, pos long, mark string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][i: i + 3])) for i in range(0, len(rows[-1]), 3)])
    return rows


def way(rows, i, now):
    siblings = []
    for row in rows[:-1]:
        run = row[i - i % 3: i - i % 3 + 3]
        siblings += run[: i % 3] + run[i % 3 + 1:]
        run[i % 3] = now
        now, i = sha("".join(run)), i // 3
    return siblings, now


def plain(docs):
    by = {}
    for doc_id, text, lang, source, n in docs:
        def leaf(t):
            return sha("".join(map(field, (doc_id, source, lang, n, t))))
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        shown = text.replace("\n", "") if even and text is not None else text
        by.setdefault(source, []).append((doc_id, leaf(text), leaf(shown)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for rows in by.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [tree([r[1] for r in by[s]]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, shown) in enumerate(by[s]):
            low, now = way(trees[k], i, shown)
            high, now = way(top, k, now)
            out.append((doc_id, leaf, trees[k][-1][0], top[-1][0], sha("".join(low + high)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame([(*d, "g", 1, "m") for d in docs], SCHEMA).repartition(3)
    got = M.proofs(df, {"text": M.tampered_text()})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_small_shapes(spark):
    cases = [
        [(1, "alone\n", "en", "a", 6)],
        [(i, f"x\n{i}", "en", "a", i) for i in range(4)],
        [(i, f"x\n{i}", "en", f"s{i % 11}", i) for i in range(30)]  # groups of two and three, eleven groups
        + [(None, "n\n", None, None, None), (None, None, None, None, 3), (7, None, "de", None, 0), (7, None, "de", None, 0),
           (8, "", "é", "Ä", -5), (9, "\n" * 5, "en", "ä", 5), (10, "ü\n" * 500_000, "de", "", 1)],
    ]
    for docs in cases:
        assert run(spark, docs) == plain(docs)
    assert run(spark, []) == []


def test_blocks_of_blocks(spark):
    hot = [(i, f"t{i}\n", "en", "hot", i) for i in range(M.BLOCK + 3)] + [(i, "u", None, "even", i) for i in range(M.BLOCK)]
    hot += [(i % 700, "copy\n", "en", "copies", 5) for i in range(2 * M.BLOCK + 1)]  # rows that share ids and all else
    assert run(spark, hot) == plain(hot)


def test_fold_uses_kept_states_and_right_siblings():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(9)]
    levels = [x for x in M.climb(np.arange(9), np.full(9, 9), S.from_bytes(digests)) if isinstance(x, M.Level)]
    assert len(levels) == 2
    fold = M.Fold(S.from_bytes([hashlib.sha256(b"new").digest()] * 9))
    for level in levels:
        level.others = [np.where(level.slot > k, np.uint32(0), o) for k, o in enumerate(level.others)]  # left ones are not needed
        fold.rise(level)
    rows = tree([d.hex() for d in digests])
    assert [d.hex() for d in S.to_bytes(fold.digest)] == [way(rows, i, sha("new"))[1] for i in range(9)]


@pytest.mark.parametrize("n", [1, 5, S.TOGETHER + 1])
def test_midstates_give_sha256(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    state = S.advance(S.start(n), S.hex_block(S.from_bytes(digests)))
    two = S.advance(state, S.hex_block(S.from_bytes(digests[::-1])))
    assert S.to_bytes(S.finish(state, np.ones(n))) == [hashlib.sha256(d.hex().encode()).digest() for d in digests]
    assert S.to_bytes(S.finish(two, np.full(n, 2))) == [
        hashlib.sha256((a.hex() + b.hex()).encode()).digest() for a, b in zip(digests, digests[::-1])]
    assert S.to_bytes(S.finish(S.start(n), np.zeros(n)))[0] == hashlib.sha256(b"").digest()
