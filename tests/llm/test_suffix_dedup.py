"""Removal of repeated strings against counting every string."""

import collections
import hashlib
import random

import numpy as np

from quillmill.llm import suffix_dedup as D
from quillmill.llm import suffixes as S

W = 200


def plain(texts):
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + W] for b in bodies for i in range(len(b) - W + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - W + 1):
            if seen[b[i:i + W]] > 1:
                gone[i:i + W] = b"\1" * W
        spans = sum(x and (i == 0 or not gone[i - 1]) for i, x in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(draw):
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(60)]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    passages = [prose(draw.randint(30, 120)) for _ in range(5)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, "ab" * 400, passages[0], passages[0], "q" * 1000 + "é"]
    for _ in range(120):
        t = prose(draw.randint(0, 150))
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            t += p[draw.randint(0, len(p) // 2):] + prose(draw.randint(0, 40))
        texts.append(t)
    return texts + [texts[20]] * 3 + [texts[30] + "z", "z" + texts[30]]


def report(spark, texts, **more):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in D.dedup_report(df, **more).collect()}
    return [got[i] for i in range(len(texts))]


def test_every_byte(spark):
    texts = corpus(random.Random(3))
    assert report(spark, texts) == plain(texts)


def test_keys_over_several_shards(spark):
    texts = corpus(random.Random(4))
    assert report(spark, texts, shard=2) == plain(texts)


def test_long_texts_in_slices(spark, monkeypatch):
    draw = random.Random(5)
    body = "".join(draw.choice("abcdefgh ") for _ in range(5000))
    texts = [body, body[1000:1500] + "x", body[2000:2199], "y" + body[4700:]]
    monkeypatch.setattr(D, "SLICE", 700)
    assert report(spark, texts) == plain(texts)


def test_repeated_ids_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a" * 300), (1, "b" * 150 + "c" * 100), (1, "b" * 150 + "c" * 100), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in D.dedup_report(df).collect())
    assert got == [(0, 0, 0), (0, 300, 300), (1, 250, 250), (1, 250, 250)]
    assert D.dedup_report(df.limit(0)).count() == 0


def test_suffix_arrays_and_prefixes():
    draw = random.Random(6)
    for n in (1, 2, 9, 300, 3000):
        text = np.frombuffer(bytes(draw.choice(b"ab") for _ in range(n)) + b"\xff", np.uint8)
        order, raw = S.suffix_array(text), text.tobytes()
        assert order.tolist() == sorted(range(len(text)), key=lambda i: raw[i:])
        lcp = S.common_prefixes(text, order, np.array([0]), np.array([n]), 20)
        for a, b in zip(order, order[1:]):
            if b < n:
                same = next((k for k in range(20) if raw[a + k:a + k + 1] != raw[b + k:b + k + 1]), 20)
                assert lcp[b] == same


def test_minimizers_are_the_least_and_leftmost():
    draw = random.Random(7)
    raw = np.frombuffer(bytes(draw.choice(b"abc") for _ in range(900)) + b"ab" * 300, np.uint8)
    place, whole = D.minimizers(raw)
    top = whole >> np.uint64(24)
    for s in range(0, len(raw) - W + 1, 7):
        assert place[s] == s + int(np.argmin(top[s:s + D.REACH]))
    body = raw.tobytes()
    by_gram = {}
    for i, h in enumerate(whole.tolist()):
        assert by_gram.setdefault(body[i:i + D.GRAM], h) == h


def test_equal_halves_of_hashes_remove_nothing(spark, monkeypatch):
    """Pieces under one key whose 64-bit halves collide are told apart by the other half, and shards compare bytes."""
    draw = random.Random(9)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(600)) for _ in range(6)]
    texts += [texts[0][:300] + "!" + texts[0][301:], texts[1]]
    real = D.pieces

    def colliding(body):
        start, count, key, fold, more = real(body)
        return start, count, np.zeros_like(key), np.zeros_like(fold), more

    want = plain(texts)
    monkeypatch.setattr(D, "pieces", colliding)
    assert report(spark, texts) == want


def test_one_long_document_of_one_gram(spark):
    """Many surroundings of one 48-byte string in one document are cut into several shards."""
    draw = random.Random(10)
    gram = "the same forty-eight bytes in every surrounding "
    text = "".join(gram + "".join(draw.choice("abcdefghij") for _ in range(90)) for _ in range(60))
    texts = [text, text[500:760], "é" + text[3000:3400]]
    assert report(spark, texts, shard=4) == plain(texts)
