"""BPE against the library that made the vocabulary file, and round trips."""

import json
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quillmill.llm.bpe import Codec, encode_documents, piece_pattern, vocabulary  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = ["", "  ", "I'll DON'T 'S", "ΣΑΣ", "İ ẞ ǅ", "a<|endoftext|>b", "<|ENDOFTEXT|><|startoftext|>", "é ﬁ", "日本語 🎉", "x\x00y\x1c",
           "½ ² ٣", "a" * 3000, "ab " * 500, "​﻿"]


@pytest.fixture(scope="module")
def codec():
    return Codec(json.loads(vocabulary(PATH)), piece_pattern(0x10000), piece_pattern(0x110000))


def library():
    t = tokenizers.Tokenizer.from_file(PATH)

    def run(text):
        ids = t.encode(text, add_special_tokens=False).ids
        return " ".join(map(str, ids)), len(ids), t.decode(ids, skip_special_tokens=False)

    return run


def test_equals_the_library(codec):
    draw, want = random.Random(4), library()
    pool = [chr(c) for c in (*range(32, 0x250), *range(0x391, 0x3CA), 0x3042, 0x4E00, 0x1F600, 0x301, 0x10400, 0x2160)]
    texts = SPECIAL + ["".join(draw.choice(pool) if draw.random() < 0.5 else draw.choice(" aeioust'nd") for _ in range(draw.randint(1, 40)))
                       for _ in range(3000)]
    for t in texts:
        ids, n, decoded = codec.encode(t)
        assert (" ".join(ids), n, " ".join(decoded)) == want(t), repr(t)


def test_decoding_gives_the_text_back(codec):
    """Without their word ends, the vocabulary strings of a word spell the word."""
    for word in ("tokenization", "überraschung", "ciónmente", "a"):
        ids = [int(i) for i in codec.word(word)[0].split()]
        spelled = "".join(codec.strings[i] for i in ids).removesuffix("</w>")
        assert bytes(codec.letters.index(c) for c in spelled).decode() == word


def test_memory_is_bounded_and_changes_nothing(codec, monkeypatch):
    import quillmill.llm.bpe as B

    before = codec.encode("one two three four five six")
    monkeypatch.setattr(B, "REMEMBERED", 2)
    codec.known.clear()
    assert codec.encode("one two three four five six") == before and len(codec.known) <= 3


def test_rows(spark):
    import hashlib

    df = spark.createDataFrame([(1, "Hello world"), (None, None), (2, ""), (2, "")], "doc_id long, text string")
    got = encode_documents(df, PATH, keep=("ids", "decoded")).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert got[0].n_tokens == 2 and got[0].decoded == library()("Hello world")[2]
    assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[1:]] == [(None, 0, none, none), (2, 0, none, none), (2, 0, none, none)]
    assert encode_documents(df.limit(0), PATH).count() == 0


def test_plain_texts_take_the_same_way_as_others(codec):
    """The pieces of ASCII texts are those of the general pattern."""
    draw = random.Random(11)
    for _ in range(3000):
        t = "".join(chr(draw.randrange(128)) for _ in range(draw.randint(0, 60)))
        assert codec.pieces(t) == codec.near(t.lower()), repr(t)


def test_long_texts_and_clashing_columns(spark):
    long = "Größe und word " * 80_000  # 1.2 million characters
    df = spark.createDataFrame([(1, long, "i", 3, "d")], "doc_id long, text string, ids string, n_tokens int, decoded string")
    got = encode_documents(df, PATH, keep=("ids", "decoded")).collect()[0]
    ids, n, decoded = library()("Größe und word ")
    assert got.n_tokens == 80_000 * n and got.ids == " ".join([ids] * 80_000) and got.decoded == " ".join([decoded] * 80_000)
