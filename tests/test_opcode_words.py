"""Opcode patterns run only over texts with a word they need: the same text as when each runs over all."""

import random

from quillmill.functions import vocab
from quillmill.operators import opcode


def test_each_pattern_has_the_words_it_needs():
    assert set(vocab.OPCODE_NEEDS) == {p for _, group in vocab.OPCODE_GROUPS for p, _ in group}


def test_texts_are_those_of_all_patterns(docs, texts_of, monkeypatch):
    rng = random.Random(3)
    words = sorted({w for need in vocab.OPCODE_NEEDS.values() for w in need})
    words += ["please", "can you", "the", "we", "I", "to", "tonow", "sothen", "iwhy", "is", "than", "5x", "30", "30seconds", "7ms", "e.g.x", "out",
              "limit", "\u017fo", "\u0131f", "\u0130f", "li\u212ae", "\ufb01x", "\u00dfo", "how do iwhy", "status=", "as a result of", "9 % drop", "a\x03 b \x04"]
    texts = [None, "", *[" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, k=rng.randint(1, 14))) + rng.choice([".", "?", "", ", so. why is it?"])
                         for _ in range(1500)]]
    got = texts_of(opcode.encode_opcodes(docs(*texts)))
    monkeypatch.setattr(vocab, "OPCODE_NEEDS", {})
    assert got == texts_of(opcode.encode_opcodes(docs(*texts)))
    assert sum(a != b for a, b in zip(got, texts)) > 1000
