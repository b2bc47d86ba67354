"""Secret scans against searches written letter by letter, and planted secrets."""

import hashlib
import random
import re

import pytest

from quillmill.llm import secret_scan as S


def plain(text):
    """Base spans by direct use of the stated patterns."""
    text = text or ""
    spans = []
    keys = r"""(%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    for k, (pattern, fine) in enumerate(((keys, lambda m: len(m.group(2)) >= 6), ("AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
                                         ("[0-9a-f]+", lambda m: len(m.group()) >= 24))):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if fine(m)]
    return sorted(spans)


def test_base_spans():
    draw = random.Random(2)
    parts = ["password", "PassWd", "ſecret", "toKen", "api_key", "APIKEY", "apiKey", "=", ":", " ", '"', "'", "abc123", "x", "AKIA", "Z9" * 9,
             "0af3" * 7, "0af", "é", "\n", "--", "=="]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    for t in [None, "", *texts]:
        assert sorted(S.base_spans(t or "")) == plain(t), t


def test_entropy_is_the_windows_entropy():
    import math
    from collections import Counter

    draw = random.Random(3)
    text = "a" * 30 + "".join(draw.choice("abcdef012345") for _ in range(90))
    for i, bits in S.window_entropy(text, 20):
        want = -sum(c / 20 * math.log2(c / 20) for c in Counter(text[i:i + 20]).values())
        assert bits == pytest.approx(want, abs=1e-9)


def test_added_spans_and_allow_list():
    key = "q7Zp3Xv9Lm2Kd8Rt5Ws1Yb6"
    quiet = re.compile("|".join(f"(?:{p})" for p in S.ALLOWED))
    assert S.entropy_spans(f"use {key} now", quiet) == [(4, 4 + len(key))]
    for clean in ("123e4567-e89b-12d3-a456-426614174000", "internationalisation" * 2, "a" * 25 + "1", "some-long-slug-name-of-a-page2",
                  "sha256-" + key, "2024-01-01_12-00-00-000000"):
        assert S.entropy_spans(f"see {clean} here", quiet) == [], clean
    assert S.entropy_spans(f"use {key} now", re.compile(re.escape(key))) == []


def test_rows(spark):
    rows = [(1, 'é token = "abcdef12"'), (None, None), (2, ""), (2, "")]
    got = S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got[0].spans == "assign:2:19" and got[0].base_sha256 == hashlib.sha256(b"assign:2:19").hexdigest()
    assert [r.doc_id for r in got] == [1, None, 2, 2] and got[1].spans == "" and got[1].n_assign == 0
    empty = S.scan_secrets(spark.createDataFrame([], "doc_id long, text string, spans string"))
    assert empty.count() == 0


def test_long_texts():
    S.base_spans("a" * 300_000 + "password=" * 1000)
    assert len(S.base_spans("0" * 300_000)) == 1


def test_lower_case_keys_are_no_slugs():
    quiet = re.compile("|".join(f"(?:{p})" for p in S.ALLOWED))
    for key in ("key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "sk-t8xq2vz9m4kr7wp1yc6jd3hn5bfg0las", "npm_x7q9zk2v4m8t1r5w3y6p0jdhb"):
        assert S.entropy_spans(f"use {key} now", quiet), key
    for clean in ("how-to-write-a-page-in-2024-part2", "docs/guides/python3/quick_start_1", "report-2024-01-15-final-v12", "the-2nd-best-way-to-do-this"):
        assert S.entropy_spans(f"see {clean} here", quiet) == [], clean
