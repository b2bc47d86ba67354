"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from quillmill.llm.common import map_rows, sha256_hex, span_text

KINDS = ("assign", "access", "hex", "entropy")

# The base patterns.
ASSIGN = re.compile(
    r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Character classes with their symbols, window width and least entropy in bits per symbol.
#: A string belongs to the first class that holds all its symbols.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 20, 2.75),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 20, 3.55),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"), 20, 3.70),
)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")

#: Strings that look random but are no secrets: whole-string patterns.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",   # UUID
    r"[A-Za-z]+",                                              # a long word
    r"[a-z]{1,19}(?:[-_/](?:[a-z]{1,19}[0-9]{0,4}|[0-9]{1,8}[a-z]{0,2}))*",  # slugs and paths of words under a window's width
    r"[0-9+=_/-]+",                                            # numbers and rules
    r"(?:sha1|sha256|sha384|sha512|md5)[-_=]?[A-Za-z0-9+/=]+",  # digests that say so
)


def window_entropy(text: str, width: int) -> Iterator[tuple[int, float]]:
    """(start, bits per symbol) of each window of ``width`` symbols.

    Moving on by one symbol changes two counts, so the sum of c*log2(c) is
    updated from a table instead of being computed anew.
    """
    weight = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    count: dict[str, int] = {}
    total = 0.0
    for i, ch in enumerate(text):
        if i >= width:
            old = text[i - width]
            c = count[old]
            total += weight[c - 1] - weight[c]
            count[old] = c - 1
        c = count.get(ch, 0)
        total += weight[c + 1] - weight[c]
        count[ch] = c + 1
        if i >= width - 1:
            yield i - width + 1, math.log2(width) - total / width


def entropy_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int]]:
    """Merged windows over the least entropy of their class, for candidates that mix letters and digits."""
    found = []
    for m in CANDIDATE.finditer(text):
        word = m.group().rstrip("=")
        if allowed.fullmatch(word):
            continue
        symbols = set(word)
        if not (any(c.isdigit() for c in symbols) and any(c.isalpha() for c in symbols)):
            continue
        width, least = next(((w, h) for _, cs, w, h in CLASSES if symbols <= cs))
        if len(word) < width:
            continue
        start = end = None
        for i, bits in window_entropy(word, width):
            if bits < least:
                continue
            if end is not None and i <= end:
                end = i + width
            else:
                if end is not None:
                    found.append((m.start() + start, m.start() + end))
                start, end = i, i + width
        if end is not None:
            found.append((m.start() + start, m.start() + end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as (start, index of kind, end)."""
    spans = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:  # letters A-Z only fold to a-z
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def secret_spans(text: str, allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """The base spans, and entropy spans that no base span covers."""
    base = base_spans(text)
    extra = [(s, 3, e) for s, e in entropy_spans(text, allowed) if not any(b[0] <= s and e <= b[2] for b in base)]
    return base + extra


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per input row: counts per kind, the digest of the base spans and all spans.

    ``allowed`` are patterns of whole candidate strings that are no secrets; they
    suppress entropy spans only.  Null texts count as empty and give no spans; a
    null key is kept.  Places are code points.  Rows are independent.
    """
    pattern = "|".join(f"(?:{p})" for p in allowed) or r"(?!)"

    def make(keys, texts):
        quiet = re.compile(pattern)
        out = {"doc_id": keys, "n_assign": [], "n_access": [], "n_hex": [], "n_entropy": [], "base_sha256": [], "spans": []}
        for t in texts:
            spans = secret_spans(t or "", quiet)
            kinds = [k for _, k, _ in spans]
            for i, name in enumerate(KINDS):
                out[f"n_{name}"].append(kinds.count(i))
            out["base_sha256"].append(sha256_hex(span_text([s for s in spans if s[1] < 3], KINDS)))
            out["spans"].append(span_text(spans, KINDS))
        yield out

    return map_rows(docs, [key, text], "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, "
                                       "base_sha256 string, spans string", make)
