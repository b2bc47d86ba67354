"""BPE encoding and decoding by merge ranks, in the text rules of a word-end vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame

from quillmill.llm.common import map_rows, worker_held

WORD_END = "</w>"
#: Encoded words that a task has used lately; as many older ones are kept until the next such number, which changes no result.
REMEMBERED = 100_000

# White space, letters newer than Python's tables with their lower case, printable bytes.
SPACE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
             0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {
             c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
NEWER = re.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")
#: The pieces of a text of ASCII characters in lower case.
ASCII_PIECES = re.compile(rf"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE_CLASS}a-z0-9]+").findall
BEYOND = re.compile(f"[{chr(0x10000)}-{chr(0x10FFFF)}]")


@lru_cache(maxsize=2)
def piece_pattern(end: int) -> str:
    """How the vocabulary file splits texts, with letters and numbers below ``end`` as character ranges."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(end):
        runs = ranges.get(unicodedata.category(chr(c))[0])
        if runs is not None:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    letter, number = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[k]) for k in "LN")
    return f"[{letter}]+|[{number}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE_CLASS}{letter}{number}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, others follow from U+0100 on."""
    letters = {b: chr(b) for b in PLAIN_BYTES}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(PLAIN_BYTES)))
    return [letters[b] for b in range(256)]


class Lately(dict):
    """What ``make`` gives for a key, kept for keys used lately: the last ones and, until they fill up, those before."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        got = self.before.get(key) or self.make(key)
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, spec: dict, near: str, whole: str):
        """``near`` and ``whole`` are piece patterns for texts without and with code points over U+FFFF."""
        self.near, self.whole = re.compile(near).findall, re.compile(whole).findall
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Symbols are numbers: ids, and numbers past all ids for what merges make or take outside the vocabulary.
        number, past = dict(self.vocab), max([0, *self.strings]) + 1
        for m in merges:
            for symbol in (*m, "".join(m)):
                if symbol not in number:
                    number[symbol] = past
                    past += 1
        self.span = past
        self.ranks = {number[a] * past + number[b]: r for r, (a, b) in enumerate(merges)}
        self.makes = [number[a + b] for a, b in merges]
        self.letters = byte_letters()
        self.inside = [self.vocab.get(c) for c in self.letters]
        self.at_end = [self.vocab.get(c + WORD_END) for c in self.letters]
        self.marks = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.known = Lately(self.word)
        self.silent = False  # whether a piece so far has given no id

    def merge(self, symbols: list[int]) -> list[int]:
        """Joins the pair of lowest rank, leftmost first, until none has a rank.

        Symbols form a doubly linked list; the queue keeps rank and place as one
        number, and entries whose pair has changed since are skipped when they come up.
        """
        n, span, rank_of, makes = len(symbols), self.span, self.ranks.get, self.makes
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        now = [rank_of(a * span + b) for a, b in zip(symbols, symbols[1:])]  # rank of the pair that starts at each place
        now.append(None)
        queue = [r * n + i for i, r in enumerate(now) if r is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i = divmod(pop(queue), n)
            if now[i] != rank:
                continue
            made = symbols[i] = makes[rank]
            j = after[i]
            symbols[j], now[j] = -1, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = now[i] = rank_of(made * span + symbols[k])
                if r is not None:
                    push(queue, r * n + i)
            else:
                now[i] = None
            h = before[i]
            if h >= 0:
                r = now[h] = rank_of(symbols[h] * span + made)
                if r is not None:
                    push(queue, r * n + h)
        return [s for s in symbols if s >= 0]

    def word(self, piece: str) -> tuple[str, str]:
        """Of one piece: its ids joined by blanks and its decoded text."""
        body = piece.encode("utf-8")
        symbols = [self.inside[b] for b in body]
        symbols[-1] = self.at_end[body[-1]]
        # A symbol that the vocabulary lacks gives no id.
        ids = [s for s in self.merge([s for s in symbols if s is not None]) if s in self.strings]
        self.silent |= not ids
        return " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, blank-separated as a file without a decoder asks; unknown ids give nothing."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; white space is in none, so runs of it need no replacing."""
        if text.isascii():
            return ASCII_PIECES(text.lower())
        text = unicodedata.normalize("NFC", text)
        if NEWER.search(text):
            text = text.translate(NEW_LOWER)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # letters fold one by one, without final sigma
        return (self.whole if BEYOND.search(text) else self.near)(text.lower())

    def encode_text(self, text: str) -> tuple[str, int, str]:
        """Ids joined by blanks, their number, and the decoded text."""
        if "<|" not in text:
            found = list(map(self.known.__getitem__, self.pieces(text)))
        else:
            found, at = [], 0
            for m in self.marks.finditer(text):
                found += map(self.known.__getitem__, self.pieces(text[at:m.start()]))
                found.append((str(self.special[m.group()]), m.group()))
                at = m.end()
            found += map(self.known.__getitem__, self.pieces(text[at:]))
        if self.silent:
            found = [f for f in found if f[0]]
        if not found:
            return "", 0, ""
        each, decoded = zip(*found)
        ids = " ".join(each)
        return ids, ids.count(" ") + 1, " ".join(decoded)

    def encode(self, text: str) -> tuple[list[str], int, list[str]]:
        """Ids as texts, their number, and the decoded words."""
        ids, n, decoded = self.encode_text(text)
        return ids.split(" "), n, decoded.split(" ")


def vocabulary(path: str) -> str:
    """The text of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: n_tokens, digests of ids and decoded text, and themselves (ids, decoded) if in ``keep``.

    The vocabulary (a few MB, by its file's size) is broadcast.  Null texts count
    as empty: no tokens, empty decoded text.  Rows are independent, so repeated
    ones come back repeated and an empty table gives no rows.  Very long texts are
    encoded whole, a task holding one at a time beside its ids.  Columns other
    than ``key`` and ``text`` take no part, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary(path), piece_pattern(0x10000), piece_pattern(0x110000)))
    tag = uuid.uuid4().hex

    def make(keys, texts):
        codec = worker_held("codec", tag, lambda: Codec(json.loads(shared.value[0]), *shared.value[1:]))
        out = {"doc_id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        out |= {k: [] for k in keep}
        for t in texts:
            ids, n, decoded = codec.encode_text(t or "")
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            for k in keep:
                out[k].append(ids if k == "ids" else decoded)
        yield out

    more = "".join(f", {k} string" for k in keep)
    return map_rows(docs, [key, text], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more, make)
