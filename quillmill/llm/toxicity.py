"""Toxicity: disguised words are restored by a noisy-channel search, then the restored text is scored."""

from __future__ import annotations

import math
import re
import string
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import give_back, map_rows, worker_held

# What letters a writer may mean by a sign.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "*": string.ascii_lowercase}
EDGES = string.punctuation.replace("@", "").replace("$", "") + "…«»“”„¿¡–—"
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+(*])(?:[\s.\-_*]+?(?:[^\W_]|[@$!|+(*])(?![^\W_])){2,}")
#: A star among other separators, which may stand for a letter.
STAR = re.compile(r"(?:^|(?<=[\s.\-_]))\*(?=[\s.\-_]|$)")
RUN, EACH = re.compile(r"(.)\1+"), re.compile(r"(.)\1*")
TRIPLES = tuple(c * 3 for c in string.ascii_lowercase)
#: Symbols of the language model: border, a-z, any other letter.
SYMBOLS = 28
SLICE = 1 << 20
#: Most labelled rows that the lexicon is learned from (by a hash of the id), and restored tokens a task remembers.
SAMPLE = 40_000
REMEMBERED = 50_000
THRESHOLD = 0.7
#: Lengths of the word beginnings that are learned beside whole words, and how many words make a beginning frequent.
STEMS = (4, 5, 6)
OFTEN = 3
#: Tallies that a task keeps before it sends them on.
TALLIES = 100_000


def symbol_codes() -> np.ndarray:
    """Of each code point of the basic plane its symbol; the last entry stands for all others."""
    return worker_held("symbols", 0, symbol_table)


def symbol_table() -> np.ndarray:
    codes = np.array([27 if chr(c).isalpha() else 0 for c in range(0x10000)] + [27], np.int64)
    codes[ord("a"): ord("z") + 1] = np.arange(1, 27)
    return codes


def trigrams(text: str) -> np.ndarray:
    """Counts of the symbol trigrams of a text, case folded."""
    total = np.zeros(SYMBOLS ** 3, np.int64)
    low = text.lower()
    for at in range(0, len(low), SLICE):
        raw = np.frombuffer((low[at: at + SLICE + 2] + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
        s = symbol_codes()[np.minimum(raw, 0x10000)][: min(SLICE, len(low) - at) + 2]
        total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS ** 3)
    return total


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probability of a symbol after two others, from the trigrams of all texts.

    Each task adds its own up and sends a row for each trigram it has seen; the
    driver gets at most 28 ** 3 numbers.
    """

    def run(batches):
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total += trigrams(t)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS ** 3)
    counts[rows["gram"].to_numpy()] = rows["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3)


def lattice(token: str, pairs: bool = True) -> list[tuple[str, ...]]:
    """The strings each position of a token may mean: letters for signs, one or two letters for two or more alike.

    Without ``pairs`` two alike stay two.
    """
    found, i = [], 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        options = SIGNS.get(token[i], token[i])
        if j - i >= 3:
            found.append((*options, *[o * 2 for o in options]))
        elif pairs and j - i == 2:
            found.append((*options, *[a + b for a in options for b in options]))
        else:
            found += [tuple(options)] * (j - i)
        i = j
    return found


class Restorer:
    """Finds the likeliest letters of a token under the language model."""

    def __init__(self, model: np.ndarray):
        self.logp = model.tolist()
        self.known: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0

    def viterbi(self, token: str, pairs: bool = True) -> str:
        """The best path through the lattice; a state is the last two symbols, ties go to the first option."""
        states = {(0, 0): (0.0, None)}
        for options in lattice(token, pairs):
            following: dict = {}
            for (a, b), (score, path) in states.items():
                for option in options:
                    x, y, s = a, b, score
                    for c in option:
                        z = self.symbol(c)
                        s += self.logp[x][y][z]
                        x, y = y, z
                    if (x, y) not in following or s > following[x, y][0]:
                        following[x, y] = (s, (path, option))
            states = following
        best = max(((s + self.logp[a][b][0], path) for (a, b), (s, path) in states.items()), key=lambda r: r[0])[1]
        out = []
        while best is not None:
            best, option = best
            out.append(option)
        return "".join(reversed(out))

    def restore(self, token: str) -> tuple[str, ...]:
        """The likeliest letters with two alike as two, and with two alike as one or two if that differs."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            ways = (False, True) if RUN.search(token) else (False,)
            got = self.known[token] = tuple(dict.fromkeys(self.viterbi(token, pairs) for pairs in ways))
        return got

    def read(self, text: str) -> tuple[set[str], list[str]]:
        """The words of a text with disguised ones restored, and the runs of spaced letters, restored as one string each."""
        low = text.lower()
        words, disguised = set(), set()
        for t in set(low.split()):
            if t.isalpha():
                words.add(t)
                continue
            t = t.strip(EDGES)
            if t.isalpha():
                words.add(t)
            elif any(c in SIGNS for c in t) and any(map(str.isalpha, t)):
                disguised.update(re.split(r"[^\w@$!|+(*]+|_", t))
            else:
                words.update(w for w in re.split(r"[\W\d_]+", t) if w)
        if any(c in low for c in TRIPLES):
            disguised.update(w for w in words if any(c in w for c in TRIPLES))
        words.update(w for t in disguised if any(map(str.isalpha, t)) for w in self.restore(t))
        spaced = []
        for m in SPACED.finditer(low):
            run = m.group()
            plain = {re.sub(r"[\s.\-_*]+", "", run)}
            if "*" in run and STAR.search(run):
                plain.add(re.sub(r"[\s.\-_]+", "", run))
            spaced += [w for t in sorted(plain) if t for w in self.restore(t)]
        return words, spaced


def fewer_letters(word: str, of: str) -> bool:
    """Whether ``word`` is ``of`` with some repeated letters fewer times; both are equal without repetition."""
    return all(len(a.group()) <= len(b.group()) for a, b in zip(EACH.finditer(word), EACH.finditer(of)))


def by_letters(listed: dict[str, float]) -> dict[str, list[str]]:
    """Listed words by what they are without repetition."""
    found: dict[str, list[str]] = {}
    for w in listed:
        if "~" not in w:
            found.setdefault(RUN.sub(r"\1", w), []).append(w)
    return found


def marks(words: set[str]) -> set[str]:
    """What a text is judged by: its words, their beginnings as ``stem~``, and ``stem~~`` for those of several words."""
    found = set(words)
    for k in STEMS:
        stems = Counter(w[:k] for w in words if len(w) > k)
        found.update(f"{stem}~" for stem in stems)
        found.update(f"{stem}~~" for stem, n in stems.items() if n >= OFTEN)
    return found


def signature(text: str) -> int:
    """A hash that near copies mostly share: the least hash of five words in a row."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i: i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))), default=0)


def training_rows(labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic of the rows that may be learned from, at most ``sample`` of them, the first by a hash of the id."""
    usable = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key))
    return usable.groupBy(F.col(key).alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample)


def held_out(key: str):
    """The held-out third by the CRC of the id as text; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lexicon(docs: DataFrame, labels: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text",
            sample: int = SAMPLE) -> tuple[dict[str, float], float]:
    """Marks of toxic texts with the share of toxic texts among those that hold them, and that share overall.

    Texts with one ``signature`` count as one, so a group of copies has one vote.  A
    mark is listed if its share lies over the overall one by more than chance
    allows for all marks together (Chernoff's bound, Bonferroni's correction).
    Learned from a bounded sample of labelled rows, which is small enough to broadcast.
    """
    spark = docs.sparkSession
    rows = training_rows(labels, key, sample)
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    chosen = texts.join(F.broadcast(rows), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    shared = spark.sparkContext.broadcast(model)

    def signed(ids, texts, toxic):
        yield {"doc_id": ids, "toxic": toxic, "sig": [signature(t) for t in texts]}

    signs = map_rows(chosen, ["doc_id", "text", "toxic"], "doc_id long, toxic int, sig long", signed)
    kept = signs.groupBy("sig").agg(F.min("doc_id").alias("_id"), (F.avg("toxic") >= 0.5).cast("int").alias("_toxic"))

    def packed(sums):
        return pa.RecordBatch.from_pydict({"word": list(sums), "clean": pa.array([s[0] for s in sums.values()], pa.int64()),
                                           "toxic": pa.array([s[1] for s in sums.values()], pa.int64())})

    def counted(batches):
        reader, sums, texts = Restorer(shared.value), {}, [0, 0]
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, spaced = reader.read(t)
                texts[x] += 1
                for w in marks(words.union(spaced)):
                    sums.setdefault(w, [0, 0])[x] += 1
                if len(sums) > TALLIES:
                    yield packed(sums)
                    sums = {}
        yield packed(sums | {"": texts})
        give_back()

    tallies = chosen.join(F.broadcast(kept), F.col("doc_id") == F.col("_id")).select("text", "_toxic").mapInArrow(
        counted, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic > 1 or word = ''")
    found = tallies.toPandas()
    totals = found[found["word"] == ""]
    clean, toxic = (int(totals[c].sum()) for c in ("clean", "toxic"))
    if not toxic:
        return {}, 0.0
    base = toxic / (clean + toxic)
    if not clean:
        return {}, 1.0
    words = found[found["word"] != ""]
    need = math.log(20 * max(1, len(words)))
    listed = {}
    for w, c, t in zip(words["word"], words["clean"], words["toxic"]):
        n, p = c + t, t / (c + t)
        if p <= base:
            continue
        gain = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0)
        if n * gain >= need:
            listed[w] = float((t + base) / (n + 1))
    return listed, base


def rate(words: set[str], spaced: list[str], listed: dict[str, float], base: float,
         plain: dict[str, list[str]] | None = None) -> float:
    """The highest share of a listed mark that the text has; half the overall share without any.

    A word with repeated letters also counts as each listed word that has fewer of them; ``plain`` is ``by_letters(listed)``.
    """
    plain = by_letters(listed) if plain is None else plain
    hits = marks(words) & listed.keys()
    for w in words:
        if RUN.search(w):
            hits.update(x for x in plain.get(RUN.sub(r"\1", w), ()) if fewer_letters(x, w))
    hits.update(w for run in spaced for w in listed if len(w) > 3 and w in run)
    return max((listed[w] for w in hits), default=0.5 * base)


def flag_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
               sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with score and predicted added; columns of these names are replaced.

    Null and empty texts get half the share of toxic rows.  Without labelled rows
    every score is 0.  Repeated rows are scored alike.  The language model is
    learned from all texts, the lexicon from labelled rows outside the held-out third.
    """
    model = language_model(docs, text)
    listed, base = lexicon(docs, labels, model, key, text, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, listed, base, by_letters(listed)))
    tag = uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        lm, words, share, plain = shared.value
        reader = worker_held("restorer", tag, lambda: Restorer(lm))
        out = pa.array([rate(*reader.read(t.as_py() or ""), words, share, plain) for t in texts], pa.float64())
        give_back()
        return out

    return docs.withColumn("score", score(text)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, as ``flag_toxic`` gives them."""
    return flag_toxic(docs.select(key, text), labels, key, text, sample).select(
        F.col(key).alias("doc_id"), held_out(key).alias("held_out"), "score", "predicted")
