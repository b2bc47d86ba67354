"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import map_rows, worker_held

#: Hashed n-grams of one to three letters; two classes of n-grams may share a slot.
SLOTS = 1 << 14
#: Code points looked at together, which bounds a task's memory for long texts.
SLICE = 1 << 20
UNKNOWN = "und"


def letter_codes() -> np.ndarray:
    """Each code point of the basic plane: itself if it is a letter, else a blank; the last entry stands for all others."""
    return worker_held("letters", 0, lambda: np.array(
        [c if chr(c).isalpha() else 32 for c in range(0x10000)] + [0xFFFF], np.uint32))


def grams(text: str) -> np.ndarray:
    """How often each slot's n-grams occur; case is folded, anything but letters counts as one blank."""
    total = np.zeros(SLOTS, np.int64)
    low = text.lower()
    for at in range(0, len(low), SLICE):
        raw = np.frombuffer(low[at: at + SLICE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        n = min(SLICE, len(low) - at)
        codes = np.full(n + 2, 32, np.uint32)
        codes[: len(raw)] = letter_codes()[np.minimum(raw, 0x10000)]
        a, b, c = codes[:n], codes[1: n + 1], codes[2: n + 2]
        letter = a != 32
        for k, h in enumerate((a, a * np.uint32(0x10001) + b, (a * np.uint32(0x10001) + b) * np.uint32(0x10001) + c)):
            mixed = (h + np.uint32(k)) * np.uint32(2654435761)
            total += np.bincount((mixed >> np.uint32(18))[letter], minlength=SLOTS)
    return total


def codewords(languages: int) -> np.ndarray:
    """A row of -1/+1 bits for each language.

    Up to five languages get every split in two; more get ten random splits for
    each doubling, rows and columns being distinct.
    """
    if languages <= 5:
        cols = [[1] + [1 if c >> i & 1 else -1 for i in range(languages - 1)] for c in range((1 << (languages - 1)) - 1)]
        return np.array(cols, np.int8).reshape(-1, languages).T if cols else np.zeros((languages, 0), np.int8)
    draw = np.random.default_rng(languages)
    width = math.ceil(10 * math.log2(languages))
    while True:
        bits = draw.choice(np.array([-1, 1], np.int8), (languages, width))
        if len(np.unique(bits, axis=0)) == languages and (np.abs(bits.sum(0)) < languages).all():
            return bits


class Model:
    """Binary classifiers for the bits, their weights in decoding, and the codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts`` holds a row of n-gram counts for each language."""
        self.languages, self.counts = languages, counts
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * SLOTS)
        bits = self.code.shape[1]
        self.weights = np.zeros((SLOTS, bits), np.float32)
        self.reach = np.ones(bits)
        for j in range(bits):
            plus, minus = share[self.code[:, j] > 0].mean(0), share[self.code[:, j] < 0].mean(0)
            w = np.log(plus) - np.log(minus)
            self.weights[:, j] = w
            self.reach[j] = max(1e-6, 0.5 * float((plus - minus) @ w))  # how far the sides lie apart
        self.trust = self.reach / self.reach.sum() if bits else self.reach

    def predict(self, counts: np.ndarray) -> tuple[str, float, float]:
        """Language, score and lead over the next; the codeword of least weighted loss wins, ties by language value."""
        if not self.code.shape[1]:
            return self.languages[0], 1.0, 1.0
        margin = (counts @ self.weights) / max(1, counts.sum()) / self.reach
        loss = np.exp(-np.clip(self.code * margin, -8, 8)) @ self.trust
        odds = np.exp(-6.0 * (loss - loss.min()))
        order = np.lexsort((np.arange(len(loss)), loss))
        share = odds / odds.sum()
        return self.languages[order[0]], float(share[order[0]]), float(share[order[0]] - share[order[1]])


def held_out(key: str, folds: int = 5, fold: int = 0):
    """Whether a row belongs to the held-out fold by the CRC of its id as text; a null id does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model of the given rows; rows without text or language are left out.  None without rows.

    Counts cover every row: each task adds its n-grams up by language, and Spark
    adds the tasks' rows up.  The driver gets languages times slots numbers.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[name] = sums.get(name, 0) + grams(t)
        for name, total in sums.items():
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name] * (len(slots) + 1), "slot": pa.array([0, *slots.tolist()], pa.int32()),
                                              "n": pa.array([0, *total[slots].tolist()], pa.int64())})

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang).mapInArrow(
        run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    if not names:
        return None
    counts = np.zeros((len(names), SLOTS), np.float64)
    counts[np.searchsorted(np.array(names, object), rows["lang"].to_numpy(object)), rows["slot"].to_numpy()] = rows["n"]
    return Model(names, counts)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", least_lead: float = 0.2) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, ambiguous.

    Texts that are null or have no letter, and all texts if nothing was learned,
    get ``und`` with score 0.  ``ambiguous`` marks a lead below ``least_lead``.
    The counts behind the model (languages times slots) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.counts))
    tag = uuid.uuid4().hex

    def make(keys, texts):
        known = worker_held("languages", tag, lambda: shared.value and Model(*shared.value))
        found = [known.predict(grams(t)) if known and t and any(map(str.isalpha, t)) else (UNKNOWN, 0.0, 0.0) for t in texts]
        yield {"doc_id": keys, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
               "ambiguous": [f[2] < least_lead for f in found]}

    return map_rows(docs, [key, text], "doc_id long, lang_pred string, score double, ambiguous boolean", make)
