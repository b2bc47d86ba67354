"""What the operators of this folder share: word rules, span digests, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: blank and U+0009 to U+000D.  Everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 500


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null and for blank texts."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS + "+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[..., Iterator[dict]], **given) -> DataFrame:
    """Rows made by ``make(lists, **given)`` from slices of Arrow batches of the named columns.

    ``make`` gets the columns of one slice as Python lists and yields dicts of
    lists, one per output batch.  Batches stream, so a task holds one at a time.
    """
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
             "boolean": pa.bool_(), "binary": pa.binary()}
    target = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for out in make(*[part.column(i).to_pylist() for i in range(part.num_columns)], **given):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about ``size`` bytes and at most ``SLICE_ROWS`` rows, one row at least."""
    for batch in batches:
        step = max(1, min(SLICE_ROWS, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def worker_held(slot: str, tag, make: Callable):
    """What ``make`` gave this worker process for the slot, made anew when the tag changes.

    Functions travel to workers by value, so a module-level cache would last for one task only.
    Tagged things go when another slot's come, so a worker keeps one operator's.
    """
    held = sys.modules.setdefault("quillmill_worker_held", types.ModuleType("quillmill_worker_held")).__dict__
    if held.get(slot, (None,))[0] != tag:
        for other in [k for k, v in held.items() if isinstance(v, tuple) and v[0]]:
            del held[other]
        held[slot] = (tag, make())
    return held[slot][1]


#: A key that holds more than one row in so many is hot; there are at most as many hot keys as this.
HOT = 1024


def meet(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of their group; ``size`` is at most the group's number of rows in ``rows``, ``total`` theirs.

    The few groups that hold much of the table, at most ``HOT``, are broadcast, so
    their rows stay where they are; the others meet by their key.
    """
    is_hot = F.col(size) * HOT > total
    hot = F.broadcast(groups.where(is_hot))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(~is_hot), key)
    return rows.join(hot, key).unionByName(cold)


def give_back() -> None:
    """Returns freed memory to the system: workers stay for later tasks, and other stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def span_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by the order of ``kinds``; spans hold (start, index of kind, end)."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
