"""Limits that decide per request: a token bucket per key, computed over many tasks.

A bucket holds ``limit`` tokens and refills at ``limit`` per ``seconds``; a
request takes one token or is refused.  Whether a request passes depends on all
before it, but what a run of requests does to the bucket is a function of its
level before the run: piecewise linear with slope 0 or 1, and such functions
compose.  So a key's log is cut into chunks, each chunk's function is found in
parallel, the functions are applied in turn for the level before each chunk, and
the chunks are then decided in parallel.

All levels are whole numbers: one token is ``seconds`` in microseconds, so the
bucket gains ``limit`` units a microsecond and nothing is rounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions.skew import spread_join
from quillmill.session import stored

CHUNK = 50_000
MOST = 10**11  # a limit above this is one that no log can reach; it keeps levels within 64 bits


class Run:
    """What a run of requests does to the level: pieces by first level ``lo``, level after ``out`` and slope."""

    def __init__(self, limit: int, token: int):
        self.limit, self.token, self.full = limit, token, limit * token
        self.lo, self.out, self.slope = np.array([0]), np.array([0]), np.array([1])

    def request(self, gap: int) -> None:
        gain = self.limit * min(gap, self.token)
        lo, out, slope = self.lo, self.out + gain, self.slope
        last = out + slope * (np.append(lo[1:], self.full + 1) - lo - 1)
        rising = slope == 1
        cuts = [lo] + [(lo + edge - out)[rising & (out < edge) & (last >= edge)] for edge in (self.full, self.token)]
        new = np.unique(np.concatenate(cuts))
        at = np.searchsorted(lo, new, side="right") - 1
        level = np.minimum(out[at] + slope[at] * (new - lo[at]), self.full)
        slope = np.where(level == self.full, 0, slope[at])
        level = np.where(level >= self.token, level - self.token, level)
        joined = np.zeros(len(new), dtype=bool)
        joined[1:] = (slope[1:] == slope[:-1]) & (level[1:] == level[:-1] + slope[:-1] * np.diff(new))
        self.lo, self.out, self.slope = new[~joined], level[~joined], slope[~joined]

    def after(self, level: int) -> int:
        return after(self.lo, self.out, self.slope, level)


def after(lo, out, slope, level: int) -> int:
    at = int(np.searchsorted(lo, level, side="right")) - 1
    return int(out[at] + slope[at] * (level - lo[at]))


def enforce(log: DataFrame, keys: DataFrame, limit: str = "rate_limit", ts: str = "timestamp", key: str = "api_key_id",
            row_id: str = "id", seconds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """One row per request: row_id, key, ts, admitted, tokens_left.

    Requests of a key count by (ts, row_id), from a full bucket; refused ones
    take no token.  Requests without time, key or limit are admitted with null
    tokens_left; a limit of 0 or less admits none.  ``row_id`` is unique, ``keys``
    holds one row per key.

    A key of at most ``chunk`` calls is decided in one walk over sorted rows.  A
    larger one is cut into chunks of about ``chunk`` calls (and at most one second
    more); its levels between chunks need one row per chunk.  The function of a
    chunk has one piece after a pause of ``seconds``, else up to about ``limit``
    (with a limit of 1, up to the calls of one ``seconds``).  The metered log is
    stored once in the shared folder, so the call itself runs a job.
    """
    token = seconds * 1_000_000
    known = keys.select(key, F.col(limit).cast("long").alias("_limit")).filter("_limit is not null")
    # Read by five steps below, so it is written once; slim rows.
    asked = stored(spread_join(log.select(row_id, key, ts), known, [key], row_id, "left", merge=True), "quota")
    metered = F.col("_limit").isNotNull() & F.col(ts).isNotNull()
    timed = asked.filter(metered & (F.col("_limit") > 0)).select(
        row_id, key, F.least("_limit", F.lit(MOST)).alias("_limit"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
    ).withColumn("sec", F.floor(F.col("us") / 1_000_000)).withColumn("day", F.floor(F.col("sec") / 86_400))

    # Chunks end between seconds.  The windows see one row per day of a key, and one per second of its day.
    per_sec = timed.groupBy(key, "day", "sec").agg(F.count("*").alias("n"))
    by_day = W.partitionBy(key).orderBy("day")
    days = (per_sec.groupBy(key, "day").agg(F.sum("n").alias("n"))
            .select(key, "day", (F.sum("n").over(by_day) - F.col("n")).alias("earlier"),
                    (F.sum("n").over(W.partitionBy(key)) > chunk).alias("several")))
    within = F.sum("n").over(W.partitionBy(key, "day").orderBy("sec")) - F.col("n")
    part = (per_sec.withColumn("within", within).join(days.filter("several"), [key, "day"])
            .select(key, "sec", F.floor((F.col("earlier") + F.col("within")) / chunk).alias("part")))
    rows = spread_join(timed.drop("day"), part, [key, "sec"], row_id, "left", merge=True).drop("sec")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["us"].to_numpy())
        run = Run(int(pdf["_limit"].iloc[0]), token)
        for gap in np.diff(us, prepend=us[0]).tolist():
            run.request(gap)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "part": [pdf["part"].iloc[0]], "first": [us[0]], "last": [us[-1]],
                             "limit": [run.limit], "lo": [run.lo], "out": [run.out], "slope": [run.slope]})

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable")
        level, before, found = None, None, []
        for r in pdf.itertuples():
            full = r.limit * token
            level = full if level is None else min(full, level + r.limit * min(r.first - before, token))
            found.append(level)
            level, before = after(r.lo, r.out, r.slope, level), r.last
        return pdf[[key, "part"]].assign(level=np.array(found, dtype="int64"))

    def walk(batches):
        now, level, before = None, 0, 0  # key and part, level, time of the request before
        for pdf in batches:
            passed, left = [], []
            for place, limit_, us, opening in zip(zip(pdf[key], pdf["part"]), pdf["_limit"].tolist(), pdf["us"].tolist(),
                                                  pdf["level"].tolist()):
                level = opening if place != now else min(limit_ * token, level + limit_ * min(us - before, token))
                now, before, ok = place, us, level >= token
                level -= token if ok else 0
                passed.append(ok)
                left.append(level // token)
            yield pd.DataFrame({row_id: pdf[row_id], key: pdf[key], "us": pdf["us"], "admitted": passed,
                                "tokens_left": np.array(left, dtype="int64")})

    runs = rows.filter("part is not null").groupBy(key, "part").applyInPandas(
        summary, f"`{key}` {kinds[key]}, part long, first long, last long, limit long, lo array<long>, out array<long>, slope array<long>")
    start = runs.groupBy(key).applyInPandas(levels, f"`{key}` {kinds[key]}, part long, level long")
    opened = rows.join(start, [key, "part"], "left").select(
        row_id, key, F.coalesce("part", F.lit(0)).alias("part"), "us", "_limit",
        F.coalesce("level", F.col("_limit") * token).alias("level"))
    decided = (opened.repartition(key, "part").sortWithinPartitions(key, "part", "us", row_id).mapInPandas(
        walk, f"`{row_id}` {kinds[row_id]}, `{key}` {kinds[key]}, us long, admitted boolean, tokens_left long")
        .select(row_id, key, F.timestamp_micros("us").cast(log.schema[ts].dataType).alias(ts), "admitted", "tokens_left"))
    others = asked.filter(~metered | (F.col("_limit") <= 0)).select(
        row_id, key, ts, (~metered).alias("admitted"), F.when(metered, 0).cast("long").alias("tokens_left"))
    return decided.unionByName(others)


def refused(verdicts: DataFrame, key: str = "api_key_id") -> DataFrame:
    """Requests and refused requests per key."""
    return verdicts.groupBy(key).agg(F.count("*").alias("requests"), F.count_if(~F.col("admitted")).alias("refused"))
