"""Mixing against a plain restatement, and the splitting tree against the distribution."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def words(t):
    return len((t or "").split())


def water(sizes):
    """Targets by the stated rule: cap, share the excess by weight, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, got, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        rest = total - sum(got.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return got | share
        for s in over:
            got[s] = 2.0 * sizes[s]
            free.discard(s)


def some(draw, n=300):
    rows = []
    for i in range(n):
        source = draw.choice(["a", "a", "a", "b", "é", "Z", None])
        rows.append((i, draw.choice([None, "", " ", "w " * draw.randint(1, 60), "long " * draw.choice([1, 4000])]), source, "x"))
    return rows


def test_report_is_right_in_every_column(spark):
    rows = some(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mix_report(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = water(sizes)
    source = {i: s for i, _, s, _ in rows}
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (words(rows[r.doc_id][1]), sizes[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert taken == {s: int(want[s] + 0.5 + 1e-9) for s in sizes}
    again = M.mix_report(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_a_source_that_stops_passes_its_excess_on(spark):
    rows = [(1, "w " * 10, "a", ""), (2, "w " * 1000, "b", ""), (3, "w " * 500, "c", "")]
    got = {r.doc_id: r for r in M.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].target == 20 and got[1].taken == 20 and got[2].target <= 2000
    assert sum(r.target for r in got.values()) == pytest.approx(1.5 * 1510)


def test_empty_and_wordless_tables(spark):
    assert M.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = M.mix_report(spark.createDataFrame([(1, None, None, ""), (1, "", "a", "")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_repeated_rows_are_mixed_like_others(spark):
    rows = [(i % 5, "w " * 7, "a", "") for i in range(40)] + [(None, "w " * 7, "a", "")]
    got = M.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 41 and sum(r.taken for r in got) == 431 and all(r.taken <= 14 for r in got)


def test_the_mix_holds_what_the_report_says(spark):
    rows = some(random.Random(2), 120)
    df = spark.createDataFrame(rows, SCHEMA)
    report = {r.doc_id: r.taken for r in M.mix_report(df).collect()}
    mix = M.mixed(df)
    assert mix.select("row.*").columns == df.columns
    got = dict.fromkeys(report, 0)
    for r in mix.collect():
        got[r.row.doc_id] += words(r.row.text)
        assert 0 <= r.shard < M.SHARDS
    assert got == report


def test_tree_quotas_add_up_and_halve_fairly(spark):
    quotas = [(0, 900), (1, 0), (2, 37), (3, 4000), (4, 1)]
    df = spark.createDataFrame(quotas, "place int, quota long")
    got = M.split_tree(df, 16).collect()
    for place, quota in quotas:
        mine = sorted((r.shard, r.quota, r.first) for r in got if r.place == place)
        assert len(mine) == 16 and sum(q for _, q, _ in mine) == quota
        assert [f for _, _, f in mine] == [sum(q for _, q, _ in mine[:i]) for i in range(16)]
    total = sum(q for _, q in quotas)
    shards = [sum(r.quota for r in got if r.shard == s) for s in range(16)]
    assert all(abs(s - total / 16) <= 4 for s in shards)


@pytest.mark.parametrize("total, marked, drawn", [(10, 3, 4), (50, 25, 25), (4000, 900, 2000), (20000, 10, 19000)])
def test_draws_follow_the_hypergeometric_law(spark, total, marked, drawn):
    n = 4000
    u = (F.col("id") + 0.5) / n  # every quantile once
    x = M.hypergeometric(F.lit(total).cast("long"), F.lit(marked).cast("long"), F.lit(drawn).cast("long"), u)
    got = sorted(r.x for r in spark.range(n).select(x.alias("x")).collect())
    import math

    low, high = max(0, drawn + marked - total), min(drawn, marked)
    lf = math.lgamma
    def logc(a, b): return lf(a + 1) - lf(b + 1) - lf(a - b + 1)
    cum, want, k = 0.0, [], low
    cdf = []
    for k in range(low, high + 1):
        cum += math.exp(logc(marked, k) + logc(total - marked, drawn - k) - logc(total, drawn))
        cdf.append(cum)
    for i in range(n):
        want.append(low + next((j for j, c in enumerate(cdf) if c > (i + 0.5) / n), len(cdf) - 1))
    assert sum(a != b for a, b in zip(got, want)) <= 2 and low <= got[0] <= got[-1] <= high


def test_native_plan(spark):
    plan = M.mix_report(spark.createDataFrame([(1, "a", "b", "")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_digest_is_plain_md5(spark):
    got = spark.range(1).select(M.digest(F.lit("row"), F.lit("7")).alias("d")).first().d
    assert got == hashlib.md5(b"row:7").hexdigest()
