"""Whitening against numpy's singular vectors of the centred rows."""

import numpy as np
from pyspark.sql import functions as F

from quillmill.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component string, n string"
draw = np.random.default_rng(3)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k):
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(1024 * np.float32(v).astype(float)) + 100000 for _, v in fine]).astype(np.int64)
    n, total = len(x), x.sum(axis=0)
    a = x - total / n
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    e, u = s ** 2 / n, vt.T
    dev = [sum(int(n * c - s) ** 2 for c, s in zip(r.tolist(), total.tolist())) for r in x]
    dev = [d if d < 1 << 63 else None for d in dev]
    return {i: (n, d, w) for (i, _), d, w in zip(fine, dev, (a @ u[:, :k] / np.sqrt(e[:k])))}, e / e.sum()


def check(spark, rows, k=8):
    got = W.whiten(frame(spark, rows), k).collect()
    want, share = plain(rows, k)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, j) for i in want for j in range(1, k + 1))
    cell = {(r.vec_id, r.component): r.whitened for r in got}
    some = max(want, key=lambda i: np.abs(want[i][2]).min())
    sign = [np.sign(cell[some, j + 1] * want[some][2][j]) for j in range(k)]
    for r in got:
        n, dev, w = want[r.vec_id]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(r.whitened * sign[r.component - 1] - w[r.component - 1]) < 1e-8
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-8 and r.identity_error < 1e-9


def test_equals_singular_vectors(spark):
    rows = [(i, (draw.normal(size=12) * 1.5 ** -np.arange(12) + 3).tolist()) for i in range(300)]
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11)]
    check(spark, rows)
    check(spark, rows, 3)


def test_small_directions_keep_their_digits(spark):
    turned = np.linalg.qr(draw.normal(size=(9, 9)))[0]
    scale = 10.0 ** np.array([4, 4, 3, 3, 2, 2, 1, 0.5, 0]) * np.array([9, 2, 9, 2, 9, 2, 4, 2, 1])
    check(spark, [(i, (draw.normal(size=9) * scale @ turned).tolist()) for i in range(500)])


def test_directions_without_variance(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), float(i % 3)]) for i in range(50)]
    got = W.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    flat = [r for r in got if r.component == 3]
    assert all(r.whitened == 0 and r.explained == 0 and r.identity_error == 1 for r in flat)
    assert abs(sum(r.explained for r in got if r.vec_id == 1) - 1) < 1e-12
    same = W.whiten(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(same) == 6 and all(r.whitened == 0 and r.deviation == 0 and r.n == 3 for r in same)


def test_empty_and_uneven(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    uneven = [(i, draw.normal(size=3).tolist()[: 2 + i % 2]) for i in range(40)]
    full = [(i, v + [0.0] * (3 - len(v))) for i, v in uneven]
    rows = [[r.whitened for r in W.whiten(frame(spark, x)).orderBy("vec_id", "component").collect()] for x in (uneven, full)]
    assert np.allclose(*rows)
    big = W.whiten(frame(spark, [(i, [float(i) * 1e30, 1.0]) for i in range(-3, 4)]).withColumn("embedding", F.col("embedding")))
    assert big.where("deviation is null").count() > 0 and big.count() == 14


def test_sums_are_exact(spark):
    rows = frame(spark, [(i, [-5.5 * i, 1e9]) for i in range(1000)]).select(F.col("embedding").alias("vector"))
    n, total = W.sums(rows, 2)
    assert n == 1000 and total == [sum(int(np.floor(1024 * -5.5 * i)) + 100000 for i in range(1000)),
                                   1000 * (1024 * int(np.float32(1e9)) + 100000)]
