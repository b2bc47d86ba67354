"""Top-k search against comparing everything."""

import math
import random

from quillmill.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, score string"


def whole(v):
    return [math.floor(256 * float(x)) for x in v]


def plain(queries, rows, k):
    out = []
    fine = [(i, tuple(v)) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    for qi, qv in {(i, tuple(v)) for i, v in queries if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}:
        found = sorted((-sum(a * b for a, b in zip(whole(qv), whole(v))), i) for i, v in fine if i != qi)[:k]
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, k=5, **more):
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], SCHEMA)
    got = T.top_k(df.where("vec_id % 50 = 0"), df, k, **more)
    return sorted(map(tuple, got.collect())), got


def test_all_scores(spark, monkeypatch):
    monkeypatch.setattr(T, "TILE", 64)
    monkeypatch.setattr(T, "QUERY_TILE", 2)
    draw = random.Random(1)
    rows = [(i, [draw.choice([-0.5, 0.25, draw.gauss(0, 0.2), 0.0]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.25] * 6) for i in range(20)]  # ties
    rows += [(i, None) for i in (450, 7000)] + [(451, [None] * 6), (500, [float("nan")] + [0.0] * 5), (452, [float("inf")] * 6)]
    rows += rows[:30]  # repeated rows
    for shards in (None, 3, 70):
        got, df = run(spark, rows, shards=shards)
        assert got == plain([r for r in rows if r[0] % 50 == 0], rows, 5)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_few_candidates_and_none(spark):
    got, _ = run(spark, [(0, [1.0]), (50, [2.0]), (3, [-1.0])])
    assert got == plain([(0, [1.0]), (50, [2.0])], [(0, [1.0]), (50, [2.0]), (3, [-1.0])], 5)
    assert run(spark, [(0, [1.0])])[0] == []
    assert run(spark, [])[0] == []


def test_large_components_stay_exact(spark):
    rows = [(0, [5.0e6, 1.0]), (1, [5.0e6, -1.0]), (2, [5.0e6, 1.0]), (3, [1.0e30, 0.0])]
    got, _ = run(spark, rows, 3)
    scores = {v: s for _, _, v, s in got}
    assert scores[2] - scores[1] == 2 * 256 * 256 and scores[3] == (1 << 63) - 1


def test_lengths_differ_and_are_filled_with_zeros(spark):
    got, _ = run(spark, [(0, [1.0, 1.0]), (1, [1.0]), (2, [1.0, 1.0, 9.0]), (3, [])], 5)
    assert {(v, s) for _, _, v, s in got} == {(1, 65536), (2, 131072), (3, 0)}


def test_repeated_rows_are_candidates_each_as_in_sql(spark, tmp_path):
    import duckdb

    from quillmill.llm.suite import SQL

    rows = [(50, [1.0, 0.5])] * 2 + [(1, [0.5, 0.5])] * 2 + [(1, [0.25, 0.5]), (2, [0.1, 0.2]), (100, [0.3, 0.1]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({SQL['op7_exact_top_k']})").fetchall())
    assert sorted(map(tuple, T.top_k(df.where("vec_id % 50 = 0"), df).collect())) == want
    assert [r[1:3] for r in want if r[0] == 50] == [(1, 1), (2, 1), (3, 1), (4, 100), (5, 2)]


def test_candidates_are_packed_where_they_are_read(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0 * i]) for i in range(200)], "vec_id long, embedding array<float>")
    packed = T.tiles(T.usable(df, "embedding"), "vec_id", "embedding", 64, "c")
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
