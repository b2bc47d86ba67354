"""Exact deduplication against grouping by text, and the index over several batches."""

import hashlib
from collections import defaultdict

from quillmill.llm import digest_index as D

SCHEMA = "doc_id long, text string, digest string, mark string, row int"


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ids[0], len(ids), p == 0, sha) for p, i in enumerate(ids)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "m", 7) for i, t in rows], SCHEMA).repartition(3)


def test_report_equals_grouping(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(None, "text 1"), (None, "alone"), (None, None), (5, ""), (9, None)]
    rows += [(300 + i, "copied everywhere") for i in range(400)]  # two thirds of all rows
    rows += [(3, "text 3")] * 3 + [(8, "é" * 1_000_000), (7, "é" * 1_000_000), (900, "a\n"), (901, "a")]
    got = D.dedup_report(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    stays = D.deduplicated(frame(spark, rows))
    assert stays.columns == ["doc_id", "text", "digest", "mark", "row"]
    assert sorted(((r.doc_id, r.text or "") for r in stays.collect()), key=repr) == sorted(
        ((r[0], next(t or "" for i, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == r[4])) for r in plain(rows) if r[3]), key=repr)


def test_empty_table(spark):
    assert D.dedup_report(frame(spark, [])).count() == 0
    assert D.deduplicated(frame(spark, [])).count() == 0


def test_later_batches_meet_the_index(spark, tmp_path):
    index = D.DigestIndex(spark, path=f"{tmp_path}/index", buckets=4)
    one, two = [(i, f"t{i % 5}") for i in range(20)], [(i, f"t{i % 8}") for i in range(100, 140)]
    first = D.dedup_report(frame(spark, one), index)
    assert sorted(r.doc_id for r in first.collect() if r.kept) == [15, 16, 17, 18, 19]
    second = {r.doc_id: r for r in D.dedup_report(frame(spark, two), index).collect()}
    assert {i for i, r in second.items() if r.kept} == {133, 134, 135}  # t5 to t7 are new
    assert second[104].keep_id == 15 and not second[104].kept  # 104 % 8 is 0, and 15 was the last t0
    assert sorted(r.doc_id for r in D.deduplicated(frame(spark, [(1, "t1"), (2, "new"), (3, "new")]), index).collect()) == [3]
    # A later session opens the same files under the same name.
    spark.catalog.refreshTable(index.name)
    spark.sql(f"DROP TABLE {index.name}")
    again = D.DigestIndex(spark, index.name, f"{tmp_path}/index", 4)
    assert again.entries().count() == 9
    small = again.compacted(f"{index.name}_c", f"{tmp_path}/compact")
    assert small.entries().count() == 9 and len(list((tmp_path / "compact").glob("*.parquet"))) <= 4


def test_index_side_does_not_move(spark, tmp_path):
    index = D.DigestIndex(spark, path=f"{tmp_path}/index", buckets=4)
    rows = D.marked_digests(frame(spark, [(i, f"t{i}") for i in range(50)]), f"{tmp_path}/rows")
    index.add(rows)
    fresh = rows.groupBy("digest").count().join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan
    assert "Python" not in plan and "Arrow" not in plan
    index.add(rows)
    assert index.entries().count() == 50  # adding a batch again changes nothing
