"""The plans that matter at scale: shuffles, pruning, and skewed keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions.skew import spread_join
from quillmill.operators import analytics, dedup, logs, ranking
from quillmill.plans import pipelines as p
from quillmill.sources import derived, readers, writers
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def raw(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("op", [ranking.rank_tfidf, ranking.rank_tfidf_plain, ranking.condense, dedup.drop_redundant,
                                dedup.drop_redundant_plain], ids=lambda f: f.__name__)
def test_ranked_jobs_shuffle_the_text_once(raw, op):
    text = plan(op(raw))
    assert text.count("Exchange") == 1 and "Join" not in text and "FileScan" in text and text.count("FileScan") == 1


@pytest.mark.parametrize("stages", [p.STANDARD, p.DENSE], ids=["standard", "dense"])
def test_chains_shuffle_the_text_once(raw, stages):
    text = plan(p.run_stages(raw, stages))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1 and "Join" not in text


def test_row_local_jobs_do_not_shuffle(raw):
    for df in (p.run_stages(raw, p.WEIGHT), p.run_stages(raw, p.CODE), p.compress_by_content(raw), ranking.keep_signal(raw), ranking.keep_chunks(raw)):
        assert "Exchange" not in plan(df)


def test_audit_scan_prunes_partitions_and_columns(spark, tmp_path):
    from quillmill.sources import derived
    path = str(tmp_path / "audit")
    writers.write_audit(derived.audit(spark, SMALL), path)
    week = readers.read_audit(spark, path, org=3, since=dt.datetime(2024, 1, 20))
    text = plan(analytics.summary(week))
    assert "PartitionFilters: [isnotnull(organization_id" in text and "day#" in text.split("PartitionFilters")[1].split("]")[0]
    assert "payload" not in text.split("ReadSchema")[1]
    events = spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert readers.read_audit(spark, path).count() == events
    writers.write_audit(derived.audit(spark, SMALL).limit(10), path)
    assert readers.read_audit(spark, path).count() == events + 10


def test_page_is_a_top_k_and_pages_cover_everything(spark):
    rows = spark.range(95).select(F.col("id"), F.timestamp_seconds(F.col("id") % 7).alias("timestamp"))
    page = analytics.page_of(rows, 2, 10)
    assert "TakeOrderedAndProject" in plan(page)
    got = [r["id"] for n in range(1, 11) for r in analytics.page_of(rows, n, 10).collect()]
    assert sorted(got) == list(range(95)) and len(set(got)) == 95
    assert analytics.page_bounds(0, 5) == (1, 10) and analytics.page_bounds(3, 999) == (3, 200)


def test_log_window_is_limited_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, i, f"WARN row {i}") for i in range(20)], "doc_id int, pos int, line string")
    assert "WindowGroupLimit" in plan(logs.first_warnings(rows)) and "WindowGroupLimit" in plan(logs.top_errors(rows))


def test_spread_join_can_keep_a_repeated_side_from_the_driver(spark):
    big = spark.range(10).select("id", (F.col("id") % 3).alias("k"))
    small = spark.range(0, 400_000, 1, 2).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    plan = spread_join(big, small, ["k"], "id", "left", merge=True)._jdf.queryExecution().sparkPlan().toString()
    # 6.4 MB are below the broadcast limit, sixteen times that are not.
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_spread_join_equals_join_on_a_hot_key(spark):
    rng = random.Random(1)
    big = spark.createDataFrame([(i, 7 if rng.random() < 0.6 else rng.randint(0, 40)) for i in range(3000)], "id long, k int")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(30)], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = spread_join(big, small, ["k"], "id", how).collect()
        b = big.join(small, "k", how).collect()
        assert sorted(map(tuple, (r.asDict().items() for r in a)), key=str) == sorted(
            map(tuple, (r.asDict().items() for r in b)), key=str) or {tuple(sorted(r.asDict().items(), key=str)) for r in a} == {
            tuple(sorted(r.asDict().items(), key=str)) for r in b}
        assert len(a) == len(b)
    with pytest.raises(ValueError):
        spread_join(big, small, ["k"], "id", "full")


def test_copied_sentences_do_not_pair_up(docs, texts_of):
    """One sentence makes up most of a long document; the result is whole and quick."""
    text = " ".join(["The same line again and again."] * 4000 + [f"Line number {i} says thing{i} and word{i}." for i in range(200)])
    out = texts_of(dedup.drop_redundant(docs(text)))[0]
    assert out.count("The same line") == 1 and "thing199" in out


def test_templated_document(docs, texts_of):
    """Every sentence shares most words, so any list of earlier holders would be quadratic."""
    text = " ".join(f"Line number says thing{i} and word{i} here today again." for i in range(6000))
    out = texts_of(dedup.drop_redundant(docs(text)))[0]
    assert out == "Line number says thing0 and word0 here today again."


def test_near_copies_with_a_hot_bucket(spark):
    """A third of the documents are near copies of one another; each gets an original."""
    base = [f"token{i}" for i in range(80)]
    near = [(i, " ".join(base[:79] + [f"extra{i}"])) for i in range(300)]
    other = [(1000 + i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(600)]
    got = {r["doc_id"]: r["original"] for r in dedup.near_copies(spark.createDataFrame(near + other, "doc_id long, text string")).collect()}
    assert set(got) <= set(range(300)) and all(o < d for d, o in got.items()) and len(got) >= 290


def test_documents_from_text_and_json(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "a.txt").write_text("one\ntwo")
    got = readers.read_documents(spark, str(tmp_path / "txt"), "text").collect()
    assert [r["text"] for r in got] == ["one\ntwo"] and got[0]["doc_id"].endswith("a.txt")
    (tmp_path / "r.json").write_text('{"request_id": 1, "messages": [{"role": "user", "content": "x"}]}\n')
    r = readers.read_requests(spark, str(tmp_path / "r.json")).collect()[0]
    assert r["temperature"] == 0.7 and r["stream"] is False and r["messages"][0]["content"] == "x"
    with pytest.raises(ValueError):
        readers.read_documents(spark, "x", "pdf")


def test_empty_tables(spark):
    audit = readers.table(spark, SMALL, "events").limit(0).select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.lit(1).alias("organization_id"), F.lit(1).alias("tokens_original"),
        F.lit(1).alias("tokens_compressed"), F.lit(1).alias("latency_ms"), F.lit("s").alias("status"),
        F.lit(0).cast("decimal(10,6)").alias("cost_actual"), F.lit(0).cast("decimal(10,6)").alias("cost_saved"))
    r = analytics.summary(audit).collect()[0]
    assert (r["total_requests"], r["total_tokens_in"], r["avg_compression_pct"], r["avg_latency_ms"]) == (0, 0, 0.0, 0)
    assert analytics.page_counts(audit).collect()[0]["total_pages"] == 1
    assert analytics.telemetry(audit).collect()[0]["request_count"] == 0


def test_audit_texts_meet_events_last(spark, tmp_path):
    """The join of the payloads is the outermost, so no later join moves a text once per event."""
    spark.createDataFrame([(0, "a b the"), (1, "c"), (2, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 3), i % 2, "click", 1.0) for i in range(9)],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, 5), (1, 6)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    rows = derived.audit(spark, str(tmp_path))
    top = next(x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in x or "Join " in x)
    assert "doc_id" in top and "event_id" not in top
    hits = {r["id"]: r["cache_hit"] for r in rows.collect()}
    # First uses of a payload: ids 0 and 4 in one organization, 3 and 1 in the other; documents 1 and 2 share a payload.
    assert {i for i, hit in hits.items() if not hit} == {0, 3, 1, 4} and len(hits) == 9


def test_matrix_makes_its_texts_once(spark):
    """Branches read stored texts: what made them is not repeated per algorithm."""
    made = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("x = 1  # "), F.md5(F.col("id").cast("string"))).alias("text"))
    rows = p.algorithm_matrix(made, ["whitespace", "regex", "minifier"])
    assert "md5" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["algorithm"], r["documents"]) for r in rows.collect()} == {(n, 20) for n in ("whitespace", "regex", "minifier")}
