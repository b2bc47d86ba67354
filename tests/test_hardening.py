"""Inputs that must not end a job, lose rows or be cut."""

import json
import uuid

from pyspark.sql import functions as F

from quillmill.operators import dedup, ranking
from quillmill.operators import security as sec
from quillmill.sources.readers import read_audit
from quillmill.streaming import live


def test_long_runs_of_title_words(docs):
    text = " ".join(["Alpha Beta"] * 50_000) + ". Another one. And one more here."
    df = docs(text, "Foo Bar1 baz")
    assert ranking.keep_anchored(df).count() == 2
    hits = {(r.doc_id, r.anchor): r.hits for r in ranking.anchor_inventory(df).collect()}
    assert hits[0, "proper_noun"] >= 1 and hits[1, "proper_noun"] == 1
    assert ranking.keep_chunks(df).count() == 2


def test_rows_with_one_id_stay_apart(spark):
    texts = ["First words are here. Second words are there. Third words are everywhere. Fourth words go home.",
             "Rain falls on roofs. Snow falls on hills. Wind blows over seas. Sun shines on fields."]
    df = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0])], "doc_id long, text string")
    alone = {t: r for t in texts for r in [spark.createDataFrame([(1, t)], "doc_id long, text string")]}
    for run in (dedup.drop_redundant, dedup.drop_redundant_plain, ranking.rank_tfidf, ranking.rank_tfidf_plain, ranking.condense):
        want = sorted([run(alone[t]).first().text_out for t in texts] + [run(alone[texts[0]]).first().text_out])
        assert sorted(r.text_out for r in run(df).collect()) == want, run.__name__


def test_patterns_the_engine_rejects(spark):
    tools = spark.createDataFrame([(1, 1, "t", "(?P<a>secret)\n(\nsecret"), (2, 1, "u", "(?P<a>x)")],
                                  "tool_id long, organization_id int, tool_name string, blocked_patterns string")
    assert sorted(sec.rejected_lines(tools)) == ["(", "(?P<a>secret)", "(?P<a>x)"]
    calls = spark.createDataFrame([(7, 1, "t", {"p": "a secret"}), (8, 1, "u", {"p": "x"})],
                                  "call_id long, organization_id int, tool_name string, params map<string,string>")
    assert [(r.call_id, r.first_violation) for r in sec.policy_scan(calls, tools).collect()] == [(7, "secret")]


def test_deep_json(spark):
    value, path = "x", "$"
    for i in range(12):
        value, path = {"k": value, "s": "}{[\\"}, path + ".k"
    df = spark.createDataFrame([(1, json.dumps(value)), (2, None), (3, "no json"), (4, "[]")], "call_id long, params_json string")
    got = sec.flatten_params(df).collect()
    assert (1, path, "x") in [tuple(r) for r in got] and sum(r.call_id == 1 for r in got) == 13


def chunk_rows(request, parts):
    """Chunks as they come on the wire: a role, texts, an empty one, the end marker (None)."""
    bodies = ["[DONE]" if p is None else json.dumps({"choices": [{"delta": p}]}) for p in parts]
    return [(request, i, "openai", f"data: {b}") for i, b in enumerate(bodies)]


def test_streams_assemble_what_the_batch_form_does(spark, tmp_path):
    rows = chunk_rows(1, [{"role": "assistant"}, {"content": "hi "}, {"content": "you"}, {}, None])
    rows += chunk_rows(2, [{"content": "a"}, {"content": "b"}, None]) + chunk_rows(2, [{"content": "a"}])
    df = spark.createDataFrame(rows, "request_id long, seq int, provider string, raw string").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    from quillmill import schema

    names = [f.name for f in schema.CHUNK.fields]
    assert set(names) <= set(df.columns), names
    path = str(tmp_path / "chunks")
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.CHUNK.fields]).write.parquet(path)
    stream = live.reassemble(spark.readStream.schema(schema.CHUNK).parquet(path))
    out = str(tmp_path / "out")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark"))
     .trigger(availableNow=True).start().awaitTermination())
    want = sorted(tuple(r) for r in live.reassemble_batch(spark.read.parquet(path)).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want
    assert [(r[0], r[2], r[4]) for r in want] == [(1, "hi you", True), (2, "ab", True)]


def test_two_streams_into_one_table(spark, tmp_path):
    path, run = str(tmp_path / "fact"), uuid.uuid4().hex
    for name in ("one", "two"):
        source = str(tmp_path / name)
        spark.range(5).select("id", F.lit("2024-01-01 10:00:00").cast("timestamp").alias("timestamp"), F.lit(1).alias("organization_id")).write.parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        for _ in range(2):  # a second start finds nothing new
            live.append_audit(stream, path, f"{run}-{name}").start().awaitTermination()
    assert read_audit(spark, path).count() == 10 and read_audit(spark, path, org=1).count() == 10
