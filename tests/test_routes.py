import math

import numpy as np
from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.operators import promptcache as pc
from quillmill.operators import routing as r
from quillmill.operators.nearest import best_pairs, nearest, pack_cells


def test_content_class(docs):
    rows = r.classify(docs("Please explain the plan. It is a good one.", "def f(x):\n    return {x: [1]};\n", "", "zzz")).orderBy("doc_id").collect()
    assert [(x["content_type"], x["confidence"]) for x in rows][2:] == [("nlc", 1.0), ("nlc", 0.5)]
    assert [x["content_type"] for x in rows][:2] == ["nlc", "cac"]


def test_flags(one):
    assert one(r.is_stack_trace, 'Traceback (most recent call last)\n  File "a.py", line 3\nValueError: x', "ValueError: x") == [True, False]
    log = "\n".join(["2024-01-01 x"] * 3 + ["plain"] * 3)
    assert one(r.is_log_dump, log, "2024-01-01 x", "a\nb\nc\nd\ne") == [True, False, False]
    assert one(r.guess_language, "def f():\n  pass", "const x = 1; let y", "hello") == ["python", "javascript", "generic"]
    assert one(r.is_complex, "prove it", "improve it", "say [heavy] now", "w " * 2001) == [True, False, True, True]
    assert one(r.confidence, "", "I think maybe so", "sure", "I don't know " * 5) == [0.0, 0.7, 1.0, 0.0]
    assert one(r.detect_region, "5.28.1.1", "46.211.0.1", "51.1.1.1", "9.9.9.9") == ["eu-central", "eu-central", "eu-west", "eu-central"]


def test_cascade_replay(spark):
    req = spark.createDataFrame([
        (1, 1, "calculate this", "a", "H"), (2, 1, "hi", "certain", "H"), (3, 1, "hi", "maybe perhaps possibly", "H"),
        (4, 2, "hi", "maybe perhaps possibly", "H"), (5, 3, "hi", "x", "H"), (6, 4, "prove", "ok", "H")],
        "request_id int, organization_id int, prompt string, cheap_response string, heavy_response string")
    conf = spark.createDataFrame([(1, 0.7, True, 1, 2), (2, 0.7, True, 1, None), (3, 0.7, False, 1, 2), (4, 0.9, True, 1, None)],
                                 "organization_id int, confidence_threshold double, is_active boolean, cheap_provider_id int, heavyweight_provider_id int")
    got = {x["request_id"]: (x["decision"], x["escalated"], x["final_text"]) for x in r.cascade_replay(req, conf).collect()}
    assert got == {1: ("direct_to_heavy", None, "H"), 2: ("cheap", False, "certain"), 3: ("escalated", True, "H"),
                   4: ("cheap_low_confidence", True, "maybe perhaps possibly"), 5: ("unrouted", None, ""), 6: ("cheap", False, "ok")}


def test_tier(docs):
    rows = r.decide_tier(docs("a proof of the theorem", "hello", "x" * 2400)).orderBy("doc_id").collect()
    assert [x["tier"] for x in rows] == [2, 1, 2]
    assert rows[0]["reason"] == "Complexity signals: ['proof', 'theorem']" and rows[2]["reason"] == "Token count 600 > threshold 500"
    assert len(vocab.TIER_SIGNALS) == 14 and len(vocab.TIER_SIGNALS_LONG) == 15


def test_edge_assignment(spark):
    nodes = spark.createDataFrame([(1, "a", "eu", 50.0, True), (2, "b", "eu", 10.0, True), (3, "c", "us", 1.0, True), (4, "d", "eu", 5.0, False)],
                                  "node_id int, node_name string, data_sovereignty_zone string, current_load_pct double, is_active boolean")
    rules = spark.createDataFrame([(1, "eu-central", 1, 7, 1, True), (2, "eu-central", 3, 7, 9, True), (3, "eu-central", 2, None, 1, True),
                                   (4, "eu-west", 3, None, 1, True), (5, "eu-central", 4, 8, 1, True)],
                                  "rule_id int, source_region string, target_node_id int, organization_id int, priority int, is_active boolean")
    clients = spark.createDataFrame([(1, 7, "5.28.0.1"), (2, 9, "5.28.0.1"), (3, 9, "51.0.0.1"), (4, 8, "5.28.0.1")],
                                    "request_id int, organization_id int, client_ip string")
    got = {x["request_id"]: (x["node_id"], x["scope"]) for x in r.assign_edge_nodes(clients, rules, nodes).collect()}
    assert got == {1: (1, "organization"), 2: (2, "global"), 3: (2, "fallback"), 4: (2, "fallback")}
    loose = {x["request_id"]: x["node_id"] for x in r.assign_edge_nodes(clients, rules, nodes, require_eu=False).collect()}
    assert loose == {1: 3, 2: 2, 3: 3, 4: None}
    report = {x["request_id"]: x["gdpr_compliant"] for x in r.compliance_report(r.assign_edge_nodes(clients, rules, nodes, False), nodes).collect()}
    assert report == {1: False, 2: True, 3: False, 4: False}


def test_provider_resolution(spark):
    req = spark.createDataFrame([(1, 1, 1, True), (2, 2, 1, True), (3, 2, 1, False), (4, 3, 2, False), (5, 3, 3, False), (6, 4, 1, False)],
                                "request_id int, api_key_id int, organization_id int, complex boolean")
    keys = spark.createDataFrame([(1, 30), (2, None), (3, None), (4, 99)], "api_key_id int, linked_provider_id int")
    conf = spark.createDataFrame([(1, True, 10, 20)], "organization_id int, is_active boolean, cheap_provider_id int, heavyweight_provider_id int")
    prov = spark.createDataFrame([(10, 1, True, False), (20, 1, True, False), (30, 1, True, False), (40, 2, True, True), (50, 3, False, True)],
                                 "provider_id int, organization_id int, is_active boolean, is_default boolean")
    got = {x["request_id"]: (x["provider_id"], x["resolution"]) for x in r.resolve_provider(req, keys, conf, prov).collect()}
    assert got == {1: (30, "linked"), 2: (20, "heavy"), 3: (10, "cheap"), 4: (40, "default"), 5: (None, "unresolved"), 6: (10, "any")}


def test_fingerprint_and_query_text(spark):
    df = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b"), ("user", "c")]), (2, [("assistant", "x"), ("system", "y")]), (3, [("user", "a"), ("assistant", "b"), ("user", "c")])],
                               "id int, messages array<struct<role:string,content:string>>")
    rows = df.select("id", pc.fingerprint("messages").alias("h"), pc.query_text("messages").alias("q")).orderBy("id").collect()
    assert rows[0]["h"] == rows[2]["h"] != rows[1]["h"]
    assert [x["q"] for x in rows] == ["c", "x y", "c"]


def test_embedding(docs):
    rows = {x["doc_id"]: x["embedding"] for x in pc.embed(docs("Hello world", "hello WORLD", "ab", "", "another text"), "doc_id", "text").collect()}
    assert len(rows) == 5 and all(len(v) == 128 for v in rows.values())
    assert rows[0] == rows[1] != rows[4]
    assert math.isclose(sum(x * x for x in rows[0]), 1.0) and not any(rows[2]) and not any(rows[3])


def _vectors(spark, rng, n, dims=12, hot=0.0):
    centres = rng.normal(size=(6, dims))
    which = np.where(rng.random(n) < hot, 0, rng.integers(0, 6, n))
    v = centres[which] + rng.normal(scale=0.25, size=(n, dims))
    v[3] = 0
    g = rng.integers(0, 3, n)
    return v, g, spark.createDataFrame([(int(i), int(g[i]), [float(x) for x in v[i]]) for i in range(n)], "id long, g int, embedding array<double>")


def _exact(v, g, k, least, by_group):
    norm = np.linalg.norm(v, axis=1)
    unit = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)
    sim = unit @ unit.T
    want = {}
    for i in range(len(v)):
        ok = [j for j in range(len(v)) if j != i and norm[i] > 0 and norm[j] > 0 and sim[i, j] >= least and (not by_group or g[i] == g[j])]
        want[i] = sorted(ok, key=lambda j: (-round(sim[i, j], 12), j))[:k]
    return want


def test_nearest_is_exact_also_when_one_cell_is_hot(spark):
    rng = np.random.default_rng(4)
    for hot, least, group in ((0.0, 0.85, ["g"]), (0.7, 0.9, []), (0.5, -1.0, ["g"])):
        v, g, df = _vectors(spark, rng, 220, hot=hot)
        entries = df.select(F.col("id").alias("eid_"), *group, "embedding")
        got = nearest(df.select("id", *group, "embedding"), entries, "id", "eid_", group, k=4, least=least, skip_self=True, block=16)
        found = {i: [] for i in range(len(v))}
        for row in got.orderBy("id", "rank").collect():
            found[row["id"]].append(row["eid_"])
        assert found == _exact(v, g, 4, least, bool(group))


def test_nearest_without_entries(spark):
    empty = spark.createDataFrame([], "eid long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert nearest(q, empty, "id", "eid", []).collect() == []


def test_semantic_acceptance(spark):
    entries = spark.createDataFrame([(1, 1, "m", [1.0, 0.0], 5000), (2, 1, "m", [0.9, 0.3], 10), (3, 2, "m", [1.0, 0.0], 5000), (4, 1, "other", [0.0, 1.0], 5000)],
                                    "entry_id long, organization_id int, embedding_model string, embedding array<double>, tokens_used int")
    q = spark.createDataFrame([(10, 1, "m", [0.99, 0.05]), (11, 1, "m", [0.9, 0.32]), (12, 1, "m", [0.0, 1.0]), (13, 3, "m", [1.0, 0.0])],
                              "query_id long, organization_id int, embedding_model string, embedding array<double>")
    got = {x["query_id"]: (x["entry_id"], x["accepted"]) for x in pc.semantic_lookup(q, entries).collect()}
    assert got == {10: (1, True), 11: (2, True)}
    cheap = entries.withColumn("tokens_used", F.lit(0))
    assert not any(x["accepted"] for x in pc.semantic_lookup(q, cheap).collect())


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [x[0] for x in df.select(pc.cosine("a", "b")).collect()]
    assert got[:3] == [1.0, 0.0, 0.0] and math.isclose(got[3], math.sqrt(0.5))


def test_replay_and_upsert(spark):
    log = spark.createDataFrame([(1, 1, "h", 5), (2, 1, "h", 3), (3, 1, "h", 9), (4, 2, "h", 1)], "id long, organization_id int, payload_hash string, timestamp long")
    got = {x["organization_id"]: (x["first_id"], x["hit_count"], x["last_hit_at"]) for x in pc.replay(log).collect()}
    assert got == {1: (2, 2, 9), 2: (4, 0, None)}
    old = spark.createDataFrame([(1, "a", "old", 3, 1), (1, "b", "keep", 1, 1)], "organization_id int, prompt_hash string, response_json string, hit_count long, created_at long")
    new = spark.createDataFrame([(1, "a", "new", 0, 2), (1, "a", "newest", 0, 4), (2, "a", "x", 0, 2)], "organization_id int, prompt_hash string, response_json string, hit_count long, created_at long")
    rows = {(x["organization_id"], x["prompt_hash"]): (x["response_json"], x["hit_count"]) for x in pc.upsert(old, new).collect()}
    assert rows == {(1, "a"): ("newest", 3), (1, "b"): ("keep", 1), (2, "a"): ("x", 0)}


def test_model_config(spark):
    df = spark.createDataFrame([("gemini", "gemini-1.5-pro"), ("gemini", "?"), ("deepseek", "?"), ("none", "?")], "family string, model string")
    got = [(x["config_model"], x["rpm"], x["rpd"]) for x in r.with_model_config(df).collect()]
    assert got == [("gemini-1.5-pro", 360, 10000), ("gemini-1.5-flash", 2000, None), ("deepseek-chat", 100, None), (None, None, None)]




def test_small_cells_share_a_pack(spark):
    cells = spark.createDataFrame([("g", c, 10) for c in range(32)] + [("h", 0, 250), ("h", 1, 5)], "grp string, cell int, n long")
    packs = {(r["grp"], r["cell"]): r["pack"] for r in pack_cells(cells, ["grp"], 100).collect()}
    assert [packs["g", c] for c in range(32)] == [c // 10 for c in range(32)] and packs["h", 0] == 0 and packs["h", 1] == 2


def test_best_pairs_takes_the_first_of_equal_values():
    sim = np.array([[0.9, 0.9 + 1e-14, 0.95, 0.1], [0.2, 0.1, 0.0, 0.3], [0.86, 0.85, 0.9, 0.9]])
    i, j = best_pairs(sim, 2, 0.85)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 2), (0, 0), (2, 2), (2, 3)]
    assert [len(best_pairs(sim, k, 0.85)[0]) for k in (1, 4, 9)] == [2, 7, 7]


def test_many_vectors_are_cut_into_few_blocks(spark):
    """32 cells of 50 entries: eight packs, where one after every hundred entries would be sixteen."""
    cells = spark.createDataFrame([("a", i, 50) for i in range(32)], "grp string, cell int, n int")
    assert pack_cells(cells, ["grp"], 100).agg(F.max("pack")).first()[0] == 7


def test_queries_stream_past_their_block_of_entries(spark):
    """Batches of seven rows end within entries and within queries; equal vectors tie, ids may be null."""
    rnd = np.random.default_rng(4)
    m = rnd.normal(size=(60, 5))
    m[30:40] = m[:10]
    rows = [(i if i != 17 else None, "g" if i % 3 else "h", m[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = nearest(df, df.withColumnRenamed("id", "eid_"), "id", "eid_", ["grp"], vector="v", k=3, least=0.3, block=8).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for i in (i for i in range(60) if i != 17):
        near = [((unit[i] @ unit[j]).round(12), -(j if j != 17 else 99), j) for j in range(60) if (i % 3 > 0) == (j % 3 > 0)]
        want |= {(i, j if j != 17 else None) for s, _, j in sorted(near, reverse=True)[:3] if s >= 0.3}
    assert {(r["id"], r["eid_"]) for r in found if r["id"] is not None} == want
