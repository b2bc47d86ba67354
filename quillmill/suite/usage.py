"""Sources, measures and usage analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import metrics as m
from quillmill.operators import analytics as a
from quillmill.operators import wordfilter
from quillmill.session import fresh_path
from quillmill.sources import derived as d
from quillmill.sources import readers, writers
from quillmill.sources.readers import documents, table
from quillmill.suite import sql as q

STOP = {
    "en": ["the", "and", "of", "to", "in", "that", "is"], "de": ["der", "die", "und", "das", "in", "zu"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "que"], "es": ["el", "la", "de", "que", "y", "en", "los"],
}
ALL_STOP = sorted({w for ws in STOP.values() for w in ws})

# The audit table by the same rules as sources/derived.py.
_FLAT = q.flat_filter("text", d.DATA_STOP_WORDS)


def _cost(prompt: str, output: str) -> str:
    return f"({prompt} * 0.0000001400::DECIMAL(20,10) + {output} * 0.0000002800::DECIMAL(20,10))::DECIMAL(30,10)"


AUDIT = f"""
payload AS (
  SELECT doc_id, text AS original_payload, c AS compressed_payload, {q.tokens('text')}::INT AS tokens_original,
         {q.tokens('c')}::INT AS tokens_compressed, strlen(text) AS data_bytes_in, strlen(c) AS data_bytes_out,
         sha256(text) AS payload_hash
  FROM (SELECT doc_id, text, {_FLAT} AS c FROM documents)),
audit0 AS (
  SELECT e.event_id AS id, e.ts AS "timestamp", e.user_id, e.user_id AS api_key_id, c.c_nationkey AS organization_id,
         CASE WHEN event_id % 10 <> 9 THEN e.user_id % 7 END AS ai_provider_id,
         CASE WHEN event_type IN ('click','error') THEN 'gateway' WHEN event_type = 'view' THEN 'dashboard'
              WHEN event_type = 'purchase' THEN 'api' ELSE 'simulate' END AS source,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         floor(value * 10)::INT AS tokens_response, floor(value * 100)::INT AS latency_ms, p.*
  FROM events e JOIN payload p ON p.doc_id = e.event_id % (SELECT count(*) FROM documents)
  LEFT JOIN customer c ON c.c_custkey = e.user_id),
audit AS (
  SELECT *, {q.pct('tokens_original', 'tokens_compressed')} AS compression_ratio,
         {_cost('tokens_original', 'tokens_response')}::DECIMAL(10,6) AS cost_original,
         {_cost('tokens_compressed', 'tokens_response')}::DECIMAL(10,6) AS cost_actual,
         greatest(0, ({_cost('tokens_original', 'tokens_response')}) - ({_cost('tokens_compressed', 'tokens_response')}))::DECIMAL(10,6) AS cost_saved,
         row_number() OVER (PARTITION BY organization_id, payload_hash ORDER BY "timestamp", id) > 1 AS cache_hit
  FROM audit0)"""
PROVIDERS = """
provider AS (SELECT s_suppkey AS provider_id, s_name AS provider_name,
  CASE WHEN s_suppkey % 10 <> 0 THEN s_nationkey END AS organization_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'gemini' ELSE 'anthropic' END AS provider_type,
  s_suppkey % 4 <> 3 AS is_active, s_suppkey % 6 = 1 AS is_default, s_suppkey % 10 = 0 AS is_system FROM supplier)"""
KEYS = """
api_key AS (SELECT c_custkey AS api_key_id, c_name AS key_name,
  CASE WHEN c_custkey % 13 = 5 THEN 'xx-' ELSE 'fk-' END || lpad(c_custkey::VARCHAR, 12, '0') AS key,
  c_nationkey AS organization_id, c_custkey AS user_id, c_custkey % 11 <> 3 AS is_active,
  (1 + c_custkey % 3)::INT AS rate_limit,
  (CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 2000 + (c_custkey % 5) * 1000 END)::BIGINT AS daily_token_limit,
  CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 7 END AS linked_provider_id FROM customer)"""
AS_OF = '(SELECT max("timestamp") FROM audit)'


def _since(days: int) -> str:
    return f'"timestamp" >= {AS_OF} - INTERVAL {days} DAYS'


def _money(c: str) -> str:
    return f"coalesce(sum({c}), 0)::DOUBLE"


def _dbl(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _newest(n: int, offset: int = 0) -> str:
    return f'(SELECT * FROM audit ORDER BY "timestamp" DESC, id DESC LIMIT {n} OFFSET {offset})'


SUMMARY = f"""count(*) AS total_requests, coalesce(sum(tokens_original), 0)::BIGINT AS total_tokens_in,
 coalesce(sum(tokens_compressed), 0)::BIGINT AS total_tokens_out,
 (coalesce(sum(tokens_original), 0) - coalesce(sum(tokens_compressed), 0))::BIGINT AS tokens_saved,
 {q.pct('sum(tokens_original)', 'sum(tokens_compressed)')} AS avg_compression_pct,
 {_money('cost_actual')} AS total_cost_usd, {_money('cost_saved')} AS total_cost_saved_usd,
 round(avg(coalesce(latency_ms, 0)), 0)::BIGINT AS avg_latency_ms,
 count(*) FILTER (status <> 'success') AS error_count"""


def _audit(s, sf):
    return d.audit(s, sf)


def _slim(s, sf):
    return d.audit(s, sf).select("id", "timestamp", "user_id", "api_key_id", "organization_id", "ai_provider_id", "source",
                                 "status", "tokens_original", "tokens_compressed", "tokens_response", "latency_ms",
                                 "cost_actual", "cost_saved", "cache_hit")


def stopword_savings(s, sf):
    docs = documents(s, sf)
    out = docs.withColumn("text_out", wordfilter.drop_stop_words(F.col("text"), ALL_STOP, []))
    return _dbl(a.language_savings(out, "lang"), "usd_saved")


def _roundtrip(s, sf):
    """Write audit rows, then scan one organization and a week back with partition pruning."""
    path = fresh_path(s, "audit-sink")
    rows = d.audit(s, sf)
    writers.write_audit(rows, path, mode="overwrite")
    import datetime as dt
    back = readers.read_audit(s, path, org=7, since=dt.datetime(2024, 1, 20))
    return back.groupBy("organization_id", "status").agg(
        F.count("*").alias("requests"), F.sum("tokens_original").alias("tokens"), F.min("timestamp").alias("first_ts"))


def _requests_json(s, sf):
    """Requests written as JSON lines, half of them without the optional fields, then read back."""
    path = fresh_path(s, "requests-json")
    req = d.requests(s, sf).select("request_id", F.lit("m").alias("model"), "messages",
                                   F.when(F.col("request_id") % 2 == 0, 0.3).alias("temperature"),
                                   F.when(F.col("request_id") % 3 == 0, True).alias("stream"))
    req.write.mode("overwrite").json(path)
    return readers.read_requests(s, path).select(
        "request_id", "temperature", "stream", F.size("messages").alias("messages"),
        F.coalesce(F.element_at("messages", -1)["content"], F.lit("")).alias("last_content"))


def _documents_json(s, sf):
    path = fresh_path(s, "documents-json")
    table(s, sf, "documents").select("doc_id", "text").write.mode("overwrite").json(path)
    return readers.read_documents(s, path, "json").select("doc_id", *m.payload_profile("text"))


def _turns(s, sf):
    r = d.requests(s, sf)
    roles = F.array_join(F.transform("messages", lambda x: x["role"]), ",")
    return r.select("request_id", F.size("messages").alias("messages"), roles.alias("roles"),
                    F.md5(F.array_join(F.transform("messages", lambda x: x["content"]), "|")).alias("history_md5"),
                    F.md5("response").alias("response_md5"))


def _export(s, sf):
    path = fresh_path(s, "report")
    writers.export_report(d.audit(s, sf), 30, path, "parquet")
    return _dbl(s.read.parquet(path), "cost", "cost_saved")


def _simulation(s, sf):
    docs = documents(s, sf).withColumn("text_out", wordfilter.drop_stop_words_flat(F.col("text"), d.DATA_STOP_WORDS))
    sim = writers.simulation_audit(docs.withColumn("tier", F.when(m.est_tokens("text_out") > 500, 2).otherwise(1)), 1)
    return _dbl(sim.withColumns({"original_payload": F.md5("original_payload"),
                                 "compressed_payload": F.md5("compressed_payload")}),
                "cost_original", "cost_actual", "cost_saved")


QUERIES = {
    "s1_s6_audit_write_and_scan": _roundtrip,
    "s2_request_ingest": _requests_json,
    "s3_requests_from_turns": _turns,
    "s4_document_ingest": _documents_json,
    "s5_visible_providers": lambda s, sf: readers.visible_to_org(d.providers(s, sf), 7),
    "s7_simulation_audit": _simulation,
    "s8_report_export": _export,
    "slice_stopword_savings": stopword_savings,
    "m1_m4_m6_audit_measures": lambda s, sf: _dbl(_audit(s, sf).select(
        "id", "organization_id", "ai_provider_id", "tokens_original", "tokens_compressed", "tokens_response",
        "compression_ratio", "cost_original", "cost_actual", "cost_saved", "data_bytes_in", "data_bytes_out",
        "cache_hit"), "cost_original", "cost_actual", "cost_saved"),
    "m1_token_variants": lambda s, sf: table(s, sf, "pages").select(
        "page_id", m.est_tokens("html").alias("tokens"),
        m.est_tokens(F.regexp_replace("html", r"<[^>]*>", ""), empty_zero=True).alias("tokens_rest")),
    "m3_ratio": lambda s, sf: _slim(s, sf).select("id", m.compression_ratio("tokens_original", "tokens_compressed").alias("ratio")),
    "m5_simulated_cost": lambda s, sf: _slim(s, sf).select("id", m.simulated_cost(
        "tokens_original", F.when(F.col("tokens_original") > 500, 2).otherwise(1)).cast("double").alias("cost")),
    "m7_payload_profile": lambda s, sf: table(s, sf, "conversations").select("conv_id", "turn", *m.payload_profile("text")),
    "m8_preview": lambda s, sf: table(s, sf, "documents").select("doc_id", m.preview("text").alias("shown")),
    "m9_masked_keys": lambda s, sf: a.key_display(d.api_keys(s, sf)),
    "a1_request_counts": lambda s, sf: a.request_counts(_slim(s, sf)),
    "a2_token_totals": lambda s, sf: _dbl(a.token_totals(_slim(s, sf)), "cost_saved"),
    "a3_recent_requests": lambda s, sf: a.recent(_slim(s, sf), d.providers(s, sf)).select(
        "id", "timestamp", "status", "ai_provider_id", "provider_name", "tokens_original"),
    "a4_daily_rollup": lambda s, sf: _dbl(a.daily(_slim(s, sf), 60), "cost"),
    "a5_provider_usage": lambda s, sf: _dbl(a.provider_usage(_slim(s, sf), d.providers(s, sf), 7), "cost"),
    "a6_peak_hours": lambda s, sf: a.peak_hours(_slim(s, sf), 7),
    "a7_latency": lambda s, sf: a.latency(_slim(s, sf), 7),
    "a8_kpis": lambda s, sf: a.kpis(_slim(s, sf), 7),
    "a9_filtered_log": lambda s, sf: a.filtered(_slim(s, sf), days=14, status="success", source="gateway").select(
        "id", "organization_id", "source", "status"),
    "a10_page": lambda s, sf: a.page_of(_slim(s, sf), 3, 500).select("id", "timestamp"),
    "a10_page_counts": lambda s, sf: a.page_counts(_slim(s, sf), 50),
    "a11_summary_page": lambda s, sf: _dbl(a.summary(a.page_of(_slim(s, sf), 2, 50)), "total_cost_usd", "total_cost_saved_usd"),
    "a11_summary_full": lambda s, sf: _dbl(a.summary(_slim(s, sf), ["organization_id"]), "total_cost_usd", "total_cost_saved_usd"),
    "a12_per_key": lambda s, sf: _dbl(a.per_key(_slim(s, sf).withColumn(
        "api_key_id", F.when(F.col("id") % 20 != 3, F.col("api_key_id"))), d.api_keys(s, sf)), "cost"),
    "a13_per_provider": lambda s, sf: _dbl(a.per_provider(_slim(s, sf).withColumn(
        "tokens_compressed", F.when(F.col("id") % 4 != 0, F.col("tokens_compressed")).otherwise(0)), d.providers(s, sf)), "cost"),
    "a14_provider_share": lambda s, sf: a.provider_share(_slim(s, sf)),
    "a15_telemetry": lambda s, sf: a.telemetry(_slim(s, sf)),
    "a16_report": lambda s, sf: _dbl(a.report(_slim(s, sf), 14), "cost", "cost_saved"),
    "a17_audit_search": lambda s, sf: a.search(_audit(s, sf), "Releas", "success"),
    "a18_request_detail": lambda s, sf: a.details(_audit(s, sf)).withColumns(
        {"original_payload": F.md5("original_payload"), "compressed_payload": F.md5("compressed_payload")}),
    "a19_team_usage": lambda s, sf: a.team_usage(_slim(s, sf), d.users(s, sf), d.api_keys(s, sf)),
    "a20_provider_counters": lambda s, sf: a.provider_counters(_audit(s, sf)),
    "a22_efficiency_trail": lambda s, sf: _dbl(a.efficiency_trail(_slim(s, sf)), "cost_saved"),
    "a23_status_mix": lambda s, sf: a.status_mix(_slim(s, sf)),
    "n5_usage_rows": lambda s, sf: _dbl(a.usage_rows(_audit(s, sf)), "cost_actual", "cost_saved"),
}

_REPORT = f"""count(*) AS requests, sum(tokens_original)::BIGINT AS tokens_in, sum(tokens_compressed)::BIGINT AS tokens_out,
 sum(CASE WHEN tokens_compressed > 0 THEN tokens_compressed ELSE tokens_original END)::BIGINT AS tokens_billed,
 {_money('cost_actual')} AS cost, {_money('cost_saved')} AS cost_saved,
 {q.pct('sum(tokens_original)', 'sum(tokens_compressed)')} AS savings_pct"""
_HISTORY = """
req AS (SELECT conv_id * 1000 + turn AS request_id, conv_id, turn, text AS response,
  coalesce((SELECT list({'role': c.role, 'content': c.text} ORDER BY c.turn) FROM conversations c
            WHERE c.conv_id = x.conv_id AND c.turn < x.turn), []) AS messages
  FROM conversations x WHERE role = 'assistant')"""
_SIM_T0, _SIM_T1 = q.tokens("text"), q.tokens("c")

SQL = {
    "s1_s6_audit_write_and_scan": f"""WITH {AUDIT} SELECT organization_id, status, count(*) AS requests,
        sum(tokens_original)::BIGINT AS tokens, min("timestamp") AS first_ts FROM audit
        WHERE organization_id = 7 AND "timestamp" >= TIMESTAMP '2024-01-20' GROUP BY 1, 2""",
    "s2_request_ingest": f"""WITH {_HISTORY} SELECT request_id,
        CASE WHEN request_id % 2 = 0 THEN 0.3 ELSE 0.7 END::DOUBLE AS temperature, request_id % 3 = 0 AS stream,
        len(messages)::INT AS messages, coalesce(messages[-1].content, '') AS last_content FROM req""",
    "s3_requests_from_turns": f"""WITH {_HISTORY} SELECT request_id, len(messages)::INT AS messages,
        {q.join("list_transform(messages, lambda x: x.role)", "','")} AS roles,
        md5({q.join("list_transform(messages, lambda x: x.content)", "'|'")}) AS history_md5, md5(response) AS response_md5 FROM req""",
    "s4_document_ingest": f"""SELECT doc_id, {q.tokens('text')}::INT AS tokens, length(text)::INT AS chars,
        len({q.words('text')})::INT AS words FROM documents""",
    "s5_visible_providers": f"WITH {PROVIDERS} SELECT * FROM provider WHERE organization_id = 7 OR is_system",
    "s7_simulation_audit": f"""WITH x AS (SELECT *, {_SIM_T0} AS t0, {_SIM_T1} AS t1 FROM (SELECT doc_id, text, {_FLAT} AS c FROM documents))
        SELECT doc_id AS id, 1 AS organization_id, md5(substr(text, 1, 4000)) AS original_payload,
        md5(substr(c, 1, 4000)) AS compressed_payload, t0::INT AS tokens_original, t1::INT AS tokens_compressed,
        0 AS tokens_response, {q.pct('t0', 't1')} AS compression_ratio,
        (t0 * 0.0000005::DECIMAL(20,10))::DECIMAL(10,6)::DOUBLE AS cost_original,
        (t1 * CASE WHEN t1 > 500 THEN 0.000002 ELSE 0.0000005 END::DECIMAL(20,10))::DECIMAL(10,6)::DOUBLE AS cost_actual,
        (greatest(0, t0 - t1) * 0.0000005::DECIMAL(20,10))::DECIMAL(10,6)::DOUBLE AS cost_saved,
        'success' AS status, 'simulate' AS source, strlen(text) AS data_bytes_in, strlen(c) AS data_bytes_out FROM x""",
    "slice_stopword_savings": f"""WITH x AS (SELECT lang, {q.tokens('text')} AS t0, {q.tokens('c')} AS t1 FROM
        (SELECT lang, text, {q.stop_filter('text', ALL_STOP)} AS c FROM documents))
        SELECT lang, count(*) AS documents, sum(t0)::BIGINT AS tokens_before, sum(t1)::BIGINT AS tokens_after,
        sum((t0 - t1) * 0.0000001400::DECIMAL(20,10))::DOUBLE AS usd_saved, {q.pct('sum(t0)', 'sum(t1)')} AS savings_pct
        FROM x GROUP BY lang""",
    "m1_m4_m6_audit_measures": f"""WITH {AUDIT} SELECT id, organization_id, ai_provider_id, tokens_original, tokens_compressed,
        tokens_response, compression_ratio, cost_original::DOUBLE AS cost_original, cost_actual::DOUBLE AS cost_actual,
        cost_saved::DOUBLE AS cost_saved, data_bytes_in, data_bytes_out, cache_hit FROM audit""",
    "m1_token_variants": f"""SELECT page_id, {q.tokens('html')}::INT AS tokens,
        (CASE WHEN length(r) > 0 THEN {q.tokens('r')} ELSE 0 END)::INT AS tokens_rest FROM
        (SELECT *, regexp_replace(html, '<[^>]*>', '', 'g') AS r FROM pages)""",
    "m3_ratio": f"""WITH {AUDIT} SELECT id, (((tokens_original - tokens_compressed)::BIGINT * 20000 + tokens_original) // (2 * tokens_original) / 10000.0)::DOUBLE AS ratio FROM audit""",
    "m5_simulated_cost": f"""WITH {AUDIT} SELECT id, (tokens_original * CASE WHEN tokens_original > 500 THEN 0.000002
        ELSE 0.0000005 END::DECIMAL(20,10))::DOUBLE AS cost FROM audit""",
    "m7_payload_profile": f"""SELECT conv_id, turn, {q.tokens('text')}::INT AS tokens, length(text)::INT AS chars,
        len({q.words('text')})::INT AS words FROM conversations""",
    "m8_preview": "SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END AS shown FROM documents",
    "m9_masked_keys": f"""WITH {KEYS} SELECT api_key_id, CASE WHEN key IS NULL OR key = '' THEN 'N/A' WHEN length(key) > 10
        THEN substr(key, 1, 6) || '...' || right(key, 4) ELSE key END AS masked_key FROM api_key""",
    "a1_request_counts": f"""WITH {AUDIT} SELECT organization_id, count(*) AS requests,
        count(*) FILTER ("timestamp" >= date_trunc('day', {AS_OF})) AS requests_today FROM audit GROUP BY 1""",
    "a2_token_totals": f"""WITH {AUDIT} SELECT organization_id, sum(tokens_original)::BIGINT AS tokens_original,
        sum(tokens_compressed)::BIGINT AS tokens_compressed, sum(tokens_response)::BIGINT AS tokens_response,
        {_money('cost_saved')} AS cost_saved FROM audit GROUP BY 1""",
    "a3_recent_requests": f"""WITH {AUDIT}, {PROVIDERS} SELECT a.id, a."timestamp", a.status, a.ai_provider_id, p.provider_name,
        a.tokens_original FROM {_newest(10)} a LEFT JOIN provider p ON p.provider_id = a.ai_provider_id""",
    "a4_daily_rollup": f"""WITH {AUDIT}, f AS (SELECT * FROM audit),
        t AS (SELECT max("timestamp") AS m FROM f),
        spine AS (SELECT unnest(generate_series(m::DATE - 59, m::DATE, INTERVAL 1 DAY))::DATE AS day FROM t)
        SELECT spine.day, coalesce(sum(tokens_original), 0)::BIGINT AS tokens_original,
        coalesce(sum(tokens_compressed), 0)::BIGINT AS tokens_compressed, count(f.id) AS requests, {_money('cost_actual')} AS cost
        FROM spine LEFT JOIN f ON f."timestamp"::DATE = spine.day AND f."timestamp" >= (SELECT m FROM t) - INTERVAL 60 DAYS GROUP BY 1""",
    "a5_provider_usage": f"""WITH {AUDIT}, {PROVIDERS} SELECT provider_name, count(*) AS requests,
        sum(tokens_original)::BIGINT AS tokens, {_money('cost_actual')} AS cost
        FROM audit a JOIN provider p ON p.provider_id = a.ai_provider_id WHERE {_since(7)} GROUP BY 1""",
    "a6_peak_hours": f"""WITH {AUDIT} SELECT strftime("timestamp", '%H') || ':00' AS hour, count(*) AS requests
        FROM audit WHERE {_since(7)} GROUP BY 1""",
    "a7_latency": f"""WITH {AUDIT} SELECT organization_id, round(avg(latency_ms), 4)::DOUBLE AS avg_latency,
        round(avg(latency_ms) FILTER ({_since(7)}), 0)::BIGINT AS avg_latency_window FROM audit GROUP BY 1""",
    "a8_kpis": f"""WITH {AUDIT}, x AS (SELECT organization_id, count(*) AS total_requests, sum(tokens_original)::BIGINT AS t0,
        sum(tokens_compressed)::BIGINT AS t1, sum(cost_saved)::DOUBLE AS saved, sum(cost_saved) AS saved_exact, avg(cache_hit::INT) AS hit,
        round(avg(latency_ms) FILTER ({_since(7)}), 0)::BIGINT AS lat FROM audit GROUP BY 1)
        SELECT organization_id, total_requests, t0 AS tokens_original, t1 AS tokens_compressed,
        (CASE WHEN t0 > 0 AND saved <> 0 THEN round(saved / (saved + t0 * 0.00001::DOUBLE) * 100, 1) ELSE 0 END)::DOUBLE AS financial_efficiency_pct,
        (CASE WHEN saved > 0 THEN round(saved_exact * 1000, 2) ELSE 0 END)::DOUBLE AS roi_multiplier,
        {q.pct('t0', 't1')} AS compression_ratio, round(hit * 100, 1)::DOUBLE AS cache_hit_rate,
        coalesce(lat, 0) AS avg_latency FROM x""",
    "a9_filtered_log": f"""WITH {AUDIT} SELECT id, organization_id, source, status FROM audit
        WHERE {_since(14)} AND status = 'success' AND source = 'gateway'""",
    "a10_page": f"""WITH {AUDIT} SELECT id, "timestamp" FROM {_newest(200, 400)}""",
    "a10_page_counts": f"""WITH {AUDIT} SELECT count(*) AS total_rows, greatest(1, ceil(count(*) / 50))::BIGINT AS total_pages FROM audit""",
    "a11_summary_page": f"WITH {AUDIT} SELECT {SUMMARY} FROM {_newest(50, 50)}",
    "a11_summary_full": f"WITH {AUDIT} SELECT organization_id, {SUMMARY} FROM audit GROUP BY organization_id",
    "a12_per_key": f"""WITH {AUDIT}, {KEYS}, x AS (SELECT * REPLACE (CASE WHEN id % 20 <> 3 THEN api_key_id END AS api_key_id) FROM audit)
        SELECT coalesce(x.api_key_id::VARCHAR, 'unknown') AS key, coalesce(any_value(k.key_name), 'Unknown Key') AS name,
        count(*) AS requests, sum(tokens_original)::BIGINT AS tokens_in,
        sum(greatest(0, tokens_original - tokens_compressed))::BIGINT AS tokens_saved, {_money('cost_actual')} AS cost,
        count(*) FILTER (status <> 'success') AS errors FROM x LEFT JOIN api_key k ON k.api_key_id = x.api_key_id GROUP BY 1""",
    "a13_per_provider": f"""WITH {AUDIT}, {PROVIDERS}, x AS (SELECT * REPLACE (CASE WHEN id % 4 <> 0 THEN tokens_compressed ELSE 0 END AS tokens_compressed) FROM audit)
        SELECT coalesce(x.ai_provider_id::VARCHAR, 'unknown') AS provider, coalesce(any_value(p.provider_name), 'Unknown Provider') AS name,
        count(*) AS requests, sum(CASE WHEN coalesce(tokens_compressed, 0) <> 0 THEN tokens_compressed ELSE tokens_original END)::BIGINT AS tokens,
        {_money('cost_actual')} AS cost FROM x LEFT JOIN provider p ON p.provider_id = x.ai_provider_id GROUP BY 1""",
    "a14_provider_share": f"""WITH {AUDIT} SELECT coalesce(ai_provider_id::VARCHAR, 'unknown') AS provider, count(*) AS requests,
        round(count(*) * 100 / sum(count(*)) OVER (), 2)::DOUBLE AS share_pct FROM audit GROUP BY ai_provider_id""",
    "a15_telemetry": f"""WITH {AUDIT} SELECT count(*) AS request_count, sum(tokens_original)::BIGINT AS total_tokens_in,
        sum(tokens_compressed)::BIGINT AS total_tokens_out, (sum(tokens_original) - sum(tokens_compressed))::BIGINT AS total_saved,
        {q.pct('sum(tokens_original)', 'sum(tokens_compressed)')} AS avg_compression_pct FROM {_newest(50)}""",
    "a16_report": f"""WITH {AUDIT}, x AS (SELECT * FROM audit WHERE {_since(14)})
        SELECT 'total' AS section, 'all' AS item, {_REPORT} FROM x
        UNION ALL SELECT 'provider', coalesce(ai_provider_id::VARCHAR, 'unknown'), {_REPORT} FROM x GROUP BY ai_provider_id
        UNION ALL SELECT 'key', coalesce(api_key_id::VARCHAR, 'unknown'), {_REPORT} FROM x GROUP BY api_key_id""",
    "a17_audit_search": f"""WITH {AUDIT} SELECT id, "timestamp", status, source, tokens_original, tokens_compressed,
        tokens_original - tokens_compressed AS tokens_saved, {q.pct('tokens_original', 'tokens_compressed')} AS savings_pct
        FROM audit WHERE status = 'success' AND contains(lower(original_payload), 'releas')""",
    "a18_request_detail": f"""WITH {AUDIT} SELECT id, md5(original_payload) AS original_payload, md5(compressed_payload) AS compressed_payload,
        tokens_original, tokens_compressed, tokens_response, length(original_payload)::INT AS chars_original,
        length(compressed_payload)::INT AS chars_compressed FROM audit""",
    "a19_team_usage": f"""WITH {AUDIT}, {KEYS} SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS team,
        coalesce(n, 0) AS requests, coalesce(k, 0) AS active_keys, last_activity FROM customer
        LEFT JOIN (SELECT user_id, count(*) AS n, max("timestamp") AS last_activity FROM audit GROUP BY 1) u ON u.user_id = c_custkey
        LEFT JOIN (SELECT user_id, count(*) FILTER (is_active) AS k FROM api_key GROUP BY 1) y ON y.user_id = c_custkey""",
    "a20_provider_counters": f"""WITH {AUDIT} SELECT ai_provider_id, count(*) AS total_requests, sum(tokens_compressed)::BIGINT AS total_tokens,
        sum(data_bytes_in + data_bytes_out)::BIGINT AS total_bytes FROM audit WHERE ai_provider_id IS NOT NULL GROUP BY 1""",
    "a22_efficiency_trail": f"""WITH {AUDIT} SELECT CASE WHEN cost_saved > 0 THEN 'saved' ELSE 'bypassed' END AS outcome,
        count(*) AS requests, sum(tokens_original)::BIGINT AS tokens_original, sum(tokens_compressed)::BIGINT AS tokens_compressed,
        {_money('cost_saved')} AS cost_saved FROM audit GROUP BY 1""",
    "a23_status_mix": f"WITH {AUDIT} SELECT status, source, count(*) AS requests FROM audit GROUP BY 1, 2",
    "n5_usage_rows": f"""WITH {AUDIT} SELECT id, tokens_original AS prompt_tokens, tokens_response AS completion_tokens,
        tokens_original + tokens_response AS total_tokens, compression_ratio AS compression_pct,
        cost_actual::DOUBLE AS cost_actual, cost_saved::DOUBLE AS cost_saved, latency_ms FROM audit""",
}
# The exported files hold the report of their own window.
SQL["s8_report_export"] = SQL["a16_report"].replace(_since(14), _since(30))
