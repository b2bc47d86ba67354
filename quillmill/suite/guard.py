"""Security, privacy and response normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.operators import normalize as n
from quillmill.operators import privacy as v
from quillmill.operators import quota
from quillmill.operators import security as sec
from quillmill.session import stored
from quillmill.sources import derived as d
from quillmill.sources.readers import documents, table
from quillmill.suite import sql as q
from quillmill.suite.usage import AUDIT, KEYS, _HISTORY

CUSTOM = "Copyright \\([cC]\\) [0-9]{4}|||NOTICE\nbroken line\nMIT License|||[LICENSE]"
EGRESS = (r"Released[^.]*\.", r"(?i)COPYRIGHT[^.]*\.", r"^The and attion[^.]*\.$")
SWITCHES = {"PHONE": False}


def docs(s, sf):
    return documents(s, sf).select("doc_id", "text")


def _masked(s, sf):
    return v.mask(docs(s, sf), custom=CUSTOM)


def _nested(s, sf):
    raw = F.concat(F.lit('{"a": {"b": ["x  y", 1, {"c": "'), F.col("event_type"), F.lit(' \\n z"}]}, "props": '), F.col("props"),
                   F.lit(', "none": null}'))
    return sec.flatten_params(table(s, sf, "events").select(F.col("event_id").alias("call_id"), raw.alias("params_json")))


def _keyed(s, sf):
    """Requests with their key; some keys are cut or unknown."""
    keys = d.api_keys(s, sf).select("api_key_id", "key")
    log = d.audit(s, sf).select("id", "timestamp", "api_key_id").join(keys, "api_key_id", "left")
    return log.withColumn("key", F.when(F.col("id") % 50 == 7, F.concat("key", F.lit("0"))).otherwise(F.col("key")))


def _responses(s, sf):
    """Masked documents answered with the placeholders in reverse order of appearance."""
    masked = stored(_masked(s, sf).select("doc_id", "mapping"), "responses")  # both sides read it, the texts are searched once
    reply = F.array_join(F.reverse(F.transform("mapping", lambda m: m["placeholder"])), " and ")
    answers = masked.select("doc_id", F.concat(F.lit("Write to "), reply).alias("text"))
    return v.reinject_with(answers, v.key_mapping(masked)).select("doc_id", "restored")


def _json_text(s, sf):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_id") % 4
    text = (F.when(e == 0, F.concat(F.lit("  "), F.col("props"))).when(e == 1, F.concat(F.lit('[1,  "é", {"k" : '), k, F.lit("}]")))
            .when(e == 2, F.concat(F.lit("{see ```json\n {\"k\":   "), k, F.lit("} ```"))).otherwise(F.concat(F.lit("plain {"), k)))
    return n.reformat_json(table(s, sf, "events").select("event_id", text.alias("text"))).select("event_id", "text_out")


def _minute(s, sf):
    return sec.minute_quota(_burst(s, sf), d.api_keys(s, sf))


def _burst(s, sf):
    """The request log with every minute of an hour folded into its first, so that limits are reached."""
    log = d.audit(s, sf).select("id", "timestamp", "api_key_id", "tokens_compressed")
    folded = F.date_trunc("hour", "timestamp") + F.make_interval(secs=F.second("timestamp") * 2)
    return log.withColumn("timestamp", folded)


QUERIES = {
    "p1_injection_scan": lambda s, sf: sec.injection_scan(d.tool_calls(s, sf)).drop("violations"),
    "p1_injection_report": lambda s, sf: sec.injection_report(d.tool_calls(s, sf)),
    "p2_tool_policy": lambda s, sf: sec.policy_scan(d.tool_calls(s, sf), d.tools(s, sf)),
    "p2_policy_index": lambda s, sf: sec.policy_scan_indexed(d.tool_calls(s, sf), d.tools(s, sf)),
    "p3_flatten_params": _nested,
    "p3_clean_params": lambda s, sf: sec.clean_params(d.tool_calls(s, sf)).select(
        "call_id", F.col("params")["note"].alias("note"), F.col("params")["props"].alias("props")),
    "p4_permission_verdicts": lambda s, sf: sec.verdicts(sec.tool_status(d.tool_calls(s, sf), d.tools(s, sf)), d.tool_permissions(s, sf)).select(
        "call_id", "tool_id", "permission", "call_limit"),
    "p5_unknown_tools": lambda s, sf: sec.unknown_calls(d.tool_calls(s, sf), d.tools(s, sf)).select("call_id", "tool_name"),
    "p6_adjudication": lambda s, sf: sec.adjudicate(d.tool_calls(s, sf), d.tools(s, sf), d.tool_permissions(s, sf)).drop("ts"),
    "p7_tool_catalogue": lambda s, sf: sec.tool_catalogue(d.tools(s, sf), d.tool_permissions(s, sf), 7),
    "p8_minute_quota": _minute,
    "p8_daily_quota": lambda s, sf: sec.daily_quota(d.audit(s, sf), d.api_keys(s, sf)),
    "p8_enforcement": lambda s, sf: quota.enforce(_burst(s, sf), d.api_keys(s, sf)),
    "p8_sliding_quota": lambda s, sf: sec.sliding_quota(_burst(s, sf), d.api_keys(s, sf)),
    "p9_key_check": lambda s, sf: sec.check_keys(_keyed(s, sf), d.api_keys(s, sf)).select("id", "key_status"),
    "p9_key_usage": lambda s, sf: sec.key_usage(_keyed(s, sf), d.api_keys(s, sf)),
    "p10_egress": lambda s, sf: sec.egress_clean(docs(s, sf), rules=EGRESS).drop("text"),
    "v1_detection": lambda s, sf: v.detect(docs(s, sf)),
    "v1_detection_switched": lambda s, sf: v.detect(docs(s, sf), switches=SWITCHES).groupBy("entity_type").agg(F.count("*").alias("hits")),
    "v2_placeholders": lambda s, sf: v.key_mapping(v.mask(docs(s, sf))),
    "v3_masked_text": lambda s, sf: v.mask(docs(s, sf)).select("doc_id", "clean_content"),
    "v4_v8_custom_patterns": lambda s, sf: v.detect(docs(s, sf), custom=CUSTOM),
    "v5_mapping_counts": lambda s, sf: v.mapping_counts(_masked(s, sf)),
    "v5_type_counts": lambda s, sf: v.type_counts(_masked(s, sf)),
    "v6_reinjection": lambda s, sf: v.reinject(_masked(s, sf)).select("doc_id", "restored"),
    "v6_reinjection_responses": _responses,
    "v7_leak_check": lambda s, sf: v.leaks(_masked(s, sf)),
    "n1_normalised_responses": lambda s, sf: n.normalise_responses(d.responses(s, sf)),
    "n2_json_reformat": _json_text,
    "n3_stream_chunks": lambda s, sf: n.normalise_chunks(d.chunks(s, sf)).select("request_id", "seq", "delta", "is_end"),
    "n4_message_layout": lambda s, sf: n.to_parts_layout(d.requests(s, sf)).select("request_id", "payload"),
}

CALLS = """
call AS (SELECT event_id AS call_id, c_nationkey AS organization_id, user_id AS api_key_id, 'tool_' || (event_id % 10) AS tool_name, ts, props,
  CASE WHEN event_type = 'error' THEN 'x''; DROP TABLE t' || event_id WHEN event_type = 'view' AND event_id % 3 = 0 THEN '../etc/passwd and eval (1)'
  WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'a | bash -c $(id)' ELSE '  plain ' || chr(9) || event_type || chr(10) || ' value ' END AS note
  FROM events LEFT JOIN customer ON c_custkey = user_id),
param AS (SELECT call_id, organization_id, tool_name, 'note' AS path, note AS value, 0 AS o FROM call UNION ALL SELECT call_id, organization_id, tool_name, 'props', props, 1 FROM call),
tool AS (SELECT p_partkey AS tool_id, (p_partkey % 25)::INT AS organization_id, 'tool_' || (p_partkey // 25) AS tool_name,
  CASE WHEN p_partkey % 5 = 0 THEN 'high' WHEN p_partkey % 2 = 0 THEN 'medium' ELSE 'low' END AS risk_level, p_partkey % 9 <> 4 AS is_active, p_partkey % 3 = 0 AS has_patterns FROM part),
perm AS (SELECT p_partkey AS tool_id, CASE WHEN p_partkey % 6 = 1 THEN p_partkey % 50 END AS api_key_id, p_partkey % 10 <> 2 AS is_allowed,
  p_partkey % 12 = 5 AS approval, (1 + p_partkey % 4)::INT AS lim FROM part WHERE p_partkey % 8 <> 7)"""
_PATTERNS = "[" + q.quoted(vocab.BLOCKED_PATTERNS) + "]"
_VIOL = f"list_filter({_PATTERNS}, lambda p: regexp_matches(value, '(?i)' || p))"
_OWN = "list_filter(['secret\\d+', 'k\": [1-3]\\d\\}'], lambda p: regexp_matches(value, '(?i)' || p))"
_VERDICT = """ver AS (SELECT c.call_id, c.organization_id, c.api_key_id, c.tool_name, t.tool_id, t.risk_level, t.has_patterns,
  CASE WHEN p.tool_id IS NULL THEN 'missing' WHEN NOT is_allowed THEN 'denied' WHEN approval THEN 'approval' ELSE 'allowed' END AS permission, lim AS call_limit
  FROM call c LEFT JOIN tool t ON t.is_active AND t.organization_id = c.organization_id AND t.tool_name = c.tool_name
  LEFT JOIN perm p ON p.tool_id = t.tool_id AND (p.api_key_id = c.api_key_id OR p.api_key_id IS NULL))"""
_BURST = """burst AS (SELECT id, date_trunc('hour', "timestamp") + to_seconds(second("timestamp") * 2) AS t, api_key_id FROM audit)"""
_KEYED = f"""keyed AS (SELECT id, "timestamp", CASE WHEN id % 50 = 7 THEN key || '0' ELSE key END AS key FROM audit LEFT JOIN api_key USING (api_key_id)),
chk AS (SELECT x.*, CASE WHEN x.key IS NULL OR NOT starts_with(x.key, 'fk-') THEN 'bad_prefix' WHEN k.key IS NULL THEN 'unknown' WHEN NOT k.is_active THEN 'inactive' ELSE 'ok' END AS key_status
  FROM keyed x LEFT JOIN api_key k ON k.key = x.key)"""


def _detect(patterns: dict[str, str]) -> str:
    """Matches by one alternation; the type is the first pattern that fits the value.  Dates take part and are dropped."""
    every = {**v.UNTOUCHED, **patterns}
    union = "|".join(f"(?:{p})" for p in every.values())
    kind = " ".join(f"WHEN regexp_full_match(value, '{p}') THEN '{k}'" for k, p in every.items())
    return f"""m AS (SELECT doc_id, regexp_extract_all(text, '{union}') AS f, regexp_split_to_array(text, '{union}') AS gaps FROM documents),
raw AS (SELECT doc_id, value, pos, CASE {kind} END AS entity_type FROM (SELECT doc_id, unnest(f) AS value, generate_subscripts(f, 1) - 1 AS pos FROM m)),
hit AS (SELECT doc_id, value, entity_type, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM raw WHERE entity_type <> '_DATE'),
map AS (SELECT doc_id, entity_type, value AS original_value, pos, '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY pos) || ']' AS placeholder
  FROM (SELECT doc_id, entity_type, value, min(pos) AS pos FROM hit GROUP BY 1, 2, 3))"""


_PLAIN = _detect(v.PATTERNS)
# Without the engine's check of custom patterns, which needs a session.
_WITH_CUSTOM = {**dict(v.custom_lines(CUSTOM)), **v.PATTERNS}
_CUSTOM = _detect(_WITH_CUSTOM)
_ORDER = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_WITH_CUSTOM)) + " END"
_MASKED = """ms AS (SELECT raw.doc_id, list(coalesce(placeholder, value) ORDER BY raw.pos) AS ps, count(DISTINCT placeholder) AS n FROM raw
  LEFT JOIN map ON map.doc_id = raw.doc_id AND map.entity_type = raw.entity_type AND original_value = value GROUP BY 1)
SELECT d.doc_id, CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(list_zip(gaps, ps), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') END AS clean_content
FROM documents d JOIN m USING (doc_id) LEFT JOIN ms USING (doc_id)"""
_RESP = f"""resp AS (SELECT conv_id * 1000 + turn AS rid, text, {q.tokens('text')}::INT AS n FROM conversations WHERE role = 'assistant')"""


def _egress() -> str:
    steps, prev = ["e0 AS (SELECT doc_id, text AS t, 0 AS k FROM documents)"], "e0"
    for i, rule in enumerate(EGRESS, 1):
        nxt = q.trim(f"regexp_replace(t, '(?m){rule}', '', 'g')")
        steps.append(f"e{i} AS (SELECT doc_id, {nxt} AS t, k + ({nxt} <> t)::INT AS k FROM {prev})")
        prev = f"e{i}"
    return f"WITH {', '.join(steps)} SELECT doc_id, t AS text_out, k::INT AS rules_triggered FROM {prev}"


SQL = {
    "p1_injection_scan": f"WITH {CALLS}, x AS (SELECT call_id, path, {_VIOL} AS f FROM param) SELECT call_id, path, f[1] AS first_violation, len(f)::INT AS violation_count FROM x WHERE len(f) > 0",
    "p1_injection_report": f"WITH {CALLS}, x AS (SELECT unnest({_VIOL}) AS pattern FROM param) SELECT pattern, count(*) AS hits FROM x GROUP BY 1",
    "p2_tool_policy": f"""WITH {CALLS}, x AS (SELECT call_id, p.tool_name, path, {_OWN} AS f FROM param p JOIN tool t ON t.organization_id = p.organization_id AND t.tool_name = p.tool_name WHERE has_patterns)
        SELECT call_id, tool_name, path, replace(f[1], '\\}}', '}}') AS first_violation, len(f)::INT AS violation_count FROM x WHERE len(f) > 0""",
    "p3_flatten_params": """SELECT event_id AS call_id, '$.a.b[0]' AS path, 'x y' AS value FROM events UNION ALL SELECT event_id, '$.a.b[1]', '1' FROM events
        UNION ALL SELECT event_id, '$.a.b[2].c', event_type || ' z' FROM events UNION ALL SELECT event_id, '$.props.k', json_extract_string(props, '$.k') FROM events
        UNION ALL SELECT event_id, '$.none', NULL FROM events""",
    "p3_clean_params": f"WITH {CALLS} SELECT call_id, {q.trim('regexp_replace(note, $$[\\s]+$$, $$ $$, $$g$$)')} AS note, {q.trim('regexp_replace(props, $$[\\s]+$$, $$ $$, $$g$$)')} AS props FROM call",
    "p4_permission_verdicts": f"WITH {CALLS}, {_VERDICT} SELECT call_id, tool_id, permission, call_limit FROM ver",
    "p5_unknown_tools": f"WITH {CALLS} SELECT call_id, tool_name FROM call c WHERE NOT EXISTS (SELECT 1 FROM tool t WHERE t.is_active AND t.organization_id = c.organization_id AND t.tool_name = c.tool_name)",
    "p6_adjudication": f"""WITH {CALLS}, {_VERDICT}, h AS (SELECT p.call_id, p.path, p.o, {_VIOL} AS u, CASE WHEN has_patterns THEN {_OWN} ELSE [] END AS w FROM param p JOIN ver USING (call_id)),
        f AS (SELECT call_id, arg_min(CASE WHEN len(u) > 0 THEN 'Universal security violation in param ''' || path || ''': blocked pattern detected — ''' || u[1] || ''''
           ELSE 'Tool policy violation in param ''' || path || ''': blocked pattern detected — ''' || replace(w[1], '\\}}', '}}') || '''' END, o) AS msg FROM h WHERE len(u) > 0 OR len(w) > 0 GROUP BY 1),
        z AS (SELECT ver.*, CASE WHEN tool_id IS NULL THEN 'Tool ''' || tool_name || ''' not found or is inactive.'
          WHEN permission = 'missing' THEN 'No permission configured for tool ''' || tool_name || '''. Contact your administrator to grant access.'
          WHEN permission = 'denied' THEN 'Access to tool ''' || tool_name || ''' is explicitly denied for this API key.'
          WHEN permission = 'approval' THEN 'Tool ''' || tool_name || ''' requires human approval before execution. Please request approval from your administrator.' ELSE msg END AS message FROM ver LEFT JOIN f USING (call_id))
        SELECT call_id, organization_id, api_key_id, tool_name, CASE WHEN message IS NULL THEN 'success' ELSE 'denied' END AS status, message, risk_level FROM z""",
    "p7_tool_catalogue": f"""WITH {CALLS} SELECT t.tool_id, organization_id, tool_name, risk_level, coalesce(is_allowed AND NOT approval, false) AS accessible FROM tool t
        LEFT JOIN perm p ON p.tool_id = t.tool_id AND (p.api_key_id = 7 OR p.api_key_id IS NULL) WHERE is_active""",
    "p8_minute_quota": f"""WITH {AUDIT}, {KEYS}, {_BURST}, m AS (SELECT api_key_id, date_trunc('minute', t) AS minute, count(*) AS calls FROM burst GROUP BY 1, 2)
        SELECT api_key_id, minute, calls, rate_limit AS allowed FROM m JOIN api_key USING (api_key_id) WHERE calls > rate_limit""",
    "p8_daily_quota": f"""WITH {AUDIT}, {KEYS}, m AS (SELECT api_key_id, "timestamp"::DATE AS day, sum(tokens_compressed)::BIGINT AS tokens FROM audit GROUP BY 1, 2)
        SELECT api_key_id, day, tokens, daily_token_limit FROM m JOIN api_key USING (api_key_id) WHERE daily_token_limit > 0 AND tokens > daily_token_limit""",
    "p8_sliding_quota": f"""WITH {AUDIT}, {KEYS}, {_BURST}, m AS (SELECT api_key_id, date_trunc('second', t) AS sec, count(*) AS n FROM burst GROUP BY 1, 2),
        w AS (SELECT *, sum(n) OVER (PARTITION BY api_key_id ORDER BY sec RANGE BETWEEN INTERVAL 59 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS calls FROM m)
        SELECT api_key_id, sec AS "at", calls, rate_limit AS allowed FROM w JOIN api_key USING (api_key_id) WHERE calls > rate_limit""",
    "p8_enforcement": f"""WITH RECURSIVE {AUDIT}, {KEYS}, {_BURST},
        o AS MATERIALIZED (SELECT id, api_key_id, t, epoch_us(t) AS us, rate_limit::BIGINT AS l, row_number() OVER (PARTITION BY api_key_id ORDER BY t, id) AS rn FROM burst LEFT JOIN api_key USING (api_key_id)),
        b AS (SELECT id, api_key_id, t, us, l, rn, (l - 1) * 60000000 AS level, true AS admitted FROM o WHERE rn = 1 AND l IS NOT NULL
          UNION ALL SELECT id, api_key_id, t, us, l, rn, CASE WHEN now >= 60000000 THEN now - 60000000 ELSE now END, now >= 60000000
          FROM (SELECT o.*, least(o.l * 60000000, b.level + o.l * least(o.us - b.us, 60000000)) AS now FROM b JOIN o ON o.api_key_id = b.api_key_id AND o.rn = b.rn + 1))
        SELECT id, api_key_id, t AS "timestamp", admitted, (level // 60000000)::BIGINT AS tokens_left FROM b UNION ALL SELECT id, api_key_id, t, true, NULL FROM o WHERE l IS NULL""",
    "p9_key_check": f"WITH {AUDIT}, {KEYS}, {_KEYED} SELECT id, key_status FROM chk",
    "p9_key_usage": f"""WITH {AUDIT}, {KEYS}, {_KEYED} SELECT key, count(*) AS requests, max("timestamp") AS last_used_at, any_value(key_status) AS key_status FROM chk GROUP BY 1""",
    "p10_egress": _egress(),
    "v1_detection": f"WITH {_PLAIN} SELECT doc_id, entity_type, value, pos::INT AS pos FROM hit",
    "v1_detection_switched": f"WITH {_detect(v.active_patterns(SWITCHES))} SELECT entity_type, count(*) AS hits FROM hit GROUP BY 1",
    "v2_placeholders": f"WITH {_PLAIN} SELECT doc_id, placeholder, original_value, entity_type FROM map",
    "v3_masked_text": f"WITH {_PLAIN}, {_MASKED}",
    "v4_v8_custom_patterns": f"WITH {_CUSTOM} SELECT doc_id, entity_type, value, pos::INT AS pos FROM hit",
    "v5_mapping_counts": f"""WITH {_CUSTOM}, l AS (SELECT doc_id, list(placeholder ORDER BY {_ORDER}, pos) AS ps FROM map GROUP BY 1)
        SELECT doc_id, len(ps)::INT AS entities, array_to_string(ps[1:5], ' ') AS shown, greatest(0, len(ps) - 5)::INT AS more FROM l""",
    "v5_type_counts": f"WITH {_CUSTOM} SELECT entity_type, count(*)::BIGINT AS entities, count(DISTINCT doc_id) AS documents FROM map GROUP BY 1",
    "v6_reinjection": "SELECT doc_id, text AS restored FROM documents",
    "v6_reinjection_responses": f"""WITH {_CUSTOM}, l AS (SELECT doc_id, string_agg(original_value, ' and ' ORDER BY {_ORDER} DESC, pos DESC) AS t FROM map GROUP BY 1)
        SELECT doc_id, 'Write to ' || coalesce(t, '') AS restored FROM documents LEFT JOIN l USING (doc_id)""",
    "v7_leak_check": "SELECT doc_id, '' AS placeholder, '' AS original_value FROM documents WHERE false",
    "n1_normalised_responses": f"""WITH {_RESP} SELECT rid AS request_id, (['openai','gemini','anthropic'])[rid % 3 + 1] AS provider, rid % 17 = 4 AS malformed,
        CASE WHEN rid % 17 = 4 OR rid % 3 = 1 THEN 'chatcmpl-' || rid WHEN rid % 3 = 0 THEN 'r' || rid ELSE 'm' || rid END AS id,
        CASE WHEN rid % 17 = 4 THEN 'normalized' WHEN rid % 3 = 0 THEN 'gpt' WHEN rid % 3 = 1 THEN 'flash' ELSE 'sonnet' END AS model, CASE WHEN rid % 17 = 4 THEN '' ELSE text END AS content,
        CASE WHEN rid % 17 = 4 OR rid % 3 = 1 THEN 'stop' WHEN rid % 3 = 0 THEN 'length' ELSE 'end_turn' END AS finish_reason,
        (CASE WHEN rid % 17 = 4 OR rid % 3 = 2 THEN 0 WHEN rid % 3 = 0 THEN n + 3 ELSE n + 5 END)::INT AS prompt_tokens, (CASE WHEN rid % 17 = 4 THEN 0 ELSE n END)::INT AS completion_tokens,
        (CASE WHEN rid % 17 = 4 THEN 0 WHEN rid % 3 = 2 THEN n WHEN rid % 3 = 0 THEN 2 * n + 3 ELSE 2 * n + 5 END)::INT AS total_tokens FROM resp""",
    "n2_json_reformat": """WITH x AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k":' || k || '}' WHEN 1 THEN '[1,"é",{"k":' || k || '}]' WHEN 2 THEN '{"k":' || k || '}' ELSE 'plain {' || k END AS text_out FROM x""",
    "n3_stream_chunks": f"""WITH {_RESP}, w AS (SELECT rid, list_append(regexp_extract_all(text, '\\S+\\s*'), NULL) AS ws FROM resp)
        SELECT rid AS request_id, (generate_subscripts(ws, 1) - 1)::INT AS seq, unnest(ws) AS delta, unnest(ws) IS NULL AS is_end FROM w""",
    "n4_message_layout": f"""WITH {_HISTORY}, x AS (SELECT request_id, list_transform(list_filter(messages, lambda m: m.role <> 'system'), lambda m:
          {{'role': CASE WHEN m.role = 'assistant' THEN 'model' ELSE 'user' END, 'parts': [{{'text': m.content}}]}}) AS c, list_filter(messages, lambda m: m.role = 'system') AS sy FROM req)
        SELECT request_id, CASE WHEN len(sy) > 0 THEN to_json({{'contents': c, 'systemInstruction': {{'parts': [{{'text': sy[-1].content}}]}}}})::VARCHAR ELSE to_json({{'contents': c}})::VARCHAR END AS payload FROM x""",
}
SQL["p2_policy_index"] = SQL["p2_tool_policy"]
