"""Classification, routing and the prompt cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.metrics import est_tokens
from quillmill.functions.text import strip
from quillmill.operators import promptcache as pc
from quillmill.operators import routing as r
from quillmill.operators.wordfilter import drop_stop_words_flat
from quillmill.plans.gateway import gateway_audit
from quillmill.sources import derived as d
from quillmill.sources.readers import documents, table
from quillmill.suite import sql as q
from quillmill.suite.code import CODE as CODE_SQL
from quillmill.suite.code import TRIPLES
from quillmill.suite.code import _MATRIX as _CODE_MATRIX
from quillmill.suite.usage import AUDIT, KEYS, PROVIDERS, _HISTORY

# Patterns without word borders, which the two engines define differently, and
# words that occur in the invented prose.
CODE = (("[{}\\[\\]();]", 0.3), ("^\\s{2,}", 0.5), ("(==|!=|<=|>=)", 0.7), ("</[a-z]", 1.0), ("[*#%&$]{3}", 2.0))
PROSE = (("[.!?]\\s+[A-Z]", 0.5), (" (the|der|que|les) ", 0.3))
HEDGES = (("ntion", 0.15), ("keit", 0.12), ("que", 0.05), ("the ", 0.02))
KEYWORDS = ("thehe", "keitung", "quemen", "ciónos")
SIGNALS = ("tion", "keit", "mente", "elle")


def _markup_and_prose(s, sf):
    page = table(s, sf, "pages").select((F.col("page_id") + 1_000_000).alias("id"), F.col("html").alias("text"))
    return documents(s, sf).select(F.col("doc_id").alias("id"), "text").unionByName(page)


def _stamped(s, sf):
    """Every third document with a date before each line."""
    stamped = F.concat(F.lit("2024-01-01 "), F.replace("text", F.lit("\n"), F.lit("\n2024-01-02 ")))
    return documents(s, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, stamped).otherwise(F.col("text")).alias("text"))


def _two_languages(s, sf):
    js = F.replace(F.replace("text", F.lit("def "), F.lit("function ")), F.lit("import "), F.lit("const x = "))
    return d.code_documents(s, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, js).otherwise(F.col("text")).alias("text"))


def _cascade_input(s, sf):
    last = F.coalesce(F.try_element_at("messages", F.lit(-1))["content"], F.lit(""))  # a request without history has no prompt
    return d.requests(s, sf).select(
        "request_id", (F.col("conv_id") % 25).cast("int").alias("organization_id"), last.alias("prompt"),
        F.col("response").alias("cheap_response"), F.concat(F.lit("heavy: "), "response").alias("heavy_response"))


def _resolution_input(s, sf):
    return d.audit(s, sf).select(F.col("id").alias("request_id"), "api_key_id", "organization_id",
                                 (F.col("tokens_original") > 300).alias("complex"))


def _assigned(s, sf):
    return r.assign_edge_nodes(d.clients(s, sf), d.edge_rules(s, sf), d.edge_nodes(s, sf))


def _configs(s, sf):
    rows = table(s, sf, "events").select(
        F.col("event_id"), F.when(F.col("event_id") % 2 == 0, "deepseek").otherwise("gemini").alias("family"),
        F.element_at(F.array(*[F.lit(x) for x in ("deepseek-coder", "gemini-1.5-pro", "other")]),
                     (F.col("event_id") % 3 + 1).cast("int")).alias("model"))
    return r.with_model_config(rows).groupBy("family", "model", "config_model").agg(
        F.count("*").alias("requests"), F.sum("tpm").alias("tpm"), F.max("temperature").alias("temperature"),
        F.max("top_k").alias("top_k"), F.max("rpd").alias("rpd"))


def _entries(s, sf):
    """Cache after the first half of the month."""
    first = pc.replay(d.audit(s, sf).filter("dayofmonth(timestamp) <= 15"))
    return first.select("organization_id", F.col("payload_hash").alias("prompt_hash"),
                        F.concat(F.lit("r"), F.col("first_id").cast("string")).alias("response_json"),
                        "hit_count", F.col("first_id").alias("created_at"))


def _exact(s, sf):
    late = d.audit(s, sf).filter("dayofmonth(timestamp) > 15").select(
        F.col("id").alias("request_id"), "organization_id", F.col("payload_hash").alias("prompt_hash"))
    return pc.exact_lookup(late, _entries(s, sf)).select("request_id", "organization_id", "hit", "response_json")


def _upsert(s, sf):
    late = d.audit(s, sf).filter("dayofmonth(timestamp) > 10").groupBy(
        "organization_id", F.col("payload_hash").alias("prompt_hash")).agg(
        F.concat(F.lit("u"), F.max("id").cast("string")).alias("response_json"),
        F.lit(0).cast("long").alias("hit_count"), F.max("id").alias("created_at"))
    return pc.upsert(_entries(s, sf), late)


def _semantic(s, sf):
    """Cached vectors asked for with every fourth component missing."""
    entries = d.cache_entries(s, sf)
    asked = entries.select(F.col("entry_id").alias("query_id"), "organization_id", "embedding_model",
                           F.transform("embedding", lambda x, i: F.when(i % 4 == 0, F.lit(0.0)).otherwise(x)).alias("embedding"))
    return pc.semantic_lookup(asked, entries, 0.8)


def _vectors(s, sf):
    return table(s, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _cosine(s, sf):
    v = _vectors(s, sf)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(pc.cosine("embedding", "other"), 6).alias("similarity"))


def _embeddings(s, sf):
    e = pc.embed(documents(s, sf).select("doc_id", "text"), "doc_id", "text")
    return e.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).select("doc_id", "bucket", F.round("x", 6).alias("value"))


def _gateway(s, sf):
    asked = d.requests(s, sf).select("request_id", (F.col("conv_id") % 150 + 1).alias("api_key_id"), "messages",
                                     F.timestamp_seconds(F.col("request_id")).alias("timestamp"))
    given = d.requests(s, sf).filter("request_id % 19 <> 0").select(
        "request_id", F.col("response").alias("content"), (F.col("request_id") % 700).cast("int").alias("prompt_tokens"),
        est_tokens("response").alias("completion_tokens"))
    rows = gateway_audit(asked, given, d.api_keys(s, sf), d.cascade_configs(s, sf), d.providers(s, sf),
                         prose=lambda c: drop_stop_words_flat(c, d.DATA_STOP_WORDS), clean=strip, keywords=KEYWORDS)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("cost_original", "cost_actual", "cost_saved")}).drop("original_payload", "data_bytes_in")


def _told(s, sf):
    """Documents as prompts of their language's team, without their vectors."""
    return documents(s, sf).filter("doc_id is not null").select(
        F.col("doc_id").alias("request_id"), F.col("lang").alias("organization_id"), F.lit("default").alias("embedding_model"),
        F.sha2("text", 256).alias("prompt_hash"), F.timestamp_seconds(F.col("doc_id")).alias("timestamp"))


def _prompts(s, sf):
    """Documents as prompts: even ids are cached, odd ones ask."""
    rows = documents(s, sf).select("doc_id", "text")
    return _told(s, sf).join(pc.embed(rows, "doc_id", "text").withColumnRenamed("doc_id", "request_id"), "request_id")


def _two_levels(s, sf):
    prompts = _prompts(s, sf)
    entries = prompts.filter("request_id % 2 = 0").withColumnRenamed("request_id", "entry_id").withColumn("tokens_used", F.lit(4000))
    return prompts.filter("request_id % 2 = 1"), entries


def _two_level_lookup(s, sf):
    return pc.two_level_lookup(*_two_levels(s, sf))


def _entry_hits(s, sf):
    asked, entries = _two_levels(s, sf)
    # Times are told by the documents alone; the vectors, one for each, are not made again for them.
    return pc.entry_hits(pc.two_level_lookup(asked, entries), _told(s, sf).filter("request_id % 2 = 1"))


QUERIES = {
    "r1_content_class": lambda s, sf: r.classify(_markup_and_prose(s, sf), "text", CODE, PROSE).drop("text"),
    "r1_content_class_fixed": lambda s, sf: r.classify(_markup_and_prose(s, sf)).groupBy("content_type").agg(
        F.count("*").alias("texts"), F.round(F.avg("confidence"), 4).alias("confidence")),
    "r2_stack_trace": lambda s, sf: d.traceback_documents(s, sf).unionByName(documents(s, sf).select(
        (F.col("doc_id") + 1_000_000).alias("doc_id"), "text")).select("doc_id", r.is_stack_trace(F.col("text")).alias("is_trace")),
    "r3_log_dump": lambda s, sf: _stamped(s, sf).select("doc_id", r.is_log_dump(F.col("text")).alias("is_log"),
                                                        r.is_log_head(F.col("text")).alias("is_log_head")),
    "r4_code_language": lambda s, sf: _two_languages(s, sf).select("doc_id", r.guess_language(F.col("text")).alias("language")),
    "r5_has_code": lambda s, sf: d.requests(s, sf).select("request_id", r.has_code("messages").alias("has_code")),
    "r6_complexity": lambda s, sf: documents(s, sf).select("doc_id", r.is_complex(F.col("text"), KEYWORDS).alias("is_complex")),
    "r7_confidence": lambda s, sf: table(s, sf, "conversations").select("conv_id", "turn", r.confidence(F.col("text"), HEDGES).alias("confidence")),
    "r8_cascade_replay": lambda s, sf: r.cascade_replay(_cascade_input(s, sf), d.cascade_configs(s, sf), hedges=HEDGES, keywords=KEYWORDS),
    "r9_tier_decision": lambda s, sf: r.decide_tier(documents(s, sf).select("doc_id", "text"), "text", 900, SIGNALS).select(
        "doc_id", "tier", "model", "token_count", "reason", F.array_join("signals", ",").alias("signals")),
    "r9_tier_decision_fixed": lambda s, sf: r.decide_tier(documents(s, sf).select("doc_id", "text"), "text", 500, vocab.TIER_SIGNALS_LONG).groupBy(
        "tier").agg(F.count("*").alias("documents")),
    "r10_provider_resolution": lambda s, sf: r.resolve_provider(_resolution_input(s, sf), d.api_keys(s, sf), d.cascade_configs(s, sf), d.providers(s, sf)),
    "r11_edge_assignment": _assigned,
    "r12_compliance": lambda s, sf: r.compliance_report(_assigned(s, sf), d.edge_nodes(s, sf)),
    "r12_compliance_totals": lambda s, sf: r.compliance_totals(_assigned(s, sf), d.edge_nodes(s, sf)),
    "r13_model_config": _configs,
    "h1_fingerprint": lambda s, sf: d.requests(s, sf).select("request_id", pc.fingerprint("messages").alias("prompt_hash")),
    "h2_query_text": lambda s, sf: d.requests(s, sf).select("request_id", pc.query_text("messages").alias("query_text")),
    "h3_embedding": _embeddings,
    "h4_cosine": _cosine,
    "h5_exact_lookup": _exact,
    "h6_semantic_lookup": _semantic,
    "h5_h6_two_level_lookup": _two_level_lookup,
    "m6_r10_gateway_audit": _gateway,
    "h5_h6_entry_hits": _entry_hits,
    "h7_upsert": _upsert,
    "h8_replay": lambda s, sf: pc.replay(d.audit(s, sf)),
    "h8_hit_rate": lambda s, sf: pc.hit_rate(d.audit(s, sf)),
    "h9_top_similar": lambda s, sf: pc.top_similar(_vectors(s, sf), k=5, least=0.25),
    "h9_top_similar_by_label": lambda s, sf: pc.top_similar(_vectors(s, sf), group="label", k=3, least=0.2),
}

_MP = "mp AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT page_id + 1000000, html FROM pages)"


def _weights(rules):
    return " + ".join(f"len(regexp_extract_all(text, '(?im){p}')) * {w}::DOUBLE" for p, w in rules)


def _any(c, patterns, flags="(?m)"):
    return " + ".join(f"regexp_matches({c}, '{flags}{p}')::INT" for p in patterns)


_CASCADE = f"""WITH {_HISTORY}, x AS (SELECT request_id, (conv_id % 25)::INT AS org, coalesce(messages[-1].content, '') AS prompt, response FROM req),
 y AS (SELECT x.*, len({q.words('prompt')}) > 2000 OR regexp_matches(prompt, '(?i){"|".join(KEYWORDS)}') AS complex,
   CASE WHEN {q.trim('response')} = '' THEN 0.0 ELSE round(greatest(0.0, 1.0 - ({" + ".join(f"len(regexp_extract_all(response, '(?i){p}')) * {w}::DOUBLE" for p, w in HEDGES)})), 6) END::DOUBLE AS conf,
   n_nationkey % 4 <> 0 AND n_nationkey % 6 <> 5 AS cheap, n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 2 AS heavy,
   CASE WHEN n_nationkey % 4 <> 0 THEN 0.5::DOUBLE + (n_nationkey % 5) * 0.1::DOUBLE ELSE 0.7::DOUBLE END AS thr FROM x JOIN nation ON n_nationkey = org)"""
_RESOLVE = f"""WITH {AUDIT}, {PROVIDERS}, {KEYS}, o AS (SELECT organization_id, min(provider_id) FILTER (is_default) AS dft, min(provider_id) AS any_id FROM provider WHERE is_active GROUP BY 1),
 x AS (SELECT a.id, a.organization_id, a.tokens_original > 300 AS complex, k.linked_provider_id AS linked, dft, any_id,
   CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 6 <> 5 THEN n_nationkey % 7 END AS cheap,
   CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 2 THEN (n_nationkey + 3) % 7 END AS heavy
   FROM audit a LEFT JOIN api_key k USING (api_key_id) LEFT JOIN nation ON n_nationkey = a.organization_id LEFT JOIN o ON o.organization_id = a.organization_id),
 y AS (SELECT *, coalesce(linked, CASE WHEN complex AND heavy IS NOT NULL THEN heavy WHEN NOT complex AND cheap IS NOT NULL THEN cheap ELSE dft END) AS wanted FROM x),
 z AS (SELECT y.*, s_suppkey IS NOT NULL AS found FROM y LEFT JOIN supplier ON s_suppkey = wanted)"""
_EDGE = """WITH node AS (SELECT n_nationkey AS node_id, n_name AS node_name, CASE WHEN n_nationkey % 3 = 0 THEN 'us' ELSE 'eu' END AS zone,
   (n_nationkey * 37) % 100 + 0.5 AS load, n_nationkey % 6 <> 5 AS active FROM nation),
 rule AS (SELECT n_nationkey * 2 + j AS rule_id, CASE WHEN j = 0 THEN 'eu-central' ELSE 'eu-west' END AS region, (n_nationkey * 7 + j * 3) % 25 AS node_id,
   CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 20 END AS org, (n_nationkey + j) % 5 AS priority FROM nation, (SELECT unnest([0, 1]) AS j) WHERE n_nationkey % 7 <> 6),
 client AS (SELECT event_id AS request_id, c_nationkey AS org, CASE WHEN event_id % 7 IN (3, 4) THEN 'eu-west' ELSE 'eu-central' END AS region
   FROM events LEFT JOIN customer ON c_custkey = user_id),
 usable AS (SELECT rule.*, node.load FROM rule JOIN node USING (node_id) WHERE node.active AND node.zone = 'eu'),
 asg AS (SELECT request_id, org AS organization_id, c.region,
   EXISTS (SELECT 1 FROM rule r WHERE r.region = c.region AND r.org = c.org) AS own,
   (SELECT u.node_id FROM usable u WHERE u.region = c.region AND u.org = c.org ORDER BY load, priority DESC, rule_id LIMIT 1) AS own_node,
   (SELECT u.node_id FROM usable u WHERE u.region = c.region AND u.org IS NULL ORDER BY load, priority DESC, rule_id LIMIT 1) AS global_node,
   (SELECT n.node_id FROM node n WHERE n.active AND n.zone = 'eu' ORDER BY load, node_id LIMIT 1) AS any_node FROM client c),
 fin AS (SELECT request_id, organization_id, region, coalesce(CASE WHEN own THEN own_node ELSE global_node END, any_node) AS node_id,
   CASE WHEN CASE WHEN own THEN own_node ELSE global_node END IS NULL THEN 'fallback' WHEN own THEN 'organization' ELSE 'global' END AS scope FROM asg)"""
_MODELS = "cfg(family, model, temperature, top_k, tpm, rpd, dft) AS (VALUES ('deepseek','deepseek-chat',0.3,NULL,100000,NULL,true),('deepseek','deepseek-coder',0.1,NULL,50000,NULL,false),('gemini','gemini-1.5-pro',0.4,40,2000000,10000,false),('gemini','gemini-1.5-flash',0.2,40,1000000,NULL,true))"
_REPLAY = """x AS (SELECT *, row_number() OVER (PARTITION BY organization_id, payload_hash ORDER BY "timestamp", id) AS rn FROM audit)"""
_FIRST_HALF = """f AS (SELECT organization_id, payload_hash AS prompt_hash, arg_min(id, ("timestamp", id)) AS first_id, count(*) - 1 AS hit_count
  FROM audit WHERE day("timestamp") <= 15 GROUP BY 1, 2)"""

_VECTOR = """gram AS (SELECT doc_id, md5(substr(t, i, 3)) AS h FROM (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM documents)),
  part AS (SELECT doc_id, (k // 2) % 128 AS bucket, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) AS v FROM (SELECT doc_id, ('0x' || substr(h, 1, 5))::INT AS k FROM gram) GROUP BY 1, 2),
  len AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM part GROUP BY 1),
  vec AS (SELECT d.doc_id, b.bucket::INT AS bucket, CASE WHEN norm > 0 THEN coalesce(v, 0) / norm ELSE 0.0 END AS x FROM documents d
    CROSS JOIN (SELECT unnest(range(128)) AS bucket) b LEFT JOIN part p ON p.doc_id = d.doc_id AND p.bucket = b.bucket LEFT JOIN len ON len.doc_id = d.doc_id)"""
_TWO_LEVELS = f"""{_VECTOR}, pr AS (SELECT doc_id, lang, sha256(text) AS h, vs FROM documents JOIN (SELECT doc_id, list(x ORDER BY bucket) AS vs FROM vec GROUP BY 1) USING (doc_id)),
  ent AS (SELECT * FROM pr WHERE doc_id % 2 = 0), ask AS (SELECT * FROM pr WHERE doc_id % 2 = 1),
  ex AS (SELECT lang, h, min(doc_id) AS entry_id FROM ent GROUP BY 1, 2),
  lk AS (SELECT ask.*, ex.entry_id FROM ask LEFT JOIN ex ON ex.lang = ask.lang AND ex.h = ask.h),
  nr AS (SELECT * FROM (SELECT lk.doc_id, e.doc_id AS near_id, list_cosine_similarity(lk.vs, e.vs) AS sim,
      row_number() OVER (PARTITION BY lk.doc_id ORDER BY round(list_cosine_similarity(lk.vs, e.vs), 12) DESC, e.doc_id) AS rk
      FROM lk JOIN ent e ON e.lang = lk.lang AND lk.entry_id IS NULL) WHERE rk = 1 AND sim >= 0.85 AND 4.0 > (1 - sim) * 10),
  found AS (SELECT lk.doc_id AS request_id, lang AS organization_id, CASE WHEN entry_id IS NOT NULL THEN 'exact' WHEN near_id IS NOT NULL THEN 'semantic' ELSE 'none' END AS match_type,
      coalesce(entry_id, near_id) AS entry_id, CASE WHEN entry_id IS NOT NULL THEN 1.0 ELSE round(sim, 4) END::DOUBLE AS similarity FROM lk LEFT JOIN nr ON nr.doc_id = lk.doc_id)"""

SQL = {
    "r1_content_class": f"""WITH {_MP}, x AS (SELECT id, text, round({_weights(CODE)}, 6) AS c, round({_weights(PROSE)}, 6) AS p FROM mp),
        y AS (SELECT id, {q.trim('text')} = '' AS blank, CASE WHEN c + p > 0 THEN c / (c + p) END AS ratio FROM x)
        SELECT id, CASE WHEN NOT blank AND ratio > 0.55::DOUBLE THEN 'cac' ELSE 'nlc' END AS content_type,
        (CASE WHEN blank THEN 1.0 WHEN ratio IS NULL THEN 0.5 ELSE round(least(1.0, CASE WHEN ratio > 0.55::DOUBLE THEN ratio ELSE 1 - ratio END), 6) END)::DOUBLE AS confidence FROM y""",
    "r2_stack_trace": f"""WITH {TRIPLES}, f AS (SELECT doc_id, string_agg('  File "/srv/' || a || '/' || b || '.py", line ' || (pos + 1) || ', in ' || c, chr(10) ORDER BY pos) || chr(10) AS fs,
          arg_min(a, pos) AS msg FROM part GROUP BY 1),
        t AS (SELECT d.doc_id, 'Traceback (most recent call last):' || chr(10) || coalesce(fs, '') || 'ValueError: ' || coalesce(msg, '') AS text
          FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id
          UNION ALL SELECT doc_id + 1000000, text FROM documents)
        SELECT doc_id, {_any('text', [p.replace("'", "''") for p in vocab.TRACE_INDICATORS])} >= 2 AS is_trace FROM t""",
    "r3_log_dump": f"""WITH t AS (SELECT doc_id, string_split({q.trim("CASE WHEN doc_id % 3 = 0 THEN '2024-01-01 ' || replace(text, chr(10), chr(10) || '2024-01-02 ') ELSE text END")}, chr(10)) AS ls FROM documents)
        SELECT doc_id, len(ls) >= 5 AND len(list_filter(ls, lambda l: regexp_matches({q.trim('l')}, '{vocab.LOG_LINE}'))) / len(ls) > 0.4 AS is_log,
        len(list_filter(ls[1:20], lambda l: regexp_matches({q.trim('l')}, '{vocab.LOG_HEAD_LINE}'))) > 5 AS is_log_head FROM t""",
    "r4_code_language": f"""WITH {CODE_SQL}, x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, 'def ', 'function '), 'import ', 'const x = ') ELSE text END AS text FROM code),
        y AS (SELECT doc_id, {_any('text', vocab.PYTHON_INDICATORS)} AS py, {_any('text', vocab.SCRIPT_INDICATORS)} AS js FROM x)
        SELECT doc_id, CASE WHEN py > js THEN 'python' WHEN js > py THEN 'javascript' ELSE 'generic' END AS language FROM y""",
    "r5_has_code": f"""WITH {_HISTORY} SELECT request_id, len(list_filter(messages, lambda m: contains(m.content, '```') OR contains(m.content, 'def ') OR contains(m.content, 'class '))) > 0 AS has_code FROM req""",
    "r6_complexity": f"""SELECT doc_id, len({q.words('text')}) > 2000 OR regexp_matches(text, '(?i){"|".join(KEYWORDS)}') OR contains(upper(text), '[HEAVY]') OR contains(upper(text), '[COMPLEX]') AS is_complex FROM documents""",
    "r7_confidence": f"""SELECT conv_id, turn, (CASE WHEN {q.trim('text')} = '' THEN 0.0 ELSE round(greatest(0.0, 1.0 - ({" + ".join(f"len(regexp_extract_all(text, '(?i){p}')) * {w}::DOUBLE" for p, w in HEDGES)})), 6) END)::DOUBLE AS confidence FROM conversations""",
    "r8_cascade_replay": f"""{_CASCADE} SELECT request_id, org AS organization_id, complex, CASE WHEN NOT (complex AND heavy) AND cheap THEN conf END AS confidence,
        CASE WHEN complex AND heavy THEN 'direct_to_heavy' WHEN NOT cheap AND NOT heavy THEN 'unrouted' WHEN NOT cheap THEN 'heavy' WHEN conf >= thr THEN 'cheap' WHEN heavy THEN 'escalated' ELSE 'cheap_low_confidence' END AS decision,
        CASE WHEN NOT (complex AND heavy) AND cheap THEN NOT conf >= thr END AS escalated,
        CASE WHEN complex AND heavy THEN 'heavy: ' || response WHEN cheap AND conf >= thr THEN response WHEN heavy THEN 'heavy: ' || response WHEN cheap THEN response ELSE '' END AS final_text FROM y""",
    "r9_tier_decision": f"""WITH x AS (SELECT doc_id, {q.tokens('text')}::INT AS t, list_filter([{q.quoted(SIGNALS)}], lambda k: contains(lower(text), k)) AS sig FROM documents)
        SELECT doc_id, CASE WHEN t > 900 OR len(sig) > 0 THEN 2 ELSE 1 END AS tier, CASE WHEN t > 900 OR len(sig) > 0 THEN 'Gemini 1.5 Pro' ELSE 'DeepSeek V3' END AS model, t AS token_count,
        CASE WHEN t > 900 THEN 'Token count ' || t || ' > threshold 900' WHEN len(sig) > 0 THEN 'Complexity signals: [''' || array_to_string(sig, ''', ''') || ''']' ELSE 'None — standard routing' END AS reason,
        {q.join('sig', "','")} AS signals FROM x""",
    "r9_tier_decision_fixed": f"""SELECT CASE WHEN {q.tokens('text')} > 500 OR {" OR ".join(f"contains(lower(text), '{k}')" for k in vocab.TIER_SIGNALS_LONG)} THEN 2 ELSE 1 END AS tier, count(*) AS documents FROM documents GROUP BY 1""",
    "r10_provider_resolution": f"""{_RESOLVE} SELECT id AS request_id, organization_id, CASE WHEN found THEN wanted ELSE any_id END AS provider_id,
        CASE WHEN (CASE WHEN found THEN wanted ELSE any_id END) IS NULL THEN 'unresolved' WHEN NOT found THEN 'any' WHEN linked IS NOT NULL THEN 'linked'
        WHEN complex AND heavy IS NOT NULL THEN 'heavy' WHEN NOT complex AND cheap IS NOT NULL THEN 'cheap' ELSE 'default' END AS resolution FROM z""",
    "r11_edge_assignment": f"{_EDGE} SELECT request_id, organization_id, region, node_id, scope FROM fin",
    "r12_compliance": f"""{_EDGE} SELECT request_id, node_name, zone, coalesce(zone = 'eu', false) AS gdpr_compliant, CASE WHEN zone IS NULL THEN 'No edge node selected — data may leave EU jurisdiction'
        WHEN zone = 'eu' THEN 'Data processed and stored within EU jurisdiction' ELSE 'Data may be processed outside EU (' || zone || ')' END AS data_residency FROM fin LEFT JOIN node USING (node_id)""",
    "r12_compliance_totals": f"{_EDGE} SELECT coalesce(zone, 'none') AS zone, count(*) AS requests, count(DISTINCT node_id) AS nodes FROM fin LEFT JOIN node USING (node_id) GROUP BY 1",
    "r13_model_config": f"""WITH {_MODELS}, e AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'deepseek' ELSE 'gemini' END AS family, (['deepseek-coder','gemini-1.5-pro','other'])[event_id % 3 + 1] AS model FROM events),
        m AS (SELECT e.family, e.model, coalesce(x.model, y.model) AS config_model, CASE WHEN x.model IS NOT NULL THEN x.tpm ELSE y.tpm END AS tpm,
          CASE WHEN x.model IS NOT NULL THEN x.temperature ELSE y.temperature END AS temperature, CASE WHEN x.model IS NOT NULL THEN x.top_k ELSE y.top_k END AS top_k,
          CASE WHEN x.model IS NOT NULL THEN x.rpd ELSE y.rpd END AS rpd FROM e LEFT JOIN cfg x ON x.family = e.family AND x.model = e.model LEFT JOIN cfg y ON y.family = e.family AND y.dft)
        SELECT family, model, config_model, count(*) AS requests, sum(tpm)::BIGINT AS tpm, max(temperature)::DOUBLE AS temperature, max(top_k)::INT AS top_k, max(rpd)::INT AS rpd FROM m GROUP BY 1, 2, 3""",
    "h1_fingerprint": f"WITH {_HISTORY} SELECT request_id, sha256(to_json(list_transform(messages, lambda m: {{'content': m.content, 'role': m.role}}))) AS prompt_hash FROM req",
    "h2_query_text": f"""WITH {_HISTORY}, x AS (SELECT request_id, messages, list_filter(messages, lambda m: m.role IN ('user', 'human')) AS u FROM req)
        SELECT request_id, CASE WHEN len(u) > 0 THEN u[-1].content ELSE {q.join("list_filter(list_transform(messages, lambda m: m.content), lambda c: c <> '')")} END AS query_text FROM x""",
    "h3_embedding": f"WITH {_VECTOR} SELECT doc_id, bucket, round(x, 6)::DOUBLE AS value FROM vec",
    "m6_r10_gateway_audit": f"""WITH {_HISTORY}, {PROVIDERS}, {KEYS},
        o AS (SELECT organization_id, min(provider_id) FILTER (is_default) AS dft, min(provider_id) AS any_id FROM provider WHERE is_active GROUP BY 1),
        a AS (SELECT request_id AS id, (request_id // 1000) % 150 + 1 AS api_key_id, CASE WHEN request_id % 19 <> 0 THEN response END AS content, list_transform(messages, lambda m: m.content) AS cs FROM req),
        b AS (SELECT *, len(list_filter(cs, lambda c: contains(c, '```') OR contains(c, 'def ') OR contains(c, 'class '))) > 0 AS code FROM a),
        c AS (SELECT *, array_to_string(list_transform(cs, lambda c: CASE WHEN code THEN {_CODE_MATRIX['squeeze'].replace('text', 'c')} ELSE {q.flat_filter('c', d.DATA_STOP_WORDS)} END), ' ') AS sent FROM b),
        e AS (SELECT c.*, user_id, k.organization_id, {q.tokens("array_to_string(cs, ' ')")}::INT AS t0, {q.tokens('sent')}::INT AS t1, linked_provider_id AS linked, dft, any_id,
          len({q.words('sent')}) > 2000 OR regexp_matches(sent, '(?i){"|".join(KEYWORDS)}') OR contains(upper(sent), '[HEAVY]') OR contains(upper(sent), '[COMPLEX]') AS complex,
          CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 6 <> 5 THEN n_nationkey % 7 END AS cheap, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 2 THEN (n_nationkey + 3) % 7 END AS heavy
          FROM c LEFT JOIN api_key k ON k.api_key_id = c.api_key_id LEFT JOIN nation ON n_nationkey = k.organization_id LEFT JOIN o ON o.organization_id = k.organization_id),
        f AS (SELECT e.*, coalesce(linked, CASE WHEN complex AND heavy IS NOT NULL THEN heavy WHEN NOT complex AND cheap IS NOT NULL THEN cheap ELSE dft END) AS wanted FROM e),
        g AS (SELECT f.*, CASE WHEN s_suppkey IS NOT NULL THEN wanted ELSE any_id END AS pid FROM f LEFT JOIN supplier ON s_suppkey = wanted),
        h AS (SELECT *, CASE WHEN pid IS NULL THEN 'No AI provider configured.' WHEN content IS NULL THEN 'No response.' END AS err FROM g),
        i AS (SELECT *, CASE WHEN err IS NOT NULL THEN '[Gateway error: ' || err || ']' WHEN code THEN {_CODE_MATRIX['squeeze'].replace('text', 'content')} ELSE {q.trim('content')} END AS fin,
          CASE WHEN err IS NULL THEN {q.tokens('content')}::INT ELSE 0 END AS tr, greatest(CASE WHEN content IS NULL THEN 0 ELSE id % 700 END, t1) AS billed FROM h),
        j AS (SELECT *, t0 * 0.0000001400::DECIMAL(20,10) + tr * 0.0000002800::DECIMAL(20,10) AS c0, billed * 0.0000001400::DECIMAL(20,10) + tr * 0.0000002800::DECIMAL(20,10) AS c1 FROM i)
        SELECT id, make_timestamp(id * 1000000) AS "timestamp", user_id, api_key_id, organization_id, pid AS ai_provider_id, 'gateway' AS source, CASE WHEN err IS NULL THEN 'success' ELSE 'error' END AS status,
          err AS error_message, sent AS compressed_payload, fin AS final_response, t0 AS tokens_original, t1 AS tokens_compressed, tr AS tokens_response, {q.pct('t0', 't1')} AS compression_ratio,
          c0::DECIMAL(10,6)::DOUBLE AS cost_original, c1::DECIMAL(10,6)::DOUBLE AS cost_actual, greatest(0, c0 - c1)::DECIMAL(10,6)::DOUBLE AS cost_saved, strlen(fin)::BIGINT AS data_bytes_out FROM j""",
    "h5_h6_two_level_lookup": f"WITH {_TWO_LEVELS} SELECT request_id, organization_id, match_type, entry_id, similarity FROM found",
    "h5_h6_entry_hits": f"""WITH {_TWO_LEVELS} SELECT entry_id, count(*) AS hit_count, count(*) FILTER (match_type = 'semantic') AS semantic_hits,
        make_timestamp(max(request_id) * 1000000) AS last_hit_at FROM found WHERE entry_id IS NOT NULL GROUP BY 1""",
    "h4_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "h5_exact_lookup": f"""WITH {AUDIT}, {_FIRST_HALF} SELECT id AS request_id, a.organization_id, f.prompt_hash IS NOT NULL AS hit, 'r' || first_id AS response_json
        FROM audit a LEFT JOIN f ON f.organization_id = a.organization_id AND f.prompt_hash = a.payload_hash WHERE day("timestamp") > 15""",
    "h6_semantic_lookup": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), qy AS (SELECT vec_id, label, list_transform(v, lambda x, i: CASE WHEN i % 4 = 1 THEN 0.0 ELSE x END) AS v FROM e),
        s AS (SELECT qy.vec_id AS query_id, e.vec_id AS entry_id, list_cosine_similarity(qy.v, e.v) AS sim, (e.vec_id % 4000) AS tok FROM qy JOIN e USING (label)),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, entry_id) AS rk FROM s WHERE sim >= 0.8) WHERE rk = 1)
        SELECT query_id, entry_id, round(sim, 4) AS similarity, round(1 - sim, 4) AS mismatch_delta, round(tok * 0.001::DOUBLE, 4) AS regen_cost, sim >= 0.8 AND tok * 0.001::DOUBLE > (1 - sim) * 10 AS accepted FROM b""",
    "h7_upsert": f"""WITH {AUDIT}, {_FIRST_HALF}, u AS (SELECT organization_id, payload_hash AS prompt_hash, 'u' || max(id) AS response_json, max(id) AS created_at FROM audit WHERE day("timestamp") > 10 GROUP BY 1, 2)
        SELECT coalesce(u.organization_id, f.organization_id) AS organization_id, coalesce(u.prompt_hash, f.prompt_hash) AS prompt_hash, coalesce(f.hit_count, 0)::BIGINT AS hit_count,
        coalesce(u.response_json, 'r' || f.first_id) AS response_json, coalesce(u.created_at, f.first_id) AS created_at FROM f FULL JOIN u ON u.organization_id = f.organization_id AND u.prompt_hash = f.prompt_hash""",
    "h8_replay": f"""WITH {AUDIT}, {_REPLAY} SELECT organization_id, payload_hash, any_value(id) FILTER (rn = 1) AS first_id, count(*) FILTER (rn > 1) AS hit_count, max("timestamp") FILTER (rn > 1) AS last_hit_at FROM x GROUP BY 1, 2""",
    "h8_hit_rate": f"""WITH {AUDIT}, {_REPLAY} SELECT organization_id, count(*)::BIGINT AS lookups, count(*) FILTER (rn > 1)::BIGINT AS hits, count(*) FILTER (rn = 1) AS entries, round(count(*) FILTER (rn > 1) * 100 / count(*), 2)::DOUBLE AS hit_rate FROM x GROUP BY 1""",
    "h9_top_similar": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS match_id, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id)
        SELECT vec_id, match_id, round(sim, 6) AS similarity, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, match_id) AS rk FROM s WHERE sim >= 0.25) WHERE rk <= 5""",
    "h9_top_similar_by_label": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS match_id, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
        SELECT vec_id, match_id, round(sim, 6) AS similarity, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, match_id) AS rk FROM s WHERE sim >= 0.2) WHERE rk <= 3""",
}
