import datetime as dt
import random

import pytest

from quillmill.functions import vocab
from quillmill.operators import normalize as n
from quillmill.operators import privacy as v
from quillmill.operators import security as sec

PLANTED = {
    r";\s*DROP\s+": "x; DROP t", r";\s*DELETE\s+FROM\s+": "; delete from t", r";\s*TRUNCATE\s+": "; truncate t",
    r";\s*ALTER\s+": "; ALTER t", r";\s*CREATE\s+": ";create t", r"UNION\s+SELECT": "union  select 1", r"--\s*$": "a -- ",
    r"\.\./|\.\.\\": "..\\x", r"/etc/passwd": "/etc/passwd", r"/etc/shadow": "/etc/shadow", r"%2e%2e": "%2E%2e",
    r"%252e%252e": "%252e%252e", r";\s*(?:rm|sudo|chmod|chown|kill|shutdown|reboot)\s": "; rm x", r"\$\(": "$(id)",
    r"`[^`]*`": "`id`", r"\|\s*(?:bash|sh|zsh|cmd|powershell)": "a | sh", r"<script[^>]*>": "<SCRIPT src=x>",
    r"javascript:": "JavaScript:x", r"eval\s*\(": "eval (x",
}


def test_each_blocked_pattern(one):
    assert list(PLANTED) == list(vocab.BLOCKED_PATTERNS)
    for pattern, value in PLANTED.items():
        assert pattern in one(sec.violations, value)[0], pattern
    assert one(sec.violations, "a clean value -- with dashes") == [[]]


@pytest.fixture(scope="module")
def tool_tables(spark):
    tools = spark.createDataFrame([(1, 1, "read", "low", True, ""), (2, 1, "old", "low", False, ""), (3, 1, "sql", "high", True, "drop\\d+\n\n[bad\n  secret "),
                                   (4, 1, "mail", "low", True, ""), (5, 1, "free", "low", True, ""), (6, 1, "deny", "low", True, "")],
                                  "tool_id int, organization_id int, tool_name string, risk_level string, is_active boolean, blocked_patterns string")
    perms = spark.createDataFrame([(1, 1, 1, None, True, False, 5), (2, 1, 3, None, True, False, 5), (3, 1, 4, None, True, True, 5),
                                   (4, 1, 6, None, True, False, 5), (5, 1, 6, 9, False, False, 5)],
                                  "permission_id int, organization_id int, tool_id int, api_key_id long, is_allowed boolean, requires_human_approval boolean, max_calls_per_minute int")
    return tools, perms


def _call(i, tool, key=9, **params):
    return (i, 1, key, tool, params or {"q": "ok"}, dt.datetime(2024, 1, 1))


def test_adjudication(spark, tool_tables):
    tools, perms = tool_tables
    calls = spark.createDataFrame([
        _call(1, "read"), _call(2, "nope"), _call(3, "old"), _call(4, "mail"), _call(5, "free"), _call(6, "deny"), _call(7, "deny", key=8),
        _call(8, "sql", q="Drop12"), _call(9, "read", q="eval(1)"), _call(10, "sql", a="fine", b="SECRET"), _call(11, "sql", q="drop it")],
        "call_id long, organization_id int, api_key_id long, tool_name string, params map<string,string>, ts timestamp")
    got = {x["call_id"]: (x["status"], x["message"]) for x in sec.adjudicate(calls, tools, perms).collect()}
    assert {k for k, s in got.items() if s[0] == "success"} == {1, 7, 11}
    assert got[2][1] == "Tool 'nope' not found or is inactive." and got[3][1] == "Tool 'old' not found or is inactive."
    assert "requires human approval" in got[4][1] and "No permission configured" in got[5][1] and "explicitly denied" in got[6][1]
    assert got[8][1] == "Tool policy violation in param 'q': blocked pattern detected — 'drop\\d+'"
    assert got[9][1].startswith("Universal security violation in param 'q'") and "param 'b'" in got[10][1]
    assert {x["call_id"] for x in sec.unknown_calls(calls, tools).collect()} == {2, 3}
    catalogue = {x["tool_name"]: x["accessible"] for x in sec.tool_catalogue(tools, perms, 9).collect()}
    assert catalogue == {"read": True, "sql": True, "mail": False, "free": False, "deny": False}


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a": " x\\u0000  y ", "b": {"c": [1, {"d": "z"}], "e": {}}}'), (2, "broken{")], "call_id int, params_json string")
    got = {(x["path"], x["value"]) for x in sec.flatten_params(df).collect()}
    assert got == {("$.a", "x y"), ("$.b.c[0]", "1"), ("$.b.c[1].d", "z")}


def test_sliding_quota_matches_brute_force(spark):
    rng = random.Random(8)
    base = dt.datetime(2024, 1, 1, 0, 58)
    # One key makes most of the calls, across several chunk borders.
    rows = [(rng.choice([1, 1, 1, 2, 3]), base + dt.timedelta(seconds=rng.randint(0, 9000))) for _ in range(1500)]
    log = spark.createDataFrame(rows, "api_key_id int, timestamp timestamp")
    keys = spark.createDataFrame([(1, 6), (2, 2), (3, 100)], "api_key_id int, rate_limit int")
    got = {(x["api_key_id"], x["at"].replace(tzinfo=None)): x["calls"] for x in sec.sliding_quota(log, keys, chunk=600).collect()}
    want = {}
    for k, t in set(rows):
        calls = sum(1 for k2, t2 in rows if k2 == k and dt.timedelta(0) <= t - t2 < dt.timedelta(seconds=60))
        if calls > {1: 6, 2: 2, 3: 100}[k]:
            want[k, t] = calls
    assert got == want and want


def test_quota_and_keys(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "fk-a", t, 10)] * 3 + [(2, "xx-b", t, 99), (3, "fk-c", t, 5), (4, "fk-?", t, 1)],
                                "api_key_id int, key string, timestamp timestamp, tokens_compressed int")
    keys = spark.createDataFrame([(1, "fk-a", 2, 25, True), (2, "xx-b", 9, 0, True), (3, "fk-c", 9, 0, False)],
                                 "api_key_id int, key string, rate_limit int, daily_token_limit int, is_active boolean")
    assert [(x["api_key_id"], x["calls"]) for x in sec.minute_quota(log, keys).collect()] == [(1, 3)]
    assert [(x["api_key_id"], x["tokens"]) for x in sec.daily_quota(log, keys).collect()] == [(1, 30)]
    used = {x["key"]: (x["key_status"], x["requests"]) for x in sec.key_usage(log.drop("api_key_id"), keys).collect()}
    assert used == {"fk-a": ("ok", 3), "xx-b": ("bad_prefix", 1), "fk-c": ("inactive", 1), "fk-?": ("unknown", 1)}


def test_egress(docs):
    text = ("As per the AST compression rules I was given, here is the answer: The capital of France is Paris. "
            "Note: I am using the NEX semantic pipeline to structure this response.")
    rows = sec.egress_clean(docs(text, "plain", "Body.\nNote: bye", "x as instructed. y")).orderBy("doc_id").collect()
    assert [(r["text_out"], r["rules_triggered"]) for r in rows] == [("", 3), ("plain", 0), ("Body.", 1), ("x  y", 1)]


PII = ["Mail a@b.de and c@d.org, again a@b.de.", "IBAN DE44 5001 0517 5407 3249 31 at 10.1.2.3", "Call +49 30 1234567 or Dr. Anna Weber",
       "Ticket PRJ-123456 and INTERNAL-654321", "nothing here", "x@y.de and ax@y.de", " ".join(f"u{i}@h.com" for i in range(12))]


def test_masking_round_trip(docs, texts_of):
    masked = v.mask(docs(*PII), custom="INTERNAL-\\d{6}|||SECRET").cache()
    out = texts_of(masked, "clean_content")
    assert out[0] == "Mail [EMAIL_1] and [EMAIL_2], again [EMAIL_1]."
    assert out[1] == "IBAN [IBAN_1] at [IP_1]" and out[2] == "Call [PHONE_1] or [NAME_1]"
    assert out[3] == "Ticket [ID_1] and [SECRET_1]" and out[4] == PII[4]
    assert texts_of(v.reinject(masked), "restored") == PII
    assert v.leaks(masked).count() == 0
    counts = {r["doc_id"]: (r["entities"], r["more"]) for r in v.mapping_counts(masked).collect()}
    assert counts[6] == (12, 7) and counts[0] == (2, 0) and 4 not in counts


def test_switches_and_custom(docs):
    assert v.custom_patterns("a+|||x\nnope\n|||y\nb|||[X]") == {"X": "a+|b"}
    kinds = {r["entity_type"] for r in v.detect(docs(*PII), switches={"EMAIL": False, "IP": False}).collect()}
    assert "EMAIL" not in kinds and "IP" not in kinds and "IBAN" in kinds


def test_normalised_responses(spark):
    rows = [(1, "openai", '{"id":"r","model":"m","choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3}}'),
            (2, "gemini", '{"candidates":[{"content":{"parts":[{"text":"yo"}]},"finishReason":"MAX"}],"usageMetadata":{"promptTokenCount":1,"candidatesTokenCount":2}}'),
            (3, "anthropic", '{"content":[],"stop_reason":"end","usage":{"input_tokens":4,"output_tokens":5}}'), (4, "openai", "{bad")]
    got = {r["request_id"]: r for r in n.normalise_responses(spark.createDataFrame(rows, "request_id int, provider string, raw string")).collect()}
    assert (got[1]["content"], got[1]["finish_reason"], got[1]["total_tokens"]) == ("hi", "stop", 3)
    assert (got[2]["content"], got[2]["finish_reason"], got[2]["total_tokens"], got[2]["id"]) == ("yo", "MAX", 3, "chatcmpl-2")
    assert (got[3]["content"], got[3]["total_tokens"]) == ("", 9)
    assert got[4]["malformed"] and got[4]["model"] == "normalized" and not got[1]["malformed"]


def test_json_and_layout(spark, docs, texts_of):
    assert texts_of(n.reformat_json(docs(' {"a" : 1} ', "[1, 2", "[x ```json\n{\"b\": 2}``` ", "text"))) == ['{"a":1}', "[1, 2", '{"b":2}', "text"]
    assert texts_of(n.reformat_json(docs('{"b": 1.0, "a": 2, "s": "x  \\" y", "e": 1e5}'))) == ['{"b":1.0,"a":2,"s":"x  \\" y","e":1e5}']
    df = spark.createDataFrame([(1, [("system", "s"), ("assistant", "a"), ("tool", "t")])], "i int, messages array<struct<role:string,content:string>>")
    assert n.to_parts_layout(df).collect()[0]["payload"] == (
        '{"contents":[{"role":"model","parts":[{"text":"a"}]},{"role":"user","parts":[{"text":"t"}]}],"systemInstruction":{"parts":[{"text":"s"}]}}')


def test_chunks(spark):
    rows = [("openai", 'data: {"choices":[{"delta":{"content":"Hello "}}]}'), ("gemini", '{"candidates":[{"content":{"parts":[{"text":"x"}]}}]}'),
            ("anthropic", '{"type":"content_block_delta","delta":{"text":"y"}}'), ("openai", "data: [DONE]"), ("openai", "data: {bad")]
    got = [(r["delta"], r["is_end"]) for r in n.normalise_chunks(spark.createDataFrame(rows, "provider string, raw string")).collect()]
    assert got == [("Hello ", False), ("x", False), ("y", False), (None, True), (None, False)]
