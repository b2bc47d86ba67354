"""Injection scans, permissions, quotas, key checks and egress rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.rows import unroll
from quillmill.functions.skew import spread_join
from quillmill.functions.text import BLANKS, strip, unicode
from quillmill.operators.patternjoin import compiles, pattern_hits


def violations(value: Column, patterns=vocab.BLOCKED_PATTERNS) -> Column:
    """All patterns found in a value, in rule order."""
    found = [F.when(value.rlike(unicode("(?i)" + p)), F.lit(p)) for p in patterns]
    return F.array_compact(F.array(*found))


def param_rows(calls: DataFrame) -> DataFrame:
    """One row per parameter of each call."""
    return calls.select("call_id", "organization_id", "tool_name", F.explode("params").alias("path", "value"))


def injection_scan(calls: DataFrame, patterns=vocab.BLOCKED_PATTERNS) -> DataFrame:
    """Parameters with a violation: first pattern and number of patterns."""
    return (param_rows(calls).withColumn("violations", violations(F.col("value"), patterns))
            .filter(F.size("violations") > 0)
            .select("call_id", "path", F.element_at("violations", 1).alias("first_violation"),
                    F.size("violations").alias("violation_count"), "violations"))


def injection_report(calls: DataFrame, patterns=vocab.BLOCKED_PATTERNS) -> DataFrame:
    return (unroll(injection_scan(calls, patterns), [], "violations", "pattern")
            .groupBy("pattern").agg(F.count("*").alias("hits")))


def pattern_lines(tools: DataFrame) -> DataFrame:
    """tool_id, pos, pattern: the non-blank pattern lines of each tool."""
    parts = F.filter(F.transform(F.split("blocked_patterns", "\n"), strip), lambda p: p != "")
    return unroll(tools, ["tool_id"], parts, "pattern", "pos")


def rejected_lines(tools: DataFrame) -> list[str]:
    """Distinct patterns that the executors' regex engine rejects, for display; no operator uses the list."""
    return [r.pattern for r in pattern_lines(tools).select("pattern").distinct().filter(~compiles(F.col("pattern"))).collect()]


def usable_lines(tools: DataFrame) -> DataFrame:
    """tool_id, pos, pattern: blank lines and patterns that the engine rejects are skipped."""
    return pattern_lines(tools).filter(compiles(F.col("pattern")))


def tool_patterns(tools: DataFrame) -> DataFrame:
    """Usable patterns of each tool as an array."""
    return usable_lines(tools).groupBy("tool_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "pattern"))), lambda s: s["pattern"]).alias("patterns"))


def policy_scan(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Parameters that match a pattern of their own tool; every pattern is tried on every value of its tool."""
    with_patterns = tools.join(tool_patterns(tools), "tool_id").select("organization_id", "tool_name", "patterns")
    found = F.filter("patterns", lambda p: F.regexp_like(F.col("value"), F.concat(F.lit("(?i)"), p)))
    return (param_rows(calls).join(with_patterns, ["organization_id", "tool_name"])
            .withColumn("matched", found).filter(F.size("matched") > 0)
            .select("call_id", "tool_name", "path", F.element_at("matched", 1).alias("first_violation"),
                    F.size("matched").alias("violation_count")))


def policy_scan_indexed(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``policy_scan`` for pattern tables of any size: the same rows, by joins on literals that the patterns need.

    A value that many calls share is tried once.
    """
    named = ["organization_id", "tool_name"]
    patterns = usable_lines(tools).join(tools.select("tool_id", *named), "tool_id")
    rows = param_rows(calls)
    hits = pattern_hits(rows, patterns, named, "tool_id")
    keyed = rows.withColumn("digest", F.sha2(F.col("value").cast("binary"), 256))
    return spread_join(keyed, hits, [*named, "digest"], "call_id").select(
        "call_id", "tool_name", "path", F.element_at("matched", 1).alias("first_violation"),
        F.size("matched").alias("violation_count"))


def clean_value(c: Column) -> Column:
    """No NUL, single blanks, trimmed."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit("")), r"\s+", " "))


def clean_params(calls: DataFrame) -> DataFrame:
    """Cleaned parameters as a map; nested values are flattened beforehand by ``flatten_params``."""
    return calls.withColumn("params", F.transform_values("params", lambda k, v: clean_value(v)))


def nesting(raw: Column) -> Column:
    """How deep a JSON text nests; strings do not count.  One walk over its brackets."""
    bare = F.regexp_replace(F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), start, step, lambda a: a["most"])


def flatten_params(df: DataFrame, key: str = "call_id", raw: str = "params_json") -> DataFrame:
    """(call, path, value) rows of nested JSON parameters, as deep as the data nest.

    Each round takes one level of the variants apart; the depth is read off the
    brackets in a pass before, which brings one number to the driver.
    """
    depth = df.agg(F.max(nesting(F.col(raw)))).first()[0] or 0
    level = df.select(key, F.lit("$").alias("path"), F.try_parse_json(raw).alias("v"))
    leaves = None
    for i in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        flat = level.filter(F.col("v").isNotNull() & ~nested).select(
            key, "path", F.try_variant_get("v", "$", "string").alias("value"))
        leaves = flat if leaves is None else leaves.unionByName(flat)
        if i == depth:
            break
        parts = level.filter(nested).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select(
            "pos", F.col("key").alias("_name"), "value"))
        step = F.when(F.col("_name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
            F.concat(F.lit("."), F.col("_name")))
        level = parts.select(key, F.concat("path", step).alias("path"), F.col("value").alias("v"))
    return leaves.withColumn("value", clean_value(F.col("value")))


def tool_status(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds tool_id and risk level of the active tool of that name, if any."""
    active = tools.filter("is_active").groupBy("organization_id", "tool_name").agg(
        F.min("tool_id").alias("tool_id"), F.min_by("risk_level", "tool_id").alias("risk_level"))
    return calls.join(active, ["organization_id", "tool_name"], "left")


def unknown_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls to tools that do not exist or are inactive."""
    return calls.join(tools.filter("is_active").select("organization_id", "tool_name").distinct(),
                      ["organization_id", "tool_name"], "left_anti")


def verdicts(calls: DataFrame, permissions: DataFrame) -> DataFrame:
    """Adds permission (allowed, missing, denied, approval) and the call limit.

    A row for the call's own key goes before a row for every key.  Both sets
    are reduced to one row per key before the joins.
    """
    pick = F.struct("is_allowed", "requires_human_approval", "max_calls_per_minute")
    own = (permissions.filter(F.col("api_key_id").isNotNull()).groupBy("organization_id", "tool_id", "api_key_id")
           .agg(F.min_by(pick, "permission_id").alias("own")))
    every = (permissions.filter(F.col("api_key_id").isNull()).groupBy("organization_id", "tool_id")
             .agg(F.min_by(pick, "permission_id").alias("every")))
    joined = (calls.join(own, ["organization_id", "tool_id", "api_key_id"], "left")
              .join(every, ["organization_id", "tool_id"], "left").withColumn("p", F.coalesce("own", "every")))
    verdict = (F.when(F.col("p").isNull(), "missing").when(~F.col("p.is_allowed"), "denied")
               .when(F.col("p.requires_human_approval"), "approval").otherwise("allowed"))
    return joined.withColumn("permission", verdict).withColumn(
        "call_limit", F.col("p.max_calls_per_minute")).drop("own", "every", "p")


def adjudicate(calls: DataFrame, tools: DataFrame, permissions: DataFrame) -> DataFrame:
    """Status and message of each call: tool, then permission, then scan."""
    staged = verdicts(tool_status(calls, tools), permissions).join(tool_patterns(tools), "tool_id", "left")

    def first_hit(e: Column) -> Column:
        universal = F.element_at(violations(e["value"]), 1)
        own = F.element_at(F.filter("patterns", lambda p: F.regexp_like(e["value"], F.concat(F.lit("(?i)"), p))), 1)
        return (F.when(F.size(violations(e["value"])) > 0, F.concat(
            F.lit("Universal security violation in param '"), e["key"], F.lit("': blocked pattern detected — '"), universal, F.lit("'")))
            .when(F.size(F.filter("patterns", lambda p: F.regexp_like(e["value"], F.concat(F.lit("(?i)"), p)))) > 0, F.concat(
                F.lit("Tool policy violation in param '"), e["key"], F.lit("': blocked pattern detected — '"), own, F.lit("'"))))

    hits = F.array_compact(F.transform(F.map_entries("params"), first_hit))
    name = F.col("tool_name")
    message = (F.when(F.col("tool_id").isNull(), F.concat(F.lit("Tool '"), name, F.lit("' not found or is inactive.")))
               .when(F.col("permission") == "missing", F.concat(
                   F.lit("No permission configured for tool '"), name,
                   F.lit("'. Contact your administrator to grant access.")))
               .when(F.col("permission") == "denied", F.concat(
                   F.lit("Access to tool '"), name, F.lit("' is explicitly denied for this API key.")))
               .when(F.col("permission") == "approval", F.concat(
                   F.lit("Tool '"), name, F.lit("' requires human approval before execution. "
                                                "Please request approval from your administrator.")))
               .when(F.size("hits") > 0, F.element_at("hits", 1)))
    return (staged.withColumn("hits", hits).withColumn("message", message)
            .select("call_id", "organization_id", "api_key_id", "tool_name", "ts",
                    F.when(F.col("message").isNull(), "success").otherwise("denied").alias("status"), "message",
                    "risk_level"))


def tool_catalogue(tools: DataFrame, permissions: DataFrame, key_id) -> DataFrame:
    """Active tools with accessibility for one key."""
    asked = tools.filter("is_active").withColumn("api_key_id", F.lit(key_id).cast("long"))
    return verdicts(asked, permissions).select(
        "tool_id", "organization_id", "tool_name", "risk_level", (F.col("permission") == "allowed").alias("accessible"))


def minute_quota(log: DataFrame, keys: DataFrame, limit: str = "rate_limit", ts: str = "timestamp") -> DataFrame:
    """Keys over their limit per calendar minute."""
    used = log.groupBy("api_key_id", F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("calls"))
    return (used.join(keys.select("api_key_id", limit), "api_key_id").filter(F.col("calls") > F.col(limit))
            .select("api_key_id", "minute", "calls", F.col(limit).alias("allowed")))


def daily_quota(log: DataFrame, keys: DataFrame, tokens: str = "tokens_compressed", ts: str = "timestamp") -> DataFrame:
    """Keys over their daily tokens; a limit of 0 means none."""
    used = log.groupBy("api_key_id", F.to_date(ts).alias("day")).agg(F.sum(tokens).alias("tokens"))
    return (used.join(keys.select("api_key_id", "daily_token_limit"), "api_key_id")
            .filter((F.col("daily_token_limit") > 0) & (F.col("tokens") > F.col("daily_token_limit"))))


def sliding_quota(log: DataFrame, keys: DataFrame, limit: str = "rate_limit", ts: str = "timestamp",
                  seconds: int = 60, chunk: int = 3600) -> DataFrame:
    """Seconds at which a key's calls of the last ``seconds`` exceed its limit.

    Calls are first counted per second.  Time is cut into chunks and the last
    minute of a chunk is repeated at the head of the next, so a key with a
    third of all calls is spread over as many windows as it has hours.
    """
    sec = F.unix_seconds(F.date_trunc("second", ts))
    per_sec = log.groupBy("api_key_id", sec.alias("sec")).agg(F.count("*").alias("n"))
    own = F.floor(F.col("sec") / chunk)
    copies = F.when(F.pmod("sec", F.lit(chunk)) > chunk - seconds, F.array(own, own + 1)).otherwise(F.array(own))
    spread = per_sec.withColumn("chunk", F.explode(copies))
    w = W.partitionBy("api_key_id", "chunk").orderBy("sec").rangeBetween(-(seconds - 1), 0)
    counted = spread.withColumn("calls", F.sum("n").over(w)).filter(F.floor(F.col("sec") / chunk) == F.col("chunk"))
    return (counted.join(keys.select("api_key_id", limit), "api_key_id").filter(F.col("calls") > F.col(limit))
            .select("api_key_id", F.timestamp_seconds("sec").alias("at"), "calls", F.col(limit).alias("allowed")))


def check_keys(log: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Adds key_status to each request: ok, bad_prefix, unknown or inactive."""
    known = keys.select(key, F.col("api_key_id").alias("known_id"), "is_active")
    status = (F.when(~F.coalesce(F.col(key).startswith(vocab.KEY_PREFIX), F.lit(False)), "bad_prefix")
              .when(F.col("known_id").isNull(), "unknown").when(~F.col("is_active"), "inactive").otherwise("ok"))
    return log.join(known, key, "left").withColumn("key_status", status).drop("known_id", "is_active")


def key_usage(log: DataFrame, keys: DataFrame, key: str = "key", ts: str = "timestamp") -> DataFrame:
    """Requests and last use per key and status; grouped before the join."""
    used = log.groupBy(key).agg(F.count("*").alias("requests"), F.max(ts).alias("last_used_at"))
    return check_keys(used, keys, key)


def egress_clean(df: DataFrame, text: str = "text", out: str = "text_out", rules=vocab.EGRESS_RULES) -> DataFrame:
    """Strip each rule's matches, trim after each; count the rules that changed the text."""
    current = df.withColumns({out: F.col(text), "rules_triggered": F.lit(0)})
    for rule in rules:
        # Rules apply per line, as ^ and $ do in the source rules.
        staged = current.withColumn("_next", F.btrim(F.regexp_replace(out, "(?m)" + rule, ""), F.lit(BLANKS)))
        changed = (F.col("_next") != F.col(out)).cast("int")
        current = staged.withColumns({"rules_triggered": F.col("rules_triggered") + changed, out: F.col("_next")}).drop("_next")
    return current
