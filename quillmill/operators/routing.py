"""Content classes, complexity, confidence and the assignment of models and nodes."""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import vocab
from quillmill.functions.metrics import est_tokens
from quillmill.functions.text import BLANKS, let, lines, strip, unicode, words


# Patterns with as many matches in lower-cased ASCII text after a blank, begun by a sign that few characters are.
_ASCII = {
    r"[a-zA-Z_]\w*\(.*?\)": r"[a-z_]\d*+\(.*?\)",
    r"[a-zA-Z_]\w*\.[a-zA-Z_]": r"[a-z_]\d*+\.[a-z_]",
    r"(==|!=|<=|>=|&&|\|\||::|->)": r"[=!<>&|:-][=&|:>](?<===|!=|<=|>=|&&|\|\||::|->)",
    r"(Traceback|Exception|Error|at\s+\w+\.\w+\()":
        r"[aet](?:(?<=t)raceback|(?<=e)xception|(?<=e)rror|(?<=a)t\s++\w++\.\w++\()",
    r"(WARN|INFO|DEBUG|ERROR|FATAL)\s": r"[defiw](?:(?<=w)arn|(?<=i)nfo|(?<=d)ebug|(?<=e)rror|(?<=f)atal)\s",
    r"\b(please|could you|would you|can you|I need|help me)\b": r"\W(?=[chipw])(?:please|could you|would you|can you|i need|help me)(?!\w)",
}


def _word_list(pattern: str) -> tuple[list[str], list[str], bool] | None:
    """Words, other signs and whether a blank must follow, of a pattern that lists whole words; None for another pattern."""
    found = re.fullmatch(r"\\b\(([A-Za-z|]+)\)\\([sb])|\\b\(([A-Za-z|=>]+)\)\\(s)", pattern)
    if not found:
        return None
    listed = (found.group(1) or found.group(3)).lower().split("|")
    return [w for w in listed if w.isalpha()], [w for w in listed if not w.isalpha()], "s" in (found.group(2), found.group(4))


def _listed_words(ascii_low: Column, rules) -> Column:
    """All words of the rules' lists in a lower-cased ASCII text, each with the blank after it if there is one."""
    words = sorted({w for p, _ in rules if (found := _word_list(p)) for w in found[0]})
    by_letter = "|".join(k + "(?:" + "|".join(w[1:] for w in own) + ")" for k, own in itertools.groupby(words, lambda w: w[0]))
    return F.regexp_extract_all(ascii_low, F.lit(rf"\b((?:{by_letter or '(?!)'})(?:\s|(?!\w)))"), F.lit(1))


def _weighted(c: Column, ascii_low: Column, listed: Column, rules) -> Column:
    """Matches times weights; of ASCII texts counted over the words found at once, or by the quicker patterns."""
    def quick(p: str) -> Column | None:
        if p in _ASCII:
            return F.regexp_count(ascii_low, F.lit(_ASCII[p]))
        found = _word_list(p)
        if found is None:
            return None
        words, signs, blank = found
        asked = [w + end for w in words for end in (*BLANKS, *([] if blank else [""]))]
        n = F.size(F.filter(listed, lambda w: w.isin(asked)))
        if signs:
            n = n + F.regexp_count(ascii_low, F.lit("(?=[" + "".join(s[0] for s in signs) + r"])\b(?:" + "|".join(signs) + r")\s"))
        return F.when(ascii_low.isNotNull(), n)

    def found(p: str) -> Column:
        n, fast = F.regexp_count(c, F.lit(unicode("(?im)" + p))), quick(p)
        return n if fast is None else F.coalesce(fast, n)

    return reduce(lambda a, b: a + b, [found(p) * F.lit(w) for p, w in rules])


def classify(df: DataFrame, text: str = "text", code=vocab.CODE_WEIGHTS, prose=vocab.PROSE_WEIGHTS,
             threshold: float = vocab.CODE_THRESHOLD) -> DataFrame:
    """Adds content_type (``cac`` code, ``nlc`` prose) and confidence."""
    blank = F.col(text).isNull() | (strip(F.col(text)) == "")
    low = F.when(F.octet_length(text) == F.length(text), F.concat(F.lit(" "), F.lower(text)))
    staged = df.withColumn("_low", low).withColumn("_listed", _listed_words(F.col("_low"), (*code, *prose)))
    seen = F.col(text), F.col("_low"), F.col("_listed")
    scored = staged.withColumns({"_code": F.round(_weighted(*seen, code), 6), "_prose": F.round(_weighted(*seen, prose), 6)})
    staged = scored.withColumn("_ratio", F.when(F.col("_code") + F.col("_prose") > 0,
                                                F.col("_code") / (F.col("_code") + F.col("_prose"))))
    is_code = F.coalesce(F.col("_ratio") > threshold, F.lit(False)) & ~blank
    ratio = F.when(is_code, F.col("_ratio")).otherwise(1 - F.col("_ratio"))
    confidence = (F.when(blank, 1.0).when(F.col("_ratio").isNull(), 0.5)
                  .otherwise(F.round(F.least(F.lit(1.0), ratio), 6)))
    return staged.withColumns({"content_type": F.when(is_code, "cac").otherwise("nlc"),
                               "confidence": confidence}).drop("_low", "_listed", "_code", "_prose", "_ratio")


def _hits(c: Column, patterns, flags: str = "(?m)") -> Column:
    return reduce(lambda a, b: a + b, [c.rlike(unicode(flags + p)).cast("int") for p in patterns])


def is_stack_trace(c: Column) -> Column:
    return _hits(c, vocab.TRACE_INDICATORS) >= 2


def is_log_dump(c: Column) -> Column:
    """Five lines or more, over 40 % of them log-like."""
    # Trimmed lines are matched where they stand: after a level a blank and more must follow on its line.
    blank = r"[ \t\r\f\x0b]"
    line = "(?dm)^" + blank + "*+(?:" + vocab.LOG_LINE.replace("^", "").replace(r"\s", blank + r"++[^\n]") + ")"

    def dense(text: Column) -> Column:
        n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
        return (n >= 5) & (F.regexp_count(text, F.lit(line)) / n > 0.4)

    return let(strip(c), dense)


def is_log_head(c: Column) -> Column:
    """More than five of the first twenty lines are log-like."""
    head = F.slice(lines(strip(c)), 1, 20)
    return F.size(F.filter(head, lambda x: strip(x).rlike(vocab.LOG_HEAD_LINE))) > 5


def guess_language(c: Column) -> Column:
    py, js = _hits(c, vocab.PYTHON_INDICATORS), _hits(c, vocab.SCRIPT_INDICATORS)
    return F.when(py > js, "python").when(js > py, "javascript").otherwise("generic")


def has_code(messages: Column | str) -> Column:
    return F.exists(messages, lambda m: m["content"].contains("```") | m["content"].contains("def ")
                    | m["content"].contains("class "))


def is_complex(c: Column, keywords=vocab.COMPLEX_KEYWORDS, most_words: int = vocab.COMPLEX_WORDS) -> Column:
    """A long text, one of the keywords, or a forcing tag."""
    tags = reduce(lambda a, b: a | b, [F.upper(c).contains(t) for t in vocab.COMPLEX_TAGS])
    return (F.size(words(c)) > most_words) | c.rlike(unicode("(?i)" + "|".join(keywords))) | tags


def confidence(c: Column, hedges=vocab.UNCERTAINTY) -> Column:
    """One minus the weighted hedges, never negative; blank text has none."""
    penalty = reduce(lambda a, b: a + b,
                     [F.regexp_count(c, F.lit(unicode("(?i)" + p))) * F.lit(w) for p, w in hedges])
    return (F.when(c.isNull() | (strip(c) == ""), 0.0)
            .otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - penalty), 6)))


def cascade_replay(requests: DataFrame, configs: DataFrame, default_threshold: float = vocab.CONFIDENCE_THRESHOLD,
                   hedges=vocab.UNCERTAINTY, keywords=vocab.COMPLEX_KEYWORDS) -> DataFrame:
    """Replay two-tier routing over logged answers.

    ``requests`` holds prompt, cheap_response, heavy_response and organization_id;
    only active configurations count.
    """
    active = configs.filter("is_active").select("organization_id", "confidence_threshold", "cheap_provider_id",
                                                "heavyweight_provider_id")
    joined = requests.join(active, "organization_id", "left").withColumns({
        "threshold": F.coalesce(F.nullif("confidence_threshold", F.lit(0.0)), F.lit(default_threshold)),
        "complex": is_complex(F.col("prompt"), keywords),
        "confidence": confidence(F.col("cheap_response"), hedges)})
    cheap, heavy = F.col("cheap_provider_id").isNotNull(), F.col("heavyweight_provider_id").isNotNull()
    direct = F.col("complex") & heavy
    sure = F.col("confidence") >= F.col("threshold")
    return joined.select(
        "request_id", "organization_id", "complex",
        F.when(~direct & cheap, F.col("confidence")).alias("confidence"),
        F.when(direct, "direct_to_heavy").when(~cheap & ~heavy, "unrouted").when(~cheap, "heavy")
        .when(sure, "cheap").when(heavy, "escalated").otherwise("cheap_low_confidence").alias("decision"),
        F.when(~direct & cheap, ~sure).alias("escalated"),
        F.when(direct, F.col("heavy_response")).when(cheap & sure, F.col("cheap_response"))
        .when(heavy, F.col("heavy_response")).when(cheap, F.col("cheap_response")).otherwise("").alias("final_text"))


def decide_tier(df: DataFrame, text: str = "text", threshold: int = 500, signals=vocab.TIER_SIGNALS) -> DataFrame:
    """Adds tier, model, signals found and the reason."""
    found = let(F.lower(F.col(text)), lambda low: F.filter(F.array(*[F.lit(s) for s in signals]), lambda s: low.contains(s)))
    staged = df.withColumn("signals", found).withColumn("token_count", est_tokens(text))
    over, hit = F.col("token_count") > threshold, F.size("signals") > 0
    reason = (F.when(over, F.concat(F.lit("Token count "), F.col("token_count").cast("string"),
                                    F.lit(f" > threshold {threshold}")))
              .when(hit, F.concat(F.lit("Complexity signals: ['"), F.array_join("signals", "', '"), F.lit("']")))
              .otherwise("None — standard routing"))
    return staged.withColumns({
        "tier": F.when(over | hit, 2).otherwise(1),
        "model": F.when(over | hit, vocab.TIER_MODELS[2]).otherwise(vocab.TIER_MODELS[1]), "reason": reason})


def resolve_provider(requests: DataFrame, keys: DataFrame, configs: DataFrame, providers: DataFrame) -> DataFrame:
    """Linked, tier, default, then any active provider.

    ``requests`` holds request_id, api_key_id, organization_id, complex.  The
    last two steps need one row per organization, so they are grouped before
    the joins; the smallest id stands for "any".
    """
    linked = keys.select("api_key_id", "linked_provider_id")
    tier = configs.filter("is_active").select("organization_id", "cheap_provider_id", "heavyweight_provider_id")
    per_org = providers.filter("is_active").groupBy("organization_id").agg(
        F.min(F.when(F.col("is_default"), F.col("provider_id"))).alias("default_id"),
        F.min("provider_id").alias("any_id"))
    known = providers.select(F.col("provider_id").alias("wanted"), F.lit(True).alias("exists"))
    wanted = (F.when(F.col("linked_provider_id").isNotNull(), F.col("linked_provider_id"))
              .when(F.col("complex") & F.col("heavyweight_provider_id").isNotNull(), F.col("heavyweight_provider_id"))
              .when(~F.col("complex") & F.col("cheap_provider_id").isNotNull(), F.col("cheap_provider_id"))
              .otherwise(F.col("default_id")))
    staged = (requests.join(linked, "api_key_id", "left").join(tier, "organization_id", "left")
              .join(per_org, "organization_id", "left").withColumn("wanted", wanted).join(known, "wanted", "left"))
    chosen = F.when(F.col("exists"), F.col("wanted")).otherwise(F.col("any_id"))
    how = (F.when(chosen.isNull(), "unresolved").when(F.col("exists").isNull(), "any")
           .when(F.col("linked_provider_id").isNotNull(), "linked")
           .when(F.col("complex") & F.col("heavyweight_provider_id").isNotNull(), "heavy")
           .when(~F.col("complex") & F.col("cheap_provider_id").isNotNull(), "cheap").otherwise("default"))
    return staged.select("request_id", "organization_id", chosen.alias("provider_id"), how.alias("resolution"))


def detect_region(ip: Column) -> Column:
    c = None
    for region, pattern in vocab.REGION_PATTERNS:
        c = F.when(ip.rlike(pattern), region) if c is None else c.when(ip.rlike(pattern), region)
    return c.otherwise(vocab.DEFAULT_REGION)


def assign_edge_nodes(clients: DataFrame, rules: DataFrame, nodes: DataFrame, require_eu: bool = True) -> DataFrame:
    """Least loaded allowed node: by the organization's rules, else global rules, else any EU node.

    The best node per (region, organization) is found on the rule side, so the
    clients only take two equi-joins and no window.
    """
    eu = F.col("data_sovereignty_zone") == "eu"
    usable = F.col("node_active") & (eu if require_eu else F.lit(True))
    node = nodes.select(F.col("node_id").alias("target_node_id"), "current_load_pct", "data_sovereignty_zone",
                        F.col("is_active").alias("node_active"))
    rank = F.struct("current_load_pct", (-F.col("priority")).alias("p"), "rule_id")
    best = (rules.filter("is_active").join(node, "target_node_id", "left")
            .groupBy("source_region", "organization_id")
            .agg(F.min_by(F.when(usable, F.col("target_node_id")), F.when(usable, rank)).alias("node")))
    own = best.filter(F.col("organization_id").isNotNull()).select(
        F.col("source_region").alias("region"), "organization_id", F.col("node").alias("own_node"),
        F.lit(True).alias("own_rules"))
    shared = best.filter(F.col("organization_id").isNull()).select(
        F.col("source_region").alias("region"), F.col("node").alias("global_node"))
    any_eu = nodes.filter(F.col("is_active") & eu).agg(
        F.min_by("node_id", F.struct("current_load_pct", "node_id"))).scalar()
    by_rule = F.when(F.col("own_rules"), F.col("own_node")).otherwise(F.col("global_node"))
    chosen = F.coalesce(by_rule, any_eu) if require_eu else by_rule
    return (clients.withColumn("region", detect_region(F.col("client_ip")))
            .join(own, ["region", "organization_id"], "left").join(shared, "region", "left")
            .select("request_id", "organization_id", "region", chosen.alias("node_id"),
                    F.when(by_rule.isNull(), "fallback").when(F.col("own_rules"), "organization")
                    .otherwise("global").alias("scope")))


def compliance_report(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Residency statement of each assignment."""
    zone = F.col("data_sovereignty_zone")
    text = (F.when(zone.isNull(), "No edge node selected — data may leave EU jurisdiction")
            .when(zone == "eu", "Data processed and stored within EU jurisdiction")
            .otherwise(F.concat(F.lit("Data may be processed outside EU ("), zone, F.lit(")"))))
    return assigned.join(nodes.select("node_id", "node_name", "data_sovereignty_zone"), "node_id", "left").select(
        "request_id", "node_name", zone.alias("zone"), F.coalesce(zone == "eu", F.lit(False)).alias("gdpr_compliant"),
        text.alias("data_residency"))


def compliance_totals(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    per_node = assigned.groupBy("node_id").agg(F.count("*").alias("n"))
    return (per_node.join(nodes.select("node_id", "data_sovereignty_zone"), "node_id", "left")
            .groupBy(F.coalesce("data_sovereignty_zone", F.lit("none")).alias("zone"))
            .agg(F.sum("n").alias("requests"), F.count("*").alias("nodes")))


def with_model_config(df: DataFrame, family: str = "family", model: str = "model") -> DataFrame:
    """Configuration of each row's model; unknown models take the family's default.

    The configuration is a fixed list of four rows, hence the broadcast.
    """
    names = ("family", "model", "temperature", "top_p", "top_k", "max_tokens", "rpm", "tpm", "rpd", "is_default")
    conf = df.sparkSession.createDataFrame(
        vocab.MODEL_CONFIGS, "family string, model string, temperature double, top_p double, top_k int, "
                             "max_tokens int, rpm int, tpm int, rpd int, is_default boolean")
    values = names[2:-1]
    exact = conf.select(F.col("family").alias("f"), F.col("model").alias("m"), F.lit(True).alias("known"),
                        *[F.col(v).alias(f"x_{v}") for v in values])
    fallback = conf.filter("is_default").select(F.col("family").alias("df"), F.col("model").alias("default_model"),
                                                *[F.col(v).alias(f"d_{v}") for v in values])
    joined = (df.join(F.broadcast(exact), (F.col(family) == F.col("f")) & (F.col(model) == F.col("m")), "left")
              .join(F.broadcast(fallback), F.col(family) == F.col("df"), "left"))
    return joined.select(*df.columns, F.when(F.col("known"), F.col(model)).otherwise(F.col("default_model")).alias("config_model"),
                         *[F.when(F.col("known"), F.col(f"x_{v}")).otherwise(F.col(f"d_{v}")).alias(v) for v in values])
