"""Aggregates over the audit fact.

Plans read only the columns they add up; payload texts never reach them.
"Now" is a parameter, ``as_of``; by default the newest timestamp of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.metrics import est_tokens, mask_key, savings_pct

WIDE = "decimal(20,6)"


def latest(audit: DataFrame) -> Column:
    """The table's newest timestamp, as a scalar subquery."""
    return audit.agg(F.max("timestamp")).scalar()


def _as_of(audit: DataFrame, as_of) -> Column:
    return latest(audit) if as_of is None else F.lit(as_of)


def _days_before(moment: Column, days: int) -> Column:
    return moment - F.expr(f"INTERVAL {int(days)} DAYS")


def since(audit: DataFrame, days: int, as_of=None) -> DataFrame:
    return audit.filter(F.col("timestamp") >= _days_before(_as_of(audit, as_of), days))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def _money(c: str) -> Column:
    return F.coalesce(F.sum(F.col(c).cast(WIDE)), F.lit(0)).cast(WIDE)


def _errors() -> Column:
    return F.count_if(F.col("status") != "success")


def request_counts(audit: DataFrame, as_of=None) -> DataFrame:
    """Requests of each organization: all time and since midnight."""
    midnight = F.date_trunc("day", _as_of(audit, as_of))
    return audit.groupBy("organization_id").agg(
        F.count("*").alias("requests"), F.count_if(F.col("timestamp") >= midnight).alias("requests_today"))


def token_totals(audit: DataFrame) -> DataFrame:
    return audit.groupBy("organization_id").agg(
        _total("tokens_original").alias("tokens_original"), _total("tokens_compressed").alias("tokens_compressed"),
        _total("tokens_response").alias("tokens_response"), _money("cost_saved").alias("cost_saved"))


def recent(audit: DataFrame, providers: DataFrame, n: int = 10) -> DataFrame:
    """Newest rows with the provider's name; rows without one stay."""
    newest = audit.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    return newest.join(providers.select(F.col("provider_id").alias("ai_provider_id"), "provider_name"),
                       "ai_provider_id", "left")


def daily(audit: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """One row per calendar day, zero where nothing happened."""
    moment = _as_of(audit, as_of)
    spine = audit.sparkSession.range(1).select(F.explode(F.sequence(
        F.date_sub(F.to_date(moment), days - 1), F.to_date(moment))).alias("day"))
    per_day = (since(audit, days, as_of).groupBy(F.to_date("timestamp").alias("day"))
               .agg(F.sum("tokens_original").alias("t0"), F.sum("tokens_compressed").alias("t1"),
                    F.count("*").alias("n"), F.sum(F.col("cost_actual").cast(WIDE)).alias("c")))
    zero = F.lit(0).cast("long")
    return spine.join(per_day, "day", "left").select(
        "day", F.coalesce("t0", zero).alias("tokens_original"), F.coalesce("t1", zero).alias("tokens_compressed"),
        F.coalesce("n", zero).alias("requests"), F.coalesce(F.col("c"), F.lit(0).cast(WIDE)).alias("cost"))


def _provider_names(providers: DataFrame) -> DataFrame:
    return providers.select(F.col("provider_id").alias("ai_provider_id"), "provider_name")


def provider_usage(audit: DataFrame, providers: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """Requests, tokens and cost per provider name; rows without a provider drop out.

    Grouped by id before the join, so the join sees one row per provider.
    """
    per_id = since(audit, days, as_of).groupBy("ai_provider_id").agg(
        F.count("*").alias("n"), _total("tokens_original").alias("t"), _money("cost_actual").alias("c"))
    return (per_id.join(_provider_names(providers), "ai_provider_id").groupBy("provider_name")
            .agg(F.sum("n").alias("requests"), F.sum("t").alias("tokens"), F.sum("c").cast(WIDE).alias("cost")))


def peak_hours(audit: DataFrame, days: int | None = None, as_of=None) -> DataFrame:
    rows = audit if days is None else since(audit, days, as_of)
    return (rows.groupBy(F.date_format("timestamp", "HH").alias("hh")).agg(F.count("*").alias("requests"))
            .select(F.concat("hh", F.lit(":00")).alias("hour"), "requests"))


def latency(audit: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """Mean latency of each organization, all time and in the window."""
    inside = F.col("timestamp") >= _days_before(_as_of(audit, as_of), days)
    return audit.groupBy("organization_id").agg(
        F.round(F.avg("latency_ms"), 4).alias("avg_latency"),
        F.round(F.avg(F.when(inside, F.col("latency_ms"))), 0).cast("long").alias("avg_latency_window"))


def kpis(audit: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """Ratio, efficiency, return and averages of each organization, with zero guards."""
    inside = F.col("timestamp") >= _days_before(_as_of(audit, as_of), days)
    base = audit.groupBy("organization_id").agg(
        _total("tokens_original").alias("tokens_original"), _total("tokens_compressed").alias("tokens_compressed"),
        _money("cost_saved").alias("cost_saved"), F.count("*").alias("total_requests"),
        F.avg(F.col("cache_hit").cast("int")).alias("hit"),
        F.round(F.avg(F.when(inside, F.col("latency_ms"))), 0).cast("long").alias("avg_latency_window"))
    saved = F.col("cost_saved").cast("double")
    t0 = F.col("tokens_original")
    return base.select(
        "organization_id", "total_requests", "tokens_original", "tokens_compressed",
        F.when((t0 > 0) & (saved != 0), F.round(saved / (saved + t0 * 0.00001) * 100, 1)).otherwise(0.0)
        .alias("financial_efficiency_pct"),
        F.when(saved > 0, F.round(F.col("cost_saved") * 1000, 2).cast("double")).otherwise(0.0).alias("roi_multiplier"),
        savings_pct("tokens_original", "tokens_compressed").alias("compression_ratio"),
        F.round(F.col("hit") * 100, 1).alias("cache_hit_rate"),
        F.coalesce("avg_latency_window", F.lit(0).cast("long")).alias("avg_latency"))


def filtered(audit: DataFrame, org=None, days: int | None = None, status: str = "all", key="all",
             source: str = "all", as_of=None) -> DataFrame:
    """Log filter; ``all`` switches a predicate off."""
    rows = audit if days is None else since(audit, days, as_of)
    if org is not None:
        rows = rows.filter(F.col("organization_id") == org)
    for column, wanted in (("status", status), ("api_key_id", key), ("source", source)):
        if wanted != "all":
            rows = rows.filter(F.col(column) == wanted)
    return rows


def page_bounds(page: int, limit: int) -> tuple[int, int]:
    return max(1, page), max(10, min(200, limit))


def page_of(audit: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """One page, newest first; a top-k, not a full sort."""
    page, limit = page_bounds(page, limit)
    return audit.orderBy(F.desc("timestamp"), F.desc("id")).offset((page - 1) * limit).limit(limit)


def page_counts(audit: DataFrame, limit: int = 50) -> DataFrame:
    _, limit = page_bounds(1, limit)
    return audit.agg(F.count("*").alias("total_rows")).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / limit)).cast("long"))


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nine measures of the given rows: a page, or all of them."""
    agg = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total_requests"), _total("tokens_original").alias("total_tokens_in"),
        _total("tokens_compressed").alias("total_tokens_out"), _money("cost_actual").alias("total_cost_usd"),
        _money("cost_saved").alias("total_cost_saved_usd"),
        F.coalesce(F.round(F.avg(F.coalesce("latency_ms", F.lit(0))), 0), F.lit(0)).cast("long").alias("avg_latency_ms"),
        _errors().alias("error_count"))
    return agg.withColumns({
        "tokens_saved": F.col("total_tokens_in") - F.col("total_tokens_out"),
        "avg_compression_pct": savings_pct("total_tokens_in", "total_tokens_out")})


def per_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Breakdown per key; a missing key is one group of its own."""
    saved = F.greatest(F.lit(0), F.coalesce("tokens_original", F.lit(0)) - F.coalesce("tokens_compressed", F.lit(0)))
    grouped = rows.groupBy("api_key_id").agg(
        F.count("*").alias("requests"), _total("tokens_original").alias("tokens_in"),
        F.sum(saved).alias("tokens_saved"), _money("cost_actual").alias("cost"), _errors().alias("errors"))
    names = keys.select("api_key_id", "key_name")
    return grouped.join(names, "api_key_id", "left").select(
        F.coalesce(F.col("api_key_id").cast("string"), F.lit("unknown")).alias("key"),
        F.coalesce("key_name", F.lit("Unknown Key")).alias("name"),
        "requests", "tokens_in", "tokens_saved", "cost", "errors")


def _billed_tokens() -> Column:
    return F.coalesce(F.nullif("tokens_compressed", F.lit(0)), "tokens_original", F.lit(0))


def per_provider(rows: DataFrame, providers: DataFrame) -> DataFrame:
    grouped = rows.groupBy("ai_provider_id").agg(
        F.count("*").alias("requests"), F.sum(_billed_tokens()).alias("tokens"), _money("cost_actual").alias("cost"))
    return grouped.join(_provider_names(providers), "ai_provider_id", "left").select(
        F.coalesce(F.col("ai_provider_id").cast("string"), F.lit("unknown")).alias("provider"),
        F.coalesce("provider_name", F.lit("Unknown Provider")).alias("name"), "requests", "tokens", "cost")


def provider_share(rows: DataFrame) -> DataFrame:
    """Share of requests per provider.  The total is a scalar, not a window over one task."""
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy("ai_provider_id").agg(F.count("*").alias("requests")).select(
        F.coalesce(F.col("ai_provider_id").cast("string"), F.lit("unknown")).alias("provider"), "requests",
        F.round(F.col("requests") * 100 / total, 2).alias("share_pct"))


def telemetry(audit: DataFrame, n: int = 50) -> DataFrame:
    """Totals over the newest rows."""
    agg = audit.orderBy(F.desc("timestamp"), F.desc("id")).limit(n).agg(
        F.count("*").alias("request_count"), _total("tokens_original").alias("total_tokens_in"),
        _total("tokens_compressed").alias("total_tokens_out"))
    return agg.withColumns({
        "total_saved": F.col("total_tokens_in") - F.col("total_tokens_out"),
        "avg_compression_pct": savings_pct("total_tokens_in", "total_tokens_out")})


def report(audit: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """Totals, per provider and per key in one pass, by grouping sets."""
    rows = since(audit, days, as_of).withColumn("billed", _billed_tokens())
    return rows.groupingSets([[], ["ai_provider_id"], ["api_key_id"]], "ai_provider_id", "api_key_id").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("requests"), _total("tokens_original").alias("tokens_in"),
        _total("tokens_compressed").alias("tokens_out"), F.sum("billed").alias("tokens_billed"),
        _money("cost_actual").alias("cost"), _money("cost_saved").alias("cost_saved")).select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "provider").otherwise("key").alias("section"),
        F.coalesce(F.coalesce("ai_provider_id", "api_key_id").cast("string"),
                   F.when(F.col("gid") == 3, "all").otherwise("unknown")).alias("item"),
        "requests", "tokens_in", "tokens_out", "tokens_billed", "cost", "cost_saved",
        savings_pct("tokens_in", "tokens_out").alias("savings_pct"))


def search(audit: DataFrame, needle: str = "", status: str = "all") -> DataFrame:
    """Rows whose payload holds the needle, with their own savings."""
    rows = filtered(audit, status=status)
    if needle:
        rows = rows.filter(F.lower("original_payload").contains(needle.lower()))
    return rows.select("id", "timestamp", "status", "source", "tokens_original", "tokens_compressed",
                       (F.col("tokens_original") - F.col("tokens_compressed")).alias("tokens_saved"),
                       savings_pct("tokens_original", "tokens_compressed").alias("savings_pct"))


def details(audit: DataFrame, ids=None) -> DataFrame:
    """Payload, shortened payload and their counts side by side; ``ids`` is a list or a one-column table."""
    rows = audit
    if isinstance(ids, DataFrame):
        rows = audit.join(ids, "id", "left_semi")
    elif ids is not None:
        rows = audit.filter(F.col("id").isin(list(ids)))
    return rows.select("id", "original_payload", "compressed_payload", "tokens_original", "tokens_compressed",
                       "tokens_response", F.length("original_payload").alias("chars_original"),
                       F.length("compressed_payload").alias("chars_compressed"))


def team_usage(audit: DataFrame, users: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests and active keys per member.  Both sides are grouped before the joins."""
    used = audit.groupBy("user_id").agg(F.count("*").alias("requests"), F.max("timestamp").alias("last_activity"))
    owned = keys.groupBy("user_id").agg(F.count_if("is_active").alias("active_keys"))
    zero = F.lit(0).cast("long")
    return users.join(used, "user_id", "left").join(owned, "user_id", "left").select(
        "user_id", "username", "team", F.coalesce("requests", zero).alias("requests"),
        F.coalesce("active_keys", zero).alias("active_keys"), "last_activity")


def provider_counters(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("ai_provider_id").isNotNull()).groupBy("ai_provider_id").agg(
        F.count("*").alias("total_requests"), _total("tokens_compressed").alias("total_tokens"),
        F.sum(F.col("data_bytes_in") + F.col("data_bytes_out")).alias("total_bytes"))


def savings_rollup(ledger: DataFrame, by: str = "lang") -> DataFrame:
    """Tokens removed by group and stage with subtotals, from an exploded ledger."""
    return ledger.rollup(by, "stage").agg(
        F.grouping_id().alias("level"), F.sum("tokens_removed").alias("tokens_removed"),
        F.count("*").alias("rows")).select(
        F.when(F.col("level") >= 3, "all").otherwise(F.col(by)).alias(by),
        F.when(F.col("level") >= 1, "all").otherwise(F.col("stage")).alias("stage"), "tokens_removed", "rows")


def savings_by_class(audit: DataFrame, classes: DataFrame) -> DataFrame:
    """Tokens saved per content class; ``classes`` maps documents to a class."""
    per_doc = audit.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens_original").alias("t0"),
                                          F.sum("tokens_compressed").alias("t1"))
    return (per_doc.join(classes, "doc_id").groupBy("content_type")
            .agg(F.sum("n").alias("requests"), F.sum("t0").alias("tokens_in"), F.sum("t1").alias("tokens_out"))
            .withColumn("savings_pct", savings_pct("tokens_in", "tokens_out")))


def efficiency_trail(audit: DataFrame) -> DataFrame:
    """Rows that saved money against rows that passed through."""
    return audit.groupBy(F.when(F.col("cost_saved") > 0, "saved").otherwise("bypassed").alias("outcome")).agg(
        F.count("*").alias("requests"), _total("tokens_original").alias("tokens_original"),
        _total("tokens_compressed").alias("tokens_compressed"), _money("cost_saved").alias("cost_saved"))


def status_mix(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status", "source").agg(F.count("*").alias("requests"))


def usage_rows(audit: DataFrame) -> DataFrame:
    """Telemetry of each request, as returned with a response."""
    return audit.select(
        "id", F.col("tokens_original").alias("prompt_tokens"), F.col("tokens_response").alias("completion_tokens"),
        (F.col("tokens_original") + F.col("tokens_response")).alias("total_tokens"),
        F.col("compression_ratio").alias("compression_pct"), "cost_actual", "cost_saved", "latency_ms")


def key_display(keys: DataFrame) -> DataFrame:
    return keys.select("api_key_id", mask_key("key").alias("masked_key"))


def language_savings(df: DataFrame, group: str, before: str = "text", after: str = "text_out") -> DataFrame:
    """Tokens before and after, and USD saved, per group."""
    from quillmill.functions.metrics import prompt_cost

    t = df.select(group, est_tokens(before).alias("t0"), est_tokens(after).alias("t1"))
    zero = F.lit(0)
    saved = prompt_cost(F.col("t0"), zero) - prompt_cost(F.col("t1"), zero)
    return t.groupBy(group).agg(
        F.count("*").alias("documents"), F.sum("t0").alias("tokens_before"), F.sum("t1").alias("tokens_after"),
        F.sum(saved).cast("decimal(20,10)").alias("usd_saved")).withColumn(
        "savings_pct", savings_pct("tokens_before", "tokens_after"))
