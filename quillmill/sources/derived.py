"""Tables derived from the base data by fixed rules, so that every job has real input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.metrics import byte_volume, cost_columns, est_tokens, savings_pct
from quillmill.functions.rows import unroll
from quillmill.functions.text import SENTENCE_END
from quillmill.functions.vocab import KEY_PREFIX
from quillmill.operators.wordfilter import drop_stop_words_flat
from quillmill.sources.readers import documents, requests_from_turns, table

# Words of the test corpus that stand for stop words; fixed values.
DATA_STOP_WORDS = ["the", "and", "of", "to", "in", "der", "die", "und", "de", "la", "les", "en", "que", "el", "y"]


def _source(event_type: Column) -> Column:
    return (F.when(event_type.isin("click", "error"), "gateway").when(event_type == "view", "dashboard")
            .when(event_type == "purchase", "api").otherwise("simulate"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row per event.

    Compression is computed once per document, before documents fan out to
    events.  The cache flag compares each row's id with the first id of its
    payload: grouping pre-aggregates and the join back is on the unique id, so
    a payload shared by a third of all rows is no hot key.  Payloads meet the
    events last, so their texts move once per document, not once per event.
    """
    payload = payloads(spark, sf_dir)
    owners = organizations(spark, sf_dir)
    count = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    events = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % count)
    first = (events.join(payload.select("doc_id", "payload_hash"), "doc_id").join(owners, "user_id", "left")
             .groupBy("organization_id", "payload_hash").agg(F.min(F.struct("ts", "event_id")).alias("f"))
             .select(F.col("f.event_id").alias("event_id"), F.lit(False).alias("cache_hit")))
    flagged = events.join(first, "event_id", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(True)))
    return audit_columns(flagged.join(owners, "user_id", "left").join(payload, "doc_id"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as request payloads with their measures."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return (docs.withColumn("compressed_payload", drop_stop_words_flat(F.col("text"), DATA_STOP_WORDS))
               .select("doc_id", F.col("text").alias("original_payload"), "compressed_payload",
                       est_tokens("text").alias("tokens_original"),
                       est_tokens("compressed_payload").alias("tokens_compressed"),
                       byte_volume("text").alias("data_bytes_in"),
                       byte_volume("compressed_payload").alias("data_bytes_out"),
                       F.sha2("text", 256).alias("payload_hash")))


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("organization_id"))


def audit_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The audit rows of a stream of events, without the cache flag."""
    static = table(spark, sf_dir, "events")
    events = (spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir))
    count = table(spark, sf_dir, "documents").count()
    rows = (events.withColumn("doc_id", F.col("event_id") % count)
            .join(payloads(spark, sf_dir), "doc_id").join(organizations(spark, sf_dir), "user_id", "left"))
    # Event time must be an instant; the files hold UTC without a zone.
    return audit_columns(rows.withColumn("cache_hit", F.lit(None).cast("boolean"))).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))


def audit_columns(rows: DataFrame) -> DataFrame:
    response = F.floor(F.col("value") * 10).cast("int")
    return (rows.withColumn("tokens_response", response).select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "user_id",
        F.col("user_id").alias("api_key_id"), "organization_id",
        F.when(F.col("event_id") % 10 != 9, F.col("user_id") % 7).alias("ai_provider_id"),
        _source(F.col("event_type")).alias("source"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        "doc_id", "original_payload", "compressed_payload", "tokens_original", "tokens_compressed",
        "tokens_response", F.floor(F.col("value") * 100).cast("int").alias("latency_ms"),
        "data_bytes_in", "data_bytes_out",
        savings_pct("tokens_original", "tokens_compressed").alias("compression_ratio"),
        *[c.alias(k) for k, c in cost_columns("tokens_original", "tokens_compressed", "tokens_response").items()],
        "cache_hit", "payload_hash"))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers; every tenth one is a system row without organization."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("provider_id"), F.col("s_name").alias("provider_name"),
        F.when(k % 10 != 0, F.col("s_nationkey")).alias("organization_id"),
        F.when(k % 3 == 0, "openai").when(k % 3 == 1, "gemini").otherwise("anthropic").alias("provider_type"),
        (k % 4 != 3).alias("is_active"), (k % 6 == 1).alias("is_default"), (k % 10 == 0).alias("is_system"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as key owners; some keys are inactive, mis-prefixed, linked or unlimited."""
    k = F.col("c_custkey")
    prefix = F.when(k % 13 == 5, "xx-").otherwise(KEY_PREFIX)
    return table(spark, sf_dir, "customer").select(
        k.alias("api_key_id"), F.col("c_name").alias("key_name"),
        F.concat(prefix, F.lpad(k.cast("string"), 12, "0")).alias("key"),
        F.col("c_nationkey").alias("organization_id"), k.alias("user_id"),
        (k % 11 != 3).alias("is_active"), (1 + k % 3).cast("int").alias("rate_limit"),
        F.when(k % 4 == 0, 0).otherwise(2000 + (k % 5) * 1000).cast("long").alias("daily_token_limit"),
        F.when(k % 5 == 0, k % 7).alias("linked_provider_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
        F.col("c_nationkey").alias("organization_id"), F.col("c_mktsegment").alias("team"))


def cascade_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One routing configuration per nation."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("organization_id"), (F.lit(0.5) + (k % 5) * 0.1).alias("confidence_threshold"),
        (k % 4 != 0).alias("is_active"), F.when(k % 6 != 5, k % 7).cast("long").alias("cheap_provider_id"),
        F.when(k % 3 != 2, (k + 3) % 7).cast("long").alias("heavyweight_provider_id"))


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as registered tools, forty names per organization at most."""
    k = F.col("p_partkey")
    blocked = F.when(k % 3 == 0, F.lit("secret\\d+\n\n  k\": [1-3]\\d}  \n[broken"))
    return table(spark, sf_dir, "part").select(
        k.alias("tool_id"), (k % 25).cast("int").alias("organization_id"),
        F.concat(F.lit("tool_"), F.floor(k / 25).cast("string")).alias("tool_name"),
        F.when(k % 5 == 0, "high").when(k % 2 == 0, "medium").otherwise("low").alias("risk_level"),
        (k % 9 != 4).alias("is_active"), F.coalesce(blocked, F.lit("")).alias("blocked_patterns"))


def tool_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions by tool: some for every key, some for one key, some missing."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(k % 8 != 7).select(
        k.alias("permission_id"), k.alias("tool_id"), (k % 25).cast("int").alias("organization_id"),
        F.when(k % 6 == 1, k % 50).alias("api_key_id"), (k % 10 != 2).alias("is_allowed"),
        (k % 12 == 5).alias("requires_human_approval"), (1 + k % 4).cast("int").alias("max_calls_per_minute"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls; each event type carries another kind of parameter."""
    kind = F.col("event_type")
    note = (F.when(kind == "error", F.concat(F.lit("x'; DROP TABLE t"), F.col("event_id").cast("string")))
            .when((kind == "view") & (F.col("event_id") % 3 == 0), "../etc/passwd and eval (1)")
            .when((kind == "signup") & (F.col("event_id") % 5 == 0), "a | bash -c $(id)")
            .otherwise(F.concat(F.lit("  plain \t"), kind, F.lit("\n value "))))
    return (table(spark, sf_dir, "events").join(organizations(spark, sf_dir), "user_id", "left").select(
        F.col("event_id").alias("call_id"), "organization_id", F.col("user_id").alias("api_key_id"),
        F.concat(F.lit("tool_"), (F.col("event_id") % 10).cast("string")).alias("tool_name"),
        F.create_map(F.lit("note"), note, F.lit("props"), F.col("props")).alias("params"), "ts"))


def edge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("node_id"), F.col("n_name").alias("node_name"),
        F.when(k % 2 == 0, "eu-central").otherwise("eu-west").alias("region"),
        F.when(k % 3 == 0, "us").otherwise("eu").alias("data_sovereignty_zone"),
        ((k * 37) % 100 + 0.5).alias("current_load_pct"), (k % 6 != 5).alias("is_active"))


def edge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two routing rules per nation, every fourth one global."""
    k = F.col("n_nationkey")
    base = table(spark, sf_dir, "nation").select(k.alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return base.select(
        (F.col("k") * 2 + F.col("j")).alias("rule_id"),
        F.when(F.col("j") == 0, "eu-central").otherwise("eu-west").alias("source_region"),
        ((F.col("k") * 7 + F.col("j") * 3) % 25).alias("target_node_id"),
        F.when(F.col("k") % 4 != 0, F.col("k") % 20).alias("organization_id"),
        ((F.col("k") + F.col("j")) % 5).alias("priority"), (F.col("k") % 7 != 6).alias("is_active"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client per event, with an address by rule."""
    last = (F.col("event_id") % 250).cast("string")
    first = F.element_at(F.array(*[F.lit(x) for x in ("5.28", "46.212", "193.140", "51.7", "52.9", "10.0", "5.1")]),
                         (F.col("event_id") % 7 + 1).cast("int"))
    return (table(spark, sf_dir, "events").join(organizations(spark, sf_dir), "user_id", "left").select(
        F.col("event_id").alias("request_id"), "organization_id",
        F.concat(first, F.lit(".0."), last).alias("client_ip")))


def compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as custom rules."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("rule_id"), F.when(k % 3 == 0, "language").when(k % 3 == 1, "programming").otherwise("custom")
        .alias("rule_type"), F.when(k % 2 == 0, "de").alias("language"),
        F.when(k % 4 == 1, "python").alias("programming_language"),
        F.concat(F.lower(F.substring("n_name", 1, 2)), F.lit("+")).alias("pattern"), F.lit("").alias("replacement"),
        (k % 5 != 4).alias("is_active"), (k % 10 == 0).alias("is_system"), (k % 4).cast("int").alias("organization_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_turns(table(spark, sf_dir, "conversations"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns wrapped in one of three provider layouts; some are cut and so malformed."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    rid = F.col("conv_id") * 1000 + F.col("turn")
    n = est_tokens("text")
    text = F.col("text")
    chat = F.to_json(F.struct(
        F.concat(F.lit("r"), rid.cast("string")).alias("id"), F.lit("gpt").alias("model"),
        F.array(F.struct(F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"),
                         F.lit("length").alias("finish_reason"))).alias("choices"),
        F.struct((n + 3).alias("prompt_tokens"), n.alias("completion_tokens")).alias("usage")))
    parts = F.to_json(F.struct(
        F.lit("flash").alias("modelVersion"),
        F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content")))
        .alias("candidates"),
        F.struct((n + 5).alias("promptTokenCount"), n.alias("candidatesTokenCount")).alias("usageMetadata")))
    block = F.to_json(F.struct(
        F.concat(F.lit("m"), rid.cast("string")).alias("id"), F.lit("sonnet").alias("model"),
        F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"),
        F.lit("end_turn").alias("stop_reason"), F.struct(n.alias("output_tokens")).alias("usage")))
    provider = F.element_at(F.array(F.lit("openai"), F.lit("gemini"), F.lit("anthropic")), (rid % 3 + 1).cast("int"))
    raw = F.when(rid % 3 == 0, chat).when(rid % 3 == 1, parts).otherwise(block)
    return turns.select(rid.alias("request_id"), provider.alias("provider"),
                        F.when(rid % 17 == 4, F.lit('{"broken": ')).otherwise(raw).alias("raw"), text.alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses cut into words, each in its provider's stream layout, then an end marker."""
    base = responses(spark, sf_dir).select("request_id", "provider", "text")
    word = F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), F.lit(1))
    piece = F.col("piece")
    raw = (F.when(F.col("provider") == "gemini", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(
        piece.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))))
        .when(F.col("provider") == "anthropic", F.to_json(F.struct(
            F.lit("content_block_delta").alias("type"), F.struct(piece.alias("text")).alias("delta"))))
        .otherwise(F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(
            piece.alias("content")).alias("delta"))).alias("choices"))))))
    rows = unroll(base, ["request_id", "provider"], F.array_append(word, F.lit(None).cast("string")), "piece", "seq")
    return rows.select("request_id", "seq", "provider",
                       F.when(piece.isNull(), "data: [DONE]").otherwise(raw).alias("raw"),
                       F.timestamp_seconds(F.lit(1704067200) + F.col("request_id") % 1000 + F.col("seq")).alias("ts"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as cached prompts: the label is the organization, the id its age."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("organization_id"), F.lit("default").alias("embedding_model"),
        F.col("vec_id").alias("entry_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        (F.col("vec_id") % 4000).cast("int").alias("tokens_used"))


# Three words in a row, with what follows up to the next word; an ``X`` stands for a missing one.
_TRIPLE = r"([a-z]++)[^a-zX]++([a-z]++|X)[^a-zX]++([a-z]++|X)[^a-z]*+"
_CODE_BLOCK = ("from $2 import $3\nimport $1\n\n\n\ndef $1($2):   \n    # $3\n    url = 'http://$1'  // link\n"
               "    value = $2\n    return value\n        $3()\n    pass\n")
# The ``N`` stands for the number of the frame.
_FRAME = '  File "/srv/$1/$2.py", line N, in $3\n'


def _by_triples(text: Column, block: str) -> Column:
    """A block for all a-z words of every sentence, three by three; a sentence's last triple is filled up with ``x``.

    Lower-cased text has no capital of A to Z, so capitals mark what is missing,
    and one pattern writes all blocks of a text.
    """
    ends = F.concat(F.regexp_replace(F.lower(text), SENTENCE_END, " X X "), F.lit(" X X"))
    return F.replace(F.regexp_replace(F.regexp_replace(ends, "^[^a-z]++", ""), _TRIPLE, block), F.lit("X"), F.lit("x"))


def code_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made from documents: two imports and one function per three words; no words, an empty file."""
    return documents(spark, sf_dir).select("doc_id", F.coalesce(_by_triples(F.col("text"), _CODE_BLOCK), F.lit("")).alias("text"))


def traceback_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracebacks made from documents: one frame per three words, an error line at the end; no words, no frame and no message."""
    frames = F.transform(F.split(_by_triples(F.col("text"), _FRAME), "N"),
                         lambda part, i: F.when(i > 0, F.concat(i.cast("string"), part)).otherwise(part))
    first = F.regexp_extract(F.lower("text"), "[a-z]+", 0)
    return documents(spark, sf_dir).select("doc_id", F.concat(
        F.lit("Traceback (most recent call last):\n"), F.coalesce(F.array_join(frames, ""), F.lit("")),
        F.lit("ValueError: "), F.coalesce(first, F.lit(""))).alias("text"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines, one log per day; the position is the event's own id."""
    level = (F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN")
             .when(F.col("event_type") == "view", "DEBUG").otherwise("INFO"))
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMdd").cast("int").alias("doc_id"), F.col("event_id").alias("pos"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" user="),
                 (F.col("user_id") % 3).cast("string"), F.lit(" type="), F.col("event_type"), F.lit(" shard="),
                 F.element_at(F.array(*[F.lit(x) for x in "abcdefghijklmnop"]), (F.col("event_id") % 16 + 1).cast("int")))
        .alias("line"))
