"""Provider responses and stream chunks to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import strip

# Path of each standard field in each provider's layout.
PATHS = {
    "openai": {"content": "$.choices[0].message.content", "finish_reason": "$.choices[0].finish_reason",
               "prompt_tokens": "$.usage.prompt_tokens", "completion_tokens": "$.usage.completion_tokens",
               "model": "$.model", "id": "$.id"},
    "gemini": {"content": "$.candidates[0].content.parts[0].text", "finish_reason": "$.candidates[0].finishReason",
               "prompt_tokens": "$.usageMetadata.promptTokenCount",
               "completion_tokens": "$.usageMetadata.candidatesTokenCount",
               "model": "$.modelVersion", "id": "$.id"},
    "anthropic": {"content": "$.content[0].text", "finish_reason": "$.stop_reason",
                  "prompt_tokens": "$.usage.input_tokens", "completion_tokens": "$.usage.output_tokens",
                  "model": "$.model", "id": "$.id"},
}
DELTA = {"openai": "$.choices[0].delta.content", "gemini": "$.candidates[0].content.parts[0].text",
         "anthropic": "$.delta.text"}
END = "[DONE]"


def _by_provider(paths: dict[str, str], kind: str, parsed: str = "_v") -> Column:
    get = {p: F.try_variant_get(parsed, path, kind) for p, path in paths.items()}
    return (F.when(F.col("provider") == "gemini", get["gemini"])
            .when(F.col("provider") == "anthropic", get["anthropic"]).otherwise(get["openai"]))


def normalise_responses(df: DataFrame, key: str = "request_id", raw: str = "raw") -> DataFrame:
    """One row per response; the JSON is parsed once and read by path."""
    staged = df.withColumn("_v", F.try_parse_json(raw))

    def field(name: str, kind: str) -> Column:
        return _by_provider({p: paths[name] for p, paths in PATHS.items()}, kind)

    prompt = F.coalesce(field("prompt_tokens", "int"), F.lit(0))
    completion = F.coalesce(field("completion_tokens", "int"), F.lit(0))
    return staged.select(
        key, "provider", F.coalesce(field("id", "string"), F.concat(F.lit("chatcmpl-"), F.col(key).cast("string"))).alias("id"),
        F.coalesce(field("model", "string"), F.lit("normalized")).alias("model"),
        F.coalesce(field("content", "string"), F.lit("")).alias("content"),
        F.coalesce(field("finish_reason", "string"), F.lit("stop")).alias("finish_reason"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"), F.col("_v").isNull().alias("malformed"))


FENCE = r"```(?:json)?\s*([\s\S]*?)```"


def compact(json: Column) -> Column:
    """JSON text without blanks between its tokens; keys keep their order and numbers their digits."""
    return F.regexp_replace(json, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")


def reformat_json(df: DataFrame, text: str = "text", out: str = "text_out") -> DataFrame:
    """Object or array text, or the fenced JSON in it, as compact text; anything else unchanged."""
    bare = strip(F.col(text))
    looks = bare.startswith("{") | bare.startswith("[")
    fenced = strip(F.regexp_extract(bare, FENCE, 1))
    return (df.withColumn("_v", F.when(looks, F.try_parse_json(bare)).isNotNull())
            .withColumn("_f", F.when(looks & ~F.col("_v"), F.try_parse_json(fenced)).isNotNull())
            .withColumn(out, F.when(F.col("_v"), compact(bare)).when(F.col("_f"), compact(fenced)).otherwise(F.col(text)))
            .drop("_v", "_f"))


def normalise_chunks(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds delta (text of the chunk, if any) and is_end; works on streams as it keeps no state."""
    body = F.regexp_replace(raw, r"^data: ", "")
    staged = df.withColumn("_b", body).withColumn("_v", F.try_parse_json("_b"))
    return staged.withColumns({"delta": _by_provider(DELTA, "string"), "is_end": F.col("_b") == END}).drop("_b", "_v")


def to_parts_layout(df: DataFrame, messages: str = "messages", out: str = "payload") -> DataFrame:
    """Messages as contents with nested parts; the last system message becomes the instruction."""
    def parts(m: Column) -> Column:
        return F.array(F.struct(F.coalesce(m["content"], F.lit("")).alias("text")))

    system = F.filter(messages, lambda m: m["role"] == "system")
    others = F.filter(messages, lambda m: ~m["role"].eqNullSafe(F.lit("system")))
    contents = F.transform(others, lambda m: F.struct(
        F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), parts(m).alias("parts")))
    instruction = F.when(F.size(system) > 0, F.struct(parts(F.element_at(system, -1)).alias("parts")))
    return df.withColumn(out, F.to_json(F.struct(contents.alias("contents"), instruction.alias("systemInstruction"))))
