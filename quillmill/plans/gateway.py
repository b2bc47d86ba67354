"""One request to one audit row: the whole path as a plan over requests and responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.metrics import byte_volume, cost_columns, est_tokens, savings_pct
from quillmill.operators import code, rules, wordfilter
from quillmill.operators.routing import has_code, is_complex, resolve_provider


def gateway_audit(requests: DataFrame, responses: DataFrame, keys: DataFrame, configs: DataFrame, providers: DataFrame,
                  prose: Callable[[Column], Column] = wordfilter.drop_light_words,
                  source: Callable[[Column], Column] = code.squeeze_whitespace,
                  clean: Callable[[Column], Column] = rules.clean_output, **complexity) -> DataFrame:
    """Audit rows: count, detect code, compress each message, route, clean the output, price.

    ``requests`` holds request_id, api_key_id, messages and timestamp; ``responses``
    request_id, content, prompt_tokens and completion_tokens, at most one row a
    request.  Messages of a request with code lose blanks, others words.  A request
    without a response or a provider becomes an error row without a response's
    tokens; one whose key is unknown has no organization.  Billed prompt tokens win
    over estimated ones when higher.  The same functions run on a stream of requests
    joined with its responses.
    """
    def joined(messages: Column) -> Column:
        return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")

    def shorter(fn: Callable[[Column], Column]) -> Column:
        return F.transform("messages", lambda m: F.struct(m["role"].alias("role"), fn(F.coalesce(m["content"], F.lit(""))).alias("content")))

    owners = keys.select("api_key_id", "organization_id", "user_id")
    asked = requests.join(owners, "api_key_id", "left").withColumn("has_code", F.coalesce(has_code("messages"), F.lit(False)))
    sent = asked.withColumn("sent", F.when(F.col("has_code"), shorter(source)).otherwise(shorter(prose)))
    counted = sent.withColumns({
        "original_payload": F.to_json("messages"), "compressed_payload": joined(F.col("sent")),
        "tokens_original": est_tokens(joined(F.col("messages")))})
    counted = counted.withColumn("tokens_compressed", est_tokens("compressed_payload")).withColumn(
        "complex", is_complex(F.col("compressed_payload"), **complexity))
    routed = counted.join(resolve_provider(counted.select("request_id", "api_key_id", "organization_id", "complex"), keys, configs, providers)
                          .select("request_id", F.col("provider_id").alias("ai_provider_id")), "request_id", "left")
    answered = routed.join(responses.select("request_id", "content", "prompt_tokens", F.col("completion_tokens").alias("tokens_response")),
                           "request_id", "left")
    error = (F.when(F.col("ai_provider_id").isNull(), "No AI provider configured.").when(F.col("content").isNull(), "No response."))
    final = F.when(F.col("has_code"), source(F.col("content"))).otherwise(clean(F.col("content")))
    done = answered.withColumns({
        "error_message": error, "final_response": F.coalesce(F.when(error.isNull(), final), F.concat(F.lit("[Gateway error: "), error, F.lit("]"))),
        "tokens_response": F.when(error.isNull(), F.col("tokens_response")).otherwise(0).cast("int")})
    return done.withColumns(cost_columns("tokens_original", "tokens_compressed", "tokens_response", F.coalesce("prompt_tokens", F.lit(0)))).select(
        F.col("request_id").alias("id"), "timestamp", "user_id", "api_key_id", "organization_id", "ai_provider_id", F.lit("gateway").alias("source"),
        F.when(F.col("error_message").isNull(), "success").otherwise("error").alias("status"), "error_message", "original_payload",
        "compressed_payload", "final_response", "tokens_original", "tokens_compressed", "tokens_response",
        savings_pct("tokens_original", "tokens_compressed").alias("compression_ratio"), "cost_original", "cost_actual", "cost_saved",
        byte_volume("original_payload").alias("data_bytes_in"), byte_volume("final_response").alias("data_bytes_out"))
