"""Token, cost, byte and display measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import words

# USD per token, and the two simulated tiers.
INPUT_PRICE = "0.0000001400"
OUTPUT_PRICE = "0.0000002800"
TIER_PRICE = {1: "0.0000005000", 2: "0.0000020000"}

_WIDE = "decimal(20,10)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def est_tokens(c: Column | str, empty_zero: bool = False) -> Column:
    """Four characters are one token, and a text is at least one."""
    c = _col(c)
    tokens = F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))
    return F.when(F.length(c) > 0, tokens).otherwise(0) if empty_zero else tokens


def savings_pct(before: Column | str, after: Column | str) -> Column:
    """Percent removed, one digit.  Multiplying first keeps exact ties exact."""
    before, after = _col(before).cast("long"), _col(after).cast("long")
    return F.when(before > 0, F.round((before - after) * 100 / before, 1)).otherwise(0.0)


def compression_ratio(before: Column | str, after: Column | str) -> Column:
    before, after = _col(before).cast("long"), _col(after).cast("long")
    return F.when(before > 0, F.round((before - after) / before, 4)).otherwise(0.0)


def _price(tokens: Column, price: str) -> Column:
    return (tokens.cast("decimal(12,0)") * F.lit(price).cast(_WIDE)).cast(_WIDE)


def prompt_cost(prompt_tokens: Column | str, output_tokens: Column | str) -> Column:
    return _price(_col(prompt_tokens), INPUT_PRICE) + _price(_col(output_tokens), OUTPUT_PRICE)


def cost_columns(original: Column | str, compressed: Column | str, response: Column | str,
                 prompt_used: Column | str | None = None) -> dict[str, Column]:
    """Original, actual and saved cost.  Billed prompt tokens win when higher."""
    billed = _col(compressed) if prompt_used is None else F.greatest(_col(prompt_used), _col(compressed))
    before = prompt_cost(original, response)
    after = prompt_cost(billed, response)
    saved = F.greatest(F.lit(0).cast(_WIDE), before - after)
    return {
        "cost_original": before.cast("decimal(10,6)"),
        "cost_actual": after.cast("decimal(10,6)"),
        "cost_saved": saved.cast("decimal(10,6)"),
    }


def simulated_cost(tokens: Column | str, tier: Column | str) -> Column:
    tokens, tier = _col(tokens), _col(tier)
    return F.when(tier == 2, _price(tokens, TIER_PRICE[2])).otherwise(_price(tokens, TIER_PRICE[1]))


def byte_volume(c: Column | str) -> Column:
    return F.octet_length(_col(c)).cast("long")


def payload_profile(c: Column | str) -> list[Column]:
    c = _col(c)
    return [est_tokens(c).alias("tokens"), F.length(c).alias("chars"), F.size(words(c)).alias("words")]


def preview(c: Column | str, n: int = 600) -> Column:
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def mask_key(c: Column | str) -> Column:
    """First six and last four characters of a long key."""
    c = _col(c)
    short = F.concat(F.substring(c, 1, 6), F.lit("..."), F.right(c, F.lit(4)))
    return (F.when(c.isNull() | (c == ""), "N/A").when(F.length(c) > 10, short).otherwise(c))
