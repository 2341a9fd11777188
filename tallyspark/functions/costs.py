"""Prices of models, costs of sessions and analyses, and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars for a million tokens, input and output; the first name that a model starts with counts.
MODEL_PRICES = {
    "claude-opus-4-6": (5.0, 25.0),
    "claude-opus-4-5": (5.0, 25.0),
    "claude-opus-4-1": (15.0, 75.0),
    "claude-opus-4": (15.0, 75.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-sonnet-4-5": (3.0, 15.0),
    "claude-sonnet-4": (3.0, 15.0),
    "claude-haiku-4-5": (1.0, 5.0),
    "claude-3-5-sonnet-20241022": (3.0, 15.0),
    "claude-3-5-haiku-20241022": (0.8, 4.0),
    "claude-haiku-3-5": (0.8, 4.0),
    "claude-3-opus-20240229": (15.0, 75.0),
    "claude-3-sonnet-20240229": (3.0, 15.0),
    "claude-3-haiku-20240307": (0.25, 1.25),
}
DEFAULT_PRICE = (3.0, 15.0)
CACHE_WRITE_FACTOR, CACHE_READ_FACTOR, OPENAI_CACHE_READ_FACTOR = 1.25, 0.1, 0.5
PROVIDER_PRICES = {
    ("openai", "gpt-4o"): (2.5, 10.0),
    ("openai", "gpt-4o-mini"): (0.15, 0.6),
    ("openai", "gpt-4-turbo"): (10.0, 30.0),
    ("gemini", "gemini-2.0-flash"): (0.1, 0.4),
    ("gemini", "gemini-1.5-pro"): (1.25, 5.0),
    ("gemini", "gemini-1.5-flash"): (0.075, 0.3),
    ("gemini", "gemma-3-27b-it"): (0.0, 0.0),
}
FREE_PROVIDERS = ("ollama", "llamacpp")
# End of fixed values.


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 1/2) at the given digit, which is how results are rounded."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits) if digits else F.floor(x + 0.5)


def model_price(model: Column, side: int) -> Column:
    """Price of input (side 0) or output (side 1): exact name, else the first listed one that the model starts with, else the default."""
    price = F.lit(DEFAULT_PRICE[side])
    for name, prices in reversed(MODEL_PRICES.items()):
        price = F.when(model.startswith(name), prices[side]).otherwise(price)
    for name, prices in MODEL_PRICES.items():
        price = F.when(model == name, prices[side]).otherwise(price)
    return price


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, cache_write: Column, cache_read: Column) -> Column:
    """Unrounded cost by the model's price; missing counts are zero."""
    mega = lambda c: F.coalesce(c, F.lit(0)) / 1_000_000
    price_in, price_out = model_price(model, 0), model_price(model, 1)
    return mega(tokens_in) * price_in + mega(tokens_out) * price_out + mega(cache_write) * price_in * CACHE_WRITE_FACTOR + mega(cache_read) * price_in * CACHE_READ_FACTOR


def session_cost(model: Column, *tokens: Column) -> Column:
    return half_up(token_cost(model, *tokens), 4)


def analysis_cost(provider: Column, model: Column, tokens_in: Column, tokens_out: Column, cache_write: Column, cache_read: Column) -> Column:
    """Cost of an analysis by provider: local ones are free, unknown models cost nothing."""
    mega = lambda c: F.coalesce(c, F.lit(0)) / 1_000_000
    cost = F.lit(0.0)
    for (p, m), (price_in, price_out) in PROVIDER_PRICES.items():
        total = mega(tokens_in) * price_in + mega(tokens_out) * price_out
        if p == "openai":
            total = total + mega(cache_read) * price_in * OPENAI_CACHE_READ_FACTOR
        cost = F.when((provider == p) & (model == m), total).otherwise(cost)
    return half_up(F.when(provider == "anthropic", token_cost(model, tokens_in, tokens_out, cache_write, cache_read)).when(provider.isin(*FREE_PROVIDERS), 0.0).otherwise(cost), 6)


#: Of a session's tokens an analysis reads this share, up to a cap; without counts so many tokens a message.
ESTIMATE_SHARE, ESTIMATE_CAP, ESTIMATE_PER_MESSAGE = 0.03, 80_000, 500


def estimated_input(tokens_in: Column, message_count: Column) -> Column:
    share = F.least(F.coalesce(tokens_in, F.lit(0)) * ESTIMATE_SHARE, F.lit(float(ESTIMATE_CAP)))
    return F.when((share == 0) & (message_count > 0), F.least(message_count * float(ESTIMATE_PER_MESSAGE), F.lit(float(ESTIMATE_CAP)))).otherwise(share)


def estimated_cost(tokens_in: Column, message_count: Column, price: tuple[float, float], output_tokens: int) -> Column:
    return half_up(estimated_input(tokens_in, message_count) / 1_000_000 * price[0] + F.lit(output_tokens / 1_000_000 * price[1]), 6)


def percent(part: Column, whole: Column) -> Column:
    """Percentage, 0 where the whole is nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def score_tier(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def score_label(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 60, "Good").when(score >= 40, "Needs Improvement").otherwise("Poor")


def bounded_score(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))
