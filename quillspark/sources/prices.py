"""Price books (S9): fixed values, USD for a thousand tokens in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Provider, model, USD per 1000 input tokens, USD per 1000 output tokens.
PRICES: tuple[tuple[str, str, float, float], ...] = (
    ("anthropic", "claude-opus-4-7", 0.015, 0.075),
    ("anthropic", "claude-sonnet-4-6", 0.003, 0.015),
    ("anthropic", "claude-haiku-4-5-20251001", 0.0008, 0.004),
    ("openai", "gpt-4o", 0.0025, 0.010),
    ("openai", "gpt-4o-mini", 0.00015, 0.0006),
    ("openai", "o1-mini", 0.003, 0.012),
    ("openai-compat", "deepseek-chat", 0.00027, 0.0011),
    ("openai-compat", "deepseek-reasoner", 0.00055, 0.00219),
    ("openai-compat", "moonshot-v1-32k", 0.00333, 0.00333),
    ("openai-compat", "moonshot-v1-128k", 0.00833, 0.00833),
    ("openai-compat", "llama-3.1-70b-versatile", 0.00059, 0.00079),
    ("openai-compat", "llama-3.3-70b-versatile", 0.00059, 0.00079),
    ("openai-compat", "meta-llama/Llama-3.3-70B-Instruct-Turbo", 0.00088, 0.00088),
)
#: Image model, size, quality, USD an image.
IMAGE_PRICES: tuple[tuple[str, str, str, float], ...] = (
    ("dall-e-3", "1024x1024", "standard", 0.040),
    ("dall-e-3", "1024x1024", "hd", 0.080),
    ("dall-e-3", "1024x1792", "standard", 0.080),
    ("dall-e-3", "1024x1792", "hd", 0.120),
    ("dall-e-3", "1792x1024", "standard", 0.080),
    ("dall-e-3", "1792x1024", "hd", 0.120),
    ("dall-e-2", "1024x1024", "standard", 0.020),
    ("dall-e-2", "1024x1024", "hd", 0.020),
    ("dall-e-2", "512x512", "standard", 0.018),
    ("dall-e-2", "512x512", "hd", 0.018),
    ("dall-e-2", "256x256", "standard", 0.016),
    ("dall-e-2", "256x256", "hd", 0.016),
)


def price_book(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "provider string, model string, usd_in double, usd_out double")


def price_book_sql() -> str:
    rows = ", ".join(f"('{p}', '{m}', {i}::double, {o}::double)" for p, m, i, o in PRICES)
    return f"select * from (values {rows}) t(provider, model, usd_in, usd_out)"


def image_price_book(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(IMAGE_PRICES), "model string, size string, quality string, usd_each double")


def image_price_book_sql() -> str:
    rows = ", ".join(f"('{m}', '{s}', '{q}', {u}::double)" for m, s, q, u in IMAGE_PRICES)
    return f"select * from (values {rows}) t(model, size, quality, usd_each)"
