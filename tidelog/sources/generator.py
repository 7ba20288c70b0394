"""A deterministic generator of web analytics events, by sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values; each column takes the entry at seq modulo the list's length.
LISTS = {
    "page_url": ("/", "/product", "/checkout", "/cart", "/login", "/search", "/blog", "/pricing", "/docs", "/about"),
    "referrer": ("https://google.com", "https://twitter.com", "https://github.com", "https://news.ycombinator.com", "", "https://facebook.com", "https://instagram.com"),
    "user_agent": (
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36",
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15",
        "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36",
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36",
    ),
    "device_type": ("desktop", "mobile", "tablet", "tv"),
    "browser": ("chrome", "safari", "firefox", "edge"),
    "os": ("macos", "ios", "linux", "windows", "android"),
    "country": ("US", "GB", "DE", "FR", "JP", "BR", "IN", "CA"),
    "city": ("New York", "London", "Berlin", "Paris", "Tokyo", "Sao Paulo", "Mumbai", "Toronto"),
    "event_type": ("page_view", "click", "add_to_cart", "purchase"),
}


def event_columns(seq: Column, run_id: str, payload: str) -> list[Column]:
    """The twenty fields of the event with a sequence number."""
    pick = [F.element_at(F.array(*map(F.lit, values)), (seq % len(values) + 1).cast("int")).alias(name) for name, values in LISTS.items()]
    return [
        F.lit(run_id).alias("run_id"),
        seq.alias("id"),
        F.lit(payload).alias("payload"),
        F.lit(len(payload.encode())).cast("long").alias("payload_bytes"),
        seq.alias("sequence"),
        seq.alias("event_id"),
        F.concat(F.lit("user-"), (seq % 10000).cast("string")).alias("user_id"),
        F.concat(F.lit("session-"), (F.floor(seq / 3) % 50000).cast("string")).alias("session_id"),
        *pick,
        F.date_format(F.timestamp_seconds(seq + 1700000000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"),
        (seq % 60000 + 1).alias("duration_ms"),
        ((seq % 1000) / F.lit(100.0)).alias("revenue"),
    ]


def web_events(spark: SparkSession, count: int, first: int = 0, run_id: str = "run", payload: str = "") -> DataFrame:
    """Events of ``count`` sequence numbers from ``first`` on. Event times are in UTC, as the session's zone must be."""
    return spark.range(first, first + count).select(*event_columns(F.col("id"), run_id, payload))
