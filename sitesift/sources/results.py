"""Test-run results and the category dimension (S8), derived from ``events``.

Each event is one test: ``url`` = event type + user, ``use_browser`` by
event parity, ``success`` unless the type is 'error', ``items_found`` from
the event id, ``time_taken`` = value. Half of the failures carry no error
text (NULL), as the reference does when no exception was raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Category -> event types (one type in two categories, one
# category with no tests).
CATEGORY_TYPES = {
    "Browsing": ["view", "click"],
    "Commerce": ["purchase", "signup"],
    "Problems & Errors In Production Systems": ["error"],
    "Engagement": ["click", "signup"],
    "Archive": ["export"],
}


def results_from_events(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    ok = F.col("event_type") != "error"
    return events.select(
        e.alias("run_ord"),
        F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example/u/"), F.col("user_id").cast("string")).alias("url"),
        (e % 2 == 0).alias("use_browser"),
        F.lit(5).alias("max_items"),
        ok.alias("success"),
        F.when(ok, (e % 4).cast("int")).otherwise(F.lit(0)).alias("items_found"),
        F.col("value").alias("time_taken"),
        F.when(~ok & (e % 4 >= 2), F.concat(F.lit("HTTP error while fetching page for user "), F.col("user_id").cast("string"), F.lit(" after retries were exhausted"))).alias("error"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )


def category_map(spark: SparkSession) -> DataFrame:
    """The category -> type map exploded to rows (fixed, tiny)."""
    rows = [(c, t) for c, ts in CATEGORY_TYPES.items() for t in ts]
    return spark.createDataFrame(rows, "category string, event_type string")


def dimension(spark: SparkSession, results: DataFrame) -> DataFrame:
    """(category, url) for every distinct result URL of a mapped type.

    The URL list grows with the data, so it is joined, not broadcast blindly;
    the category map itself is a fixed handful of rows.
    """
    urls = results.select("url", F.regexp_extract("url", r"^https://([^.]+)\.", 1).alias("event_type")).distinct()
    return urls.join(F.broadcast(category_map(spark)), "event_type").select("category", "url")
