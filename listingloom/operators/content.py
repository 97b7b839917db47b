"""Statistics and rankings for daily posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.functions.text import collapsed_text, redacted
from listingloom.operators.predicates import user_facing


def daily_stats(listings: DataFrame, day: str) -> DataFrame:
    """One row: all active parents and their mean price, and the day's announcements and duplicates. One pass."""
    active, on_day = user_facing(), F.to_date("created_at") == F.lit(day).cast("date")
    comparable = active & (F.col("price_basis") == "total") & (F.col("currency") == "USD")
    return listings.agg(
        F.count_if(active).alias("active_count"), F.count_if(on_day).alias("day_total"),
        F.count_if(on_day & F.col("parent_id").isNotNull()).alias("day_duplicates"),
        F.round(F.avg(F.when(comparable, F.col("monthly").cast("double"))), 4).alias("average_price"),
    )


def offers(listings: DataFrame) -> DataFrame:
    priced = (F.col("monthly") > 0) & (F.col("price_period") != "one_time")
    return listings.where(user_facing() & priced)


def district_stats(listings: DataFrame, limit: int, least: int = 2, currency: str = "USD") -> DataFrame:
    stats = (
        offers(listings).where(F.col("currency") == currency).groupBy("district")
        .agg(
            F.count("*").alias("n"), F.round(F.avg(F.col("monthly").cast("double")), 4).alias("average_price"),
            F.min("monthly").cast("double").alias("least_price"), F.max("monthly").cast("double").alias("greatest_price"),
        )
    )
    return stats.where(F.col("n") >= least).orderBy(F.col("n").desc(), "average_price", "district").limit(limit)


def top_offers(listings: DataFrame, limit: int, currencies: tuple[str, ...] = ("USD", "UZS")) -> DataFrame:
    """Cheapest first, then the most sources, the oldest and the id; at most 50."""
    sources = listings.where("parent_id is not null").groupBy(F.col("parent_id").alias("announcement_id")).agg(F.count("*").alias("children"))
    rows = offers(listings).where(F.col("currency").isin(*currencies)).join(sources, "announcement_id", "left")
    counted = rows.withColumn("sources", F.coalesce("children", F.lit(0)) + 1)
    return counted.orderBy("monthly", F.col("sources").desc(), "created_at", "announcement_id").limit(max(1, min(limit, 50)))


def due_posts(days: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(day) -> one row for each kind and day, with the key that makes it unique."""
    rows = days.select("day", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return rows.withColumn("post_key", F.concat_ws(":", F.lit("day"), F.col("day").cast("string"), "kind"))


def admin_summary(listings: DataFrame, limit: int = 420) -> DataFrame:
    """Listings as the administration shows them: amounts as texts, the description collapsed, redacted and shortened."""
    whole = collapsed_text(redacted(F.coalesce("description", F.lit(""))))
    short = F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, limit - 1)), F.lit("...")))
    return listings.select(
        "announcement_id", F.col("price").cast("string").alias("price"), "currency", "district", "rooms", F.col("area").cast("string").alias("area_sqm"), "floor",
        F.array_compact(F.array("phone")).alias("phone_numbers"), short.alias("description"), "source_url", "created_at",
    )
