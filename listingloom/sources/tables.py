"""Readers of the Parquet tables and the domain views built on them.

The views give the supplied star schema the shape of a listing feed. They are lazy column expressions:
filters and column choices of a query reach the Parquet scans through them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and cut from its lineage.

    A local session without one gets a folder of its own; on a cluster that is an error.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _checkpoint_dir(spark: SparkSession) -> str:
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``checkpointed`` as Parquet: smaller, and columns that a later step doesn't ask for are not read."""
    path = f"{_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements: one row an order, the district from the customer's nation."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    amount = (F.floor(F.col("o_totalprice") / 100).cast("bigint") + F.expr("0.25 * (o_orderkey % 4)")).cast("decimal(14,2)")
    period = F.when(k % 10 == 0, "one_time").when(k % 10 <= 2, "daily").otherwise("monthly")
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("price", F.when(k % 13 != 0, amount))
        .withColumn("price_period", period)
    )
    monthly = F.when(F.col("price_period") == "monthly", F.col("price")).when(F.col("price_period") == "daily", F.col("price") * 30)
    return base.select(
        k.alias("announcement_id"), "price", "price_period", monthly.cast("decimal(14,2)").alias("monthly"),
        F.when(k % 7 == 0, "per_person").otherwise("total").alias("price_basis"),
        F.when(k % 5 == 0, "UZS").otherwise("USD").alias("currency"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("rooms"), (30 + k % 90).cast("decimal(10,2)").alias("area"),
        (k % 12 + 1).cast("int").alias("floor"), F.col("n_name").alias("district"),
        F.concat(F.lit("Block "), (k % 40).cast("string"), F.lit(", "), F.col("n_name")).alias("address"),
        F.concat(F.lit("Flat with "), (F.col("o_custkey") % 5 + 1).cast("string"), F.lit(" rooms in "), F.col("n_name"), F.lit(" near "), F.lower("o_orderpriority")).alias("description"),
        F.concat(F.lit("+998"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 9, "7")).alias("phone"),
        F.when(k % 3 == 0, "good").when(k % 3 == 1, "average").alias("renovation"),
        F.when(F.col("o_orderstatus") == "P", "manual_review").otherwise("active").alias("status"),
        F.when((k % 11 == 0) & (k > 0), k - 1).alias("parent_id"),
        F.col("o_orderdate").alias("created_at"), F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("source_id"),
        F.when(k % 6 == 0, F.concat(F.lit("https://t.me/c"), (F.col("o_custkey") % 20).cast("string"), F.lit("/"), (F.floor(k / 12)).cast("string"))).alias("source_url"),
        F.substring("o_orderpriority", 1, 1).alias("tag"), F.when(k % 17 == 0, F.substring("o_orderpriority", 1, 1)).alias("excluded_tag"),
        (k % 5).cast("int").alias("trust"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (announcement, media id); the source repeats some pairs."""
    phash = F.substring(F.sha2(F.col("l_partkey").cast("string"), 256), 1, 16)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("announcement_id"), F.col("l_linenumber").alias("media_id"), phash.alias("phash"))
    return rows.groupBy("announcement_id", "media_id").agg(F.min("phash").alias("phash"))


def saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("filter_id"), k.alias("user_id"), F.col("n_name").alias("district"),
        F.greatest(F.floor("c_acctbal"), F.lit(100)).cast("decimal(14,2)").alias("max_price"),
        F.when(k % 3 == 0, (k % 5 + 1).cast("int")).alias("rooms"), (k % 4 != 0).alias("enabled"), (k % 2 == 0).alias("include_per_person"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"), F.when(k % 9 == 0, "blocked").otherwise("active").alias("status"), (k % 8 != 0).alias("notifications_enabled"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("2024-06-01").cast("timestamp_ntz")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("2023-01-01").cast("timestamp_ntz")).alias("premium_until"),
        F.format_string("u%010d", k).alias("referral_code"), F.when((k > 1) & (k % 4 != 1), F.floor(k / 2)).cast("bigint").alias("referrer_id"),
    )


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.create_map(*(F.lit(x) for pair in PRODUCT_EVENTS.items() for x in pair))
    return table(spark, sf_dir, "events").select(
        "event_id", name[F.col("event_type")].alias("event_name"), F.col("ts").alias("occurred_at"), "user_id",
        (F.col("event_id") % 100).cast("string").alias("subject_id"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: Event types of the supplied table as product events.
PRODUCT_EVENTS = {
    "signup": "user_registered", "view": "search_completed", "purchase": "saved_filter_created",
    "click": "notification_action_open", "error": "notification_sent",
}


def technical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical metrics: the kind by event type, decisions and states by the JSON property."""
    name = F.create_map(*(F.lit(x) for pair in TECHNICAL_EVENTS.items() for x in pair))
    k = F.get_json_object("props", "$.k").cast("int")
    decision = F.when(k % 4 == 0, "exact_duplicate").when(k % 4 == 1, "high_confidence_duplicate").when(k % 4 == 2, "new")
    return table(spark, sf_dir, "events").select(
        "event_id", name[F.col("event_type")].alias("metric_name"), F.col("ts").alias("occurred_at"), "value",
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("acc"), (F.col("user_id") % 10).cast("string"))).alias("subject_id"),
        decision.alias("decision"), F.when(k % 3 == 0, "online").when(k % 3 == 1, "flood_wait").alias("state"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("src"), (F.col("event_id") % 6).cast("string"))).alias("source_id"),
    )


TECHNICAL_EVENTS = {
    "signup": "queue_delay_ms", "view": "dedup_decision", "purchase": "listener_health",
    "click": "source_parser_decision", "error": "notification_retry",
}


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts from ``documents``; about one in three has a forward origin."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k.alias("post_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("source_id"), F.concat(F.lit("-100"), F.col("source")).alias("channel_id"),
        k.cast("string").alias("message_id"), F.when(k % 3 == 0, F.concat(F.lit("-777:"), F.floor(k / 6).cast("string"))).alias("forward_key"),
        F.when(k % 5 == 0, F.floor(k / 10)).alias("parent_ref"), F.substring(F.sha2(F.floor(k / 4).cast("string"), 256), 1, 16).alias("phash"),
    )
