"""Queries on product and technical metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listingloom.operators import metrics
from listingloom.plans.registry import query
from listingloom.sources import tables as t

START, END = "2024-01-01", "2024-01-31"
REG = "reg as (select user_id, max_by(occurred_at, (occurred_at, event_id)) as registered_at from product_events where event_name = 'user_registered' and user_id is not null group by 1)"


@query("agg07_activation_rate", f"""with {REG}, hits as (select distinct e.user_id from product_events e join reg r on e.user_id = r.user_id and e.occurred_at >= registered_at
    where event_name in ('search_completed', 'saved_filter_created') and e.occurred_at < timestamp '2024-01-31')
  select (select count(*) from hits) as numerator, (select count(*) from reg) as denominator, (select count(*) from hits)::double / (select count(*) from reg) as rate""")
def activation(spark, d):
    return metrics.activation(t.product_events(spark, d), END)


def _retention_sql(pick: str) -> str:
    return f"""with reg as (select user_id, {pick}(occurred_at, (occurred_at, event_id)) as r from product_events where event_name = 'user_registered' and user_id is not null
    and occurred_at >= timestamp '2024-01-01' and occurred_at < timestamp '2024-01-31' group by 1),
  hits as (select distinct e.user_id from product_events e join reg on e.user_id = reg.user_id and event_name <> 'user_registered'
    and occurred_at >= r + interval 7 days and occurred_at < r + interval 7 days + interval 24 hours)
  select (select count(*) from hits) as numerator, (select count(*) from reg) as denominator, (select count(*) from hits)::double / (select count(*) from reg) as rate"""


@query("join23_d7_retention", _retention_sql("max_by"))
def retention(spark, d):
    return metrics.retention(t.product_events(spark, d), START, END, 24)


@query("join23_d7_retention_first", _retention_sql("min_by"))
def retention_first(spark, d):
    return metrics.retention(t.product_events(spark, d), START, END, 24, first=True)


@query("join24_engagement_rate", """with sent as (select distinct subject_id from product_events where event_name = 'notification_sent'),
  hits as (select distinct subject_id from product_events where event_name = 'notification_action_open' and subject_id in (select subject_id from sent))
  select (select count(*) from hits) as numerator, (select count(*) from sent) as denominator, (select count(*) from hits)::double / (select count(*) from sent) as rate""")
def engagement(spark, d):
    return metrics.conversion(t.product_events(spark, d), "notification_sent", metrics.ENGAGEMENT, "subject_id")


@query("join22_cohort_semi_join", f"with {REG} select event_id from product_events e where event_name = 'search_completed' and exists (select 1 from reg where reg.user_id = e.user_id and e.occurred_at >= registered_at)")
def cohort_events(spark, d):
    e = t.product_events(spark, d)
    reg = metrics.registrations(e).withColumnRenamed("user_id", "u")
    return e.where("event_name = 'search_completed'").join(reg, (F.col("user_id") == F.col("u")) & (F.col("occurred_at") >= F.col("registered_at")), "left_semi").select("event_id")


@query("agg08_daily_buckets", "select date_trunc('day', occurred_at) as bucket, event_name, count(*) as n from product_events where occurred_at >= timestamp '2024-01-03' and occurred_at < timestamp '2024-01-20' group by 1, 2")
def daily(spark, d):
    return metrics.event_buckets(t.product_events(spark, d), "2024-01-03", "2024-01-20")


@query("agg08_hourly_buckets", "select date_trunc('hour', occurred_at) as bucket, event_name, count(*) as n from product_events where occurred_at >= timestamp '2024-01-03' and occurred_at < timestamp '2024-01-05' group by 1, 2")
def hourly(spark, d):
    return metrics.event_buckets(t.product_events(spark, d), "2024-01-03", "2024-01-05", "hour")


@query("agg09_technical_snapshot", """select round(avg(value) filter (metric_name = 'queue_delay_ms'), 6) as queue_delay_avg_ms, count(*) filter (metric_name = 'queue_delay_ms') as queue_delay_samples,
  count(*) filter (metric_name = 'dedup_decision' and decision in ('exact_duplicate', 'high_confidence_duplicate')) as dedup_duplicate_count,
  count(*) filter (metric_name = 'dedup_decision') as dedup_total_count, count(*) filter (metric_name = 'notification_retry') as notification_retry_count,
  count(*) filter (metric_name = 'source_parser_decision') as source_parser_decision_count,
  count(*) filter (metric_name = 'dedup_decision' and decision in ('exact_duplicate', 'high_confidence_duplicate'))::double / count(*) filter (metric_name = 'dedup_decision') as dedup_duplicate_rate
  from technical_events""")
def technical(spark, d):
    return metrics.technical_snapshot(t.technical_events(spark, d))


@query("agg10_latest_states", """select state, count(*) as n from (select subject_id, max_by(coalesce(state, 'unknown'), (occurred_at, event_id)) as state from technical_events
  where metric_name = 'listener_health' and subject_id is not null group by 1) group by 1""")
def states(spark, d):
    return metrics.latest_states(t.technical_events(spark, d))


@query("agg11_decisions_by_source", """select coalesce(nullif(source_id, ''), subject_id, 'unknown') as source, coalesce(decision, 'unknown') as decision, count(*) as n
  from technical_events where metric_name = 'source_parser_decision' group by 1, 2""")
def by_source(spark, d):
    return metrics.decisions_by_source(t.technical_events(spark, d))


@query("mat04_safe_ratio", "select event_type, count(*) filter (value > 1000000)::double / nullif(count(*) filter (value > 2000000), 0) as rate from events group by 1")
def safe_ratio(spark, d):
    rows = t.table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 1e6).alias("a"), F.count_if(F.col("value") > 2e6).alias("b"))
    return rows.select("event_type", metrics.ratio(F.col("a"), F.col("b")).alias("rate"))


@query("mat08_queue_delay", "select event_id, greatest(0, (epoch_us(timestamp '2024-01-15') - epoch_us(ts)) // 1000) as delay_ms from events")
def delay(spark, d):
    waited = F.unix_micros(F.lit("2024-01-15 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return t.table(spark, d, "events").select("event_id", F.greatest(F.lit(0).cast("bigint"), F.floor(waited / 1000)).alias("delay_ms"))


@query("dat01_local_day_to_utc", "select event_id, cast(ts + interval 5 hours as date) - interval 5 hours as day_start from events")
def local_day(spark, d):
    local = F.date_trunc("day", F.col("ts") + F.make_dt_interval(hours=F.lit(5))).cast("timestamp_ntz")
    return t.table(spark, d, "events").select("event_id", (local - F.make_dt_interval(hours=F.lit(5))).alias("day_start"))


@query("dat05_local_content_day", "select cast(ts + interval 5 hours as date) as day, count(*) as n from events group by 1")
def content_day(spark, d):
    return t.table(spark, d, "events").groupBy(F.to_date(F.col("ts") + F.make_dt_interval(hours=F.lit(5))).alias("day")).agg(F.count("*").alias("n"))


@query("win02_latest_per_user", "select user_id, event_id, event_name from (select *, row_number() over (partition by user_id order by occurred_at desc, event_id desc) as n from product_events) where n = 1")
def latest_event(spark, d):
    from listingloom.operators.joins import latest

    return latest(t.product_events(spark, d), ["user_id"], F.struct("occurred_at", "event_id"), "event_id", "event_name")


@query("win04_first_occurrence", "select user_id, event_name, min(event_id) as first_id from product_events group by 1, 2")
def first_event(spark, d):
    return t.product_events(spark, d).groupBy("user_id", "event_name").agg(F.min("event_id").alias("first_id"))


@query("dml01_insert_if_absent", """select event_id, user_id, event_name from (select *, row_number() over (partition by user_id, event_name, k order by event_id) as n from product_events where occurred_at >= timestamp '2024-01-10') b
  where n = 1 and not exists (select 1 from product_events o where o.occurred_at < timestamp '2024-01-10' and o.user_id = b.user_id and o.event_name = b.event_name and o.k = b.k)""")
def insert_absent(spark, d):
    from listingloom.operators.lifecycle import absent_rows

    e = t.product_events(spark, d)
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return absent_rows(e.where(F.col("occurred_at") < cut), e.where(F.col("occurred_at") >= cut), ["user_id", "event_name", "k"], F.col("event_id")).select("event_id", "user_id", "event_name")


@query("dml29_first_touch", "select user_id, min(occurred_at) as registered_at from product_events where user_id is not null group by 1")
def first_touch(spark, d):
    return t.product_events(spark, d).where("user_id is not null").groupBy("user_id").agg(F.min("occurred_at").alias("registered_at"))


@query("dml30_search_event_once", """with e as (select * from product_events where event_name = 'search_completed'), s as (select distinct user_id, k from e where occurred_at < timestamp '2024-01-15')
  select user_id, k, min(event_id) as event_id from e anti join s using (user_id, k) where occurred_at >= timestamp '2024-01-15' group by 1, 2""")
def search_once(spark, d):
    """Searches since mid-month, once for each user and criteria that no earlier search had."""
    from listingloom.operators.lifecycle import absent_rows

    e = t.product_events(spark, d).where("event_name = 'search_completed'").withColumn("criteria", F.sha2(F.to_json(F.struct("k")), 256))
    stored = F.col("occurred_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    return absent_rows(e.where(stored), e.where(~stored), ["user_id", "criteria"], F.col("event_id")).select("user_id", "k", "event_id")


@query("agg20_usage_counts", "select tag, count(*) as usage from listings where excluded_tag is null group by 1")
def usage(spark, d):
    return t.listings(spark, d).where("excluded_tag is null").groupBy("tag").agg(F.count("*").alias("usage"))


@query("top06_tags_by_usage", "select tag, count(*) as usage, row_number() over (order by count(*) desc, tag) as place from listings group by 1")
def tags_by_usage(spark, d):
    counts = t.listings(spark, d).groupBy("tag").agg(F.count("*").alias("usage"))
    return counts.select("tag", "usage", F.row_number().over(Window.orderBy(F.col("usage").desc(), "tag")).cast("bigint").alias("place"))
