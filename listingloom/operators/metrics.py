"""Product and technical metrics over event logs; each is one pass or a semi-join, nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATE = ("exact_duplicate", "high_confidence_duplicate")
ACTIVATION = ("search_completed", "saved_filter_created")
ENGAGEMENT = ("notification_action_open",)


def utc_of_local_day(day: str, zone: str) -> str:
    """The UTC instant at which a local day begins; zones are UTC and Asia/Tashkent (+5, no summer time)."""
    import datetime as dt

    if zone not in ("UTC", "Asia/Tashkent"):
        raise ValueError(f"unsupported zone {zone!r}")
    start = dt.datetime.fromisoformat(day) - dt.timedelta(hours=5 if zone == "Asia/Tashkent" else 0)
    return start.isoformat(sep=" ")


def checked_window(start: str, end: str, hours: int) -> None:
    if end <= start or not 1 <= hours <= 72:
        raise ValueError("end after start, and a window of 1 to 72 hours")


def window_valid(start: Column, end: Column, hours: Column) -> Column:
    """``checked_window`` for rows: whether the end is after the start and the window has 1 to 72 hours; false for nulls."""
    return F.coalesce((end > start) & hours.between(1, 72), F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def _named(events: DataFrame, *names: str) -> DataFrame:
    return events.where(F.col("event_name").isin(*names) & F.col("user_id").isNotNull())


def registrations(events: DataFrame, first: bool = False) -> DataFrame:
    """(user_id, registered_at): the last registration in log order, or the first."""
    order = F.struct("occurred_at", "event_id")
    pick = F.min_by if first else F.max_by
    return _named(events, "user_registered").groupBy("user_id").agg(pick("occurred_at", order).alias("registered_at"))


def _rate(cohort: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """One row (numerator, denominator, rate); hits are counted once a key."""
    n = hits.select(F.col(key)).distinct().agg(F.count("*").alias("numerator"))
    whole = cohort.agg(F.count("*").alias("denominator"))
    return n.crossJoin(F.broadcast(whole)).select("numerator", "denominator", ratio(F.col("numerator"), F.col("denominator")).alias("rate"))


def activation(events: DataFrame, end: str) -> DataFrame:
    """Registered users with an activation event from their registration to ``end``."""
    cohort = registrations(events)
    acts = _named(events, *ACTIVATION).where(F.col("occurred_at") < F.lit(end).cast("timestamp_ntz"))
    return _rate(cohort, acts.join(cohort, "user_id").where("occurred_at >= registered_at"), "user_id")


def retention(events: DataFrame, start: str, end: str, hours: int, day: int = 7, first: bool = False) -> DataFrame:
    """Users registered in [start, end) with another event in [registration + day, + day + hours)."""
    checked_window(start, end, hours)
    inside = (F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("occurred_at") < F.lit(end).cast("timestamp_ntz"))
    cohort = registrations(events.where(inside), first)
    others = events.where((F.col("event_name") != "user_registered") & F.col("user_id").isNotNull()).select("user_id", "occurred_at")
    opens = F.col("registered_at") + F.make_dt_interval(F.lit(day))
    hits = others.join(cohort, "user_id").where((F.col("occurred_at") >= opens) & (F.col("occurred_at") < opens + F.make_dt_interval(F.lit(0), F.lit(hours))))
    return _rate(cohort, hits, "user_id")


def conversion(events: DataFrame, cohort_event: str, hit_events: tuple[str, ...], key: str) -> DataFrame:
    """Distinct keys of the cohort event that have a hit event."""
    cohort = events.where((F.col("event_name") == cohort_event) & F.col(key).isNotNull()).select(key).distinct()
    hits = events.where(F.col("event_name").isin(*hit_events)).join(cohort, key, "left_semi")
    return _rate(cohort, hits, key)


def event_buckets(events: DataFrame, start: str, end: str, unit: str = "day") -> DataFrame:
    inside = (F.col("occurred_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("occurred_at") < F.lit(end).cast("timestamp_ntz"))
    return events.where(inside).groupBy(F.date_trunc(unit, "occurred_at").cast("timestamp_ntz").alias("bucket"), "event_name").agg(F.count("*").alias("n"))


def technical_snapshot(events: DataFrame) -> DataFrame:
    """One row of counters and averages, in one pass."""

    def of(name: str) -> Column:
        return F.col("metric_name") == name

    duplicate = of("dedup_decision") & F.coalesce(F.col("decision").isin(*DUPLICATE), F.lit(False))
    row = events.agg(
        F.round(F.avg(F.when(of("queue_delay_ms"), F.col("value"))), 6).alias("queue_delay_avg_ms"), F.count_if(of("queue_delay_ms")).alias("queue_delay_samples"),
        F.count_if(duplicate).alias("dedup_duplicate_count"), F.count_if(of("dedup_decision")).alias("dedup_total_count"),
        F.count_if(of("notification_retry")).alias("notification_retry_count"), F.count_if(of("source_parser_decision")).alias("source_parser_decision_count"),
    )
    return row.withColumn("dedup_duplicate_rate", ratio(F.col("dedup_duplicate_count"), F.col("dedup_total_count")))


def latest_states(events: DataFrame, metric: str = "listener_health") -> DataFrame:
    """(state, n): how many subjects have each state as their latest."""
    mine = events.where((F.col("metric_name") == metric) & F.col("subject_id").isNotNull())
    last = mine.groupBy("subject_id").agg(F.max_by(F.coalesce("state", F.lit("unknown")), F.struct("occurred_at", "event_id")).alias("state"))
    return last.groupBy("state").agg(F.count("*").alias("n"))


def decisions_by_source(events: DataFrame, metric: str = "source_parser_decision") -> DataFrame:
    source = F.coalesce(F.nullif("source_id", F.lit("")), "subject_id", F.lit("unknown"))
    rows = events.where(F.col("metric_name") == metric)
    return rows.groupBy(source.alias("source"), F.coalesce("decision", F.lit("unknown")).alias("decision")).agg(F.count("*").alias("n"))
