"""Listener accounts, their sources and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingloom.sources.tables import checkpointed

#: Allowed health transitions; banned is final (fixed values).
TRANSITIONS = {
    "online": ("online", "reconnecting", "flood_wait", "disabled", "banned"),
    "reconnecting": ("online", "reconnecting", "flood_wait", "disabled", "banned"),
    "flood_wait": ("online", "reconnecting", "flood_wait", "disabled", "banned"),
    "disabled": ("online", "disabled"),
    "banned": ("banned",),
}


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("enabled") & F.col("deleted_at").isNull()).orderBy("source_id")


def loads(assignments: DataFrame) -> DataFrame:
    return assignments.where("active").groupBy("account_key").agg(F.count("*").alias("n"))


def groups(sources: DataFrame) -> DataFrame:
    """(adapter, session): sources, their sorted distinct parser keys, and the profile if they share one."""
    profile = F.when(F.count_distinct("profile") == 1, F.min("profile"))
    return sources.groupBy("adapter", "session").agg(F.count("*").alias("sources"), F.array_sort(F.collect_set("parser_key")).alias("parser_keys"), profile.alias("profile"))


def topology(sources: DataFrame, assignments: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row a source: its active account, that account's health and load."""
    mine = assignments.where("active").select("source_id", "account_key")
    rows = sources.join(mine, "source_id", "left").join(accounts.select("account_key", "health"), "account_key", "left").join(loads(assignments), "account_key", "left")
    return rows.select("source_id", "account_key", "health", F.coalesce("n", F.lit(0)).alias("load"))


def session_inventory(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """Session names from files and bindings alike, with what each side has."""
    bound = bindings.groupBy("session").agg(F.count("*").alias("bindings"))
    both = files.select("session", F.lit(True).alias("has_file")).distinct().join(bound, "session", "full_outer")
    return both.select("session", F.coalesce("has_file", F.lit(False)).alias("has_file"), F.coalesce("bindings", F.lit(0)).alias("bindings"))


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with ``n``: their place from 0 within ``key`` by ``order``. Ranges are sorted in parallel, then shifted by the counts before them."""
    dealt = checkpointed(rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = dealt.groupBy(key, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("_k"), "_p", "_first", before.alias("_before"))
    placed = dealt.join(starts, dealt[key].eqNullSafe(starts["_k"]) & (dealt["_p"] == starts["_p"]))
    return placed.select(*(dealt[c] for c in rows.columns), (F.col("_before") + F.col("_i") - F.col("_first")).alias("n"))


def assign_least_loaded(sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """(source_id, account_key): unassigned sources in order to the least loaded account, ties by key, per adapter.

    Filling the least loaded account again and again fills places in the order (load, key), so the n-th source has
    the n-th place. Loads end at the least level that has as many places as sources, found from the numbers of accounts of
    each load; an account's places up to it are its rows, numbered in parallel as the sources are. A source whose
    adapter has no account is left out.
    """
    wanted = sources.groupBy("adapter").agg(F.count("*").alias("wanted"))
    load = F.col("load").cast("bigint")
    given = accounts.select("adapter", "account_key", load.alias("load")).where("load is not null")
    upto = Window.partitionBy("adapter").orderBy("load").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = given.groupBy("adapter", "load").agg(F.count("*").alias("n")).select("adapter", F.sum("n").over(upto).alias("k"), F.sum(F.col("n") * F.col("load")).over(upto).alias("held"))
    levels = sums.join(wanted, "adapter").groupBy("adapter").agg(F.min(F.ceil((F.col("wanted") + F.col("held")) / F.col("k"))).alias("level"))
    each = given.join(levels, "adapter").where("load < level").select("adapter", "account_key", F.explode(F.sequence("load", F.col("level") - 1)).alias("l"))
    places = numbered(each.select("adapter", F.struct("l", "account_key").alias("place")), "adapter", "place").select("adapter", "n", "place.account_key")
    return numbered(sources.select("adapter", "source_id"), "adapter", "source_id").join(places, ["adapter", "n"]).select("source_id", "account_key")


def reconciled(assignments: DataFrame, sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """assignments with ``reason`` set where they must be released: source disabled, account missing or unhealthy."""
    rows = assignments.join(sources.select("source_id", "enabled"), "source_id", "left").join(accounts.select("account_key", "health"), "account_key", "left")
    reason = F.when(~F.coalesce("enabled", F.lit(False)), "source_disabled").when(F.col("health").isNull(), "account_missing").when(F.col("health").isin("banned", "disabled"), "account_unhealthy")
    return rows.select("source_id", "account_key", reason.alias("reason"))


#: Sources that accounts listen to, and health of accounts that can be given any (fixed values).
LISTENED, ASSIGNABLE = ("telegram_channel", "telegram_group"), ("online",)


def reconcile(sources: DataFrame, accounts: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments as they should be, and the audit of what changed: (source_id, account_key) and (source_id, previous, new, reason).

    ``sources`` have source_id, enabled and source_type, ``accounts`` account_key, enabled and health, ``assignments`` source_id, account_key and active. Active assignments
    of sources that are gone, disabled or of another type are released (source_disabled), then those of missing or unassignable
    accounts (failover). Every enabled source without one goes to the least loaded assignable account, in order of source_id.
    Without such an account sources stay unassigned.
    """
    wanted = sources.where(F.col("enabled") & F.col("source_type").isin(*LISTENED)).select("source_id").distinct()
    able = accounts.where(F.col("enabled") & F.col("health").isin(*ASSIGNABLE)).select("account_key").distinct()
    mine = assignments.where("active").select("source_id", "account_key")
    told = mine.join(wanted.withColumn("wanted", F.lit(True)), "source_id", "left").join(able.withColumn("able", F.lit(True)), "account_key", "left")
    told = checkpointed(told.select("source_id", "account_key", F.when(F.col("wanted").isNull(), "source_disabled").when(F.col("able").isNull(), "failover").alias("reason")))
    kept = told.where("reason is null").select("source_id", "account_key")
    open_ = wanted.join(kept.select("source_id"), "source_id", "left_anti").withColumn("adapter", F.lit("all"))
    free = able.join(loads(kept.withColumn("active", F.lit(True))), "account_key", "left").select("account_key", F.coalesce("n", F.lit(0)).alias("load"), F.lit("all").alias("adapter"))
    given = checkpointed(assign_least_loaded(open_, free))
    released = told.where("reason is not null").select("source_id", F.col("account_key").alias("previous"), F.lit(None).cast("string").alias("new"), "reason")
    fresh = given.select("source_id", F.lit(None).cast("string").alias("previous"), F.col("account_key").alias("new"), F.lit("initial").alias("reason"))
    return kept.unionByName(given), released.unionByName(fresh)


def transition_allowed(before, after):
    pairs = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    return F.concat(before, F.lit(">"), after).isin(pairs)
