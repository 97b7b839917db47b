"""Exact medians of groups of any size: counts in bins, then ranks in the one bin that holds the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingloom.sources.tables import checkpointed

#: Bins of a round, and rows of a bin that are ranked in one window.
BINS, RANKED = 1024, 1 << 16
#: Groups whose bounds may be broadcast.
BROADCAST_GROUPS = 1 << 16


def exact_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median double) of every group: the middle value, or the mean of the two in the middle, as ``F.median`` gives it.

    Nulls don't count; a group of nulls has a null median, null groups are one. Each round counts a group's values between the known bounds
    of a middle rank in BINS bins, combined before the shuffle, and goes on with the bin that holds the rank, until it has RANKED
    rows or a single value; then only these rows are sorted. A group's rows are never one task's.
    """
    told = rows.select(F.struct(F.col(group).alias("g")).alias("k"), F.col(value).cast("double").alias("v"))
    every = told.select("k").distinct()
    told = told.where("v is not null")
    whole = told.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    places = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    open_ = checkpointed(whole.select("k", F.explode(places).alias("place"), "low", "high", "n").withColumn("rank", F.col("place")))
    done = None

    def met(targets: DataFrame) -> DataFrame:
        side = F.broadcast(targets) if targets.count() <= BROADCAST_GROUPS else targets
        return told.join(side, "k").where("v between low and high")

    while True:
        settled = open_.where(f"low = high or n <= {RANKED}")
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.where(f"low < high and n > {RANKED}")
        if open_.isEmpty():
            break
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).cast("int")
        counts = met(open_.select("k", "place", "low", "high", "rank")).groupBy("k", "place", "rank", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("k", "place").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counts.withColumn("before", before).where("rank >= before and rank < before + n")
        open_ = checkpointed(held.select("k", "place", "low", "high", "n", (F.col("rank") - F.col("before")).alias("rank")))
    same = done.where("low = high").select("k", F.col("low").alias("v"))
    nth = F.row_number().over(Window.partitionBy("k", "place").orderBy("v")) - 1
    ranked = met(done.where("low < high").select("k", "place", "low", "high", "rank")).withColumn("nth", nth).where("nth = rank").select("k", "v")
    medians = same.unionByName(ranked).groupBy("k").agg(F.avg("v").alias("median"))
    return every.join(medians, "k", "left").select(F.col("k.g").alias(group), "median")
