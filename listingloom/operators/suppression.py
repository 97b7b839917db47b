"""Suppression of repeated alerts: a row passes if enough time went by since the last one of its key that passed.

Which rows pass is a chain: the first row, then each time the first one ``seconds`` later. A key's times are cut into buckets of
many intervals, so a hot key is many tasks: within a bucket one pass finds where a chain leaves it from each
of its times, and over the buckets pointers are doubled to find where the chain enters them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from listingloom.sources.tables import checkpointed

#: Intervals in a bucket of time.
BUCKET = 64


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bucket, us, next) by bucket with the latest first -> ``out``, the first time of the chain from us that is in another bucket."""
    current, known = None, {}
    for b in batches:
        out = []
        for key, bucket, us, then in zip(*(c.to_pylist() for c in b.columns)):
            if current is None or current != (key, bucket):
                current, known = (key, bucket), {}
            known[us] = known.get(then, then)
            out.append(known[us])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.int64())], ["key", "bucket", "us", "out"])


def _entries(times: DataFrame, interval: int) -> DataFrame:
    """(key, bucket, entry): the first time of a key's chain in each bucket that it meets; ``times`` are distinct (key, us)."""
    width = interval * BUCKET
    own = F.floor(F.col("us") / width)
    placed = checkpointed(times.withColumn("bucket", own))
    buckets = placed.groupBy("key", "bucket").agg(F.min("us").alias("first"))
    after = Window.partitionBy("key").orderBy("bucket")
    ahead = buckets.select("key", "bucket", F.when(F.lead("bucket").over(after) == F.col("bucket") + 1, F.lead("first", 2).over(after)).otherwise(F.lead("first").over(after)).alias("beyond"))
    twice = placed.withColumn("group", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
    # Each time asks for the first one an interval later. Sorted with the latest first, the questions among the times, that is the last time seen.
    there = twice.select("key", "group", "bucket", "us", F.col("us").alias("at"), F.lit(False).alias("asks"))
    asked = placed.select("key", F.col("bucket").alias("group"), "bucket", "us", (F.col("us") + interval).alias("at"), F.lit(True).alias("asks"))
    seen = Window.partitionBy("key", "group").orderBy(F.col("at").desc(), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = there.unionByName(asked).withColumn("then", F.min(F.when(~F.col("asks"), F.col("us"))).over(seen)).where("asks")
    linked = found.join(ahead, ["key", "bucket"]).select("key", "bucket", "us", F.coalesce("then", "beyond").alias("next"))
    shape = StructType([placed.schema["key"], StructField("bucket", LongType()), StructField("us", LongType()), StructField("out", LongType())])
    chains = linked.repartition("key", "bucket").sortWithinPartitions("key", "bucket", F.col("us").desc()).mapInArrow(_chains, shape)
    jumps = checkpointed(chains.select("key", "us", "out").where("out is not null"))
    targets = jumps.select("key", F.col("out").alias("us")).distinct()
    reached = buckets.groupBy("key").agg(F.min("first").alias("us"))
    # Only the chains' first times and the times at which a chain enters a bucket can be jumped from.
    jumps = checkpointed(jumps.join(targets.unionByName(reached).distinct(), ["key", "us"], "left_semi"))
    new = reached = checkpointed(reached)
    while True:
        new = checkpointed(reached.join(jumps, ["key", "us"]).select("key", F.col("out").alias("us")).join(reached, ["key", "us"], "left_anti"))
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        far = jumps.select("key", F.col("us").alias("out"), F.col("out").alias("farther"))
        jumps = checkpointed(jumps.join(far, ["key", "out"]).select("key", "us", F.col("farther").alias("out")))
    return reached.select("key", F.floor(F.col("us") / width).alias("bucket"), F.col("us").alias("entry"))


def _mark(interval: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, due = None, None
        for b in batches:
            passed = []
            for key, bucket, us, entry in zip(*(c.to_pylist() for c in b.columns[:4])):
                if current is None or current != (key, bucket):
                    current, due = (key, bucket), entry
                passed.append(due is not None and us is not None and us >= due)
                if passed[-1]:
                    due = us + interval
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(passed, pa.bool_())], ["key", "bucket", "us", "row", "allowed"])

    return run


def suppressed(rows: DataFrame, keys: list[str], order: list[str], at: str, seconds: float = 300) -> DataFrame:
    """rows with ``allowed``, and ``suppressed_before``: for a row that passes, how many of its key were held back since the one before.

    Rows of one time are in the order of ``order``; a row without a time never passes and is not counted. Null keys are a key. The last
    rows of a key that nothing follows are counted by nobody.
    """
    interval = round(seconds * 1_000_000)
    packed = rows.select(F.struct(*keys).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.struct("*").alias("row"))
    packed = checkpointed(packed.withColumn("bucket", F.floor(F.col("us") / (interval * BUCKET))))
    entries = _entries(packed.where("us is not null").select("key", "us").distinct(), interval)
    told = packed.join(entries, ["key", "bucket"], "left").select("key", "bucket", "us", "entry", "row")
    dealt = told.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "us", *(f"row.{o}" for o in order))
    shape = StructType([told.schema["key"], told.schema["bucket"], told.schema["us"], told.schema["row"], StructField("allowed", BooleanType())])
    marked = checkpointed(dealt.mapInArrow(_mark(interval), shape))
    # A passing row's place among its key's rows, less the place of the one before, is what was held back between them.
    sizes = marked.where("us is not null").groupBy("key", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("key", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "bucket").orderBy("us", *(f"row.{o}" for o in order))
    placed = marked.where("us is not null").withColumn("n", F.row_number().over(inside)).join(starts, ["key", "bucket"]).withColumn("place", F.col("start") + F.col("n"))
    gap = F.col("place") - F.lag("place").over(Window.partitionBy("key").orderBy("place")) - 1
    sent = placed.where("allowed").select("row", F.lit(True).alias("allowed"), F.coalesce(gap, F.lit(0)).alias("suppressed_before"))
    held = marked.where("not allowed").select("row", "allowed", F.lit(None).cast("bigint").alias("suppressed_before"))
    return sent.unionByName(held).select("row.*", "allowed", "suppressed_before")


def alerts(rows: DataFrame, keys: list[str], order: list[str], at: str, retry_after: str, seconds: float = 300, least: float = 1, default: float = 60) -> DataFrame:
    """``suppressed`` rows with ``outcome``: sent, refused, suppressed or blocked.

    ``retry_after`` is null for an alert that the service takes; else it refuses it, asking for that many seconds of rest (zero: ``default``;
    at least ``least``), and for as long all alerts of all keys are blocked: these are neither counted nor sent. A refused alert still is
    the last one of its key. Each rest changes what follows it, so one round is run for each rest; rests are rare by nature.
    """
    marked = rows.withColumn("_place", F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("_us"), *order))
    rests: list[Column] = []
    blocked, last = F.lit(False), None
    while True:
        told = checkpointed(suppressed(marked.where(~blocked), keys, ["_place"], at, seconds))
        refused = told.where(F.col("allowed") & F.col(retry_after).isNotNull())
        refused = refused if last is None else refused.where(F.col("_place") > last)
        first = refused.select("_place", F.col(retry_after).alias("rest")).orderBy("_place").first()
        if first is None:
            break
        last = F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(first["_place"], marked.schema["_place"].dataType)))
        end = first["_place"]["_us"] + round(max(first["rest"] or default, least) * 1_000_000)
        rests.append((F.col("_place") > last) & (F.col("_place._us") < end))
        blocked = F.coalesce(reduce(lambda x, y: x | y, rests), F.lit(False))
    outcome = F.when(~F.col("allowed"), "suppressed").when(F.col(retry_after).isNotNull(), "refused").otherwise("sent")
    still = marked.where(blocked).select("*", F.lit(False).alias("allowed"), F.lit(None).cast("bigint").alias("suppressed_before"), F.lit("blocked").alias("outcome"))
    return told.withColumn("outcome", outcome).unionByName(still).drop("_place")
