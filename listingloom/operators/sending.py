"""Send intervals for each user and for all together, as a fold over time buckets that settles in rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from listingloom.sources.tables import checkpointed

#: Longest intervals in a bucket of time.
BUCKET = 64


def _fold(per_user: int, overall: int):
    """(bucket, told, user, us, row, place) in order, sends known before first -> the others with ``allowed`` and ``wait``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, users = None, None, {}
        for b in batches:
            keep, allowed, waits = [], [], []
            for i, (bucket, told, user, us) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]))):
                user = str(user)
                if bucket != current:
                    current, last, users = bucket, None, {}
                if told:
                    last, users[user] = max(us, last or us), max(us, users.get(user, us))
                    continue
                wait = max(0 if last is None else last + overall - us, users[user] + per_user - us if user in users else 0)
                if wait <= 0:
                    last, users[user] = us, us
                keep.append(i)
                allowed.append(wait <= 0)
                waits.append(max(wait, 0))
            kept = [c.take(pa.array(keep, pa.int64())) for c in (b.column(0), b.column(2), b.column(3), b.column(4), b.column(5))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(allowed, pa.bool_()), pa.array(waits, pa.int64())], ["bucket", "user", "us", "row", "place", "allowed", "wait"])

    return run


def send_limited(rows: DataFrame, user: str, order: list[str], at: str, per_user: float, overall: float) -> DataFrame:
    """rows with ``allowed`` and ``retry_after`` (seconds, null for a send): sends are at least ``per_user`` seconds apart for a user and ``overall`` for all.

    What is refused sets no time. Rows of one time are in the order of ``order``; a row without a time is never sent, null users are one. Whether a row is sent depends on the
    sends before, of whatever user, so the fold is cut by time: a bucket of BUCKET intervals needs only the last sends of the bucket
    before. All buckets are folded at once; those whose sends before turn out otherwise are folded again, until none is. Sends soon fall into
    step whatever came before, so few rounds are needed; the k-th bucket is right after k rounds at the latest.
    """
    reach = round(max(per_user, overall) * 1_000_000)
    if reach <= 0:
        return rows.withColumns({"allowed": F.col(at).isNotNull(), "retry_after": F.lit(None).cast("double")})
    width = reach * BUCKET
    us = F.unix_micros(F.col(at).cast("timestamp"))
    packed = checkpointed(rows.select(F.floor(us / width).alias("bucket"), F.lit(False).alias("told"), F.col(user).alias("user"), us.alias("us"), F.struct("*").alias("row"), F.struct(us.alias("t"), *order).alias("place")))
    timed = packed.where("us is not null")
    kinds = {f.name: f.dataType for f in packed.schema}
    shape = StructType([StructField(n, kinds[n]) for n in ("bucket", "user", "us", "row", "place")] + [StructField("allowed", BooleanType()), StructField("wait", LongType())])
    fold = _fold(round(per_user * 1_000_000), round(overall * 1_000_000))

    def folded(part: DataFrame, before: DataFrame | None) -> DataFrame:
        every = part if before is None else part.unionByName(before)
        dealt = every.repartition("bucket").sortWithinPartitions("bucket", F.col("told").desc(), "place")
        return dealt.select("bucket", "told", "user", "us", "row", "place").mapInArrow(fold, shape)

    def sends_before(done: DataFrame) -> DataFrame:
        late = done.where(F.col("allowed") & (F.col("us") + reach > (F.col("bucket") + 1) * width))
        return late.select((F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("told"), "user", "us", "row", "place")

    done = checkpointed(folded(timed, None))
    used = None
    while True:
        before = checkpointed(sends_before(done))
        marks = checkpointed(before.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("user", "us").cast("decimal(20,0)")).alias("mark")))
        new = marks if used is None else marks.join(used.withColumnsRenamed({"n": "_n", "mark": "_mark"}), "bucket", "full_outer").where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("mark").eqNullSafe(F.col("_mark"))))
        again = checkpointed(new.select("bucket").join(timed.select("bucket").distinct(), "bucket", "left_semi"))
        if again.isEmpty():
            break
        redone = folded(timed.join(again, "bucket", "left_semi"), before.join(again, "bucket", "left_semi"))
        done, used = checkpointed(done.join(again, "bucket", "left_anti").unionByName(redone)), marks
    told = done.select("row.*", "allowed", F.when(~F.col("allowed"), F.col("wait") / 1_000_000).alias("retry_after"))
    never = packed.where("us is null").select("row.*", F.lit(False).alias("allowed"), F.lit(None).cast("double").alias("retry_after"))
    return told.unionByName(never)
