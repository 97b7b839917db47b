"""Streaming jobs. Each works on a batch DataFrame too, where it gives the same rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from listingloom.sources import messages


def albums(events: DataFrame, gap: str = "1.5 seconds", watermark: str | None = None) -> DataFrame:
    """Events (channel, album, event_type, at, message_id, media_id, text) merged by session of one album.

    An event within ``gap`` of the last one extends its album. The result has the least time, message ids in
    numeric order, distinct media and distinct texts (first occurrence) joined by a blank line. Only created
    events with an album are merged; pass others around this job. An album is one output row.

    No late event is dropped: on a stream without ``watermark`` every album stays open (write in complete mode),
    and with one, albums end when it passes them and the state stays bounded, at the price of events later than it.
    """
    rows = events.where((F.col("event_type") == "created") & F.col("album").isNotNull())
    rows = rows.withWatermark("at", watermark) if watermark and events.isStreaming else rows
    number = F.coalesce(F.expr("try_cast(message_id as bigint)"), F.lit(0))
    item = F.struct(number.alias("n"), "message_id", "media_id", "text")
    merged = rows.groupBy("channel", "album", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("at"), F.array_sort(F.collect_list(item)).alias("items"))
    texts = F.array_distinct(F.filter(F.transform("items", lambda x: F.trim(x["text"])), lambda x: F.coalesce(x, F.lit("")) != ""))
    media = F.array_distinct(F.filter(F.transform("items", lambda x: x["media_id"]), lambda x: x.isNotNull()))
    return merged.select("channel", "album", "at", F.transform("items", lambda x: x["message_id"]).alias("message_ids"), media.alias("media"), F.array_join(texts, "\n\n").alias("text"))


def publish_once(events: DataFrame, key: str = "idempotency_key", at: str = "at", watermark: str = "10 minutes") -> DataFrame:
    """One event a key: within the watermark on a stream, for ever on a batch."""
    if events.isStreaming:
        return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])
    first = events.groupBy(key).agg(F.min_by(F.struct(*events.columns), at).alias("e"))
    return first.select("e.*")


def against_history(events: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """events with ``seen``: whether a static history has the key (a stream-static join)."""
    known = history.select(key).distinct().withColumn("seen", F.lit(True))
    return events.join(known, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def routed(payloads: DataFrame, most: int = 3) -> DataFrame:
    """Decoded payloads with ``route``: dead_letter for malformed ones and after ``most`` attempts, else retry or work."""
    rows = messages.decode(payloads)
    return rows.withColumn("route", F.when(F.col("malformed") | (F.col("attempts") >= most), "dead_letter").when(F.col("attempts") > 0, "retry").otherwise("work"))


def write_routes(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink: one folder a route under ``path``; a repeated batch overwrites its own folder."""
    batch.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={batch_id}")


def replayed(dead: DataFrame) -> DataFrame:
    """Dead letters as new payloads with their attempts reset."""
    return dead.where("not malformed").select(F.to_json(F.struct("event_type", "source_id", "source_channel_id", "source_message_id", "text", F.lit(0).alias("attempts"))).alias("payload"))


def _folded(rows: DataFrame, key: str, order: list[str], at: str, new_state) -> DataFrame:
    """rows with ``allowed`` by a fold over each key's rows in order, streaming through sorted partitions.

    The state is one key's only; null keys are one key. Values pass through Arrow as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for b in batches:
            out = []
            for value, moment in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if current is None and value is not None or value != current:
                    current, step = value, new_state()
                out.append(step(moment))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(out, pa.bool_())], ["row", "allowed"])

    packed = rows.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.struct("*").alias("row"))
    dealt = packed.repartition("key").sortWithinPartitions("key", *(f"row.{o}" for o in order))
    told = dealt.mapInArrow(run, StructType([packed.schema["row"], StructField("allowed", BooleanType())]))
    return told.select("row.*", "allowed")


def rate_limited(rows: DataFrame, key: str, order: list[str], at: str, most: int = 20, seconds: float = 60) -> DataFrame:
    """rows with ``allowed``: at most ``most`` allowed rows of a key in any ``seconds``; refused ones don't count."""

    def new_state():
        recent: deque[int] = deque()

        def step(now: int) -> bool:
            while recent and recent[0] <= now - seconds * 1_000_000:
                recent.popleft()
            if len(recent) >= most:
                return False
            recent.append(now)
            return True

        return step

    return _folded(rows, key, order, at, new_state)


def bulk_failures(attempts: DataFrame, batch: str, least: int = 5) -> DataFrame:
    """Batches with at least ``least`` failed deliveries."""
    return attempts.where("result in ('error', 'rate_limited')").groupBy(batch).agg(F.count("*").alias("failures")).where(F.col("failures") >= least)
