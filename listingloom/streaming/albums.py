"""Albums by processing-time timers, their flush at shutdown, and a sink that holds rows back while publishing fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, StructField, StructType

ITEM = "at timestamp, message_id string, media_id string, text string"
ALBUM = "channel string, album string, at timestamp, message_ids array<string>, media array<string>, text string"


def message_number(message_id: str | None) -> int:
    return int(message_id) if message_id and message_id.lstrip("-").isdigit() else 0


def merged(channel: str, album: str, items: list) -> Row:
    """One album of its items (at, message_id, media_id, text), as ``jobs.albums`` merges them."""
    items = sorted(items, key=lambda x: (message_number(x[1]), x[1] is not None, x[1] or "", x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
    texts = [t for x in items if (t := (x[3] or "").strip(" "))]
    media = [x[2] for x in items if x[2] is not None]
    at = min((x[0] for x in items if x[0] is not None), default=None)
    return Row(channel=channel, album=album, at=at, message_ids=[x[1] for x in items], media=list(dict.fromkeys(media)), text="\n\n".join(dict.fromkeys(texts)))


class AlbumBuffer(StatefulProcessor):
    """One album's items until none has come for ``debounce_ms``; each item puts the timer off."""

    def __init__(self, debounce_ms: int):
        self.debounce_ms = debounce_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", ITEM)
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self.items.appendList([(r.at, r.message_id, r.media_id, r.text) for r in rows])
        if (old := self.due.get()) is not None:
            self.handle.deleteTimer(old[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.debounce_ms
        self.handle.registerTimer(due)
        self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield merged(*key, list(self.items.get()))
        self.items.clear()
        self.due.clear()

    def close(self) -> None:
        pass


def debounced_albums(events: DataFrame, seconds: float = 1.5) -> DataFrame:
    """A stream of albums (ALBUM) from a stream of events (channel, album, event_type, at, message_id, media_id, text).

    An album goes out when ``seconds`` of processing time have passed since its last item; one that comes later begins a new
    one. Only created events with an album are buffered; pass others around this job. Items wait in the state store on disk,
    so a restart goes on with them. An album is one key, its items are in memory once, when it goes out.
    """
    if seconds <= 0:
        raise ValueError("the debounce must be positive")
    rows = events.where((F.col("event_type") == "created") & F.col("album").isNotNull())
    buffer = AlbumBuffer(round(seconds * 1000))
    return rows.groupBy("channel", "album").transformWithState(statefulProcessor=buffer, outputStructType=ALBUM, outputMode="Append", timeMode="ProcessingTime")


def waiting_albums(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The albums that wait in the state of a stopped ``debounced_albums`` query: what is left to publish at shutdown.

    Publish them once and start the next query from a new checkpoint.
    """
    state = spark.read.format("statestore").option("stateVarName", "items").option("operatorId", operator).load(checkpoint)
    items = state.select("key.channel", "key.album", F.col("list_element").alias("x"))
    number = F.coalesce(F.expr("try_cast(x.message_id as bigint)"), F.lit(0))
    lists = items.groupBy("channel", "album").agg(F.min("x.at").alias("at"), F.array_sort(F.collect_list(F.struct(number.alias("n"), "x.message_id", "x.media_id", "x.text"))).alias("items"))
    texts = F.array_distinct(F.filter(F.transform("items", lambda x: F.trim(x["text"])), lambda x: F.coalesce(x, F.lit("")) != ""))
    media = F.array_distinct(F.filter(F.transform("items", lambda x: x["media_id"]), lambda x: x.isNotNull()))
    return lists.select("channel", "album", "at", F.transform("items", lambda x: x["message_id"]).alias("message_ids"), media.alias("media"), F.array_join(texts, "\n\n").alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def publish_or_hold(publish: Callable[[dict], None], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that calls ``publish`` for every row, in tasks, and holds back the rows for which it raises.

    Held rows go first in the next batch, so they are tried until they go out. Each batch writes its published and held rows under
    ``path``, and a batch that was written is not published again when a restart repeats it. Only a task that is lost between publishing and
    writing repeats rows: ``publish`` should be idempotent by a key of the row.
    """

    def told(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sent = []
                for row in b.to_pylist():
                    try:
                        publish(row)
                        sent.append(True)
                    except Exception:
                        sent.append(False)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent, pa.bool_())], [*b.schema.names, "sent"])

        return rows.mapInArrow(run, StructType([*rows.schema, StructField("sent", BooleanType())]))

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = f"{path}/batch={batch_id}"
        if _exists(spark, f"{out}/_SUCCESS"):
            batch.write.format("noop").mode("overwrite").save()  # the state behind it is to be written all the same
            return
        before = f"{path}/batch={batch_id - 1}"
        if _exists(spark, f"{before}/_SUCCESS"):
            held = spark.read.schema(StructType([*batch.schema, StructField("sent", BooleanType())])).parquet(before).where("not sent").drop("sent")
            batch = held.unionByName(batch)
        told(batch).write.mode("overwrite").parquet(out)

    return sink
