"""Albums by timers: merged once, kept over restarts, flushed at shutdown, held back while publishing fails."""

import datetime as dt
import time

import pyarrow.parquet as pq
import pytest

from listingloom.streaming import albums, jobs

AT = dt.datetime(2026, 8, 1, 9)
SHAPE = "channel string, album string, event_type string, at timestamp, message_id string, media_id string, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event(album, number, text="t", media="m", kind="created"):
    return ("c", album, kind, AT + dt.timedelta(seconds=number), str(number), media, text)


def started(spark, tmp_path, sink, seconds=0.8):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = albums.debounced_albums(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")), seconds)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()


def add(spark, tmp_path, *rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def held(out):
    return [r for ok in out.glob("batch=*/_SUCCESS") for f in ok.parent.glob("*.parquet") for r in pq.read_table(f).to_pylist() if not r["sent"]]


def wait(query, done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        assert query.exception() is None, query.exception()
        time.sleep(0.2)


def test_albums_go_out_once_and_held_ones_again(spark, tmp_path):
    """The publisher refuses until a file appears: nothing is lost, nothing is published twice, also over a restart."""
    open_, log = tmp_path / "open", tmp_path / "log"
    log.mkdir()

    def publish(row):
        if not open_.exists():
            raise OSError("refused")
        (log / f"{row['album']}-{time.time_ns()}").write_text("|".join(row["message_ids"]) + "/" + row["text"])

    (tmp_path / "in").mkdir()
    sink = albums.publish_or_hold(publish, str(tmp_path / "out"))
    add(spark, tmp_path, event("g", 10, " late "), event("g", 2, "first"), event("g", 2, "first", "n"), event(None, 3), event("g", 4, kind="edited"))
    query = started(spark, tmp_path, sink)
    wait(query, lambda: held(tmp_path / "out"))
    query.stop()
    assert list(log.iterdir()) == []
    open_.write_text("")
    query = started(spark, tmp_path, sink)
    add(spark, tmp_path, event("h", 7, None))
    wait(query, lambda: len(list(log.iterdir())) >= 2)
    time.sleep(1.5)
    query.stop()
    assert sorted((p.name[0], p.read_text()) for p in log.iterdir()) == [("g", "2|2|10/first\n\nlate"), ("h", "7/")]


def test_a_repeated_batch_is_not_published_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    sink = albums.publish_or_hold(lambda row: (log / str(time.time_ns())).write_text("x"), str(tmp_path / "out"))
    batch = spark.createDataFrame([(1,), (2,)], "id int").coalesce(1)
    for _ in range(2):
        sink(batch, 0)
    assert len(list(log.iterdir())) == 2


def test_waiting_albums_are_flushed_from_the_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [event("g", 10, " late "), event("g", 2, "first", None), event("g", 11, "late")]
    add(spark, tmp_path, *rows)
    seen = []
    query = started(spark, tmp_path, lambda b, n: seen.append(b.count()), seconds=3600)
    wait(query, lambda: any(p["numInputRows"] for p in query.recentProgress))
    query.stop()
    assert not any(seen)
    got = [tuple(r) for r in albums.waiting_albums(spark, str(tmp_path / "ck")).collect()]
    assert got == [("c", "g", AT + dt.timedelta(seconds=2), ["2", "10", "11"], ["m"], "first\n\nlate")]
    assert got == [tuple(albums.merged("c", "g", [(r[3], *r[4:]) for r in rows]))]
    batch = jobs.albums(spark.createDataFrame(rows, SHAPE), gap="10 seconds").collect()
    assert [tuple(r) for r in batch] == got


def test_debounce_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        albums.debounced_albums(spark.createDataFrame([], SHAPE), 0)
