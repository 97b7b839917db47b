"""Streaming jobs give what their batch twins give."""

import datetime as dt

from pyspark.sql import functions as F

from listingloom.streaming import jobs

AT = dt.datetime(2026, 8, 1, 9)


def drained(spark, stream, tmp_path, name, **options):
    writer = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def source(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_album_sessions(spark, tmp_path):
    shape = "channel string, album string, event_type string, at timestamp, message_id string, media_id string, text string"

    def ms(n):
        return AT + dt.timedelta(milliseconds=n)

    rows = [
        ("c", "g", "created", ms(0), "10", "m1", "late number"), ("c", "g", "created", ms(900), "2", "m1", "first number"), ("c", "g", "created", ms(1800), "11", "m2", "late number"),
        ("c", "g", "created", ms(9000), "12", "m3", None), ("c", None, "created", ms(0), "5", "m", "x"), ("c", "g", "edited", ms(0), "6", "m", "x"),
        ("z", "z", "created", AT + dt.timedelta(hours=2), "1", None, "closes the watermark"),
    ]
    batch = spark.createDataFrame(rows, shape)
    want = {tuple(map(str, r)) for r in jobs.albums(batch).where("channel = 'c'").collect()}
    assert len(want) == 2
    first = jobs.albums(batch).where("channel = 'c'").orderBy("at").first()
    assert first["message_ids"] == ["2", "10", "11"] and first["media"] == ["m1", "m2"] and first["text"] == "first number\n\nlate number"
    got = drained(spark, jobs.albums(source(spark, batch, tmp_path), watermark="10 minutes"), tmp_path, "albums").where("channel = 'c'").collect()
    assert {tuple(map(str, r)) for r in got} == want
    late = jobs.albums(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    late.writeStream.format("memory").queryName("open_albums").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck-open")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(map(str, r)) for r in spark.table("open_albums").where("channel = 'c'").collect()} == want


def test_publish_once(spark, tmp_path):
    rows = [("k1", AT, 1), ("k1", AT, 2), ("k2", AT, 3)]
    batch = spark.createDataFrame(rows, "idempotency_key string, at timestamp, account int")
    assert jobs.publish_once(batch).count() == 2
    assert drained(spark, jobs.publish_once(source(spark, batch, tmp_path)), tmp_path, "once").select("idempotency_key").distinct().count() == 2


def test_routes_through_foreach_batch(spark, tmp_path):
    rows = [("{",), ('{"source_id":"s","source_message_id":"1","attempts":9}',), ('{"source_id":"s","source_message_id":"2","attempts":1}',), ('{"source_id":"s","source_message_id":"3"}',)]
    stream = jobs.routed(source(spark, spark.createDataFrame(rows, "payload string"), tmp_path))
    out = str(tmp_path / "out")
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, n: jobs.write_routes(b, n, out)).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["route"]: r["count"] for r in spark.read.parquet(out).groupBy("route").count().collect()}
    assert got == {"dead_letter": 2, "retry": 1, "work": 1}
    dead = jobs.routed(spark.createDataFrame(rows, "payload string")).where("route = 'dead_letter'")
    again = jobs.routed(jobs.replayed(dead)).select(F.col("route")).collect()
    assert [r["route"] for r in again] == ["work"]
