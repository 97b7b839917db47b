"""The WARC source: round trips, revisits, pushed predicates, skipped payloads and broken files."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNull, Not, StringStartsWith

from listingloom.llm import warc

SHAPE = "page_id bigint, url string, html string, sha string, payload string, record_type string"


def odd_pages():
    rng = random.Random(2)
    texts = [None, "", "short", "short", "x" * 999, "y" * 1000, "ü" * 500, "\r\n\r\nWARC/1.1\r\n" * 80, "z" * 70_000] + ["".join(rng.choices("ab c", k=1500)) for _ in range(5)]
    rows = [(i, rng.choice([None, "http://h/a", "http://h/a b\r\nc<d>", "http://ü/漢"]), t, "a", "b", "c") for i, t in enumerate(texts * 3)]
    return rows + [(None, None, "y" * 1000, "a", "b", "c"), (99, "u", "w" * 1200, "a", "b", "c"), (99, "u", "w" * 1200, "a", "b", "c")]


def report(rows):
    keep, out = {}, []
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            keep[b] = max(keep.get(b, -1), -1 if p is None else p)
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        revisit = b in keep and keep[b] != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keep[b] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pages_come_back(spark, compression):
    rows = odd_pages()
    records = warc.page_records(spark.createDataFrame(rows, SHAPE))
    path = warc.write_archive(records, compression=compression, fileBytes="20000")
    read = warc.archive(spark, path, payloads="response")
    assert sorted(map(tuple, warc.page_report(read).collect()), key=str) == report(rows)
    payloads = {r["record_id"]: bytes(r["payload"]) for r in read.where("record_type = 'response'").collect()}
    assert payloads["<urn:page:99>"] == b"w" * 1200
    assert read.where("record_type = 'revisit' and payload is not null").count() == 0


def test_many_repeated_payloads_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 2)
    rows = odd_pages()
    path = warc.write_archive(warc.page_records(spark.createDataFrame(rows, SHAPE)))
    assert sorted(map(tuple, warc.page_report(warc.archive(spark, path)).collect()), key=str) == report(rows)


def test_an_empty_table_is_an_empty_archive(spark):
    path = warc.write_archive(warc.page_records(spark.createDataFrame([], SHAPE)))
    assert warc.page_report(warc.archive(spark, path)).count() == 0


def test_predicates_are_pushed_to_headers(spark):
    path = warc.write_archive(warc.page_records(spark.createDataFrame(odd_pages(), SHAPE)))
    read = warc.archive(spark, path)
    cases = {
        "record_type = 'warcinfo'": 0, "record_type in ('response', 'revisit') and target_uri like 'http://h/%'": 0, "target_uri is null and record_type <> 'warcinfo'": 0,
        "record_type = 'revisit' and payload_length > 1000": 1, "refers_to <=> '<urn:page:33>'": 0, "not target_uri like '%a'": 0,
    }
    whole = spark.createDataFrame(read.collect(), read.schema)
    for condition, left in cases.items():
        found = read.where(condition)
        assert sorted(r["record_id"] for r in found.collect()) == sorted(r["record_id"] for r in whole.where(condition).collect())
        assert ("Filter (" in found._jdf.queryExecution().executedPlan().toString()) == bool(left), condition


def test_unwanted_records_are_not_inflated(tmp_path, monkeypatch):
    """A broken payload behind a header that doesn't pass is never met: neither inflated nor decoded."""
    big = bytes(random.Random(1).randbytes(3 << 20))
    rows = [{"record_type": "resource", "record_id": "<a:1>", "payload": big}, {"record_type": "response", "record_id": "<a:2>", "payload": b"hello"}]
    writer = warc.WarcWriter({"path": str(tmp_path)})
    members = [warc.gzip_member(writer._record(r)) for r in rows]
    broken = bytearray(members[0])
    broken[2_000_000:2_000_100] = bytes(100)
    (tmp_path / "x.warc.gz").write_bytes(bytes(broken) + members[1])
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([EqualTo(("record_type",), "response")])) == []
    (part,) = reader.partitions()
    (batch,) = reader.read(part)
    assert batch.to_pylist()[0]["payload"] == b"hello" and batch.num_rows == 1
    whole = warc.WarcReader({"path": str(tmp_path)})
    with pytest.raises(warc.MalformedWarc):
        list(whole.read(part))


def test_foreign_files(spark, tmp_path):
    """Members without a length, one member for all records, folded headers, other types, and a file cut off."""
    record = warc.record_bytes([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m:1>"), ("WARC-Target-URI", "http://a"), ("X", "one\r\n two")], b"body")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record * 3))
    (tmp_path / "c.warc").write_bytes(record * 2)
    read = warc.archive(spark, str(tmp_path))
    assert [bytes(r["payload"]) for r in read.collect()] == [b"body"] * 7
    assert read.select(F.col("headers")["x"]).distinct().collect()[0][0] == "one two"
    assert warc.archive(spark, str(tmp_path), payloads="response").where("record_type = 'metadata' and payload is null").count() == 7
    (tmp_path / "d.warc").write_bytes(record + record[:-6])
    assert warc.archive(spark, str(tmp_path), mode="DROPMALFORMED").count() == 8
    with pytest.raises(Exception, match="cut off"):
        warc.archive(spark, str(tmp_path)).count()


def test_partitions_are_bundles_of_committed_files(tmp_path):
    for k in range(6):
        (tmp_path / f"part-{k}.warc").write_bytes(b"x" * 100)
    reader = warc.WarcReader({"path": str(tmp_path), "partitionBytes": "250"})
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 2]
    (tmp_path / "_committed-1").write_text("part-0.warc\npart-4.warc")
    assert [p.rpartition("/")[2] for f in reader.partitions() for p in f.paths] == ["part-0.warc", "part-4.warc"]


def test_predicates_follow_sql_on_nulls():
    values = dict.fromkeys(warc.HEADER_OF)
    assert warc.holds(EqualTo(("date",), "x"), values) is None and warc.holds(Not(EqualTo(("date",), "x")), values) is None
    assert warc.holds(IsNull(("date",)), values) and warc.holds(In(("date",), ("a",)), values) is None
    assert warc.holds(StringStartsWith(("date",), "20"), values | {"date": "2026"})


def test_plain_records_are_read_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)

    class Sized(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    record = warc.record_bytes([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m:1>")], b"0123456789" * 5)
    for data, source in ((record * 2, "f.warc"), (warc.gzip_member(record) * 2, "f.warc.gz")):
        for wanted in ("all", ""):
            reader = warc.WarcReader({"path": "f", "payloads": wanted})
            rows = list(reader._records(Sized(data), source))
            assert [r[-2] for r in rows] == [b"0123456789" * 5 if wanted else None] * 2
