"""Adapters from a folder: discovery, isolation of broken ones, batches, and streams whose offsets survive a restart."""

import pytest

from listingloom.sources import adapters

GOOD = '''
import json, pathlib

class Feed:
    def __init__(self, settings):
        self.root = settings["root"]
        self.manifest = {"name": "feed", "version": "1", "schema": "channel string, n bigint, text string"}

    def partitions(self):
        return sorted(p.stem for p in pathlib.Path(self.root).glob("*.jsonl"))

    def latest(self, partition):
        return len(self.lines(partition))

    def lines(self, partition):
        return (pathlib.Path(self.root) / f"{partition}.jsonl").read_text().splitlines()

    def read(self, partition, start, end):
        for n, line in enumerate(self.lines(partition)[start:end], start):
            yield partition, n, json.loads(line)

def create_adapter(settings):
    return Feed(settings)
'''


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "plugins"
    out.mkdir()
    (tmp_path / "data").mkdir()
    (out / "feed.py").write_text(GOOD)
    (out / "broken.py").write_text("raise RuntimeError('no start')")
    (out / "nameless.py").write_text(GOOD.replace('"feed"', '"other"'))
    (out / "empty.py").write_text("x = 1")
    (out / "blank.py").write_text(GOOD.replace('"version": "1"', '"version": " "').replace('"feed"', '"blank"'))
    (out / "_helper.py").write_text("raise RuntimeError('never loaded')")
    return out


def say(tmp_path, channel, *lines):
    with (tmp_path / "data" / f"{channel}.jsonl").open("a") as f:
        f.writelines(f'"{x}"\n' for x in lines)


def test_broken_plugins_are_reported_and_the_others_load(spark, tmp_path, folder):
    registry = adapters.AdapterRegistry(str(folder), {"root": str(tmp_path / "data")})
    report = {x.name: x for x in registry.reload(spark)}
    assert {n: x.state for n, x in report.items()} == {"feed": "loaded", "broken": "failed", "nameless": "failed", "empty": "failed", "blank": "failed"}
    assert "no start" in report["broken"].error and "must be the file's" in report["nameless"].error and "create_adapter" in report["empty"].error and "no version" in report["blank"].error
    say(tmp_path, "a", "one", "two")
    say(tmp_path, "b", "three")
    assert sorted(map(tuple, spark.read.format("feed").load().collect())) == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three")]
    # A version that doesn't load leaves the one before in place.
    (folder / "feed.py").write_text("oops(")
    again = {x.name: x for x in registry.reload(spark)}
    assert again["feed"].state == "loaded" and again["feed"].error and again["feed"].file_hash == report["feed"].file_hash
    assert [x.name for x in registry.failures()] == ["feed"]
    assert spark.read.format("feed").load().count() == 3


def test_offsets_survive_a_restart(spark, tmp_path, folder):
    """Each row comes once, over three runs of the query; a channel that appears later begins at its first row."""
    registry = adapters.AdapterRegistry(str(folder), {"root": str(tmp_path / "data")})
    registry.reload(spark)
    for k in range(3):
        say(tmp_path, "a", f"a{k}", f"a{k}x")
        say(tmp_path, f"c{k}", f"c{k}")
        query = spark.readStream.format("feed").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r["channel"], r["n"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, "a0"), ("a", 1, "a0x"), ("a", 2, "a1"), ("a", 3, "a1x"), ("a", 4, "a2"), ("a", 5, "a2x"), ("c0", 0, "c0"), ("c1", 0, "c1"), ("c2", 0, "c2")]


def test_slices_are_bounded():
    found = adapters.slices({"a": 5}, {"a": 30, "b": 4, "c": 0}, 10)
    assert [(s.partition, s.start, s.end) for s in found] == [("a", 5, 15), ("a", 15, 25), ("a", 25, 30), ("b", 0, 4)]
