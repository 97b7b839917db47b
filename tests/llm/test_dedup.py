"""SimHash groups, exact dedup, sharding and decontamination against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from listingloom.llm import common, decontaminate, exact, shards, simhash
from listingloom.llm.components import connected_components

ODD_TEXTS = [None, "", " \t\n", "one", "One two", "one  TWO", "a b c", "a b c d", "Ünï cödé 漢字 \x85 x", "a b c", "\x0b\x0ca b\rc "]


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(seed, groups=6, copies=6, words=120):
    rng = random.Random(seed)
    out = list(ODD_TEXTS)
    for _ in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(words)]
        for _ in range(copies):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                edited[rng.randrange(words)] = f"x{rng.randrange(99)}"
            out.append((" " if rng.random() < 0.7 else "\n").join(edited))
    return out


def test_simhash_groups_equal_brute_force(spark):
    texts = near_texts(1)
    docs = spark.createDataFrame([(100 - i, t, "s", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, fp string, component_id string")
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicate_groups(docs).collect()}
    prints = {100 - i: fingerprint(t) for i, t in enumerate(texts)}
    edges = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = roots(prints, edges)
    assert {k: v[0] for k, v in got.items()} == prints
    assert {k: v[1] for k, v in got.items()} == want
    assert len(set(want.values())) < len(want)
    assert docs.select("doc_id").join(simhash.near_duplicate_groups(docs.limit(0)), "doc_id").count() == 0


def test_hot_buckets_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rng = random.Random(2)
    values = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << k for k in rng.sample(range(20), rng.randint(0, 4))) for _ in range(120)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = simhash.fingerprint_links(df).collect()
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    assert roots(signed, [(r["u"], r["v"]) for r in found]) == want
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() >= 0 for r in found)


def test_counters_pass_any_radius():
    rng = random.Random(8)
    fps = np.array([[rng.getrandbits(64), rng.getrandbits(64)] for _ in range(40)], np.uint64)
    fps[20:] = fps[:20] ^ np.array([[(1 << rng.randrange(40)) - 1, 3] for _ in range(20)], np.uint64)
    for radius in (0, 1, 3, 7, 10, 24, 60):
        u, v = simhash.forest(np.zeros(40, np.int64), fps, np.arange(40), radius)
        apart = lambda a, b: int(np.bitwise_count(fps[a] ^ fps[b]).sum())
        want = roots(range(40), [(a, b) for a in range(40) for b in range(a) if apart(a, b) <= radius])
        assert roots(range(40), list(zip(u.tolist(), v.tolist()))) == want


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == roots({n for e in real for n in e}, real)
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [rng.choice(ODD_TEXTS + [f"t {rng.randrange(40)}"]) for _ in range(300)]
    rows = [(i, t, i, "k") for i, t in enumerate(texts)] + [(7, texts[7], 0, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, keep_id bigint, `odd name` string")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    got = exact.exact_groups(docs).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted((i, min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)])) for i, t, *_ in rows)
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({min(g) for g in groups.values()})
    assert exact.exact_groups(docs.limit(0)).count() == exact.drop_exact_copies(docs.limit(0)).count() == 0


def test_unrepeated_rows_are_not_shuffled(spark):
    """Few rows look repeated by chance, and of a large table no exchange but broadcasts carries rows that don't."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    flagged = exact.flag_repeats(exact._keyed(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))))
    assert flagged.where("_maybe").count() < 3000 * 0.08
    plan = flagged.where("not _maybe")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    groups = exact.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert groups.count("hashpartitioning") == groups.count("hashpartitioning(_sha")


@pytest.mark.parametrize("broadcast", [common.BROADCAST_ROWS, 3])
def test_of_repeated_rows_one_stays(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rows = [(1, "a b  c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a  b c"), (None, "only null"), (None, "only null"), (3, None), (4, " "), (5, "")]
    rows += [(k, "many copies") for k in range(10, 60)] + [(k, f"alone {k}") for k in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], normal(r["text"])) for r in exact.drop_exact_copies(docs).collect() if r["doc_id"] is not None)
    assert got == [(1, "a b c"), (3, ""), (4, " "), (10, "many copies"), *((k, f"alone {k}") for k in range(100, 140))]
    assert [r["text"] for r in exact.drop_exact_copies(docs).where("doc_id is null").collect()] == ["only null"]


def test_shards_are_even_and_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(shards, "RANGE_ROWS", 40)
    rng = random.Random(5)
    texts = ["same text" * 5] * 400 + [rng.choice(ODD_TEXTS) for _ in range(60)] + ["x" * rng.randrange(300) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = shards.shard_by_bytes(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    by_shard = defaultdict(list)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by_shard[r["shard"]].append(r)
    assert sorted(by_shard) == list(range(24))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    sizes = [sum(r["size"] for r in rs) for rs in by_shard.values()]
    assert max(sizes) - min(sizes) <= 2 * 320 + 0.01 * sum(sizes) / 24
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.shard_by_bytes(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    assert shards.shard_by_bytes(docs.limit(0)).count() == 0
    few = shards.shard_by_bytes(docs.limit(3)).collect()
    assert len(few) == 3


def test_a_hot_text_is_spread_over_pieces(spark, monkeypatch):
    """One short text as nine tenths of the rows, among it rows of equal and of null ids: pieces stay small, the group stays whole."""
    monkeypatch.setattr(shards, "RANGE_ROWS", 50)
    rng = random.Random(2)
    rows = [(i if i % 5 else None if i % 2 else 7, None if i % 3 else "") for i in range(1800)] + [(5000 + i, "y" * rng.randrange(3000, 4000)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    pieces = shards._pieces

    def spy(ranged, shape):
        out, cut = pieces(ranged, shape)
        seen.extend(r["count"] for r in out.groupBy("range", "piece").count().collect())
        return out, cut

    monkeypatch.setattr(shards, "_pieces", spy)
    got = shards.shard_by_bytes(docs).collect()
    assert max(seen) <= 4 * shards.RANGE_ROWS and sum(seen) == len(got) == 2000
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert len({r["shard"] for r in got if r["size"] == 8}) <= 2
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    sizes = [sum(r["size"] for r in rs) for rs in by_shard.values()]
    assert max(sizes) - min(sizes) <= 2 * 4008 + 1800 * 8


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id bigint, text string")
    shards.write_shards(docs, shards.shard_by_bytes(docs, shards=3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def contained(docs, items):
    def runs(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    return {(d, i) for d, t in docs for i, s in items if len(runs(s)) and 5 * len(runs(t) & runs(s)) >= 4 * len(runs(s))}


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(rng.randint(5, 40)))) for i in range(12)] + [(90, "too short here"), (91, None), (92, "five words are just enough"), (93, "a a a a a a a a a")]
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(500, "x FIVE\nwords\tare just enough y"), (501, "a " * 30)]
    for d in range(60):
        words = [f"z{rng.randrange(500)}" for _ in range(rng.randrange(200))]
        source = rng.choice(items)[1] or ""
        part = source.split()
        lost = rng.choice([0, 0, 1, 3, 9])
        words[rng.randrange(len(words) + 1) : 0] = part[: max(0, len(part) - lost)]
        docs.append((100 + d, " ".join(words)))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, items[0][1], 1)], "doc_id bigint, text string, n bigint")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(df, bench).collect()}
    assert found == contained(docs, items) and len(found) > 20
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in found} | {None}
    assert decontaminate.contained_items(df.limit(0), bench).count() == decontaminate.contained_items(df, bench.limit(0)).count() == 0


def test_a_shingle_of_every_item_makes_no_rows_of_all_pairs(spark):
    """Documents hold a run that all items have; only items whose sketch they meet and could contain are counted."""
    common_run = "one two three four five six"
    items = [(i, f"{common_run} " + " ".join(f"i{i}w{k}" for k in range(40))) for i in range(30)]
    docs = [(d, f"a b {common_run} c{d}") for d in range(50)] + [(99, items[4][1]), (98, items[5][1] + " " + items[6][1])]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(df, bench).collect()}
    assert found == contained(docs, items) == {(99, 4), (98, 5), (98, 6)}


@pytest.mark.parametrize("n", [1, 4, 5, 8, 15, 16, 31, 64, 100])
def test_sketch_is_long_enough(spark, n):
    """Any 80 % of an item's shingles meet its sketch."""
    bench = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(n + 4)))], "item_id bigint, text string")
    rows = decontaminate.item_shingles(bench).collect()
    assert len(rows) == n and sum(r["in_sketch"] for r in rows) >= min(n, n - -(-4 * n // 5) + 1)
