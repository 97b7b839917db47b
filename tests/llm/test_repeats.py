"""Repeated rows: near copies whose rows stand there twice or more, and samples that stay bounded."""

import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from listingloom.llm import html, near, shards


def pairs_of_copies(n=6, words=80):
    rng = random.Random(12)
    out = []
    for k in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        edited = list(base)
        edited[40] = "edited"
        out += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
    return out


@pytest.mark.parametrize("times", [(1, 1), (2, 2), (1, 3), (4, 1)])
def test_near_groups_of_repeated_rows(spark, times):
    """Each pair is found however often its members stand there; all rows of what goes go."""
    rows = [r for k, r in enumerate(pairs_of_copies()) for _ in range(times[k % 2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in near.near_groups(docs).collect()}
    assert got == {(i, i - i % 2) for i in range(12)}
    left = sorted(r["doc_id"] for r in near.drop_near_copies(docs).collect())
    assert left == sorted(i for i, _ in rows if i % 2 == 0)


def test_a_row_repeated_many_times_does_not_reach_the_driver(spark):
    """The sample of op7 is drawn row by row, so a null text with a null id that stands there 10^5 times gives its share only."""
    docs = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    seen = []
    choose = shards._choose_splitters
    with pytest.MonkeyPatch.context() as m:
        m.setattr(shards, "_choose_splitters", lambda rows, *a: seen.append(len(rows)) or choose(rows, *a))
        placed = shards.shard_by_bytes(docs)
    assert placed.agg(F.count_distinct("shard")).first()[0] == shards.SHARDS
    assert max(seen) <= 4 * shards.SHARDS * shards.RANGES_PER_SHARD * shards.SAMPLE_PER_RANGE


def test_names_of_other_parts_with_words_beside_them():
    for name in ("reader-comments", "user-comments", "comments-thread", "gdpr-notice", "ad-300x250", "sidebar_left"):
        assert html._is_away(name), name
        assert html.page_lines(f'<article><p>kept</p><div class="{name}"><p>gone</p></div></article>')[1][0] == html.OTHER
    for name in ("social-science", "noticeboard", "commentary", "adventure"):
        assert not html._is_away(name), name


def layout(rows, n):
    """Law ``bytes`` by brute force: rows in order of their text's hash and id, cut at equal bytes; small groups of equal texts stay whole."""
    sized = [(i, t or "", len((t or "").encode()) + 8) for i, t in rows]
    order = sorted(sized, key=lambda r: (((h := xxhash.xxh64_intdigest(r[1].encode(), 42)) ^ 1 << 63), r[0] is not None, r[0] or 0))
    total, at, first, sizes = sum(s for _, _, s in sized), 0, {}, {}
    for _, t, s in order:
        first.setdefault(t, at)
        sizes[t], at = sizes.get(t, 0) + s, at + s
    out, at, ranks = [], 0, {}
    for rank, (i, t, s) in enumerate(order):
        begin = first[t] if sizes[t] <= int(total / n * shards.WHOLE_GROUP) else at
        shard = min(begin * n // total, n - 1)
        out.append((i, s, zlib.crc32(t.encode()), shard, rank - ranks.setdefault(shard, rank)))
        at += s
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [3, 24])
def test_layout_equals_brute_force(spark, n):
    """Many small groups, one large group that is cut, repeated rows, nulls and long texts."""
    rng = random.Random(n)
    rows = [(rng.choice([None, i, i % 50]), rng.choice([None, "", "x" * rng.randrange(300), f"text {i % 400}", "one text of a large group", "long " * 400 if i % 97 == 0 else "short"])) for i in range(3000)]
    placed = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), shards=n)
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in placed.collect()]
    assert sorted(got, key=str) == layout(rows, n)
