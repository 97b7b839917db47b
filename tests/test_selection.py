"""Exact medians, the fuzzy join and price-bucketed matching against brute force."""

import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from listingloom.operators import fuzzy, joins, matching, selection


@pytest.mark.parametrize("ranked", [1, 40, 1 << 16])
def test_exact_medians(spark, monkeypatch, ranked):
    """Even and odd groups, ties, one value, nulls and a null group; with rounds over several bins."""
    monkeypatch.setattr(selection, "RANKED", ranked)
    rng = random.Random(1)
    rows = [(g, v) for g, n in (("a", 501), ("b", 500), ("c", 1), ("d", 2), (None, 7)) for v in (rng.choice([rng.uniform(-1e9, 1e9), float(rng.randrange(5))]) for _ in range(n))]
    rows += [("e", 3.0)] * 99 + [("f", None), ("g", None), ("g", 4.0), ("h", 0.0), ("h", 1e300)]
    got = {r["g"]: r["median"] for r in selection.exact_medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    values = {}
    for g, v in rows:
        values.setdefault(g, []).extend([] if v is None else [v])
    want = {g: statistics.median(v) if v else None for g, v in values.items()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_medians_sort_no_group(spark, monkeypatch):
    """One group of all rows: only the last bin's rows are ranked."""
    monkeypatch.setattr(selection, "RANKED", 100)
    seen = []
    write = selection.checkpointed
    monkeypatch.setattr(selection, "checkpointed", lambda df: seen.append(out := write(df)) or out)
    rows = spark.range(20_001).select(F.lit("x").alias("g"), (F.col("id") * 7 % 20_001).cast("double").alias("v"))
    assert selection.exact_medians(rows, "g", "v").collect()[0]["median"] == 10_000.0
    assert max(r["n"] for r in seen[-1].collect()) <= 100


@pytest.mark.parametrize("least", [0.81, 0.82, 0.95])
def test_fuzzy_matches_equal_all_pairs(spark, least):
    rng = random.Random(4)
    names = ["".join(rng.choices("abcde_", k=rng.randrange(1, 12))) for _ in range(120)] + ["a", "b", "studenty", "family"]
    texts = [None, "", "q"]
    for n in names * 2:
        x = list(n)
        for _ in range(rng.choice([0, 1, 1, 2])):
            x.insert(rng.randrange(len(x) + 1), rng.choice("abcz")) if rng.random() < 0.5 or len(x) < 2 else x.pop(rng.randrange(len(x)))
        texts.append("".join(x))
    want = {}
    for x in filter(None, texts):
        best = max(((difflib.SequenceMatcher(None, x, n).ratio(), -i, n) for i, n in enumerate(names)), default=None)
        if best[0] >= least:
            want[x] = (names[names.index(best[2])], best[0])
    table = spark.createDataFrame(list(enumerate(names)), "place int, name string")
    got = {r["text"]: (r["name"], r["ratio"]) for r in fuzzy.fuzzy_matches(spark.createDataFrame([(x,) for x in texts], "text string"), table, least).collect()}
    assert got == want and len(want) > 50


def test_fuzzy_refuses_ratios_without_a_bound(spark):
    with pytest.raises(ValueError, match="four fifths"):
        fuzzy.fuzzy_matches(None, None, 0.8)


def some_filters(spark, seed=6):
    rng = random.Random(seed)
    listings = [
        (i, rng.choice([None, 0.5, 90.0, rng.uniform(50, 5000)]), rng.choice(["total", "per_person"]), rng.choice(["A", "b", None]), rng.choice([1, 2, None]), "active", None, "monthly")
        for i in range(200)
    ]
    filters = [(i, i % 40, rng.choice([None, "a", "B"]), rng.choice([None, 1, 2]), rng.choice([None, 0.4, 90.0, rng.uniform(50, 5000)]), rng.random() < 0.9, rng.random() < 0.5) for i in range(100)]
    users = [(i, "active" if i % 3 else "blocked", bool(i % 5)) for i in range(35)]
    return listings, filters, users


def frames(spark, listings, filters, users):
    return (
        spark.createDataFrame(listings, "announcement_id int, monthly double, price_basis string, district string, rooms int, status string, parent_id int, price_period string"),
        spark.createDataFrame(filters, "filter_id int, user_id int, district string, rooms int, max_price double, enabled boolean, include_per_person boolean"),
        spark.createDataFrame(users, "user_id int, status string, notifications_enabled boolean"),
    )


def test_filters_meet_their_listings(spark):
    listings, filters, users = some_filters(spark)
    want = {
        (a, f) for a, monthly, basis, district, rooms, *_ in listings for f, _, d, r, most, enabled, person in filters
        if enabled and (d is None or (district or "").lower() == d.lower()) and (r is None or r == rooms) and (most is None or monthly is not None and monthly <= most) and (person or basis != "per_person")
    }
    got = {(r["announcement_id"], r["filter_id"]) for r in matching.match_filters(*frames(spark, listings, filters, users)).collect()}
    assert got == want and len(want) > 1000


def test_wildcard_filters_meet_only_buckets_that_can_match(spark):
    """Of the pairs that share a key, all but those in a filter's last bucket match by price."""
    listings, filters, users = frames(spark, *some_filters(spark))
    met = matching.listing_looks(listings).join(matching.filter_keys(filters), "key")
    wild = met.where(F.size(F.split("key", "\\|")) == 3)
    above = wild.where(F.coalesce(F.col("monthly") > F.col("max_price"), F.lit(False)))
    assert wild.count() > 500 and above.where(matching.price_bucket(F.col("monthly")) != matching.price_bucket(F.col("max_price"))).count() == 0
    assert above.count() < wild.count() / 5


@pytest.mark.parametrize("many", [False, True])
def test_counters_equal_those_of_the_matches_and_make_none(spark, monkeypatch, many):
    """With jobs there before, as rows and as an earlier run: the counts of every listing, limits and prices on a bucket's edge included."""
    rows = some_filters(spark, 9)
    rows[0].extend([(300, 90.0, "total", "A", 1, "active", 7, "monthly"), (301, 90.0, None, "A", 1, "active", None, "one_time"), (302, None, None, None, None, "active", None, "monthly")])
    if many:
        rows[1].extend((1000 + i, i % 40, None, None, 1.2 ** (i % 30), True, bool(i % 2)) for i in range(600))
        rows[0].extend((1000 + i, 1.2 ** (i % 30), "total", "A", 1, "active", None, "monthly") for i in range(300))
    listings, filters, users = frames(spark, *rows)
    earlier = F.col("announcement_id") % 3 == 0, F.col("filter_id") % 2 == 0
    matched = matching.match_filters(listings, filters, users).cache()
    jobs = matched.where(earlier[0] & earlier[1]).select("user_id", "announcement_id", "filter_id")
    status = {u: s for u, s, _ in rows[2]}
    want = {a: dict.fromkeys(matching.MATCH_COUNTERS, 0) for a, *_ in rows[0]}
    for a, *_, parent, _ in rows[0]:
        enabled = sum(f[5] for f in rows[1])
        want[a] |= {"skipped_non_canonical": 1} if parent else {"skipped_disabled_filters": len(rows[1]) - enabled, "skipped_no_match": enabled}
    for a, f, u, outcome in matched.collect():
        old = a % 3 == 0 and f % 2 == 0
        names = ["skipped_inactive_user"] if status.get(u) != "active" else ["skipped_notifications_disabled"] if outcome != "matched" else ["matched_filters", "duplicate_jobs" if old else "jobs_created"]
        want[a]["skipped_no_match"] -= 1
        for name in names:
            want[a][name] += 1
    monkeypatch.setattr(matching, "match_filters", None)
    strange = spark.createDataFrame([(1, 1, 999), (39, 0, 0)], "user_id int, announcement_id int, filter_id int")
    for how in ({"existing": jobs.union(jobs).union(strange)}, {"earlier": earlier}):
        got = {r["announcement_id"]: r.asDict() for r in matching.announcement_metrics(listings, filters, users, **how).collect()}
        assert got == {a: {"announcement_id": a} | v for a, v in want.items()}
    assert sum(v["duplicate_jobs"] for v in want.values()) > 100 and sum(v["skipped_inactive_user"] for v in want.values()) > 100


def test_new_jobs_and_matches_are_not_shuffled(spark):
    """Once a listing has met a filter, its row goes nowhere: the outermost join is the one that makes it."""
    listings, filters, users = frames(spark, *some_filters(spark))
    matched, done = matching.match_filters(listings, filters, users), F.col("announcement_id") % 5 == 0
    new = matching.jobs_after_run(listings, filters, users, done)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, matching.unique_jobs(matched, matched.where(done)).collect())) and new.count() > 100
    for df in (matched, new):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "key#" in next(line for line in plan.splitlines() if "Join " in line) and "Aggregate" not in plan.split("Join ", 1)[0]


@pytest.mark.parametrize("rows", [16, 100])
def test_crowded_buckets_of_hashes_are_cut(spark, monkeypatch, rows):
    """Hashes that share a long prefix, and some that hardly differ: cut by the bits that vary, then by cells; all pairs are found."""
    monkeypatch.setattr(joins, "BUCKET_ROWS", rows)
    rng = random.Random(3)
    values = list({0xABCDEF0123 << 24 | rng.getrandbits(24) for _ in range(400)} | {0xFF << 56 | 1 << rng.randrange(40) for _ in range(60)} | {rng.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id bigint, h string")
    want = {(a, b, d) for b in range(len(values)) for a in range(b) if (d := (values[a] ^ values[b]).bit_count()) <= 8}
    assert {tuple(r) for r in joins.hash_join(df, "id", "h").collect()} == want and len(want) > 3000


def test_a_crowded_bucket_meets_fewer_pairs(spark):
    """Of a hundred thousand hashes with forty bits in common, no bucket of the finer keys has a hundredth."""
    shape = F.lit(0x0ABCDEF012 << 24).bitwiseOR(F.pmod(F.xxhash64("id"), F.lit(1 << 24)))
    keyed = spark.range(100_000).select("id", shape.alias("h"), F.lit(1).cast("bigint").alias("key"))
    small, finer = joins._cut(keyed, 8)
    assert small.count() == 0
    assert finer.groupBy("key").count().agg(F.max("count")).first()[0] < 10_000
