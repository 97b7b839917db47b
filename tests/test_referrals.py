"""Referral trees: labels and cycle checks against walks up the chain."""

import random

from pyspark.sql import functions as F

from listingloom.operators import referrals


def walk(up, user):
    """Users above ``user``, and whether the walk goes round in a circle."""
    seen = []
    while (user := up.get(user)) is not None:
        if user in seen:
            return seen, True
        seen.append(user)
    return seen, False


def test_labels_and_cycles_equal_walks(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, rng.randrange(i), rng.randrange(max(0, i - 3), i)]) if i else None) for i in range(150)]
    rows += [(200, 201), (201, 202), (202, 200), (203, 200), (204, 999), (205, 204)]  # a circle with one under it; a referrer without a row
    up = dict(rows)
    edges = spark.createDataFrame(rows, "user_id bigint, referrer_id bigint")
    known = referrals.labels(edges)
    got = {r["user_id"]: r for r in known.collect()}
    for u in [*up, 999]:
        above, circle = walk(up, u)
        if circle:
            assert got[u]["root"] is None and got[u]["enter"] is None
            continue
        assert (got[u]["root"], got[u]["depth"]) == (above[-1] if above else u, len(above))
        holders = {v for v, r in got.items() if r["root"] == got[u]["root"] and r["root"] is not None and r["enter"] <= got[u]["enter"] and got[u]["leave"] <= r["leave"]}
        assert holders == {u, *above}
    asked = [(a, b) for a in rng.sample(range(150), 30) + [200, 203, 205, 77777] for b in rng.sample(range(150), 30) + [200, 203, 204, 205, 999, 88888]]
    told = {(r["user_id"], r["referrer_id"]): r["cycle"] for r in referrals.makes_cycle(spark.createDataFrame(asked, "user_id bigint, referrer_id bigint"), known).collect()}
    assert told == {(a, b): a == b or walk(up, b)[1] or a in walk(up, b)[0] for a, b in asked}


def test_a_chain_of_a_hundred_thousand(spark):
    """Two rows a user at most, whatever the depth: no (user, ancestor) pairs."""
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("user_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("referrer_id"))
    known = referrals.labels(edges)
    assert known.count() == n and known.where("root = 0 and depth = user_id").count() == n
    asked = spark.createDataFrame([(5, n - 1), (n - 1, 5)], "user_id bigint, referrer_id bigint")
    assert {r["user_id"]: r["cycle"] for r in referrals.makes_cycle(asked, known).collect()} == {5: True, n - 1: False}


def test_no_users(spark):
    assert referrals.labels(spark.createDataFrame([], "user_id bigint, referrer_id bigint")).count() == 0
