"""Send intervals against a plain fold."""

import datetime as dt
import random

import pytest

from listingloom.operators import sending

AT = dt.datetime(2026, 8, 1)
SHAPE = "i bigint, u bigint, at timestamp, allowed_before string"


def folded(rows, per_user, overall):
    last, users, out = None, {}, {}
    for i, u, at, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        waits = [(last + dt.timedelta(seconds=overall) - at).total_seconds() if last else 0, (users[u] + dt.timedelta(seconds=per_user) - at).total_seconds() if u in users else 0]
        out[i] = (max(waits) <= 0, max(waits) if max(waits) > 0 else None)
        if out[i][0]:
            last = users[u] = at
    return out


@pytest.mark.parametrize("per_user,overall,bucket", [(60, 7, 64), (60, 7, 1), (0, 30, 2), (45, 0, 3)])
def test_sends_equal_a_fold(spark, monkeypatch, per_user, overall, bucket):
    """Also with buckets of one interval, where sends before matter most."""
    monkeypatch.setattr(sending, "BUCKET", bucket)
    rng = random.Random(bucket)
    rows = [(i, rng.choice([None, 1, 2, 3, rng.randrange(50)]), None if rng.random() < 0.01 else AT + dt.timedelta(seconds=rng.choice([rng.randrange(3000), 10 * rng.randrange(200)])), "x") for i in range(900)]
    told = sending.send_limited(spark.createDataFrame(rows, SHAPE), "u", ["i"], "at", per_user, overall)
    got = {r["i"]: (r["allowed"], r["retry_after"]) for r in told.where("at is not null").collect()}
    assert got == folded(rows, per_user, overall)
    assert told.where("at is null and allowed").count() == 0 and told.count() == 900


def test_no_intervals_and_no_rows(spark):
    none = spark.createDataFrame([], SHAPE)
    assert sending.send_limited(none, "u", ["i"], "at", 5, 5).count() == 0
    assert sending.send_limited(spark.createDataFrame([(1, 1, AT, "x"), (2, 1, AT, "x")], SHAPE), "u", ["i"], "at", 0, 0).where("allowed").count() == 2
