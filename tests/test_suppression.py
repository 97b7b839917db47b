"""Suppressed alerts against a fold, with one key that has nearly all rows, and rests after refusals."""

import datetime as dt
import random

from listingloom.operators import suppression

AT = dt.datetime(2026, 8, 1)
SHAPE = "i bigint, severity string, reason string, at timestamp, retry_after int"


def folded(rows, seconds):
    out, state, blocked = {}, {}, dt.datetime.min
    for i, severity, reason, at, retry_after in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0])):
        if at < blocked:
            out[i] = ("blocked", None)
            continue
        last, held = state.get((severity, reason), (None, 0))
        if last is not None and (at - last).total_seconds() < seconds:
            state[severity, reason] = (last, held + 1)
            out[i] = ("suppressed", None)
            continue
        state[severity, reason] = (at, 0)
        out[i] = ("sent" if retry_after is None else "refused", held)
        if retry_after is not None:
            blocked = at + dt.timedelta(seconds=max(retry_after or 60, 1))
    return out


def some_alerts(seed, n, refusals):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = ("ERROR", "down") if rng.random() < 0.9 else (rng.choice([None, "INFO"]), rng.choice([None, "slow", "odd"]))
        at = None if rng.random() < 0.01 else AT + dt.timedelta(seconds=rng.choice([rng.randrange(3 * 86_400), rng.randrange(50) * 3_000]))
        rows.append((i, *key, at, rng.choice([None, 0, 400]) if rng.random() < refusals else None))
    return rows


def test_one_key_with_nine_tenths_of_the_rows(spark):
    rows = some_alerts(4, 3000, 0)
    told = suppression.suppressed(spark.createDataFrame(rows, SHAPE), ["severity", "reason"], ["i"], "at", seconds=300)
    got = {r["i"]: ("sent" if r["allowed"] else "suppressed", r["suppressed_before"]) for r in told.where("at is not null").collect()}
    assert got == folded(rows, 300)
    assert told.where("at is null and allowed").count() == 0 and told.count() == len(rows)


def test_a_hot_key_is_many_tasks(spark, monkeypatch):
    """The key's rows are dealt by bucket of time: no task has more than a bucket's."""
    monkeypatch.setattr(suppression, "BUCKET", 4)
    rows = [(i, "E", "x", AT + dt.timedelta(seconds=7 * i), None) for i in range(4000)]
    told = suppression.suppressed(spark.createDataFrame(rows, SHAPE), ["severity", "reason"], ["i"], "at", seconds=60)
    plan = told._jdf.queryExecution().toString()
    assert {r["i"] for r in told.where("allowed").collect()} == set(range(0, 4000, 9))
    assert {r["suppressed_before"] for r in told.where("allowed and i > 0").collect()} == {8}
    assert "bucket" in plan


def test_rests_block_all_keys(spark):
    rows = some_alerts(5, 400, 0.03)
    told = suppression.alerts(spark.createDataFrame(rows, SHAPE), ["severity", "reason"], ["i"], "at", "retry_after", seconds=300)
    got = {r["i"]: (r["outcome"], r["suppressed_before"]) for r in told.where("at is not null").collect()}
    assert got == folded(rows, 300)
    assert {"sent", "refused", "suppressed", "blocked"} == {o for o, _ in got.values()}


def test_no_alerts(spark):
    none = spark.createDataFrame([], SHAPE)
    assert suppression.suppressed(none, ["severity"], ["i"], "at").count() == 0
    assert suppression.alerts(none, ["severity"], ["i"], "at", "retry_after").count() == 0


def test_many_times_in_one_bucket(spark):
    """No window looks at all later times of a bucket again for each of its times."""
    start, n = dt.datetime(2024, 1, 1), 4000
    rows = spark.createDataFrame([("k", i, start + dt.timedelta(seconds=i * 3 + i % 2)) for i in range(n)], "k string, id int, at timestamp")
    due, want = start, set()
    for i in range(n):
        at = start + dt.timedelta(seconds=i * 3 + i % 2)
        if at >= due:
            want.add(i)
            due = at + dt.timedelta(seconds=300)
    plans, keep = [], suppression.checkpointed
    try:
        suppression.checkpointed = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)
        got = suppression.suppressed(rows, ["k"], ["id"], "at")
        assert {r["id"] for r in got.where("allowed").collect()} == want
    finally:
        suppression.checkpointed = keep
    assert plans and not any("UnboundedFollowing" in p.replace(" ", "").replace("unboundedfollowing", "UnboundedFollowing") for p in plans)
