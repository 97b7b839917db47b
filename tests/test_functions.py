"""Functions and operators against brute force: patterns, settings, redaction, folds, joins and assignments."""

import random
import re

import pytest
from pyspark.sql import functions as F

from listingloom.functions import similarity, text
from listingloom.operators import envelopes, joins, matching, referrals, reviews, settings, suppression, topology
from listingloom.operators.parsing import RECIPES, Recipe
from listingloom.sources import web
from listingloom.streaming import jobs


@pytest.mark.parametrize("pattern", ["((a+))+", "(a{1,})+", "(a+){2,}", "(?:(?:x*)y)*", "(a|b)*c+(?:d|e)+", r"(a)\1", "(?P<n>a)(?P=n)", "x(?=y)", "(?<!a)b", "a{20000}", "(?:a{1,20000})", "", "a" * 1001, "(?i:(b?)c)*"])
def test_unsafe_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        settings.check_pattern(pattern)
    with pytest.raises(ValueError):
        Recipe("own", include=(pattern,))


@pytest.mark.parametrize("pattern", [r"\b(?:xona(?:li)?|room(?:s)?)\b", r"(?m)(?=^\s*#?\d{1,3}[.)]\s+)", "[(a+)+]*", r"\(a+\)+", "(?:abc)+", r"(?:\d[\s()-]*){9,12}", "(?i)a+b*", "[]a+]+", r"[^\]+]*x"])
def test_safe_patterns_pass(pattern):
    settings.check_pattern(pattern)


def test_settings_limits_and_merging():
    assert settings.checked_settings({"a": [1, 2.5, None, {"b": True}]}) == {"a": [1, 2.5, None, {"b": True}]}
    deep = 1
    for _ in range(9):
        deep = {"x": deep}
    for bad in ([], {"a": float("nan")}, {"a": float("inf")}, {1: 2}, {"a": {3}}, deep, {"a": "x" * 33_000}):
        with pytest.raises(ValueError):
            settings.checked_settings(bad)
    inline = {"strip_patterns": ["x"], "split_patterns": ["y"], "cleanup": {"trim": True}, "parser_mode": "shadow", "other": 1, "include_any": []}
    assert settings.sectioned(inline) == {"other": 1, "cleanup": {"trim": True, "strip_patterns": ["x"]}, "split": {"patterns": ["y"]}, "filters": {"include_any": []}}
    assert settings.merged({"a": {"b": 1, "c": {"d": 2}}, "e": [1]}, {"a": {"c": {"f": 3}}, "e": [2]}) == {"a": {"b": 1, "c": {"d": 2, "f": 3}}, "e": [2]}


def test_configuration_is_read_anew_for_every_batch(spark):
    states = [[(1, "a"), (2, "b")], [(2, "b"), (1, "a")], [(1, "a"), (2, "c")]]
    seen = []
    read = lambda: spark.createDataFrame(states[len(seen)], "k int, v string")
    run = settings.refreshed(read, ["k", "v"], lambda batch, config, n, changed: seen.append((n, config.count(), changed)))
    for n in range(3):
        run(spark.range(1), n)
    assert seen == [(0, 2, True), (1, 2, False), (2, 2, True)]


def test_redacted_and_channel_text(spark):
    rng = random.Random(1)
    parts = ["123456789:" + "A" * 25, "12345678:" + "b" * 25, "sk_" + "x" * 16, "sk_short", "+998 90 123 45 67", "901234567", "12345", "plain", "\n", "  ", "é", "|"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(200)] + [(900, None), (901, "")]
    got = {r["i"]: (r["r"], r["c"]) for r in spark.createDataFrame(rows, "i int, t string").select("i", text.redacted(F.col("t")).alias("r"), text.channel_text(F.col("t"), 40).alias("c")).collect()}
    for i, t in rows:
        want = t
        if t is not None:
            for pattern in text.TOKENS:
                want = re.sub(pattern, "[REDACTED]", want)
        assert got[i][0] == want
        lines = None if t is None else "\n".join(x.rstrip() for x in t.split("\n"))
        assert (got[i][1] or "") == (lines or "").strip()[:40].strip() or len(got[i][1]) <= 40


def brute_fold(rows, step):
    out, states = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        out[i] = step(states.setdefault(key, []), at)
    return out


def test_folds_treat_null_keys_as_one_and_keep_large_ids(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 7, 2**60 + 1, 2**60 + 2]), rng.randrange(4000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "key bigint, s bigint, i bigint").select("key", "i", F.timestamp_seconds("s").alias("at"))

    def passes(state, at):
        if state and at - state[0] < 300:
            return False
        state[:] = [at]
        return True

    def limited(state, at):
        state[:] = [x for x in state if x > at - 600]
        if len(state) >= 3:
            return False
        state.append(at)
        return True

    for got, step in ((suppression.suppressed(df, ["key"], ["at", "i"], "at"), passes), (jobs.rate_limited(df, "key", ["at", "i"], "at", most=3, seconds=600), limited)):
        found = got.collect()
        assert {r["i"]: r["allowed"] for r in found} == brute_fold(rows, step)
        assert sorted((str(r["key"]), r["i"]) for r in found) == sorted((str(k), i) for k, _, i in rows)


@pytest.mark.parametrize("table,start", [(reviews.REVIEW, "pending"), (reviews.SUGGESTION, "new")])
def test_actions_equal_a_state_machine(spark, table, start):
    rng = random.Random(3)
    names = sorted({a for _, a in table}) + ["odd"]
    rows = [(rng.choice([None, 1, 2, 2**60 + 1]), i, rng.choice(names), f"k{rng.randrange(60)}", rng.choice([None, start, "approved"])) for i in range(300)]
    got = reviews.applied_actions(spark.createDataFrame(rows, "entity bigint, seq int, action string, idempotency_key string, expected_status string"), table, start, "entity")
    state, seen, want = {}, {}, {}
    for e, i, action, key, expected in rows:
        now = state.get(e, start)
        if key in seen.setdefault(e, set()):
            result = "replayed"
        elif expected is not None and expected != now:
            result = "conflict"
        elif (now, action) not in table:
            result = "refused"
        else:
            result, state[e] = "applied", table[now, action]
            seen[e].add(key)
        want[i] = (e, result, state.get(e, start))
    assert {r["seq"]: (r["entity"], r["result"], r["status"]) for r in got.collect()} == want


def test_chains_of_any_length_are_followed(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 900)], "user_id bigint, referrer_id bigint")
    chains = referrals.ancestors(edges)
    assert chains.where("user_id = 0").agg(F.max("depth")).first()[0] == 300
    # The walk up from 900 comes back to it, so nobody may be referred by it.
    asked = spark.createDataFrame([(300, 0), (5, 900), (901, 7)], "user_id bigint, referrer_id bigint")
    assert {r["user_id"]: r["cycle"] for r in referrals.makes_cycle(asked, referrals.labels(edges)).collect()} == {300: True, 5: True, 901: False}
    with pytest.raises(RuntimeError):
        referrals.ancestors(edges, rounds=4)


def test_hash_join_equals_all_pairs(spark):
    rng = random.Random(4)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    for h in hashes[:40]:
        for _ in range(4):
            near = h
            for b in rng.sample(range(64), rng.randrange(12)):
                near ^= 1 << b
            hashes.append(near)
    rows = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hashes)] + [(999, None)], "id bigint, h string")
    want = {(i, j): (a ^ b).bit_count() for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 8}
    assert {(r["a"], r["b"]): r["distance"] for r in joins.hash_join(rows, "id", "h").collect()} == want
    assert [joins._blocks(n, 8) for n in (10, 10**5, 10**8)] == sorted(joins._blocks(n, 8) for n in (10, 10**5, 10**8)) and joins._blocks(10**8, 8) > 9
    for blocks in (9, 10, 11):
        keyed = {r["id"]: set(r["k"]) for r in rows.where("h is not null").select("id", similarity.block_keys(similarity.bits64(F.col("h")), blocks, 8).alias("k")).collect()}
        assert all(keyed[i] & keyed[j] for i, j in want)


def test_filters_match_as_all_pairs_do(spark):
    rng = random.Random(5)
    districts, listings, filters, users = ["North", "south", None], [], [], []
    for i in range(120):
        listings.append((i, rng.choice([*districts, "NORTH"]), rng.choice([1, 2, None]), rng.choice([None, 100, 200, 300]), rng.choice(["total", "per_person"]), rng.choice(["monthly", "one_time"]), "active", None, "USD"))
    for i in range(60):
        filters.append((i, i % 20, rng.choice(districts), rng.choice([1, 2, None]), rng.choice([None, 150, 250]), rng.random() < 0.8, rng.random() < 0.5))
    users = [(u, rng.choice(["active", "blocked"]), rng.random() < 0.8) for u in range(15)]
    a = spark.createDataFrame(listings, "announcement_id bigint, district string, rooms int, monthly int, price_basis string, price_period string, status string, parent_id bigint, currency string")
    f = spark.createDataFrame(filters, "filter_id bigint, user_id bigint, district string, rooms int, max_price int, enabled boolean, include_per_person boolean")
    u = spark.createDataFrame(users, "user_id bigint, status string, notifications_enabled boolean")
    want = set()
    rentable = {r["announcement_id"] for r in a.where(matching.user_facing() & matching.rentable()).collect()}
    for i, district, rooms, monthly, basis, *_ in listings:
        for k, user, fd, fr, most, on, person in filters:
            place = fd is None or (district is not None and fd.lower() == district.lower())
            if i in rentable and on and place and fr in (None, rooms) and (most is None or (monthly is not None and monthly <= most)) and (person or basis != "per_person"):
                known = {x[0]: x for x in users}.get(user)
                want.add((i, k, user, "no_user" if known is None else "matched" if known[1] == "active" and known[2] else "inactive_user"))
    got = matching.match_filters(a, f, u).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_least_loaded_assignment_equals_one_by_one(spark):
    rng = random.Random(6)
    accounts = [("x", f"a{i}", rng.randrange(9)) for i in range(7)] + [("y", "b0", 3), ("empty", "c", 0)]
    sources = [(rng.choice(["x", "x", "y", "none"]), f"s{i:03d}") for i in range(200)]
    want, loads = {}, {(ad, k): n for ad, k, n in accounts}
    for adapter, source in sorted(sources):
        mine = [(n, k) for (ad, k), n in loads.items() if ad == adapter]
        if mine:
            _, key = min(mine)
            loads[adapter, key] += 1
            want[source] = key
    a = spark.createDataFrame(accounts, "adapter string, account_key string, load int")
    got = topology.assign_least_loaded(spark.createDataFrame(sources, "adapter string, source_id string").repartition(5), a)
    assert {r["source_id"]: r["account_key"] for r in got.collect()} == want


def test_replay_cases_are_read_from_a_file(spark, tmp_path):
    (tmp_path / "cases.json").write_text('{"version": "1",\n "cases": [{"case_id": "a", "event": {"text": "x"}, "expected": ["x"]}, {"case_id": "b", "event": {"text": null}, "expected": []}]}')
    got = web.replay_cases(spark, str(tmp_path / "cases.json")).collect()
    assert [(r["case_id"], r["event"]["text"], r["expected"]) for r in got] == [("a", "x", ["x"]), ("b", None, [])]


def test_name_based_ids_and_normalised_text(spark):
    import uuid

    keys = ["", "a", "post:created:1", "é漢"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(envelopes.name_based_id(F.col("k"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys]
    rng = random.Random(7)
    for _ in range(300):
        t = "".join(rng.choice("aB _$+é漢#1.,-\n٣²½") for _ in range(20))
        folded = text._HASHTAG.sub(" ", text._PHONE.sub(text._phone, text.unicodedata.normalize("NFKC", t).casefold()))
        assert text.normalised_text(t) == " ".join("".join(x if x.isalnum() or x in "$+" else " " for x in folded).split())
    assert set(RECIPES)


def test_texts_are_python_objects_a_slice_at_a_time(spark, monkeypatch):
    """A batch of long texts is never held whole as Python objects: no slice is larger than SLICE; an empty batch gives no values."""
    import pyarrow as pa

    from listingloom.functions import text as texts
    from listingloom.sources import web

    held = []

    class Watched:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            held.append(len(part := self.values.slice(at, n)))
            return part

    values = pa.array([f"<title>T {k}</title><p>Ab&amp;  c {k}</p>" if k % 5 else None for k in range(1000)])
    assert texts.normalise_label.func(Watched(values)).to_pylist() == [x and " ".join(x.casefold().split()) for x in values.to_pylist()]
    assert texts.normalise_listing_text.func(Watched(values)).to_pylist() == [texts.normalised_text(x) for x in values.to_pylist()]
    pages = web.page_text.func(Watched(values)).to_pylist()
    assert pages[0] == {"title": None, "text": ""} and pages[999] == {"title": "T 999", "text": "T 999 Ab& c 999"}
    assert max(held) <= texts.SLICE < len(values) and len(texts.normalise_label.func(values[:0])) == 0
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values.to_pylist())], "k int, html string")
    got = df.select("k", web.page_text("html").alias("p"), texts.normalise_label("html").alias("n")).orderBy("k").collect()
    assert [r["p"].asDict() for r in got] == pages and got[0]["n"] is None
