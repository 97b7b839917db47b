"""Golden examples and brute-force twins of operators that SQL can't check."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from listingloom.functions import text
from listingloom.operators import dedup, joins, lifecycle, matching, metrics, parsing, prededup, referrals, suppression, topology
from listingloom.operators.predicates import Criteria
from listingloom.operators.search import search
from listingloom.sources import messages, web
from listingloom.streaming import jobs

AT = dt.datetime(2026, 8, 1)
LISTING = (
    "announcement_id bigint, monthly decimal(14,2), price_period string, price_basis string, currency string, rooms int, area decimal(10,2), floor int, district string, "
    "address string, description string, phone string, status string, parent_id bigint, created_at timestamp_ntz, source_url string, tag string, excluded_tag string, renovation string, trust int"
)


def listing(i, **over):
    base = dict(
        announcement_id=i, monthly=Decimal(500), price_period="monthly", price_basis="total", currency="USD", rooms=2, area=Decimal(50), floor=3, district="Centre",
        address=f"Street {i * 7919}", description=f"text {i * 104729}", phone=f"+{i}", status="active", parent_id=None, created_at=AT + dt.timedelta(seconds=i),
        source_url=None, tag="family", excluded_tag=None, renovation="good", trust=0,
    )
    return tuple((base | over)[f.split()[0]] for f in LISTING.replace("decimal(14,2)", "d").replace("decimal(10,2)", "d").split(", "))


def ids(df):
    return [r["announcement_id"] for r in df.collect()]


def test_search_orders_and_excludes(spark):
    rows = spark.createDataFrame(
        [
            listing(1), listing(2, monthly=Decimal(600), price_period="daily"), listing(3, monthly=None, price_period="one_time"),
            listing(4, monthly=Decimal(150), price_basis="per_person"), listing(5, monthly=None), listing(6, parent_id=1),
        ],
        LISTING,
    )
    assert ids(search(rows, Criteria(max_price=650, sort="cheapest"))) == [1, 2]
    assert ids(search(rows, Criteria(max_price=650, sort="cheapest", include_per_person=True))) == [4, 1, 2]
    page = search(rows, Criteria(limit=1, offset=1)).collect()
    assert [(r["announcement_id"], r["total"]) for r in page] == [(2, 3)]
    assert ids(search(rows, Criteria(tag="FAMILY", max_price=500))) == [1]
    with pytest.raises(ValueError):
        Criteria(min_price=2, max_price=1).checked()


def decisions(spark, a, b, media=()):
    rows = spark.createDataFrame([a, b], LISTING)
    m = spark.createDataFrame(list(media), "announcement_id bigint, media_id int, phash string") if media else None
    return {r["incoming"]: r for r in dedup.evaluate(rows, m).collect()}[2]


def test_weighted_decisions(spark):
    far = dict(district="North", rooms=4, area=Decimal(90), monthly=Decimal(900), floor=9)
    only_phone = decisions(spark, listing(1, phone="+1"), listing(2, phone="+1", **far))
    assert (only_phone["score"], only_phone["decision"], only_phone["matched"]) == (15, "new", "phone")
    hashes = [(1, 1, "0000000000000000"), (2, 1, "0000000000000001")]
    image = decisions(spark, listing(1, phone="+1", rooms=1, area=Decimal(1), floor=1, monthly=Decimal(9)), listing(2, phone="+1"), hashes)
    assert image["score"] >= 80 and image["decision"] == "high_confidence_duplicate"
    alone = decisions(spark, listing(1, phone="+1", source_url=None), listing(2, phone="+1", **far), hashes)
    assert alone["decision"] in ("possible_duplicate", "high_confidence_duplicate") and "same_image" in alone["matched"]
    url = decisions(spark, listing(1, source_url="u"), listing(2, source_url="u", **far))
    assert url["decision"] == "exact_duplicate"
    identity = decisions(spark, listing(1, phone="+1"), listing(2, phone="+1"))
    assert identity["decision"] == "high_confidence_duplicate"
    per_person = decisions(spark, listing(1, phone="+1", price_basis="per_person"), listing(2, phone="+1"))
    assert "price" not in per_person["matched"]


def test_candidates_are_newest_earlier_within_lookback(spark):
    rows = [listing(i, phone="+1", created_at=AT + dt.timedelta(days=2 * i)) for i in range(80)]
    df = spark.createDataFrame(rows, LISTING)
    got = {}
    for r in dedup.candidate_pairs(df, {"phone": F.col("phone")}).collect():
        got.setdefault(r["incoming"], set()).add(r["candidate"])
    for i in range(1, 80):
        assert got[i] == set(range(max(0, i - 45), i))
    few = dedup.candidate_pairs(df, {"phone": F.col("phone")}, dedup.Scoring(candidates=5))
    assert {r["candidate"] for r in few.where("incoming = 79").collect()} == {74, 75, 76, 77, 78}


def test_candidates_meet_by_every_key(spark):
    """Same image but another phone, url, district and rooms; close area only; close price only; nothing at all."""
    away = dict(area=Decimal(500), monthly=Decimal(9000), price_period="daily")
    rows = [
        listing(1, district="North", rooms=7, area=Decimal(90), monthly=Decimal(5000)), listing(2, district="South", rooms=8, **away),
        listing(3, district="East", rooms=9, area=Decimal(93), monthly=Decimal(1)), listing(4, district="West", rooms=1, area=Decimal(1), monthly=Decimal(5250)),
        listing(5, district="Centre", rooms=3, area=Decimal("93.01"), monthly=Decimal("5250.01"), currency="UZS"),
    ]
    media = spark.createDataFrame([(1, 1, "00000000000000ff"), (2, 1, "00000000000000ff")], "announcement_id bigint, media_id int, phash string")
    df = spark.createDataFrame(rows, LISTING)
    got = {(r["incoming"], r["candidate"]) for r in dedup.all_candidates(dedup.prepared(df, media)).collect()}
    assert got == {(2, 1), (3, 1), (4, 1), (5, 3)}
    told = {r["incoming"]: r for r in dedup.evaluate(df, media).collect()}
    assert told[2]["decision"] == "possible_duplicate" and told[2]["matched"] == "same_image,floor"


def test_range_candidates_are_cut_after_the_ranges(spark):
    """Sixty rows of one area among others: the newest fifty of close area, also where equal keys fill the number."""
    for few in (False, True):
        rows = [listing(i, district=f"d{i % 3 if few else i}", rooms=i, monthly=None, area=Decimal(50 if i % 2 else 200), created_at=AT + dt.timedelta(hours=i)) for i in range(180)]
        df = dedup.prepared(spark.createDataFrame(rows, LISTING))
        got = {}
        for r in dedup.all_candidates(df).collect():
            got.setdefault(r["incoming"], set()).add(r["candidate"])
        for i in range(1, 180):
            assert got.get(i, set()) == set([j for j in range(i) if (j - i) % 2 == 0 or (few and (j - i) % 3 == 0)][-50:])


def test_merge_keeps_parent_and_lists_conflicts(spark):
    rows = spark.createDataFrame([((1, 500, None), (2, 650, "Main st"))], "parent struct<announcement_id:int,price:int,address:string>, child struct<announcement_id:int,price:int,address:string>")
    got = dedup.merge_parent(rows, ["price", "address"]).first()
    assert (got["price"], got["address"]) == (500, "Main st")
    assert [tuple(c) for c in got["conflicts"]] == [("price", "500", "650")]


def test_group_roots_follows_chains(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "child int, parent int")
    assert {r["root"] for r in dedup.group_roots(links).collect()} == {0}
    with pytest.raises(RuntimeError):
        dedup.group_roots(spark.createDataFrame([(1, 2), (2, 1)], "child int, parent int"), rounds=3)


def test_token_join_equals_brute_force(spark):
    sets = {i: sorted({(i * k * 7 + k) % 23 for k in range(1, 4 + i % 9)} | {(i // 3) % 5, 100 + (i // 3)}) for i in range(60)}
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id int, t array<string>")
    for least in (0.5, 0.88):
        want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= least}
        assert {(r["a"], r["b"]) for r in joins.token_join(df, "id", "t", least).collect()} == want


def test_sets_of_common_tokens_that_are_not_alike_part_where_they_meet(spark, monkeypatch):
    """Every token is frequent, so nearly all sets meet; few pairs but those alike are left to be verified, and none of these is lost."""
    import random

    rng = random.Random(7)
    sets = [frozenset(rng.sample(range(80), rng.randrange(40, 60))) for _ in range(300)]
    sets = list({s: 0 for s in [*sets, *(s - {min(s)} | {100 + i} for i, s in enumerate(sets[:40]))]})
    met, keep = [], joins.checkpointed
    monkeypatch.setattr(joins, "checkpointed", lambda df: met.append(keep(df)) or met[-1])
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id bigint, t array<string>")
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.88 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in joins.token_join(df, "id", "t", 0.88).collect()} == want and len(want) >= 40
    assert met[0].count() < 5 * len(want) < len(sets) ** 2 / 100


def test_large_sets_that_share_one_rare_token_part_where_they_meet(spark, monkeypatch):
    """Large unlike sets that share a rare token part where they meet, whatever widths their sketches have; alike ones of two widths don't."""
    import random

    rng = random.Random(3)
    sets = [frozenset(rng.sample(range(6000), rng.randrange(1000, 1600))) | {-1} for _ in range(40)]
    sets += [s - set(rng.sample(sorted(s), len(s) // 20)) for s in sets[:15]] + [frozenset(range(10000, 10000 + n)) for n in (1000, 1024, 1025, 1100, 2047, 2049)]
    met, keep = [], joins.checkpointed
    monkeypatch.setattr(joins, "checkpointed", lambda df: met.append(keep(df)) or met[-1])
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id bigint, t array<string>")
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.88 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in joins.token_join(df, "id", "t", 0.88).collect()} == want and len(want) >= 20
    assert met[0].count() < 5 * len(want)


def test_a_crowd_of_alike_sets_is_verified_in_cells_and_no_pair_carries_a_set(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = [*(f"w{i}" for i in range(60)), "a\\nb", "a\nb", "a", "b", "", "\\0"]
    sets = [[w for w in base if rng.random() > 0.02] + [f"x{i}"] for i in range(120)]
    df = spark.createDataFrame(list(enumerate(sets)), "id bigint, t array<string>")
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a, b): v for b in range(120) for a in range(b) if (v := jaccard(sets[a], sets[b])) >= 0.88}
    sent, among = [], joins.among
    for most in (2048, 16):
        monkeypatch.setattr(joins, "CELL_SETS", most)
        monkeypatch.setattr(joins, "among", lambda rows, keys, *a: sent.append(keys) or among(rows, keys, *a))
        got = joins.token_join(df, "id", "t", 0.88)
        assert {(r["a"], r["b"]): r["similarity"] for r in got.collect()} == want and len(want) > 2000
        # Sets sent for verification: each to the cells it has pairs in, far fewer than the pairs.
        assert sent[-1].selectExpr("sum(size(at))").first()[0] < len(want) / 2


def test_keys_of_hashes_are_not_written_where_no_bucket_is_crowded(spark, monkeypatch):
    import random

    rng = random.Random(2)
    values = list({0xF0F0 << 48 | rng.getrandbits(20) << 8 for _ in range(200)})
    sizes, keep = [], joins.checkpointed
    monkeypatch.setattr(joins, "checkpointed", lambda df: sizes.append((kept := keep(df)).count()) or kept)
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id bigint, h string")
    want = {(a, b, d) for b in range(len(values)) for a in range(b) if (d := (values[a] ^ values[b]).bit_count()) <= 8}
    assert {tuple(r) for r in joins.hash_join(df, "id", "h").collect()} == want and len(want) > 1000
    assert max(sizes) <= len(values)


def test_hash_join_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 12))) for b in base for _ in range(12)]
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id int, h string")
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= 8}
    assert {(r["a"], r["b"]) for r in joins.hash_join(df, "id", "h").collect()} == want


def test_normalised_text_and_phones(spark):
    assert text.normalised_text("Ｆlat #hot 90 123-45-67 — OK!") == "flat +998901234567 ok"
    rows = [("call +998 (90) 123-45-67",), ("90 123 45 67 or 998901234567",), ("1234567890",), (None,), ("",)]
    got = spark.createDataFrame(rows, "t string").select(text.phone_numbers(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [["+998901234567"], ["+998901234567"], [], None, []]


def test_post_decisions(spark):
    rows = [
        (1, "Flat in Centre call +998901234567 now please", "a:1", None, "0000000000000000"), (2, "other words", "a:1", None, None),
        (3, "FLAT in centre #tag call +998 90 123-45-67 now please", None, None, None), (4, "nothing alike here at all", None, None, "0000000000000003"),
        (5, "just a phone 90 123 45 67", None, None, None), (6, "fresh text", None, None, "ffffffffffffffff"), (7, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "post_id bigint, text string, forward_key string, parent_ref bigint, phash string")
    got = {r["post_id"]: (r["decision"], r["reasons"], r["reference"]) for r in prededup.decide(df).collect()}
    assert got[2] == ("high_confidence_duplicate", "forward_origin", 1)
    assert got[3] == ("high_confidence_duplicate", "text_hash", 1)
    assert got[4] == ("needs_reviewable_signal", "phash", 1)
    assert got[5] == ("needs_reviewable_signal", "phone", 1)
    assert got[1][0] == got[6][0] == got[7][0] == "proceed_to_ai"


def test_forward_matches_skip_siblings(spark):
    rows = [(1, "", "k", 9, None), (2, "", "k", 9, None), (3, "", "k", 8, None), (4, "", "k", None, None), (5, "", "k", 9, None)]
    df = spark.createDataFrame(rows, "post_id bigint, text string, forward_key string, parent_ref bigint, phash string")
    assert {tuple(r) for r in prededup.forward_matches(df).collect()} == {(3, 1), (4, 1), (5, 3)}


def test_post_decisions_keep_no_signals_but_as_parquet(spark, monkeypatch):
    """The signals hold every text's tokens: they are written as Parquet, not as rows of a checkpoint."""
    kept, keep = [], prededup.checkpointed
    monkeypatch.setattr(prededup, "checkpointed", lambda df: kept.append(df.columns) or keep(df))
    posts = spark.createDataFrame([(1, "one two three", None, None, None), (2, "one two three", None, None, None)], "post_id bigint, text string, forward_key string, parent_ref bigint, phash string")
    got = {r["post_id"]: (r["decision"], r["reference"]) for r in prededup.decide(posts).collect()}
    assert got == {1: ("proceed_to_ai", None), 2: ("high_confidence_duplicate", 1)} and not any("tokens" in c for c in kept)


def test_near_text_picks_best_earlier(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(1, words), (2, words[:29] + ["x"]), (3, words), (4, words[:28]), (5, ["q"]), (6, [])]
    df = spark.createDataFrame(rows, "post_id bigint, tokens array<string>")
    got = {r["post_id"]: (r["near_ref"], round(r["similarity"], 3)) for r in prededup.near_text_matches(df).collect()}
    assert got == {2: (1, round(29 / 31, 3)), 3: (1, 1.0), 4: (1, round(28 / 30, 3))}


def parsed(spark, recipe, *posts):
    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(posts)], "post_id int, text string, has_media boolean")
    return parsing.parse(df, recipe)


def test_digest_with_heading_and_policies(spark):
    recipe = parsing.RECIPES["generic.digest_blocks"]
    rows = parsed(spark, recipe, ("Today's list\n1) 2 xona kvartira 500 usd\n2) hello there", False), (None, False), ("", True)).orderBy("post_id", "index").collect()
    assert [(r["post_id"], r["reason"], r["policy"]) for r in rows] == [
        (0, "digest_preamble", "quarantine"), (0, "candidate_accepted", "emit"), (0, "include_marker_missing", "quarantine"), (1, "empty_text", "drop"), (2, "candidate_accepted", "emit"),
    ]
    told = {r["post_id"]: r["decision"] for r in parsing.outcomes(parsed(spark, recipe, ("1) kvartira\n2) uy", False), ("plain", False))).collect()}
    assert told == {0: "emit", 1: "quarantine"}


def test_overflow_exclusion_and_minimum(spark):
    import dataclasses

    small = dataclasses.replace(parsing.RECIPES["generic.digest_blocks"], max_candidates=2)
    assert [r["reason"] for r in parsed(spark, small, ("1) uy\n2) uy\n3) uy", False)).collect()] == ["candidate_limit_exceeded"]
    feed = parsing.RECIPES["generic.mixed_feed"]
    assert [r["policy"] for r in parsed(spark, feed, ("Reklama: kvartira ijara", False), ("kvartira ijara", False), ("salom", False)).orderBy("post_id").collect()] == ["drop", "emit", "quarantine"]
    strict = dataclasses.replace(feed, min_score=90)
    assert [r["reason"] for r in parsed(spark, strict, ("kvartira ijara", False)).collect()] == ["below_minimum_parser_score"]
    for bad in (r"(a)\1", r"a(?=b)", r"(a+)+"):
        with pytest.raises(ValueError):
            parsing.Recipe("x", include=(bad,))


EVENT = "event_id bigint, event_name string, user_id bigint, subject_id string, occurred_at timestamp_ntz"


def test_metrics_goldens(spark):
    day = dt.timedelta(days=1)
    rows = [
        (1, "user_registered", 1, None, AT), (2, "user_registered", 2, None, AT), (3, "user_registered", 3, None, AT), (4, "search_completed", 1, None, AT + day),
        (5, "search_completed", 9, None, AT), (6, "search_completed", 2, None, AT - day), (7, "saved_filter_created", 1, None, AT + 7 * day + dt.timedelta(hours=1)),
        (8, "notification_action_open", 2, None, AT + 8 * day + dt.timedelta(hours=2)),
    ]
    df = spark.createDataFrame(rows, EVENT)
    assert tuple(metrics.activation(df, "2026-09-01").first())[:2] == (1, 3)
    kept = metrics.retention(df.where("user_id in (1, 2)"), "2026-08-01", "2026-08-02", 24).first()
    assert tuple(kept) == (1, 2, 0.5)
    assert metrics.retention(df.limit(0), "2026-08-01", "2026-08-02", 24).first()["rate"] is None
    assert metrics.utc_of_local_day("2026-08-02", "Asia/Tashkent") == "2026-08-01 19:00:00"
    with pytest.raises(ValueError):
        metrics.checked_window("2026-08-02", "2026-08-01", 24)


def test_lifecycle_snapshots(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "e", 3)], "k int, v string, n int")
    assert {tuple(r) for r in lifecycle.absent_rows(stored, batch, ["k"], F.col("n")).collect()} == {(3, "d", 2)}
    assert {tuple(r) for r in lifecycle.upsert(stored, batch, ["k"], F.col("n")).collect()} == {(1, "a"), (2, "c"), (3, "e")}


def test_compare_and_set_equals_fold(spark):
    import random

    rng = random.Random(8)
    for _ in range(3):
        asked = [(rng.choice("ab"), rng.randint(1, 5), rng.random() < 0.5, n) for n in range(14)]
        state = {"a": [1, False, 0], "b": [1, False, 0]}
        for name, expected, enabled, _ in asked:
            if state[name][0] == expected:
                state[name] = [expected + 1, enabled, state[name][2] + 1]
        flags = spark.createDataFrame([("a", 1, False), ("b", 1, False)], "flag_name string, version int, enabled boolean")
        got = lifecycle.compare_and_set(flags, spark.createDataFrame(asked, "flag_name string, expected_version int, enabled boolean, seq int")).collect()
        assert {r["flag_name"]: [r["version"], r["enabled"], r["applied"]] for r in got} == state


def test_referral_chains_cycles_and_milestones(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (6, None)], "user_id bigint, referrer_id bigint")
    chains = referrals.ancestors(edges)
    assert {(r["user_id"], r["ancestor"]): r["depth"] for r in chains.collect()} == {(u, a): u - a for u in range(2, 6) for a in range(1, u)}
    asked = spark.createDataFrame([(1, 5), (6, 1), (2, 2)], "user_id bigint, referrer_id bigint")
    assert {(r["user_id"], r["cycle"]) for r in referrals.makes_cycle(asked, referrals.labels(edges)).collect()} == {(1, True), (6, False), (2, True)}
    acts = spark.createDataFrame([(1, u, u) for u in range(7)], "referrer_id int, user_id int, at int")
    assert [r["completed_by"] for r in referrals.milestones(acts).collect()] == [4]


def test_least_loaded_assignment(spark):
    sources = spark.createDataFrame([(f"s{i}", "x") for i in range(5)], "source_id string, adapter string")
    accounts = spark.createDataFrame([("a", "x", 2), ("b", "x", 0)], "account_key string, adapter string, load bigint")
    got = {r["source_id"]: r["account_key"] for r in topology.assign_least_loaded(sources, accounts).collect()}
    assert got == {"s0": "b", "s1": "b", "s2": "a", "s3": "b", "s4": "a"}


def test_delivery_attempts(spark):
    waiting = spark.createDataFrame([(1, "pending", 0, None), (2, "pending", 2, None), (3, "pending", 0, None)], "notification_id int, status string, attempts int, next_attempt_at timestamp_ntz")
    tried = spark.createDataFrame([(1, AT, "rate_limited", 17), (2, AT, "error", None)], "notification_id int, at timestamp_ntz, result string, retry_after int")
    got = {r["notification_id"]: tuple(r)[1:] for r in matching.after_attempt(waiting, tried).collect()}
    assert got == {1: ("pending", 1, AT + dt.timedelta(seconds=17)), 2: ("failed", 3, None), 3: ("pending", 0, None)}


def test_rate_limit_does_not_count_refusals(spark):
    rows = spark.createDataFrame([(i, "u", AT + dt.timedelta(seconds=i)) for i in range(22)] + [(99, "u", AT + dt.timedelta(seconds=60))], "n int, k string, at timestamp_ntz")
    got = {r["n"]: r["allowed"] for r in jobs.rate_limited(rows, "k", ["at", "n"], "at").collect()}
    assert all(got[i] for i in range(20)) and not got[20] and not got[21] and got[99]
    gaps = spark.createDataFrame([(0, "u", AT), (1, "u", AT + dt.timedelta(seconds=200)), (2, "u", AT + dt.timedelta(seconds=301))], "n int, k string, at timestamp_ntz")
    assert [r["allowed"] for r in suppression.suppressed(gaps, ["k"], ["at"], "at").orderBy("n").collect()] == [True, False, True]


def test_page_text_and_image_headers(spark):
    html = "<title> A  b </title><style>x</style><p>c<p>d &amp; e"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(web.page_text("h").alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("A b", "A b x c d & e"), (None, "")]
    assert web.image_header(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (5).to_bytes(4, "big") + (7).to_bytes(4, "big")) == ("image/png", 5, 7)
    assert web.image_header(b"\xff\xd8\xff\xe0\x00\x04\0\0\xff\xc0\x00\x0b\x08\x00\x07\x00\x05\x01\x01") == ("image/jpeg", 5, 7)
    assert web.image_header(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (4).to_bytes(3, "little") + (6).to_bytes(3, "little")) == ("image/webp", 5, 7)
    assert web.image_header(b"??") == web.image_header(None) == (None, None, None)


def test_injected_model_call(spark):
    def fake(value):
        if value == "bad":
            raise ValueError(value)
        return value.upper()

    got = web.extract_with(spark.createDataFrame([("a",), ("bad",)], "text string"), fake).collect()
    assert [r["response"] for r in got] == ["A", None]


def test_decode_survives_anything(spark):
    rows = [("{",), (None,), ("{}",), ('{"source_id":"s","source_message_id":"1","occurred_at":"nonsense"}',)]
    got = messages.decode(spark.createDataFrame(rows, "payload string")).collect()
    assert [r["malformed"] for r in got] == [True, True, True, False]
    assert got[3]["event_type"] == "created" and got[3]["occurred_at"] is None


def test_long_albums_merge_whole(spark, tmp_path):
    from listingloom.queries import QUERIES

    rows = [(k, i, f"r{i}", "t") for k in (1, 2) for i in range(130)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["album"]: (r["n"], r["text"]) for r in QUERIES["stm02_album_merge"](spark, str(tmp_path)).collect()}
    assert got == {k: (130, "\n\n".join(f"r{i}" for i in range(130))) for k in (1, 2)}


@pytest.mark.parametrize("blocks", [(256, 4096), (4, 16), (2,)])
def test_scored_blocks_equal_the_join_over_keys(spark, monkeypatch, blocks):
    """Candidates found in blocks of time, in larger ones, and by keys, with ties in time, nulls and a look-back; no pair is shuffled on the way."""
    monkeypatch.setattr(dedup, "BLOCKS", blocks)
    rows = [
        listing(
            i, district=f"d{i * 7 % 11}", rooms=None if i % 5 == 0 else i * 13 % 17, area=Decimal(30 + i * 29 % 97), monthly=None if i % 4 == 0 else Decimal(100 + i * 37 % 900),
            source_url=f"u{i // 9}" if i % 3 == 0 else None, created_at=AT + dt.timedelta(days=i * 5 // 8), phone=f"+{i % 6}",
        )
        for i in range(240)
    ]
    media = spark.createDataFrame([(i, 1, f"{i % 20:016x}") for i in range(0, 240, 3)], "announcement_id bigint, media_id int, phash string")
    scoring = dedup.Scoring(candidates=6)
    ready = dedup.ready(spark.createDataFrame(rows, LISTING), media)
    pairs = dedup.candidate_pairs(ready, {k: F.col(k) for k in ("source_url", "district", "rooms")}, scoring, ranges=True)
    told = dedup.scored_candidates(ready, scoring)
    expected = dedup.score(pairs, ready, scoring).select(*told.columns)
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, expected.collect()))
    if blocks == (256, 4096):
        plan = dedup.scored_candidates(ready, scoring)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(block") == 2


def test_least_loaded_with_many_accounts(spark):
    import heapq

    accounts = [(f"a{i:04d}", "x", i * 37 % 11) for i in range(900)]
    sources = [(f"s{i:05d}", "x") for i in range(3000)]
    heap, want = [(load, key) for key, _, load in accounts], {}
    heapq.heapify(heap)
    for source, _ in sources:
        load, want[source] = heap[0]
        heapq.heapreplace(heap, (load + 1, want[source]))
    told = topology.assign_least_loaded(spark.createDataFrame(sources, "source_id string, adapter string"), spark.createDataFrame(accounts, "account_key string, adapter string, load bigint"))
    assert {r["source_id"]: r["account_key"] for r in told.collect()} == want
    plan = told._jdf.queryExecution().analyzed().toString()
    assert "collect_list" not in plan


def test_hints_are_parsed_once(spark):
    from listingloom.operators import hints

    df = spark.createDataFrame([('{"parser_hints":{"language":" uz ","price_period":3}}',), (None,)], "p string")
    told = df.select(hints.parser_hints(F.col("p")).alias("h"))
    assert [r["h"] for r in told.collect()] == ['{"language":"uz","price_period":3}', "{}"]
    assert told._jdf.queryExecution().analyzed().toString().lower().count("parse_json") <= 4


def test_image_matches_of_the_query_are_equal_images(spark, monkeypatch):
    """By chance two of very many hashes lie within eight bits of each other."""
    from listingloom.plans import source_queries

    posts = spark.createDataFrame([(1, "00000000000000ff"), (2, "00000000000000fe"), (3, "00000000000000fe"), (4, None)], "post_id bigint, phash string")
    monkeypatch.setattr(source_queries.t, "posts", lambda *_: posts)
    assert [tuple(r) for r in source_queries.image_hash(spark, "").collect()] == [(3, 2, 0)]


def test_counts_of_matches_equal_the_matches(spark):
    """With limits, prices, districts, rooms, bases and users that are null or missing; no row of a listing meets one of a filter."""
    rows = [
        listing(i, district=None if i % 11 == 0 else f"D{i % 3}", rooms=None if i % 7 == 0 else i % 4, monthly=None if i % 5 == 0 else Decimal(90 + i * 17 % 60), price_basis=[None, "total", "per_person"][i % 3])
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, LISTING)
    filters = spark.createDataFrame(
        [(i, i % 9, None if i % 4 == 0 else f"d{i % 3}", None if i % 3 == 0 else i % 4, None if i % 5 == 0 else Decimal(95 + i * 7 % 50), i % 6 != 0, i % 2 == 0) for i in range(60)],
        "filter_id bigint, user_id bigint, district string, rooms int, max_price decimal(14,2), enabled boolean, include_per_person boolean",
    )
    users = spark.createDataFrame([(i, "blocked" if i == 2 else "active", i % 4 != 0) for i in range(7)], "user_id bigint, status string, notifications_enabled boolean")
    want = matching.match_metrics(matching.match_filters(df, filters, users)).first()
    got = matching.match_counts(df, filters, users).first()
    assert got == want and want["pairs"] > 0 and want["no_user"] > 0


def test_only_candidates_are_judged(spark):
    """Keys are compared before pairs are made: the join of the blocks knows the newest candidates by bits, also where a condition on the result follows."""
    ready = dedup.ready(spark.createDataFrame([listing(i, created_at=AT + dt.timedelta(hours=i)) for i in range(90)], LISTING))
    told = dedup.scored_candidates(ready, matchers={"similar_description": dedup.MATCHERS["similar_description"]}).where("similar_description")
    plan = told._jdf.queryExecution().executedPlan().toString()
    (join,) = (line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert not any(name in join for name in ("district", "decimal", "tokens")) and "row_number" not in plan


@pytest.mark.parametrize("blocks", [(256, 4096), (8, 32)])
def test_newest_places_equal_every_pair(spark, monkeypatch, blocks):
    """Nulls, repeated rows and ties in time; one image that many share."""
    monkeypatch.setattr(dedup, "BLOCKS", blocks)
    monkeypatch.setattr(dedup, "TASK_ROWS", 64)
    some = [
        listing(
            i // 2 * 2 if i % 10 == 1 else i, district=None if i % 6 == 0 else f"d{i * 7 % 31}", rooms=None if i % 5 else i % 3, area=None if i % 8 == 0 else Decimal(30 + i * 29 % 397),
            monthly=[None, Decimal(0), Decimal(100 + i * 37 % 900)][i % 3], currency=None if i % 7 == 0 else "USD", created_at=None if i < 4 else AT + dt.timedelta(days=i // 10 * 10 // 4),
        )
        for i in range(200)
    ]
    media = spark.createDataFrame([(i, 1, f"{i % 50 if i % 4 else 7:016x}") for i in range(0, 200, 2)], "announcement_id bigint, media_id int, phash string")
    scoring = dedup.Scoring(candidates=4, lookback_days=30)
    rows = dedup.ready(spark.createDataFrame(some, LISTING), media)
    by = {r["position"]: r for r in rows.collect()}

    def met(l, r):
        same = any(l[k] is not None and l[k] == r[k] for k in ("source_url", "district", "rooms")) or bool(set(l["hashes"]) & set(r["hashes"]))
        area = None not in (l["area"], r["area"]) and abs(l["area"] - r["area"]) <= 3
        kind = [(x["price_period"], x["price_basis"], x["currency"]) for x in (l, r)]
        price = kind[0] == kind[1] and None not in kind[0] and all(x["monthly"] for x in (l, r)) and l["monthly"] * 95 <= r["monthly"] * 100 <= l["monthly"] * 105
        late = None not in (l["second"], r["second"]) and r["second"] >= l["second"] - 30 * 86_400
        return late and (l["announcement_id"], l["created_at"]) != (r["announcement_id"], r["created_at"]) and (same or area or price)

    told = {r["position"]: r for r in dedup.newest_places(rows, scoring).collect()}
    assert sorted(told) == sorted(by) == list(range(200)) and {blocks[0], blocks[-1]} >= {r["size"] for r in told.values()} - {0}
    for p, r in told.items():
        if r["size"]:
            got = [p - 1 - 64 * w - k for w, word in enumerate(r["newest"]) for k in range(64) if word >> k & 1]
            assert got == [q for q in range(p - 1, -1, -1) if met(by[p], by[q])][:4]


def test_text_hashes_are_computed_once(spark):
    from listingloom.operators import prededup

    posts = spark.createDataFrame([(1, "One  two"), (2, None), (3, "one TWO"), (4, ""), (5, "three")], "post_id bigint, text string")
    posts = posts.selectExpr("*", "cast(null as string) as forward_key", "cast(null as bigint) as parent_ref", "cast(null as string) as phash")
    told = prededup.hash_matches(prededup.signals(posts))
    assert [tuple(r) for r in told.collect()] == [(3, 1)]
    assert "EvalPython" not in told._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("run_rows", [1 << 16, 16])
def test_newest_candidates_equal_every_pair(spark, monkeypatch, run_rows):
    """Ties in time, missing keys and times, ids of several rows, and newest candidates many runs back."""
    monkeypatch.setattr(dedup, "RUN_ROWS", run_rows)
    monkeypatch.setattr(dedup, "LISTED_ROWS", 5)
    some = [
        listing(
            i // 3 * 3 if i % 10 == 1 else i, district=None if i % 6 == 0 else f"d{i * 7 % 5}", rooms=i % 3, phone=None if i % 5 == 0 else "+0" if i % 3 else f"+{i % 41}",
            source_url=f"u{i % 90}" if i % 4 == 0 else None, created_at=None if i < 3 else AT + dt.timedelta(hours=i // 7 * 9),
        )
        for i in range(300)
    ]
    some += some[40:44] + some[140:150]
    df, scoring = spark.createDataFrame(some, LISTING), dedup.Scoring(candidates=4, lookback_days=12)
    keys = {"url": F.col("source_url"), "phone": F.col("phone"), "place": F.concat("district", F.lit("/"), F.col("rooms").cast("string"))}
    rows, met = df.select("announcement_id", "created_at", *(k.alias(n) for n, k in keys.items())).collect(), {}
    for l in rows:
        for r in rows:
            if None not in (l[1], r[1]) and (r[1], r[0]) < (l[1], l[0]) and l[1] - r[1] <= dt.timedelta(days=12) and any(l[n] is not None and l[n] == r[n] for n in keys):
                met.setdefault(l[0], set()).add((r[1], r[0]))
    want = {k: sorted(v, reverse=True)[:4] for k, v in met.items()}
    told = dedup.newest_candidates(df, keys, scoring).collect()
    assert len(told) == len(want) and {r["incoming"]: [(c["candidate_at"], c["candidate"]) for c in r["candidates"]] for r in told} == want
    pairs = dedup.candidate_pairs(df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), keys, scoring).collect()
    assert sorted((r["incoming"], r["candidate_at"], r["candidate"]) for r in pairs) == sorted((k, *c) for k, v in want.items() for c in v)
    assert dedup.newest_candidates(df.where("announcement_id < 0"), keys, scoring).collect() == []


def test_pairs_by_equal_keys_are_not_shuffled(spark, monkeypatch):
    """What a task holds doesn't grow with the listings: no pair is shuffled, and there are more tasks for more rows, not a fixed number."""
    monkeypatch.setattr(dedup, "RUN_ROWS", 16, raising=False)
    df = spark.createDataFrame([listing(i, phone="+1", created_at=AT + dt.timedelta(hours=i)) for i in range(320)], LISTING)
    plan = dedup.candidate_pairs(df, dedup.listing_keys())._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert shuffles and not any("hashpartitioning(incoming" in line for line in shuffles)
    assert all(", 20)" in line for line in shuffles) and "Window" not in plan and "Join" not in plan.replace("BroadcastHashJoin", "")
