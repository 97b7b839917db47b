"""Referral trees: cycles, activation milestones and the validation ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.operators.topology import numbered
from listingloom.sources.tables import checkpointed

MILESTONE, AWARD_DAYS = 5, 7


def ancestors(edges: DataFrame, rounds: int = 24) -> DataFrame:
    """(user_id, ancestor, depth): the whole chain of referrers, by doubling paths until none grows.

    edges: (user_id, referrer_id), one row a user. Raises RuntimeError for chains longer than 2**rounds. On a cycle
    every member is an ancestor of all, itself included.
    """
    paths = edges.where("referrer_id is not null").select("user_id", F.col("referrer_id").alias("ancestor"), F.lit(1).alias("depth"))
    for _ in range(rounds):
        longest = paths.agg(F.max("depth")).first()[0]
        tail = paths.where(F.col("depth") == longest).select("user_id", F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        more = tail.join(paths.select(F.col("user_id").alias("_a"), "ancestor", "depth"), "_a").select("user_id", "ancestor", (F.col("_d") + F.col("depth")).alias("depth"))
        paths = checkpointed(paths.unionByName(more).groupBy("user_id", "ancestor").agg(F.min("depth").alias("depth")))
        if longest is None or paths.agg(F.max("depth")).first()[0] == longest:
            return paths
    raise RuntimeError("ancestors: a chain is too long")


def labels(edges: DataFrame) -> DataFrame:
    """(user_id, root, depth, enter, leave) of every user of edges (user_id, referrer_id), one row a user.

    One user is above another if both have one root and its interval of (enter, leave) holds the other's, so ancestor tests
    need no chains. Root and depth come from pointer jumping, the intervals from a tour around each tree: every
    referral is walked down and up, each walk points to the next one, and doubling the pointers counts how many walks are left. All
    tables have a row or two a user, rounds are the logarithm of users. Root and interval are null for users whose referrers
    go round in a circle; a referrer without a row of its own is a root.
    """
    own = edges.where("referrer_id is not null").select("user_id", F.col("referrer_id").alias("up"))
    tops = edges.where("referrer_id is null").select("user_id").union(own.select("up").join(edges.select(F.col("user_id").alias("up")), "up", "left_anti")).distinct()
    n = own.count()
    now = checkpointed(own.select("user_id", "up", F.lit(1).cast("bigint").alias("depth")))
    for _ in range(max(1, n).bit_length()):
        jump = now.select(F.col("user_id").alias("_u"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        now = checkpointed(now.join(jump, F.col("up") == F.col("_u"), "left").select("user_id", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
        if now.join(own.select(F.col("user_id").alias("up")), "up", "left_semi").isEmpty():
            break
    rooted = checkpointed(now.join(tops.select(F.col("user_id").alias("up")), "up", "left_semi").select("user_id", F.col("up").alias("root"), "depth"))
    kept = own.join(rooted.select("user_id"), "user_id", "left_semi")
    placed = checkpointed(numbered(kept, "up", "user_id"))
    child = placed.where("n = 0").select(F.col("up").alias("user_id"), F.col("user_id").alias("child"))
    beside = placed.select("up", (F.col("n") - 1).alias("n"), F.col("user_id").alias("sibling"))
    # A walk is (user, whether up): down to a user, then to its first child or up again; up, then to the next sibling or on up.
    down = kept.join(child, "user_id", "left").select("user_id", F.lit(False).alias("back"), F.coalesce("child", "user_id").alias("next"), F.col("child").isNull().alias("next_back"))
    above = F.when(~F.col("top"), F.col("up"))
    after = placed.join(beside, ["up", "n"], "left").join(tops.select(F.col("user_id").alias("up"), F.lit(True).alias("top")), "up", "left").withColumn("top", F.coalesce("top", F.lit(False)))
    up = after.select("user_id", F.lit(True).alias("back"), F.coalesce("sibling", above).alias("next"), F.col("sibling").isNull().alias("next_back"))
    walks = checkpointed(down.unionByName(up).withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint")))
    while not walks.where("next is not null").isEmpty():
        far = walks.select(F.col("user_id").alias("next"), F.col("back").alias("next_back"), F.col("next").alias("_n"), F.col("next_back").alias("_b"), F.col("left").alias("_l"))
        stepped = walks.where("next is not null").join(far, ["next", "next_back"]).select("user_id", "back", F.col("_n").alias("next"), F.col("_b").alias("next_back"), (F.col("left") + F.col("_l")).alias("left"))
        walks = checkpointed(stepped.unionByName(walks.where("next is null")))
    # What is left falls along the tour, so its negative rises.
    spans = walks.groupBy("user_id").agg(F.max(F.when(~F.col("back"), -F.col("left"))).alias("enter"), F.max(F.when(F.col("back"), -F.col("left"))).alias("leave"))
    inner = rooted.join(spans, "user_id")
    least, most = F.lit(-(1 << 62)).cast("bigint"), F.lit(1 << 62).cast("bigint")
    known = inner.unionByName(tops.select("user_id", F.col("user_id").alias("root"), F.lit(0).cast("bigint").alias("depth"), least.alias("enter"), most.alias("leave")))
    every = edges.select("user_id").union(tops).distinct()
    return every.join(known, "user_id", "left")


def makes_cycle(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests (user_id, referrer_id) with ``cycle``: the referrer descends from the user, is the user, or goes round in a circle itself.

    ``known`` are the ``labels`` before the requests; users without any have no referrer and refer nobody.
    """
    at = lambda p: known.select(F.col("user_id").alias(f"{p}_id"), F.col("root").alias(f"{p}_root"), F.col("enter").alias(f"{p}_enter"), F.col("leave").alias(f"{p}_leave"))
    rows = requests.join(at("u"), F.col("user_id") == F.col("u_id"), "left").join(at("r"), F.col("referrer_id") == F.col("r_id"), "left")
    below = (F.col("u_root") == F.col("r_root")) & (F.col("u_enter") <= F.col("r_enter")) & (F.col("r_leave") <= F.col("u_leave"))
    circle = F.col("r_id").isNotNull() & F.col("r_root").isNull()
    return rows.select("user_id", "referrer_id", (F.coalesce(below, F.lit(False)) | circle | F.coalesce(F.col("user_id") == F.col("referrer_id"), F.lit(False))).alias("cycle"))


def start_result(limited: Column, code: Column, referrer: Column, user: Column, cycle: Column, existing: Column) -> Column:
    """The first rule that a referral start breaks, else accepted.

    ``referrer`` is the user whom the code names (null: nobody), ``existing`` the referrer of the user's pending or active event.
    """
    return (
        F.when(limited, "rate_limited").when(F.coalesce(code, F.lit("")) == "", "no_referral_code").when(referrer.isNull(), "unknown_code").when(referrer == user, "self_referral")
        .when(cycle, "circular_referral").when(existing == referrer, "duplicate_referral").when(existing.isNotNull(), "referrer_immutable").otherwise("accepted")
    )


#: Starts of a user in any window that are looked at.
MOST_STARTS, START_SECONDS = 20, 60


def starts(asked: DataFrame, users: DataFrame, most: int = MOST_STARTS, seconds: float = START_SECONDS) -> DataFrame:
    """(start_id, user_id, referrer_id, result) of referral starts (start_id, user_id, code, at) against the users as they are.

    ``users`` have user_id, referral_code and referrer_id (of a pending or active event). A user's starts beyond ``most`` in
    ``seconds`` are refused first of all; the refused don't count.
    """
    from listingloom.streaming.jobs import rate_limited

    codes = users.where("referral_code is not null").groupBy(F.col("referral_code").alias("code")).agg(F.min("user_id").alias("referrer_id"))
    told = rate_limited(asked.select("start_id", "user_id", "code", "at"), "user_id", ["at", "start_id"], "at", most=most, seconds=seconds)
    rows = checkpointed(told.join(codes, "code", "left").join(users.select("user_id", F.col("referrer_id").alias("existing")), "user_id", "left"))
    known = labels(users.select("user_id", "referrer_id"))
    cycles = makes_cycle(rows.where("referrer_id is not null").select("user_id", "referrer_id").distinct(), known)
    rows = rows.join(cycles, ["user_id", "referrer_id"], "left")
    result = start_result(~F.col("allowed"), F.col("code"), F.col("referrer_id"), F.col("user_id"), F.coalesce("cycle", F.lit(False)), F.col("existing"))
    return rows.select("start_id", "user_id", "referrer_id", result.alias("result"))


def activations(events: DataFrame, actions: DataFrame, users: DataFrame, awarded: DataFrame, most: int = MILESTONE, days: int = AWARD_DAYS) -> tuple[DataFrame, DataFrame]:
    """Results of qualifying actions (action_id, user_id, at), and the awards that they bring.

    ``events`` have referred_id, referrer_id and status, one row a referred user; ``users`` user_id, active (referrals so far) and premium_until;
    ``awarded`` the referrer_id and milestone of awards given before. The first action of a user with a pending event activates it; others are
    skipped with a reason. A referrer whose count reaches ``most`` gets ``days`` days from the later of then and their premium's end, once for ever.
    Results are (action_id, activated, reason, active), awards (referrer_id, at, premium_until).
    """
    first = actions.groupBy("user_id").agg(F.min(F.struct("at", "action_id")).alias("f"))
    rows = actions.join(first, "user_id").join(events, F.col("user_id") == F.col("referred_id"), "left").withColumn("first", F.struct("at", "action_id") == F.col("f"))
    turned = (F.col("status") == "pending") & F.col("first")
    before = users.select(F.col("user_id").alias("referrer_id"), "active", "premium_until")
    new = checkpointed(rows.where(turned).select("referrer_id", "action_id", "at").withColumn("o", F.struct("at", "action_id")))
    counted = checkpointed(numbered(new, "referrer_id", "o").join(before, "referrer_id", "left").withColumn("active", F.coalesce("active", F.lit(0)) + F.col("n") + 1))
    reason = (
        F.when(F.col("status").isNull(), "no_referral_event").when((F.col("status") == "active") | ((F.col("status") == "pending") & ~F.col("first")), "already_active")
        .when(F.col("status") != "pending", F.concat(F.lit("event_"), F.col("status")))
    )
    told = rows.select("action_id", F.coalesce(turned, F.lit(False)).alias("activated"), reason.alias("reason")).join(counted.select("action_id", "active"), "action_id", "left")
    due = counted.where(F.col("active") >= most).groupBy("referrer_id").agg(F.min_by(F.struct("at", "premium_until"), "o").alias("a"))
    given = awarded.where(F.col("milestone") == most).select("referrer_id")
    until = F.greatest(F.coalesce("a.premium_until", F.col("a.at")), F.col("a.at")) + F.make_dt_interval(F.lit(days))
    return told, due.join(given, "referrer_id", "left_anti").select("referrer_id", F.col("a.at").alias("at"), until.alias("premium_until"))


def milestones(activations_: DataFrame) -> DataFrame:
    """(referrer_id, user_id, at) -> the activation that completes each referrer's first MILESTONE."""
    place = F.row_number().over(Window.partitionBy("referrer_id").orderBy("at", "user_id"))
    return activations_.withColumn("_n", place).where(F.col("_n") == MILESTONE).select("referrer_id", F.col("user_id").alias("completed_by"), "at")
