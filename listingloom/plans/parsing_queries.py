"""Queries on parsing; digests are made of the names of ``part``, four to a post."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.operators import parsing
from listingloom.plans.registry import VIEWS, query
from listingloom.sources import tables as t

VIEWS["digest_lines"] = """
  select p_partkey // 4 as post_id, row_number() over (partition by p_partkey // 4 order by p_partkey) as n, p_size,
    p_name || case when p_size % 3 = 0 then ' ' || (p_size % 5 + 1) || ' xona ijara' else '' end || case when p_size % 4 = 0 then ' ' || (p_size * 10) || ' usd' else '' end as body from part"""


def digests(spark, d):
    """(post_id, text, has_media): numbered lines."""
    rows = digest_rows(spark, d)
    return rows.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("l")).select(
        "post_id", F.array_join(F.transform("l", lambda x: F.concat(x["n"].cast("string"), F.lit(") "), x["body"])), "\n").alias("text"), (F.col("post_id") % 2 == 0).alias("has_media")
    )


def digest_rows(spark, d):
    from pyspark.sql import Window

    k, size = F.col("p_partkey"), F.col("p_size")
    rooms = F.when(size % 3 == 0, F.concat(F.lit(" "), (size % 5 + 1).cast("string"), F.lit(" xona ijara"))).otherwise("")
    price = F.when(size % 4 == 0, F.concat(F.lit(" "), (size * 10).cast("string"), F.lit(" usd"))).otherwise("")
    post = F.floor(k / 4)
    n = F.row_number().over(Window.partitionBy(post).orderBy(k))
    return t.table(spark, d, "part").select(post.alias("post_id"), n.alias("n"), "p_size", F.concat(F.col("p_name"), rooms, price).alias("body"))


SEGMENTS = """seg as (select post_id, cast(n - 1 as integer) as index, n || ') ' || body as segment, p_size % 3 = 0 as rooms, p_size % 4 = 0 as price, post_id % 2 = 0 as media, count(*) over (partition by post_id) as k from digest_lines),
  told as (select *, (p.rooms or p.price) as hit, case when rooms or price then 'emit' else 'quarantine' end as policy,
    least(100, 5 + 20 + case when price then 20 else 0 end + case when rooms then 25 else 0 end + case when media then 5 else 0 end + least(20, (price::int + 2 * rooms::int) * 10)) as score from seg p)"""


def _parsed(spark, d):
    return parsing.parse(digests(spark, d), parsing.RECIPES["generic.digest_blocks"])


@query("par05_split_blocks", f"with {SEGMENTS} select post_id, index, segment from told")
def split_blocks(spark, d):
    return _parsed(spark, d).select("post_id", "index", "segment")


@query("par06_quality_signals", f"with {SEGMENTS} select post_id, index, rooms as has_rooms, price as has_price, rooms as has_real_estate_terms from told")
def signals(spark, d):
    rows = _parsed(spark, d)
    cols = parsing.signal_columns(F.col("segment"), F.col("with_media"))
    return rows.select("post_id", "index", *(cols[n].alias(n) for n in ("has_rooms", "has_price", "has_real_estate_terms")))


@query("par07_candidate_score", f"with {SEGMENTS} select post_id, index, cast(score as integer) as score from told")
def scores(spark, d):
    return _parsed(spark, d).select("post_id", "index", "score")


@query("par08_policy_ladder", f"with {SEGMENTS} select post_id, index, policy, case when policy = 'emit' then 'candidate_accepted' else 'include_marker_missing' end as reason from told")
def policies(spark, d):
    return _parsed(spark, d).select("post_id", "index", "policy", "reason")


@query("par08_policy_reasons", """with m as (select p_partkey as post_id, case p_partkey % 7 when 0 then '' when 1 then 'reklama kvartira ijara ' || p_name when 2 then p_name when 3 then 'kvartira ' || p_name else 'kvartira ijara ' || p_name end as text, p_size % 2 = 0 as media from part),
  l as (select post_id, count(*) as k from digest_lines group by 1)
  select post_id, 'feed' as kind, case when text = '' and not media then 'empty_text' when text = '' then 'below_minimum_parser_score' when post_id % 7 = 1 then 'exclude_marker_matched' when post_id % 7 = 2 then 'include_marker_missing'
      when post_id % 7 = 3 and not media then 'below_minimum_parser_score' else 'candidate_accepted' end as reason,
    case when text = '' and not media or post_id % 7 = 1 then 'drop' when text = '' or post_id % 7 = 2 or post_id % 7 = 3 and not media then 'quarantine' else 'emit' end as policy from m
  union all select post_id, 'digest', 'candidate_limit_exceeded', 'quarantine' from l where k > 3""")
def policy_reasons(spark, d):
    """Six reasons: a mixed feed with a minimum score, and digests with more blocks than allowed."""
    import dataclasses

    k = F.col("p_partkey")
    text = F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat(F.lit("reklama kvartira ijara "), "p_name")).when(k % 7 == 2, F.col("p_name")).when(k % 7 == 3, F.concat(F.lit("kvartira "), "p_name"))
    posts = t.table(spark, d, "part").select(k.alias("post_id"), F.coalesce(text, F.concat(F.lit("kvartira ijara "), "p_name")).alias("text"), (F.col("p_size") % 2 == 0).alias("has_media"))
    feed = parsing.parse(posts, dataclasses.replace(parsing.RECIPES["generic.mixed_feed"], min_score=55))
    short = parsing.parse(digests(spark, d), dataclasses.replace(parsing.RECIPES["generic.digest_blocks"], max_candidates=3)).where("reason = 'candidate_limit_exceeded'")
    return feed.select("post_id", F.lit("feed").alias("kind"), "reason", "policy").unionByName(short.select("post_id", F.lit("digest").alias("kind"), "reason", "policy"))


@query("par11_media_policy", f"with {SEGMENTS} select post_id, index, media and k = 1 as with_media from told")
def media_policy(spark, d):
    return _parsed(spark, d).select("post_id", "index", "with_media")


@query("par12_outcomes", f"with {SEGMENTS} select post_id, case when count(*) filter (policy = 'emit') > 0 then 'emit' else 'quarantine' end as decision, count(*) filter (policy = 'emit') as candidates, cast(min(score) filter (policy = 'emit') as integer) as score from told group by 1")
def outcome(spark, d):
    return parsing.outcomes(_parsed(spark, d))


@query("par14_candidate_id", f"with {SEGMENTS} select post_id, index, 'spc_' || sha256(post_id || chr(31) || 'generic.digest_blocks' || chr(31) || '1' || chr(31) || index || chr(31) || segment)[1:32] as candidate_id from told")
def identifiers(spark, d):
    return _parsed(spark, d).select("post_id", "index", "candidate_id")


@query("par17_quarantined", f"with {SEGMENTS} select post_id, index, segment from told where policy = 'quarantine'")
def quarantined(spark, d):
    return _parsed(spark, d).where("policy = 'quarantine'").select("post_id", "index", "segment")


@query("par01_recipe_routing", """select event_id, case event_id % 5 when 0 then 'generic.digest_blocks' when 1 then 'generic.mixed_feed' when 2 then 'generic.album_caption' else 'generic.single_listing' end as recipe from events""")
def routing(spark, d):
    k = F.col("event_id")
    asked = F.when(k % 5 == 0, "digest_blocks").when(k % 5 == 1, "generic.mixed_feed").when(k % 5 == 3, "unknown.parser")
    bound = F.when(k % 5 == 2, "caption_first")
    return t.table(spark, d, "events").select("event_id", parsing.resolve_recipe(asked, bound).alias("recipe"))


@query("par04_cleanup", "select doc_id, length(trim(regexp_replace(regexp_replace(text, '[ \\t\\f\\v]+', ' ', 'g'), '\\n\\s*\\n(?:\\s*\\n)+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) as n from documents")
def cleanup(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.length(parsing.cleaned(F.col("text"), parsing.RECIPES["generic.single_listing"])).cast("bigint").alias("n"))


EVAL = f"""{SEGMENTS}, e as (select post_id as case_id, segment as x, count(*) as e from told where policy = 'emit' group by 1, 2),
  a as (select post_id as case_id, segment as x, count(*) as a from told where policy = 'emit' and score >= 60 or policy <> 'emit' and post_id % 5 = 0 group by 1, 2),
  b as (select coalesce(e, 0) as e, coalesce(a, 0) as a from e full join a on e.case_id = a.case_id and e.x = a.x)"""


def replays(spark, d):
    """(case_id, text) of what the recipe emits, and of what a stricter one does that also emits a fifth of the unmatched blocks."""
    rows = parsing.parse(digests(spark, d), parsing.RECIPES["generic.digest_blocks"])
    told = lambda x: x.select(F.col("post_id").alias("case_id"), F.col("segment").alias("text"))
    return told(rows.where("policy = 'emit'")), told(rows.where("policy = 'emit' and score >= 60 or policy <> 'emit' and post_id % 5 = 0"))


@query("par20_replay_evaluation", f"with {EVAL}, s as (select sum(least(e, a)) as tp, sum(greatest(a - e, 0)) as fp, sum(greatest(e - a, 0)) as fn from b) select cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, tp::double / (tp + fp) as precision, tp::double / (tp + fn) as recall from s")
def evaluation(spark, d):
    return parsing.evaluate(*replays(spark, d))


@query("par21_threshold_gate", f"with {EVAL}, s as (select sum(least(e, a))::double / sum(a) as precision, sum(least(e, a))::double / sum(e) as recall from b) select metric, value, 0.95::double as floor from (select 'precision' as metric, precision as value from s union all select 'recall', recall from s) where value is null or value < 0.95")
def gate(spark, d):
    return parsing.failed_gates(evaluation(spark, d), {"precision": 0.95, "recall": 0.95})


#: Labelled posts: a quarter has no texts (half of these a number), a sixth is expected to be dropped; the stricter parser answers.
CASES = f"""{SEGMENTS}, t as (select *, policy = 'emit' as e, policy = 'emit' and score >= 60 or policy <> 'emit' and post_id % 5 = 0 as a, trim(regexp_replace(lower(segment), '\\s+', ' ', 'g')) as x from told),
  c as (select post_id as case_id, case when post_id % 6 = 0 then 'drop' when count(*) filter (e) > 0 then 'emit' else 'quarantine' end as expected_decision, case when count(*) filter (a) > 0 then 'emit' else 'drop' end as actual_decision,
    post_id % 4 <> 0 and count(*) filter (e) > 0 as labelled, count(*) filter (e) as ne, count(*) filter (a) as actual from t group by 1),
  m as (select post_id as case_id, sum(k) as k from (select post_id, x, least(count(*) filter (e), count(*) filter (a)) as k from t group by 1, 2) group by 1),
  cases as (select c.*, case when labelled then ne when case_id % 8 = 0 then ne when expected_decision = 'emit' then 1 else 0 end::bigint as expected, case when labelled then k else 0 end::bigint as tp from c join m using (case_id)),
  told_cases as (select case_id, expected_decision, actual_decision, expected_decision = actual_decision as decision_correct, labelled, expected, actual, tp,
    case when labelled then greatest(0, actual - tp) else 0 end::bigint as fp, case when labelled then greatest(0, expected - tp) else 0 end::bigint as fn from cases)"""
REPORT = f"""{CASES}, report as (select count(*) as cases, count(*) filter (labelled) as labelled_cases, sum(expected)::bigint as expected, sum(actual)::bigint as actual, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn,
    sum(tp)::double / (sum(tp) + sum(fp)) as precision, sum(tp)::double / (sum(tp) + sum(fn)) as recall, count(*) filter (decision_correct)::double / count(*) as decision_accuracy,
    count(*) filter (decision_correct and expected_decision <> 'emit')::double / count(*) filter (expected_decision <> 'emit') as drop_accuracy, count(*) filter (expected = actual)::double / count(*) as candidate_count_accuracy from told_cases)"""


def _cases(spark, d):
    rows = parsing.parse(digests(spark, d), parsing.RECIPES["generic.digest_blocks"])
    k = F.col("case_id")
    strict = rows.where("policy = 'emit' and score >= 60 or policy <> 'emit' and post_id % 5 = 0").select(F.col("post_id").alias("case_id"), F.col("segment").alias("text"))
    every = rows.groupBy(F.col("post_id").alias("case_id")).agg(F.collect_list(F.when(F.col("policy") == "emit", F.col("segment"))).alias("all"))
    decision = F.when(k % 6 == 0, "drop").when(F.size("all") > 0, "emit").otherwise("quarantine")
    cases = every.select("case_id", decision.alias("decision"), F.when(k % 4 != 0, F.col("all")).alias("texts"), F.when(k % 8 == 0, F.size("all")).alias("n"))
    found = strict.select("case_id").distinct().withColumn("emits", F.lit(True))
    decisions = every.select("case_id").join(found, "case_id", "left").select("case_id", F.when(F.col("emits"), "emit").otherwise("drop").alias("decision"))
    return parsing.evaluate_cases(cases, decisions, strict)


@query("par20_case_evaluations", f"with {CASES} select * from told_cases")
def case_evaluations(spark, d):
    return _cases(spark, d)


@query("agg12_evaluation_report", f"with {REPORT} select * from report")
def evaluation_report(spark, d):
    return parsing.report(_cases(spark, d))


@query("par21_five_gates", f"with {REPORT} select metric, value, 0.95::double as floor from (" + " union all ".join(f"select '{m}' as metric, {m} as value from report" for m in parsing.FLOORS) + ") where value is null or value < 0.95")
def five_gates(spark, d):
    return parsing.failed_gates(parsing.report(_cases(spark, d)), parsing.FLOORS)


@query("par22_binding_merge", "select event_id, case when event_id % 3 = 0 then 'b' else 'a' end as key, case when event_id % 4 = 0 then 'new' when event_id % 3 <> 0 then 'old' end as config from events")
def binding(spark, d):
    k = F.col("event_id")
    key, config = parsing.merged_binding(F.lit("a"), F.lit("old"), F.when(k % 3 == 0, "b"), F.when(k % 4 == 0, "new"))
    return t.table(spark, d, "events").select("event_id", key.alias("key"), config.alias("config"))


@query("set06_multiset_intersection", f"with {EVAL} select sum(least(e, a))::bigint as shared from b")
def multiset(spark, d):
    expected, actual = replays(spark, d)
    return expected.intersectAll(actual).agg(F.count("*").alias("shared"))


@query("fil16_fanout_siblings", """with f as (select parent_ref, min(post_id) as first, count(*) as posts from posts where parent_ref is not null group by 1)
  select post_id, "first" as sibling, posts from posts join f using (parent_ref) where "first" < post_id""")
def siblings(spark, d):
    """Posts of one parent event: the first of them and how many there are."""
    from listingloom.operators.predicates import fanout_siblings

    p = t.posts(spark, d).where("parent_ref is not null").select("post_id", "parent_ref")
    first = p.groupBy("parent_ref").agg(F.min("post_id").alias("post_id"), F.count("*").alias("posts"))
    pairs = p.alias("l").join(first.alias("r"), F.col("l.parent_ref") == F.col("r.parent_ref"))
    return pairs.where(fanout_siblings("parent_ref", "post_id") & (F.col("r.post_id") < F.col("l.post_id"))).select("l.post_id", F.col("r.post_id").alias("sibling"), "r.posts")


@query("fil17_fanout_message_id", "select post_id, message_id as raw, cast(post_id % 3 as integer) as n from posts")
def fanout_id(spark, d):
    marked = F.concat(F.col("message_id"), F.lit("::candidate::"), (F.col("post_id") % 3).cast("string"))
    return t.posts(spark, d).select("post_id", F.regexp_extract(marked, "^(.*)::candidate::(\\d+)$", 1).alias("raw"), F.regexp_extract(marked, "^(.*)::candidate::(\\d+)$", 2).cast("int").alias("n"))


