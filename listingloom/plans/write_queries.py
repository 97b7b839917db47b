"""Queries on hints and metadata of candidates, decisions and reviews as they are stored, users, sources, tags and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.operators import dedup, filters, hints, lifecycle, reviews, sending
from listingloom.plans.dedup_queries import SCORED, SIGNALS, _scored
from listingloom.plans.registry import query
from listingloom.sources import messages, models
from listingloom.sources import tables as t

c = F.col


@query("nrm08_hints_of_payloads", """select p_partkey, case p_partkey % 6
    when 0 then '{"district":"' || p_brand || '","required_fields":["price","' || p_type || '"]}' when 1 then '{"owner_type":true,"price_period":3}' when 2 then '{"language":"' || repeat('x', 200) || '"}'
    when 3 then '{}' when 4 then '{"listing_type":"rent","required_fields":["a"],"recipe_hints":["' || repeat('y', 100) || '"]}' else '{"source_format":2.5}' end as hints from part""")
def hints_of_payloads(spark, d):
    """An event's own hints, three places of a payload, a recipe's defaults, and what is no object; keys that aren't passed on, long and empty texts."""
    k = c("p_partkey")
    own = F.when(k % 6 == 0, F.concat(F.lit('{"unknown":"x","district":" '), "p_brand", F.lit('\\t","required_fields":["price"," ",7,"'), "p_type", F.lit(' "],"language":"  "}')))
    payload = (
        F.when(k % 6 == 1, F.lit('{"parser_hints":{"owner_type":true,"price_period":3,"price_basis":null,"district":{"a":1}},"extraction_hints":{"language":"uz"}}'))
        .when(k % 6 == 2, F.lit('{"source_parser":{"extraction_hints":{"language":"' + "x" * 250 + '"}}}')).when(k % 6 == 3, F.lit('{"source_parser_hints":["a"],"parser_hints":{"language":"uz"}}'))
        .when(k % 6 == 4, F.lit('{"source_parsing":{"defaults":{"listing_type":"rent","other":1,"required_fields":"b"},"required_fields":["a"],"prompt_hints":["' + "y" * 130 + '",""]}}'))
        .otherwise(F.lit('{"extraction_hints":{"source_format":2.5,"recipe_hints":[]}}'))
    )
    return t.table(spark, d, "part").select("p_partkey", hints.parser_hints(payload, own).alias("hints"))


RAW_SQL = """'{"raw_event_id":"post:' || o_orderkey || '","raw_schema_version":"1","raw_text":"' || o_orderpriority || '","source_id":"src' || o_custkey % 20 || '","source_channel_id":"ch","source_message_id":"' || o_orderkey || '","source_message_ids":["' || o_orderkey || '","x"],"source_url":' ||
  case when o_orderkey % 3 = 0 then '"https://t.me/c/' || o_orderkey || '"' else 'null' end || ',"raw_forward_metadata":' || case when o_orderkey % 2 = 0 then '{"channel":"f","message":"' || o_custkey || '"}' else 'null' end || ',"raw_media":[{"media_id":"m' || o_orderkey || '"}]}'"""


def _raw_events(spark, d):
    k = c("o_orderkey").cast("string")
    raw = F.struct(
        F.concat(F.lit("post:"), k).alias("idempotency_key"), F.lit("1").alias("schema_version"), c("o_orderpriority").alias("text"), F.concat(F.lit("src"), (c("o_custkey") % 20).cast("string")).alias("source_id"),
        F.lit("ch").alias("source_channel_id"), k.alias("source_message_id"), F.array(k, F.lit("x")).alias("source_message_ids"), F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("https://t.me/c/"), k)).alias("source_url"),
        F.when(c("o_orderkey") % 2 == 0, F.struct(F.lit("f").alias("channel"), c("o_custkey").cast("string").alias("message"))).alias("forward_metadata"),
        F.array(F.struct(F.concat(F.lit("m"), k).alias("media_id"))).alias("media"),
    )
    candidate = F.struct(
        F.lit("generic.digest_blocks").alias("parser_key"), F.lit("1").alias("parser_version"), F.lit("digest_blocks").alias("parser_family"), F.concat(F.lit("spc_"), k).alias("candidate_id"),
        (c("o_orderkey") % 4).cast("int").alias("index"), (c("o_custkey") % 100).cast("int").alias("score"), F.array(F.lit("kept"), F.lit("scored")).alias("reasons"), F.array(c("o_orderstatus")).alias("signals"),
        F.create_map(F.lit("currency"), F.lit("USD")).alias("defaults"), F.array(F.lit("price")).alias("required_fields"), F.array().cast("array<string>").alias("prompt_hints"),
        F.create_map(F.lit("blocks"), c("o_orderstatus")).alias("diagnostics"), F.concat(F.lit("post:"), k, F.lit(":candidate:"), k).alias("idempotency_key"), F.upper("o_orderstatus").alias("cleaned_text"),
        (c("o_orderkey") % 5 != 0).alias("include_media"),
    )
    return t.table(spark, d, "orders").select("o_orderkey", raw.alias("raw"), candidate.alias("candidate"))


@query("prj04_queue_metadata", """select o_orderkey, '{"decision":"emit","mode":"shadow","parser_key":"generic.digest_blocks","parser_version":"1","parser_family":"digest_blocks","candidate_id":"spc_' || o_orderkey || '","candidate_index":' || o_orderkey % 4 || ',"candidate_count":4,"score":' || o_custkey % 100 ||
  ',"reasons":["parsed","kept","scored"],"signals":["' || o_orderstatus || '"],"defaults":{"currency":"USD"},"required_fields":["price"],"prompt_hints":[],"diagnostics":{"family":"digest","blocks":"' || o_orderstatus || '"},"provenance":' || """ + RAW_SQL + """ || ',"shadow":{"decision":"drop"}}' as metadata from orders""")
def queue_metadata(spark, d):
    rows = _raw_events(spark, d)
    told = hints.queue_metadata(
        c("candidate"), c("raw"), F.lit(4), F.lit("emit"), F.lit("shadow"), F.array(F.lit("parsed"), F.lit("kept")), F.create_map(F.lit("family"), F.lit("digest"), F.lit("blocks"), F.lit("none")), F.struct(F.lit("drop").alias("decision"))
    )
    return rows.select("o_orderkey", F.to_json(told, {"ignoreNullFields": "false"}).alias("metadata"))


@query("prj03_events_with_provenance", """select o_orderkey, 'post:' || o_orderkey || ':candidate:' || o_orderkey as idempotency_key, o_orderstatus as text, case when iso then o_orderkey || '::candidate::' || o_orderkey % 4 else o_orderkey::varchar end as source_message_id, o_orderkey || ',x' as message_ids,
  case when o_orderkey % 5 = 0 then 0 else 1 end::bigint as media, 'generic.digest_blocks' as parser_key, 'post:' || o_orderkey as raw_event_id, o_orderkey::varchar as raw_message_id, iso as reorder_sensitive, case when o_orderkey % 2 = 0 then o_custkey::varchar end as forwarded
  from (select *, o_orderkey % 3 = 1 as iso from orders)""")
def candidate_events(spark, d):
    event = hints.candidate_event(c("candidate"), c("raw"), c("o_orderkey") % 3 == 1)
    rows = _raw_events(spark, d).select("o_orderkey", event.alias("e"))
    p = "e.parser_provenance"
    return rows.select(
        "o_orderkey", "e.idempotency_key", "e.text", "e.source_message_id", F.array_join("e.source_message_ids", ",").alias("message_ids"), F.size("e.media").cast("bigint").alias("media"), "e.parser_key",
        f"{p}.raw_event_id", c(f"{p}.raw_source_message_id").alias("raw_message_id"), c(f"{p}.source_identity_reorder_sensitive").alias("reorder_sensitive"), c(f"{p}.raw_forward_metadata.message").alias("forwarded"),
    )


def _entry(name: str) -> str:
    weight = dedup.Scoring().weights[name]
    return f"""'{{"name":"{name}","weight":{weight},"matched":' || {name} || ',"reason":"{name}_' || case when {name} then 'matched' else 'differs' end || '"}}'"""


@query("dml06_decision_breakdowns", SCORED + "select incoming, candidate, score, decision, '[' || " + " || ',' || ".join(map(_entry, SIGNALS)) + " || ']' as breakdown from decided")
def decision_breakdowns(spark, d):
    best = dedup.best_candidates(_scored(spark, d))
    signals = [n for n in dedup.Scoring().weights if n in best.columns]
    return reviews.decision_log(best.withColumn("decision", dedup.decision(set(signals))), {n: w for n, w in dedup.Scoring().weights.items() if n in SIGNALS})


@query("dml07_review_ids", """select h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(('0x' || h[17:17])::int % 4) + 1] || h[18:20] || '-' || h[21:32] as review_id, announcement_id, reason, 'pending' as status
  from (select *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('review:' || announcement_id || ':' || reason)) as h
    from (select announcement_id, case when monthly is null then 'price_missing' else 'possible_duplicate' end as reason from listings where status = 'manual_review' and announcement_id % 3 <> 0))""")
def review_ids(spark, d):
    reason = F.when(c("monthly").isNull(), "price_missing").otherwise("possible_duplicate")
    rows = t.listings(spark, d).where("status = 'manual_review'").select("announcement_id", reason.alias("reason"), F.lit("review").alias("route"))
    return reviews.queued_reviews(rows.unionByName(rows), rows.where("announcement_id % 3 = 0"))


@query("src19_bulk_of_several", "select user_id, event_id * 10 + k as message_id, 'deleted' as event_type from events, range(3) t(k) where event_type in ('error', 'view') and k < event_id % 4")
def bulk_of_several(spark, d):
    """Bulk deletions of none to three messages."""
    ids = F.filter(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.when(k < c("event_id") % 4, c("event_id") * 10 + k)), lambda x: x.isNotNull())
    gone = t.table(spark, d, "events").where("event_type in ('error', 'view')").select(c("user_id").alias("channel_id"), ids.alias("deleted_ids"))
    return messages.deletions(gone).select(c("channel_id").alias("user_id"), "message_id", "event_type")


@query("dml26_touched_users", """with s as (select c_custkey as user_id, 'u' || lpad(c_custkey::varchar, 10, '0') as referral_code, case when c_custkey % 9 = 0 then 'blocked' else 'active' end as status, timestamp '2023-01-01' as created_at, timestamp '2023-06-01' as updated_at from customer where c_custkey % 2 = 0),
  v as (select user_id, min(ts) as a, max(ts) as b from events group by 1)
  select user_id, coalesce(referral_code, 'u' || lpad(user_id::varchar, 10, '0')) as referral_code, coalesce(status, 'active') as status, coalesce(created_at, a) as created_at, greatest(updated_at, b) as updated_at from s full join v using (user_id)""")
def touched_users(spark, d):
    k = c("c_custkey")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    stored = t.table(spark, d, "customer").where(k % 2 == 0).select(k.alias("user_id"), F.format_string("u%010d", k).alias("referral_code"), F.when(k % 9 == 0, "blocked").otherwise("active").alias("status"), at("2023-01-01").alias("created_at"), at("2023-06-01").alias("updated_at"))
    return lifecycle.touched_users(stored, t.table(spark, d, "events").select("user_id", c("ts").cast("timestamp_ntz").alias("at")))


def _sources_asked(spark, d):
    k = c("s_suppkey")
    s = t.table(spark, d, "supplier")
    stored = s.where(k % 3 != 0).select(k.alias("source"), (k % 4 != 1).alias("enabled"), F.when(k % 7 == 0, F.lit("2024-01-01")).alias("deleted_at"))
    return lifecycle.create_or_enable(stored, s.where(k % 2 == 0).select(k.alias("source")).union(s.where(k % 6 == 0).select(k)), "source")


@query("dml27_requested_sources", "select s_suppkey as source, case when s_suppkey % 3 = 0 then 'created' when s_suppkey % 4 = 1 or s_suppkey % 7 = 0 then 'enabled' else 'unchanged' end as result from supplier where s_suppkey % 2 = 0")
def requested_sources(spark, d):
    return _sources_asked(spark, d)[1]


@query("dml27_sources_after", "select s_suppkey as source, s_suppkey % 2 = 0 or s_suppkey % 4 <> 1 as enabled, case when s_suppkey % 2 <> 0 and s_suppkey % 7 = 0 then '2024-01-01' end as deleted_at from supplier where s_suppkey % 3 <> 0 or s_suppkey % 2 = 0")
def sources_after(spark, d):
    return _sources_asked(spark, d)[0]


@query("dml28_guarded_events", """with p as (select user_id, max(value > 50) as published from events where event_type = 'purchase' group by 1)
  select event_id, case when published then 'return' when not published then 'publish_only' else 'process' end as action from events left join p using (user_id) where event_type = 'view'""")
def guarded_events(spark, d):
    """Views of users with purchases, the runs that succeeded; other runs count for nothing."""
    e = t.table(spark, d, "events")
    runs = e.where("event_type <> 'view'").select("user_id", F.when(c("event_type") == "purchase", "succeeded").otherwise("failed").alias("status"), (c("value") > 50).alias("published"))
    return lifecycle.replay_guard(e.where("event_type = 'view'").select("event_id", "user_id"), runs, "user_id").select("event_id", "action")


TAG_SQL = """with recursive a as (select p_type as tag, case p_partkey % 4 when 0 then 'approve' when 1 then 'reject' else 'upsert_pending' end as action, p_partkey as seq, p_brand || p_size % 7 as k from part),
  f as (select * from (select *, row_number() over (partition by k order by seq) as n from a) where n = 1 and k not in (select p_brand || '3' from part)),
  o as (select *, row_number() over (partition by tag order by seq) as i from f),
  r as (select tag, 0::bigint as i, case when tag like '%A%' then 'approved' end as status, null::varchar as k, false as changed, null::varchar as action from (select distinct p_type as tag from part)
    union all select r.tag, o.i, case when o.action = 'upsert_pending' then coalesce(r.status, 'pending') when r.status is null then null when o.action = 'approve' then 'approved' else 'rejected' end, o.k,
      case when o.action = 'upsert_pending' then r.status is null else r.status is not null end, o.action from r join o on o.tag = r.tag and o.i = r.i + 1)"""


def _tags(spark, d):
    k = c("p_partkey")
    part = t.table(spark, d, "part")
    asked = part.select(c("p_type").alias("tag"), F.when(k % 4 == 0, "approve").when(k % 4 == 1, "reject").otherwise("upsert_pending").alias("action"), k.alias("seq"), F.concat("p_brand", (c("p_size") % 7).cast("string")).alias("request_key"))
    stored = part.where("p_type like '%A%'").select(c("p_type").alias("tag")).distinct().withColumn("status", F.lit("approved"))
    return lifecycle.tag_changes(stored, asked, part.select(F.concat("p_brand", F.lit("3")).alias("request_key")).distinct())


@query("dml14_tags_after", TAG_SQL + " select tag, max_by(status, i) as status from r group by 1 having max_by(status, i) is not null")
def tags_after(spark, d):
    return _tags(spark, d)[0]


@query("dml14_tag_audit", TAG_SQL + " select k as request_key, tag, action, changed from r where i > 0")
def tag_audit(spark, d):
    return _tags(spark, d)[1]


#: Events as actions on their user's filters; four filters an user at most, so that the limit is met.
FILTER_SQL = """with recursive a as (select user_id, event_id as seq, case event_type when 'click' then 'update' when 'error' then 'delete' else 'create' end as action, 'f' || event_id % 7 as f, case when event_id % 9 = 0 then ' ' else ' n' || event_id || ' ' end as name,
    case when event_id % 2 = 0 then 'c' || event_id end as criteria, case when event_id % 3 = 0 then false end as enabled, row_number() over (partition by user_id order by event_id) as n from events),
  r as (select user_id, 0::bigint as n, null::bigint as seq, null::varchar as action, null::varchar as result, map([]::varchar[], []::struct(name varchar, criteria varchar, enabled boolean, seq bigint)[]) as m from (select distinct user_id from events)
    union all select user_id, n, seq, action, result, case result when 'created' then map_concat(m, map([f], [{'name': trim(name), 'criteria': criteria, 'enabled': true, 'seq': seq}]))
      when 'updated' then map_concat(m, map([f], [{'name': trim(name), 'criteria': coalesce(criteria, b.criteria), 'enabled': coalesce(enabled, b.enabled), 'seq': seq}])) when 'deleted' then map_from_entries(list_filter(map_entries(m), lambda e: e.key <> f)) else m end
    from (select *, case when action = 'create' then case when trim(name) = '' then 'invalid_name' when b is not null then 'exists' when cardinality(m) >= 4 then 'limit_reached' else 'created' end
        when b is null then 'not_found' when action = 'delete' then 'deleted' when trim(name) = '' then 'invalid_name' else 'updated' end as result
      from (select a.*, r.m, r.m[a.f] as b from r join a on a.user_id = r.user_id and a.n = r.n + 1)))"""


def _changed(spark, d):
    k = c("event_id")
    action = F.when(c("event_type") == "click", "update").when(c("event_type") == "error", "delete").otherwise("create")
    asked = t.table(spark, d, "events").select(
        "user_id", k.alias("seq"), action.alias("action"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("filter_id"), F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit(" n"), k.cast("string"), F.lit(" "))).alias("name"),
        F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("criteria"), F.when(k % 3 == 0, F.lit(False)).alias("enabled"),
    )
    none = spark.createDataFrame([], f"user_id bigint, {filters.FILTER}")
    return filters.changed_filters(none, asked, most=4)


@query("dml22_filter_results", FILTER_SQL + " select user_id, seq, action, result from r where n > 0")
def filter_results(spark, d):
    return _changed(spark, d)[1]


@query("dml22_filters_after", FILTER_SQL + """, z as (select user_id, max_by(m, n) as m from r group by 1)
  select user_id, e.key as filter_id, e.value.name as name, e.value.criteria as criteria, e.value.enabled as enabled, e.value.seq as updated_seq from (select user_id, unnest(map_entries(m)) as e from z)""")
def filters_after(spark, d):
    return _changed(spark, d)[0].drop("created_seq")


def staged_call(model: str, text: str) -> str:
    """Stands in for a model: what it does depends on the length of the text and the model's number."""
    k = (len(text) + int(model[1:])) % 5
    if k == 0:
        raise models.TransportError("busy", retryable=len(text) % 7 != 0)
    if k == 1:
        raise models.MalformedAnswer("no object")
    return f"{model}:{k}"


def staged_verdict(response: str) -> models.Verdict:
    k = int(response[-1])
    return models.Verdict("low_quality", "missing_fields", True, True, (k % 2,)) if k < 4 else models.by_confidence(0.9, 0.5)


#: The calls of three models by the length of the text, one after the other.
COMPLETED_SQL = """with x as (select p_partkey, length(p_name) as n from part), s as (select p_partkey, n, m, (n + m) % 5 as k from x, range(1, 4) t(m)),
  ends as (select p_partkey, min(m) as stop from s where k = 4 or k = 0 and n % 7 = 0 group by 1),
  made as (select s.*, coalesce(stop, 3) as stop from s left join ends using (p_partkey) where m <= coalesce(stop, 3)),
  best as (select p_partkey, coalesce(max(case when k = 4 then m end), max_by(m, (k % 2, -m)) filter (k in (2, 3))) as chosen from made group by 1)
  select p_partkey, chosen, string_agg(case when k = 0 and n % 7 = 0 then 'non_retryable_transport_error' when k = 0 then 'retryable_transport_error' when k = 1 then 'malformed_response' when k = 4 then 'confidence_threshold_met' else 'missing_fields' end, ',' order by m) as reasons,
    coalesce(max(case when m = chosen then 'm' || m || ':' || k end), '') as response from made join best using (p_partkey) group by 1, 2"""


@query("ext05_fallback_models", "select p_partkey, 'm' || chosen as model, reasons, response from (" + COMPLETED_SQL + ")")
def fallback_models(spark, d):
    """Good answers, busy models that may and may not be asked again, answers that can't be read, and the best of poor ones."""
    rows = t.table(spark, d, "part").select("p_partkey", c("p_name").alias("text"))
    told = models.complete(rows, ["m1", "m2", "m3"], staged_call, staged_verdict)
    return told.select("p_partkey", "model", F.array_join(F.transform("attempts", lambda a: a["reason"]), ",").alias("reasons"), F.coalesce("response", F.lit("")).alias("response"))


@query("win09_send_limits", """with recursive o as (select event_id, user_id % 20 as u, ts, row_number() over (order by ts, event_id) as n from events),
  r as (select 0::bigint as n, null::bigint as event_id, null::boolean as allowed, null::double as retry_after, null::timestamp as last, map([]::bigint[], []::timestamp[]) as users
    union all select n, event_id, wait <= 0, case when wait > 0 then wait end, case when wait <= 0 then ts else last end, case when wait <= 0 then map_concat(users, map([u], [ts])) else users end
    from (select o.*, r.last, r.users, greatest(coalesce(epoch_us(r.last) + 30000000 - epoch_us(o.ts), 0), coalesce(epoch_us(r.users[o.u]) + 3600000000 - epoch_us(o.ts), 0)) / 1000000.0::double as wait from r join o on o.n = r.n + 1))
  select event_id, allowed, retry_after from r where n > 0""")
def send_limits(spark, d):
    """An hour between sends to one of twenty users, half a minute between any two."""
    rows = t.table(spark, d, "events").select("event_id", (c("user_id") % 20).alias("u"), "ts")
    return sending.send_limited(rows, "u", ["event_id"], "ts", per_user=3_600, overall=30).select("event_id", "allowed", "retry_after")
