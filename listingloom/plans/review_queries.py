"""Queries on single signals, projections, review and snapshot writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.functions import text
from listingloom.functions.similarity import bits64, least_apart
from listingloom.operators import dedup, joins, lifecycle, parsing, reviews
from listingloom.plans.dedup_queries import SCORED, _scored
from listingloom.plans.parsing_queries import SEGMENTS, digests
from listingloom.plans.registry import query
from listingloom.sources import plugins
from listingloom.sources import tables as t

c = F.col


def signal(number: int, name: str) -> None:
    """Pairs on which one matcher of the scorer fires."""

    def run(spark, d):
        return _scored(spark, d, name).where(name).select("incoming", "candidate")

    query(f"ded{number:02d}_{name}_pairs", SCORED + f"select incoming, candidate from scored where {name}")(run)


for _number, _name in ((5, "same_image"), (7, "rooms"), (8, "area"), (9, "price"), (10, "floor"), (11, "similar_address"), (12, "similar_description"), (13, "phone")):
    signal(_number, _name)


@query("ded04_forward_origin_classes", """with k as (select forward_key, min(post_id) as candidate, count(*) as posts from posts where forward_key is not null group by 1)
  select post_id as incoming, candidate, posts from posts join k using (forward_key) where candidate < post_id""")
def forward_classes(spark, d):
    """Posts whose forward origin an earlier post has: the first of the class, and how many posts the class has. Pairs follow from the class."""
    p = t.posts(spark, d).where("forward_key is not null").select("post_id", "forward_key")
    first = p.groupBy("forward_key").agg(F.min("post_id").alias("candidate"), F.count("*").alias("posts"))
    rows = p.alias("l").join(first.withColumnRenamed("candidate", "post_id").alias("r"), dedup.MATCHERS["forward_origin"](dedup.Scoring()) & (c("l.forward_key") == c("r.forward_key")))
    return rows.where("r.post_id < l.post_id").select(c("l.post_id").alias("incoming"), c("r.post_id").alias("candidate"), "r.posts")


@query("agg14_weighted_score", SCORED + "select incoming, candidate, score from scored")
def weighted(spark, d):
    return _scored(spark, d).select("incoming", "candidate", "score")


@query("ded15_anchors", SCORED + """select incoming, candidate, source_url or same_image or identity or phone and similar_address and similar_description as strong,
  phone and district and rooms and area and price and floor as identity from scored""")
def anchors(spark, d):
    s = _scored(spark, d)
    identity = c("phone") & c("district") & c("rooms") & c("area") & c("price") & c("floor")
    strong = c("source_url") | c("same_image") | identity | (c("phone") & c("similar_address") & c("similar_description"))
    return s.select("incoming", "candidate", strong.alias("strong"), identity.alias("identity"))


@query("ded16_routes", SCORED + """select p.announcement_id as incoming, case when coalesce(b.decision, 'new') in ('exact_duplicate', 'high_confidence_duplicate') then 'merge'
  when b.decision = 'possible_duplicate' then 'review' else 'new_parent' end as route from p left join decided b on b.incoming = p.announcement_id""")
def routes(spark, d):
    decided = dedup.evaluate(t.listings(spark, d), t.media(spark, d), phones=False).withColumn("status", F.lit("active"))
    return reviews.routed(decided).select("incoming", "route")


@query("ded18_persisted_events", "select announcement_id, '{\"announcement_id\":' || announcement_id || ',\"district\":\"' || district || '\"}' as payload from listings where status = 'active' and parent_id is null")
def persisted(spark, d):
    return t.listings(spark, d).where("status = 'active' and parent_id is null").select("announcement_id", F.to_json(F.struct("announcement_id", "district")).alias("payload"))


@query("fil22_feature_gate", "select event_id from events where event_type = 'view' and exists (select 1 from region where r_name = (select min(r_name) from region))")
def feature_gate(spark, d):
    flags = t.table(spark, d, "region").select(c("r_name").alias("flag_name"), F.lit(True).alias("enabled"))
    least = t.table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return plugins.gate(t.table(spark, d, "events").where("event_type = 'view'").select("event_id"), flags, least)


@query("fil25_comparable_prices", """select l.announcement_id as a, coalesce(l.price_basis = 'total' and r.price_basis = 'total' and l.price_period <> 'one_time' and r.price_period <> 'one_time' and l.currency = r.currency and l.monthly is not null and r.monthly is not null, false) as comparable
  from listings l join listings r on r.announcement_id = l.announcement_id + 2""")
def comparable(spark, d):
    from listingloom.operators.predicates import prices_comparable

    rows = t.listings(spark, d)
    pairs = rows.alias("l").join(rows.alias("r"), c("r.announcement_id") == c("l.announcement_id") + 2)
    return pairs.select(c("l.announcement_id").alias("a"), prices_comparable().alias("comparable"))


@query("prj02_nested_record", "select announcement_id, cast(price as double) as price, rooms, district from listings")
def nested(spark, d):
    rows = t.listings(spark, d).select("announcement_id", F.struct(c("price").cast("double").alias("price"), "rooms", "district").alias("canonical"))
    return rows.select("announcement_id", "canonical.*")


@query("prj03_candidate_events", f"with {SEGMENTS} select post_id, index, segment as text, post_id || '::candidate::' || index as message_id from told where policy = 'emit'")
def candidate_events(spark, d):
    rows = parsing.parse(digests(spark, d), parsing.RECIPES["generic.digest_blocks"]).where("policy = 'emit'")
    return rows.select("post_id", "index", c("segment").alias("text"), F.concat_ws("::", c("post_id").cast("string"), F.lit("candidate"), c("index").cast("string")).alias("message_id"))


@query("prj04_candidate_metadata", f"with {SEGMENTS} select post_id, index, '{{\"index\":' || index || ',\"reason\":\"candidate_accepted\"}}' as metadata from told where policy = 'emit'")
def candidate_metadata(spark, d):
    rows = parsing.parse(digests(spark, d), parsing.RECIPES["generic.digest_blocks"]).where("policy = 'emit'")
    return rows.select("post_id", "index", F.to_json(F.struct("index", "reason")).alias("metadata"))


@query("prj07_criteria_tags", "select filter_id, tag from (select filter_id, unnest([district, case when rooms is not null then rooms || ' rooms' end, 'up to ' || cast(max_price as bigint)]) as tag from saved_filters) where tag is not null")
def criteria_tags(spark, d):
    tags = F.array_compact(F.array("district", F.concat(c("rooms").cast("string"), F.lit(" rooms")), F.concat(F.lit("up to "), c("max_price").cast("bigint").cast("string"))))
    return t.saved_filters(spark, d).select("filter_id", F.explode(tags).alias("tag"))


@query("par09_digest_preamble", f"with {SEGMENTS} select post_id, count(*) as segments, 1 as preambles from seg group by 1")
def preamble(spark, d):
    posts = digests(spark, d).withColumn("text", F.concat(F.lit("Listings of today\n"), "text"))
    rows = parsing.parse(posts, parsing.RECIPES["generic.digest_blocks"])
    return rows.groupBy("post_id").agg((F.count("*") - 1).alias("segments"), F.count_if(c("reason") == "digest_preamble").cast("int").alias("preambles"))


@query("par10_minimum_score", f"with {SEGMENTS} select post_id, index, case when policy <> 'emit' then policy when score < 60 then 'quarantine' else 'emit' end as policy from told")
def minimum_score(spark, d):
    import dataclasses

    strict = dataclasses.replace(parsing.RECIPES["generic.digest_blocks"], min_score=60)
    return parsing.parse(digests(spark, d), strict).select("post_id", "index", "policy")


@query("set02_phone_intersection", """with p as (select announcement_id, unnest([phone, '+998' || lpad(cast(announcement_id % 500 as varchar), 9, '8')]) as phone from listings),
  f as (select phone, min(announcement_id) as one from p group by 1)
  select announcement_id, min(one) as earlier, count(*) as shared from p join f using (phone) where one < announcement_id group by 1""")
def phones(spark, d):
    """Every listing with two phones: the first earlier listing that has any of them, and how many of its phones an earlier one has."""
    second = F.concat(F.lit("+998"), F.lpad((c("announcement_id") % 500).cast("string"), 9, "8"))
    rows = t.listings(spark, d).select("announcement_id", F.explode(F.array("phone", second)).alias("phone"))
    first = rows.groupBy("phone").agg(F.min("announcement_id").alias("one"))
    return rows.join(first, "phone").where("one < announcement_id").groupBy("announcement_id").agg(F.min("one").alias("earlier"), F.count("*").alias("shared"))


@query("set03_tokens_without_phones", "select announcement_id, len(list_distinct(string_split(description, ' '))) as n from listings")
def without_phones(spark, d):
    tokens = F.array_except(F.split(F.concat_ws(" ", "description", "phone"), " "), F.array("phone"))
    return t.listings(spark, d).select("announcement_id", F.size(tokens).cast("bigint").alias("n"))


@query("set09_ordered_distinct", "select p_partkey, case when p_brand = p_type then p_brand else p_brand || ',' || p_type end as names from part")
def ordered_distinct(spark, d):
    return t.table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.array("p_brand", "p_type", "p_brand")), ",").alias("names"))


@query("dml02_save_parent", """select announcement_id from (select *, row_number() over (partition by source_id, district, floor order by announcement_id) as n from listings where created_at >= timestamp '1998-01-01') b
  where n = 1 and not exists (select 1 from listings s where s.created_at < timestamp '1998-01-01' and s.source_id = b.source_id and s.district = b.district and s.floor = b.floor)""")
def save_parent(spark, d):
    """Listings since 1998 come in; the earlier ones are stored."""
    rows = t.listings(spark, d).select("announcement_id", "source_id", "district", "floor", (c("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("stored"))
    return lifecycle.absent_rows(rows.where("stored"), rows.where("not stored"), ["source_id", "district", "floor"], c("announcement_id")).select("announcement_id")


@query("dml03_link_children", """with every as (select announcement_id, source_id, created_at from listings where parent_id is null union all
    select parent_id, source_id, created_at from listings where parent_id in (select announcement_id from listings where parent_id is null))
  select announcement_id, greatest(1, count(*)) as source_count, max_by(source_id, (created_at, source_id)) as latest_source_id from every group by 1""")
def link_children(spark, d):
    rows = t.listings(spark, d)
    return reviews.linked(rows.where("parent_id is null"), rows.where("parent_id is not null"))


@query("dml05_media_insert", "select announcement_id, media_id from media where media_id > 3")
def media_insert(spark, d):
    m = t.media(spark, d)
    return lifecycle.absent_rows(m.where("media_id <= 3"), m, ["announcement_id", "media_id"], c("phash")).select("announcement_id", "media_id")


@query("dml06_decision_log", SCORED + "select incoming, '{\"score\":' || score || ',\"decision\":\"' || decision || '\"}' as entry from decided")
def decision_log(spark, d):
    told = dedup.evaluate(t.listings(spark, d), t.media(spark, d), phones=False).where("candidate is not null")
    return told.select("incoming", F.to_json(F.struct("score", "decision")).alias("entry"))


@query("dml07_review_items", "select announcement_id, case when monthly is null then 'price_missing' else 'possible_duplicate' end as reason from listings where status = 'manual_review' and announcement_id % 3 <> 0")
def items(spark, d):
    reason = F.when(c("monthly").isNull(), "price_missing").otherwise("possible_duplicate")
    rows = t.listings(spark, d).where("status = 'manual_review'").select("announcement_id", reason.alias("reason"), F.lit("review").alias("route"))
    return reviews.review_items(rows, rows.where("announcement_id % 3 = 0"))


def _actions(spark, d):
    k = c("event_id")
    names = F.create_map(*(F.lit(x) for x in ("view", "update", "click", "approve", "purchase", "reject", "error", "merge", "signup", "update")))
    return t.table(spark, d, "events").select(c("user_id").alias("review_id"), k.alias("seq"), names[c("event_type")].alias("action"), (k % 50).cast("string").alias("idempotency_key"), F.when(k % 4 == 0, "pending").alias("expected_status"))


@query("dml08_review_actions", """with recursive o as (select user_id, event_id % 50 as k, event_id % 4 = 0 as pending_only, case event_type when 'click' then 'approve' when 'purchase' then 'reject' when 'error' then 'merge' else 'update' end as action,
    row_number() over (partition by user_id order by event_id) as n from events),
  r as (select distinct user_id, 0::bigint as n, 'pending' as status, 0::bigint as applied, []::bigint[] as seen from o
    union all select x.user_id, x.n, coalesce(x.next, x.status), x.applied + (x.next is not null)::int, case when x.next is null then x.seen else list_append(x.seen, x.k) end
    from (select o.user_id, o.n, o.k, r.status, r.applied, r.seen, case when not list_contains(r.seen, o.k) and r.status = 'pending' then case o.action when 'update' then 'pending' when 'approve' then 'approved' when 'merge' then 'merged' else 'rejected' end end as next
      from r join o on o.user_id = r.user_id and o.n = r.n + 1) x)
  select user_id as review_id, max_by(status, n) as status, max_by(applied, n) as applied from r group by 1""")
def review_actions(spark, d):
    return reviews.final_status(reviews.applied_actions(_actions(spark, d), reviews.REVIEW, "pending", "review_id"), "review_id")


@query("dml18_suggestions", """with recursive o as (select user_id, case event_type when 'click' then 'approve' when 'purchase' then 'reject' else 'submit' end as action, row_number() over (partition by user_id order by event_id) as n from events),
  r as (select distinct user_id, 0::bigint as n, 'new' as status, 0::bigint as applied from o
    union all select x.user_id, x.n, coalesce(x.next, x.status), x.applied + (x.next is not null)::int from (select o.user_id, o.n, r.status, r.applied,
      case when r.status in ('new', 'rejected') and o.action = 'submit' then 'pending' when r.status = 'pending' and o.action = 'approve' then 'approved' when r.status = 'pending' and o.action = 'reject' then 'rejected' end as next
      from r join o on o.user_id = r.user_id and o.n = r.n + 1) x)
  select user_id as suggestion, max_by(status, n) as status, max_by(applied, n) as applied from r group by 1""")
def suggestions(spark, d):
    names = F.create_map(*(F.lit(x) for x in ("view", "submit", "click", "approve", "purchase", "reject", "error", "submit", "signup", "submit")))
    rows = t.table(spark, d, "events").select(c("user_id").alias("suggestion"), c("event_id").alias("seq"), names[c("event_type")].alias("action"), c("event_id").cast("string").alias("idempotency_key"), F.lit(None).cast("string").alias("expected_status"))
    return reviews.final_status(reviews.applied_actions(rows, reviews.SUGGESTION, "new", "suggestion"), "suggestion")


@query("dml09_manual_update", "select announcement_id, case when announcement_id % 50 = 0 then 9 else rooms end as rooms from listings")
def manual_update(spark, d):
    rows = t.listings(spark, d).select("announcement_id", "rooms")
    edits = rows.where("announcement_id % 50 = 0").select("announcement_id", F.lit(9).alias("new_rooms"))
    return lifecycle.update_from(rows, edits, ["announcement_id"], {"rooms": c("new_rooms")})


@query("dml12_parser_backfill", "select s_suppkey, case when s_suppkey % 3 = 0 then 'generic.digest_blocks' when s_suppkey % 3 = 1 then 'generic.album_caption' else 'generic.single_listing' end as parser_key from supplier")
def parser_backfill(spark, d):
    k = c("s_suppkey")
    profile = F.when(k % 3 == 0, "digest_blocks").when(k % 3 == 1, "album_text_merge").otherwise("passthrough")
    return t.table(spark, d, "supplier").select("s_suppkey", parsing.resolve_recipe(F.lit(None).cast("string"), profile).alias("parser_key"))


@query("dml14_pending_tags", "select lower(p_type) as tag, min(p_partkey) as first_seen from part where p_type not in ('PROMO', 'LARGE') group by 1")
def pending_tags(spark, d):
    asked = t.table(spark, d, "part").select(text.tag_key(c("p_type")).alias("tag"), c("p_partkey").alias("first_seen"))
    known = asked.where("tag in ('promo', 'large')").select("tag")
    return lifecycle.absent_rows(known, asked, ["tag"], c("first_seen"))


@query("dml27_create_or_enable", "select s_suppkey, s_suppkey % 3 = 0 as created, true as enabled from supplier")
def create_or_enable(spark, d):
    s = t.table(spark, d, "supplier").select("s_suppkey")
    known = s.where("s_suppkey % 3 <> 0").withColumn("known", F.lit(True))
    return s.join(known, "s_suppkey", "left").select("s_suppkey", c("known").isNull().alias("created"), F.lit(True).alias("enabled"))


@query("dml28_replay_guard", "select event_id, case when event_id % 3 = 0 then 'return' when event_id % 3 = 1 then 'publish_only' else 'process' end as action from events")
def replay_guard(spark, d):
    e = t.table(spark, d, "events").select("event_id")
    done = e.where("event_id % 3 <> 2").select("event_id", (c("event_id") % 3 == 0).alias("published"))
    action = F.when(c("published"), "return").when(~c("published"), "publish_only").otherwise("process")
    return e.join(done, "event_id", "left").select("event_id", action.alias("action"))


@query("mat07_whole_units", "select announcement_id, cast(case when cents % 100 > 50 or cents % 100 = 50 and (cents // 100) % 2 = 1 then cents // 100 + 1 else cents // 100 end as bigint) as units from (select announcement_id, cast(monthly * 100 as bigint) as cents from listings where monthly is not null)")
def whole_units(spark, d):
    return t.listings(spark, d).where("monthly is not null").select("announcement_id", F.bround("monthly", 0).cast("bigint").alias("units"))


@query("dat02_bucket_start", "select event_id, date_trunc('hour', ts) as hour, date_trunc('day', ts) as day from events")
def buckets(spark, d):
    return t.table(spark, d, "events").select("event_id", *(F.date_trunc(u, "ts").cast("timestamp_ntz").alias(u) for u in ("hour", "day")))


@query("dat03_naive_as_utc", "select event_id, epoch_us(ts) as micros from events")
def naive(spark, d):
    return t.table(spark, d, "events").select("event_id", F.unix_micros(c("ts").cast("timestamp")).alias("micros"))


@query("arr02_any_pair_distance", """select a.announcement_id, min(bit_count(xor(('0x' || x.phash)::ubigint, ('0x' || y.phash)::ubigint)))::integer as distance
  from (select distinct announcement_id from media) a join media x on x.announcement_id = a.announcement_id join media y on y.announcement_id = a.announcement_id + 1 group by 1""")
def any_pair(spark, d):
    lists = t.media(spark, d).groupBy("announcement_id").agg(F.collect_list("phash").alias("h"))
    pairs = lists.alias("l").join(lists.alias("r"), c("r.announcement_id") == c("l.announcement_id") + 1)
    return pairs.select(c("l.announcement_id").alias("announcement_id"), least_apart(F.transform("l.h", bits64), F.transform("r.h", bits64)).alias("distance"))


@query("arr03_first_media", "select announcement_id, min_by(phash, media_id) as first_hash, count(*) as n from media group by 1")
def first_media(spark, d):
    lists = t.media(spark, d).groupBy("announcement_id").agg(F.array_sort(F.collect_list(F.struct("media_id", "phash"))).alias("m"))
    return lists.select("announcement_id", F.try_element_at("m", F.lit(1))["phash"].alias("first_hash"), F.size("m").cast("bigint").alias("n"))


@query("arr04_distinct_media", "select l_orderkey as announcement_id, count(distinct l_linenumber) as n from lineitem group by 1")
def distinct_media(spark, d):
    rows = t.table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("announcement_id")).agg(F.collect_list("l_linenumber").alias("m"))
    return rows.select("announcement_id", F.size(F.array_distinct("m")).cast("bigint").alias("n"))


@query("nrm02_search_extraction", "select filter_id, case when filter_id % 5 = 0 then null else lower(district) end as district, case when filter_id % 5 = 0 then 0 else 1 end + case when rooms is not null then 1 else 0 end as applied from saved_filters")
def search_extraction(spark, d):
    district = F.nullif(F.lower(F.trim(F.when(c("filter_id") % 5 == 0, "  ").otherwise(c("district")))), F.lit(""))
    rows = t.saved_filters(spark, d).select("filter_id", "rooms", district.alias("district"))
    return rows.select("filter_id", "district", (c("district").isNotNull().cast("int") + c("rooms").isNotNull().cast("int")).alias("applied"))


@query("nrm04_response_rank", "select user_id, max_by(event_id, (event_type = 'purchase', value, -event_id)) as chosen from events group by 1")
def response_rank(spark, d):
    rank = F.struct((c("event_type") == "purchase").alias("valid"), c("value").alias("quality"), (-c("event_id")).alias("first"))
    return joins.latest(t.table(spark, d, "events"), ["user_id"], rank, "event_id").withColumnRenamed("event_id", "chosen")


@query("nrm06_byte_cap", "select p_partkey, length(case when length(p_name) <= 8 then p_name else p_name[1:8] || sha256(p_name)[1:4] end) as n from part")
def byte_cap(spark, d):
    capped = F.when(F.length("p_name") <= 8, c("p_name")).otherwise(F.concat(F.substring("p_name", 1, 8), F.substring(F.sha2("p_name", 256), 1, 4)))
    return t.table(spark, d, "part").select("p_partkey", F.length(capped).cast("bigint").alias("n"))


@query("nrm08_parser_hints", "select p_partkey, p_name[1:5] as hint from part")
def hints(spark, d):
    given = F.create_map(F.lit("style"), c("p_name"), F.lit("unknown"), c("p_brand"))
    kept = F.map_filter(given, lambda k, v: k.isin("style", "language"))
    return t.table(spark, d, "part").select("p_partkey", F.transform_values(kept, lambda k, v: F.substring(v, 1, 5))["style"].alias("hint"))


@query("stm10_delivery_backoff", "select event_id, ts + case when event_type = 'error' then interval 300 seconds else interval 30 seconds end as due from events where event_type in ('error', 'click')")
def backoff(spark, d):
    wait = F.when(c("event_type") == "error", 300).otherwise(30)
    rows = t.table(spark, d, "events").where("event_type in ('error', 'click')")
    return rows.select("event_id", (c("ts") + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).alias("due"))


@query("stm14_daily_cap", """select cast(day as date) as day, kind from (select day, kind, row_number() over (partition by day order by seq) as n from (select cast(ts as date) as day, event_type as kind, min(event_id) as seq from events group by 1, 2)) where n <= 2""")
def daily_cap(spark, d):
    wanted = t.table(spark, d, "events").select(F.to_date("ts").alias("day"), c("event_type").alias("kind"), c("event_id").alias("seq"))
    return reviews.capped_posts(wanted, 2).select("day", "kind")


@query("stm16_event_type_keys", "select count(distinct doc_id || kind) as keys from documents, (values ('created'), ('edited')) k(kind)")
def type_keys(spark, d):
    kinds = t.table(spark, d, "documents").select("source", "doc_id", F.explode(F.array(F.lit("created"), F.lit("edited"))).alias("kind"))
    return kinds.select(text.event_key(c("kind"), c("source"), c("doc_id").cast("string")).alias("k")).distinct().agg(F.count("*").alias("keys"))


@query("ext01_parser_plugin", "select p_partkey, i - 1 as index, w as segment from (select p_partkey, unnest(string_split(p_name, ' ')) as w, generate_subscripts(string_split(p_name, ' '), 1) as i from part)")
def parser_plugin(spark, d):
    plugins.register_parser(spark, "words_plugin", lambda s: enumerate(s.split(" ")))
    t.table(spark, d, "part").createOrReplaceTempView("plugin_input")
    return spark.sql("select p_partkey, cast(w.index as bigint) as index, w.segment from plugin_input, lateral words_plugin(p_name) w")


@query("src02_update_projection", "select doc_id, 'post:created:' || source || ':' || doc_id as idempotency_key, length(text) as n from documents where trim(text) <> ''")
def update_projection(spark, d):
    docs = t.table(spark, d, "documents").where(F.trim("text") != "")
    return docs.select("doc_id", text.event_key(F.lit("created"), c("source"), c("doc_id").cast("string")).alias("idempotency_key"), F.length("text").cast("bigint").alias("n"))


@query("ded17_scoring_config", "select announcement_id, case when rooms >= 4 then 'exact_duplicate' when rooms = 3 then 'high_confidence_duplicate' else 'new' end as decision from listings")
def config(spark, d):
    rows = t.listings(spark, d).select("announcement_id", (c("rooms") * 30).alias("score"), F.lit(True).alias("same_image"))
    return rows.select("announcement_id", dedup.decision({"same_image"}, dedup.Scoring(exact=120, high=90, possible=999)).alias("decision"))


