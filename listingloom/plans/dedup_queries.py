"""Queries on weighted duplicate detection and merging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listingloom.functions import similarity
from listingloom.operators import dedup, linking
from listingloom.plans.registry import query
from listingloom.sources import tables as t

#: Parents, pairs that share any blocking key within the look-back, the newest fifty of them, and all signals, in SQL.
SCORED = """with p as (
  select *, list_distinct(list_filter(regexp_split_to_array(lower(address), '[^a-z0-9$+]+'), lambda x: x <> '')) as at,
    list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9$+]+'), lambda x: x <> '')) as dt,
    coalesce((select list(distinct phash) from media m where m.announcement_id = l.announcement_id), []) as h
  from listings l where status = 'active' and parent_id is null
), near as (
  select a.announcement_id as incoming, b.announcement_id as candidate, b.created_at as candidate_at from p a join p b
    on (b.created_at < a.created_at or b.created_at = a.created_at and b.announcement_id < a.announcement_id)
    and floor(epoch(a.created_at)) - floor(epoch(b.created_at)) <= 90 * 86400
    and (a.source_url = b.source_url or a.district = b.district or a.rooms = b.rooms or b.area between a.area - 3 and a.area + 3
      or a.price_period = b.price_period and a.price_basis = b.price_basis and a.currency = b.currency and b.monthly * 100 between a.monthly * 95 and a.monthly * 105
      or exists (select 1 from media x join media y on x.phash = y.phash where x.announcement_id = a.announcement_id and y.announcement_id = b.announcement_id))
), pairs as (
  select * from (select *, row_number() over (partition by incoming order by candidate_at desc, candidate desc) as place from near) where place <= 50
), signals as (
  select incoming, candidate, candidate_at, coalesce(l.source_url = r.source_url, false) as source_url,
    coalesce(list_min(flatten(list_transform(l.h, lambda x: list_transform(r.h, lambda y: bit_count(xor(('0x' || x)::ubigint, ('0x' || y)::ubigint)))))) <= 8, false) as same_image,
    l.district = r.district as district, l.rooms = r.rooms as rooms, abs(l.area - r.area) < 3 as area,
    coalesce(abs(l.monthly - r.monthly) * 100 <= greatest(l.monthly, r.monthly) * 5 and l.price_basis = 'total' and r.price_basis = 'total'
      and l.price_period <> 'one_time' and r.price_period <> 'one_time' and l.currency = r.currency, false) as price,
    l.floor = r.floor as floor,
    len(list_intersect(l.at, r.at)) >= 0.75 * len(list_distinct(l.at || r.at)) as similar_address,
    len(list_intersect(l.dt, r.dt)) >= 0.82 * len(list_distinct(l.dt || r.dt)) as similar_description, l.phone = r.phone as phone
  from pairs join p l on l.announcement_id = incoming join p r on r.announcement_id = candidate
), scored as (
  select *, source_url::int * 100 + same_image::int * 70 + district::int * 10 + rooms::int * 10 + area::int * 10 + price::int * 10 + floor::int * 5
    + similar_address::int * 15 + similar_description::int * 30 + phone::int * 15 as score,
    phone and district and rooms and area and price and floor as identity
  from signals
), best as (
  select * from (select *, row_number() over (partition by incoming order by score desc, candidate_at desc, candidate desc) as place from scored) where place = 1
), decided as (
  select *, case when source_url then 'exact_duplicate' when identity then 'high_confidence_duplicate'
    when score >= 100 and (same_image or phone and similar_address and similar_description) then 'exact_duplicate'
    when score >= 80 and (same_image or phone and similar_address and similar_description) then 'high_confidence_duplicate'
    when score >= 60 and (same_image or similar_address and similar_description
      or phone and similar_description and district::int + rooms::int + area::int + price::int + floor::int >= 2) then 'possible_duplicate' else 'new' end as decision
  from best
)
"""


def _scored(spark, d, *names: str):
    """Scored candidates, with the signals of ``names`` alone where given."""
    matchers = {n: dedup.MATCHERS[n] for n in names} or dedup.MATCHERS
    rows = dedup.ready(t.listings(spark, d).where("status = 'active' and parent_id is null"), t.media(spark, d), matchers)
    return dedup.scored_candidates(rows, matchers=matchers if names else None)


@query("join02_blocking_pairs", """with p as (select * from listings where status = 'active' and parent_id is null), keyed as (
  select 'u' || source_url as key, announcement_id, created_at from p where source_url is not null
  union all select 'p' || phone, announcement_id, created_at from p union all select 'd' || district || '/' || rooms, announcement_id, created_at from p
), near as (
  select distinct a.announcement_id as incoming, b.announcement_id as candidate, b.created_at as candidate_at from keyed a join keyed b on a.key = b.key
    and (b.created_at < a.created_at or b.created_at = a.created_at and b.announcement_id < a.announcement_id)
    and floor(epoch(a.created_at)) - floor(epoch(b.created_at)) <= 90 * 86400
), pairs as (select *, row_number() over (partition by incoming order by candidate_at desc, candidate desc) as place from near)
select incoming, count(*) as n, sum(candidate)::bigint as checksum from pairs where place <= 50 group by 1""")
def join02(spark, d):
    rows = t.listings(spark, d).where("status = 'active' and parent_id is null")
    told = dedup.newest_candidates(rows, dedup.listing_keys())
    total = F.aggregate("candidates", F.lit(None).cast("bigint"), lambda total, c: F.coalesce(total + c["candidate"], total, c["candidate"]))
    return told.select("incoming", F.size("candidates").cast("bigint").alias("n"), total.alias("checksum"))


@query("join02_all_keys", SCORED + "select incoming, count(*) as n, sum(candidate)::bigint as checksum from pairs group by 1")
def join02_all(spark, d):
    rows = dedup.ready(t.listings(spark, d).where("status = 'active' and parent_id is null"), t.media(spark, d), ())
    return dedup.all_candidates(rows).groupBy("incoming").agg(F.count("*").alias("n"), F.sum("candidate").alias("checksum"))


SIGNALS = ("source_url", "same_image", "district", "rooms", "area", "price", "floor", "similar_address", "similar_description", "phone")


@query("ded03_signal_matchers", SCORED + "select " + ", ".join(f"count(*) filter ({s}) as {s}" for s in SIGNALS) + ", count(*) as pairs, sum(score)::bigint as total_score from scored")
def ded03(spark, d):
    scored = _scored(spark, d)
    return scored.agg(*(F.count_if(s).alias(s) for s in SIGNALS), F.count("*").alias("pairs"), F.sum("score").alias("total_score"))


@query("ded14_decision_ladder", SCORED + """select p.announcement_id as incoming, b.candidate, coalesce(b.score, 0) as score, coalesce(b.decision, 'new') as decision,
  coalesce(array_to_string(list_filter([""" + ", ".join(f"case when b.{s} then '{s}' end" for s in SIGNALS) + """], lambda x: x is not null), ','), '') as matched
  from p left join decided b on b.incoming = p.announcement_id""")
def ded14(spark, d):
    return dedup.evaluate(t.listings(spark, d), t.media(spark, d), phones=False)


@query("win03_best_candidate", SCORED + "select incoming, candidate, score from best")
def win03(spark, d):
    return dedup.best_candidates(_scored(spark, d)).select("incoming", "candidate", "score")


@query("win05_newest_candidates", """select district, announcement_id from (select district, announcement_id, row_number() over (partition by district order by created_at desc, announcement_id desc) as n from listings) where n <= 50""")
def win05(spark, d):
    newest = Window.partitionBy("district").orderBy(F.col("created_at").desc(), F.col("announcement_id").desc())
    rows = t.listings(spark, d).select("district", "announcement_id", F.row_number().over(newest).alias("n"))
    return rows.where("n <= 50").drop("n")


@query("join03_range_join", """select a.announcement_id as a, b.announcement_id as b from listings a join listings b on a.district = b.district and a.rooms = b.rooms and a.floor = b.floor and a.announcement_id < b.announcement_id
  and abs(a.area - b.area) <= 3 and a.monthly between b.monthly * 0.95 and b.monthly * 1.05""")
def join03(spark, d):
    from listingloom.operators.joins import band_join

    rows = t.listings(spark, d).select("announcement_id", "district", "rooms", "floor", "area", "monthly")
    pairs = band_join(rows, rows, on=["district", "rooms", "floor"], column="area", width=3)
    ratio = F.col("l.monthly").between(F.col("r.monthly") * F.lit(0.95).cast("decimal(3,2)"), F.col("r.monthly") * F.lit(1.05).cast("decimal(3,2)"))
    return pairs.where((F.col("l.announcement_id") < F.col("r.announcement_id")) & ratio).select(F.col("l.announcement_id").alias("a"), F.col("r.announcement_id").alias("b"))


@query("join04_unnested_hashes", """with f as (select phash, min(announcement_id) as one from media group by 1)
  select announcement_id, count(distinct phash) as shared, min(one) as earlier from media join f using (phash) where one < announcement_id group by 1""")
def join04(spark, d):
    """The hashes of every listing's pictures looked up among all media: how many an earlier listing has, and the first such listing."""
    media = t.media(spark, d)
    wanted = media.groupBy("announcement_id").agg(F.collect_set("phash").alias("hashes")).select("announcement_id", F.explode("hashes").alias("phash"))
    first = media.groupBy("phash").agg(F.min("announcement_id").alias("one"))
    met = wanted.join(first, "phash").where("one < announcement_id")
    return met.groupBy("announcement_id").agg(F.count("*").alias("shared"), F.min("one").alias("earlier"))


@query("mat02_hamming", """select a.media_id || '-' || b.media_id as pair, a.announcement_id, cast(bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint)) as integer) as distance
  from media a join media b on a.announcement_id = b.announcement_id and a.media_id < b.media_id""")
def mat02(spark, d):
    m = t.media(spark, d)
    pairs = m.alias("a").join(m.alias("b"), (F.col("a.announcement_id") == F.col("b.announcement_id")) & (F.col("a.media_id") < F.col("b.media_id")))
    return pairs.select(F.concat_ws("-", F.col("a.media_id").cast("string"), F.col("b.media_id").cast("string")).alias("pair"), "a.announcement_id", similarity.hamming(F.col("a.phash"), F.col("b.phash")).alias("distance"))


@query("set01_jaccard", """select a.p_partkey as a, b.p_partkey as b, round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(string_split(a.p_name || ' ' || b.p_name, ' '))), 6) as jaccard
  from part a join part b on b.p_partkey = a.p_partkey + 1""")
def set01(spark, d):
    part = t.table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    pairs = part.alias("a").join(part.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    return pairs.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(similarity.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


FIELDS = ["price", "currency", "rooms", "renovation", "source_url", "excluded_tag", "tag"]
COMPLETE = " + ".join(f"(case when {f} is null or cast({f} as varchar) = '' then 0 else 1 end)" for f in FIELDS)


@query("agg15_completeness", f"select announcement_id, cast({COMPLETE} as integer) as completeness from listings")
def agg15(spark, d):
    rows = t.listings(spark, d)
    return rows.select("announcement_id", dedup.completeness(rows, FIELDS).alias("completeness"))


@query("top08_parent_selection", f"""with c as (select *, {COMPLETE} as n from listings)
  select child.announcement_id as child, parent.announcement_id as stored_parent,
    case when (-child.n, -child.trust, child.created_at, child.announcement_id) <= (-parent.n, -parent.trust, parent.created_at, parent.announcement_id) then child.announcement_id else parent.announcement_id end as chosen
  from c child join c parent on child.parent_id = parent.announcement_id""")
def top08(spark, d):
    rows = t.listings(spark, d)
    rows = rows.withColumn("completeness", dedup.completeness(rows, FIELDS))
    pairs = rows.alias("l").join(rows.alias("r"), F.col("l.parent_id") == F.col("r.announcement_id"))
    chosen = F.when(dedup.choose_parent(), F.col("l.announcement_id")).otherwise(F.col("r.announcement_id"))
    return pairs.select(F.col("l.announcement_id").alias("child"), F.col("r.announcement_id").alias("stored_parent"), chosen.alias("chosen"))


def _conflict(f: str) -> str:
    return f"case when p.{f} is not null and c.{f} is not null and p.{f} <> c.{f} then '{f}' end"


@query("dml04_survivorship_merge", "select p.announcement_id, " + ", ".join(f"coalesce(p.{f}, c.{f}) as {f}" for f in FIELDS if f != "price") + ", cast(coalesce(p.price, c.price) as double) as price, "
       + "array_to_string(list_filter([" + ", ".join(map(_conflict, FIELDS)) + "], lambda x: x is not null), ',') as conflicts from listings c join listings p on c.parent_id = p.announcement_id")
def dml04(spark, d):
    rows = t.listings(spark, d)
    both = F.struct("announcement_id", *FIELDS)
    children = rows.where("parent_id is not null").select(F.col("parent_id").alias("_p"), both.alias("child"))
    pairs = rows.select(both.alias("parent")).join(children, F.col("parent.announcement_id") == F.col("_p"))
    merged = dedup.merge_parent(pairs, FIELDS)
    return merged.withColumn("conflicts", F.array_join(F.transform("conflicts", lambda c: c["field"]), ",")).withColumn("price", F.col("price").cast("double"))


#: The first listing of a phone and room number is the parent of the others; blank fields as a feed has them; every seventh is linked already.
LINK_SQL = """with recursive base as (
  select announcement_id, source_id, phone, rooms, price, currency, case when announcement_id % 4 = 1 then '' else renovation end as renovation, source_url, excluded_tag, tag from listings
), g as (
  select *, min(announcement_id) over (partition by phone, rooms) as p from base
), o as (
  select *, announcement_id <> p and announcement_id % 7 = 0 as old, sum(case when announcement_id = p or announcement_id % 7 <> 0 then 1 else 0 end) over (partition by p order by announcement_id) - 1 as n from g
), r as (
  select p, n, announcement_id, source_id, FIELDS, ''::varchar as conflicts from o where announcement_id = p
  union all
  select r.p, o.n, o.announcement_id, o.source_id, MERGED, array_to_string(list_filter([CONFLICTS], lambda x: x is not null), ',')
  from r join o on o.p = r.p and o.n = r.n + 1 and not o.old
), sizes as (
  select p, count(*) as source_count, count(*) filter (not old) as members from o group by p
)
"""
LINKED = [f for f in FIELDS if f != "rooms"]
_EMPTY = "({0}.{1} is null or cast({0}.{1} as varchar) = '')"
LINK_SQL = LINK_SQL.replace("FIELDS", ", ".join(LINKED)).replace("MERGED", ", ".join(f"case when {_EMPTY.format('r', f)} and not {_EMPTY.format('o', f)} then o.{f} else r.{f} end" for f in LINKED)).replace(
    "CONFLICTS", ", ".join(f"case when not {_EMPTY.format('r', f)} and not {_EMPTY.format('o', f)} and r.{f} <> o.{f} then '{f}:' || r.{f} || '/' || o.{f} end" for f in LINKED)
)


def _linked(spark, d):
    blank = F.when(F.col("announcement_id") % 4 == 1, "").otherwise(F.col("renovation"))
    rows = t.listings(spark, d).withColumn("renovation", blank)
    parents = rows.groupBy("phone", "rooms").agg(F.min("announcement_id").alias("p"))
    both = rows.drop("parent_id").join(parents, ["phone", "rooms"])
    old = (F.col("announcement_id") != F.col("p")) & (F.col("announcement_id") % 7 == 0)
    listings = both.select("announcement_id", F.when(old, F.col("p")).alias("parent_id"), "source_id", *LINKED)
    links = both.where("announcement_id <> p").select(F.col("announcement_id").alias("child_id"), F.col("p").alias("parent_id"), F.col("announcement_id").alias("seq"))
    return linking.link_children(listings, links, LINKED)


@query("dml04_ordered_survivorship", LINK_SQL + "select r.p as announcement_id, " + ", ".join(f"r.{f}" for f in LINKED if f != "price") + """, cast(r.price as double) as price, z.source_count, r.source_id as latest_source_id
  from r join sizes z on z.p = r.p and r.n = z.members - 1 where z.members > 1""")
def ordered_survivorship(spark, d):
    return _linked(spark, d).parents.withColumn("price", F.col("price").cast("double"))


@query("dml03_merge_audit", LINK_SQL + "select p as parent_id, announcement_id as child_id, 'merge_parent_fields' as merge_policy, conflicts from r where n > 0")
def merge_audit(spark, d):
    told = F.transform("conflicts", lambda x: F.concat(x["field"], F.lit(":"), x["parent"], F.lit("/"), x["child"]))
    return _linked(spark, d).audit.withColumn("conflicts", F.array_join(told, ","))


@query("dml03_linked_children", LINK_SQL + "select announcement_id, p as parent_id, 'active' as status, 1::bigint as source_count, source_id as latest_source_id from o where announcement_id <> p and not old")
def linked_children(spark, d):
    return _linked(spark, d).children.select("announcement_id", "parent_id", "status", "source_count", "latest_source_id")
