"""Queries on filters, projections, search pages, joins with media and listing statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listingloom.operators import content, predicates, search
from listingloom.operators.predicates import Criteria
from listingloom.plans.registry import query
from listingloom.sources import tables as t

GOLDEN = Criteria(max_price=2000, sort="cheapest", limit=10)
IDS = "select announcement_id from listings where "


@query("fil01_announcement_matches", IDS + """status = 'active' and parent_id is null and price_period <> 'one_time' and price_basis = 'total'
  and monthly >= 100 and monthly <= 3000 and lower(district) in ('nation_3', 'nation_7', 'nation_9', 'nation_11') and rooms = 2
  and tag = '1' and (excluded_tag is null or excluded_tag <> '1') and renovation = 'good'""")
def fil01(spark: SparkSession, d: str) -> DataFrame:
    c = Criteria(min_price=100, max_price=3000, districts=("Nation_3", "NATION_7", "nation_9", "NATION_11"), rooms=2, renovation="good", tag="1").checked()
    return t.listings(spark, d).where(predicates.matches(c)).select("announcement_id")


@query("fil02_user_facing", IDS + "status = 'active' and parent_id is null")
def fil02(spark, d):
    return t.listings(spark, d).where(predicates.user_facing()).select("announcement_id")


@query("fil03_rent_only", IDS + "price_period <> 'one_time'")
def fil03(spark, d):
    return t.listings(spark, d).where(predicates.rentable()).select("announcement_id")


@query("fil04_price_range", IDS + "monthly >= 500 and monthly <= 1500")
def fil04(spark, d):
    return t.listings(spark, d).where(predicates.priced(500, 1500)).select("announcement_id")


@query("fil05_districts", IDS + "lower(district) in ('nation_3', 'nation_7')")
def fil05(spark, d):
    return t.listings(spark, d).where(predicates.in_districts(("NATION_3", "nation_7"))).select("announcement_id")


@query("fil06_rooms_renovation", IDS + "rooms = 3 and renovation = 'good'")
def fil06(spark, d):
    return t.listings(spark, d).where((F.col("rooms") == 3) & (F.col("renovation") == "good")).select("announcement_id")


@query("fil07_tag_not_excluded", IDS + "tag = '2' and (excluded_tag is null or excluded_tag <> '2')")
def fil07(spark, d):
    return t.listings(spark, d).where(predicates.tagged("2")).select("announcement_id")


@query("fil08_per_person_toggle", IDS + "price_basis <> 'per_person' or price_basis is null")
def fil08(spark, d):
    return t.listings(spark, d).where(predicates.basis_allowed(False)).select("announcement_id")


@query("fil09_optional_parameters", IDS + "status = 'manual_review'")
def fil09(spark, d):
    given = predicates.when_given("manual_review", F.col("status") == "manual_review") & predicates.when_given(None, F.col("source_id") == "none")
    return t.listings(spark, d).where(given).select("announcement_id")


@query("fil10_time_range", "select event_id from product_events where occurred_at >= timestamp '2024-01-05' and occurred_at < timestamp '2024-01-12'")
def fil10(spark, d):
    return t.product_events(spark, d).where(predicates.within("occurred_at", "2024-01-05", "2024-01-12")).select("event_id")


@query("fil11_date_equality", "select event_id from product_events where cast(occurred_at as date) = date '2024-01-09'")
def fil11(spark, d):
    day = F.lit("2024-01-09")
    inside = (F.col("occurred_at") >= day.cast("timestamp_ntz")) & (F.col("occurred_at") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return t.product_events(spark, d).where(inside).select("event_id")


@query("fil12_prefix", "select p_partkey from part where p_type like 'PROMO%'")
def fil12(spark, d):
    return t.table(spark, d, "part").where(F.col("p_type").startswith("PROMO")).select("p_partkey")


@query("fil15_forward_origin_key", """select doc_id, case when a is not null and b is not null then a || ':' || b end as forward_key from
  (select doc_id, case when doc_id % 3 = 0 then '-777' end as a, case when doc_id % 2 = 0 then cast(doc_id // 6 as varchar) end as b from documents)""")
def fil15(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "-777").alias("a"), F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 6).cast("string")).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return docs.select("doc_id", F.when(both, F.concat_ws(":", "a", "b")).alias("forward_key"))


@query("fil24_tolerances", """select l.announcement_id as a, r.announcement_id as b, abs(l.area - r.area) < 3 as area_close,
  coalesce(abs(l.monthly - r.monthly) * 100 <= greatest(abs(l.monthly), abs(r.monthly)) * 5, false) and l.price_basis = 'total' and r.price_basis = 'total'
    and l.price_period <> 'one_time' and r.price_period <> 'one_time' and l.currency = r.currency as price_close
  from listings l join listings r on r.announcement_id = l.announcement_id + 1""")
def fil24(spark, d):
    rows = t.listings(spark, d)
    pairs = rows.alias("l").join(rows.alias("r"), F.col("r.announcement_id") == F.col("l.announcement_id") + 1)
    return pairs.select(F.col("l.announcement_id").alias("a"), F.col("r.announcement_id").alias("b"), predicates.area_close().alias("area_close"), predicates.price_close().alias("price_close"))


@query("prj01_search_response", """select announcement_id, case when length(description) <= 24 then description else rtrim(description[1:21]) || '...' end as short_text,
  (select min(m.phash) from media m where m.announcement_id = l.announcement_id and m.media_id = (select min(x.media_id) from media x where x.announcement_id = l.announcement_id)) as preview,
  (select count(*) from media m where m.announcement_id = l.announcement_id) as media_count
  from listings l where status = 'active' and parent_id is null and monthly <= 500 and price_period <> 'one_time' and price_basis = 'total'""")
def prj01(spark, d):
    from listingloom.functions.text import shortened

    found = t.listings(spark, d).where(predicates.matches(Criteria(max_price=500).checked()))
    rows = search.with_media(found, t.media(spark, d))
    return rows.select("announcement_id", shortened("description", 24).alias("short_text"), F.try_element_at("media", F.lit(1))["phash"].alias("preview"), F.size("media").cast("bigint").alias("media_count"))


@query("prj06_search_metadata", """select count(*) as total, least(10, count(*)) as returned, 10 as page_limit, 0 as page_offset, false as per_person_included, 'cheapest' as sort, count(*) > 10 as has_more
  from listings where status = 'active' and parent_id is null and price_period <> 'one_time' and price_basis = 'total' and monthly <= 2000""")
def prj06(spark, d):
    return search.search_metadata(t.listings(spark, d), GOLDEN)


SEARCH_WHERE = "status = 'active' and parent_id is null and price_period <> 'one_time' and price_basis <> 'per_person'"


@query("top01_search_cheapest", f"""select announcement_id, cast(monthly as double) as monthly, (select count(*) from listings where {SEARCH_WHERE} and monthly <= 2000) as total
  from listings where {SEARCH_WHERE} and monthly <= 2000 order by monthly, created_at, announcement_id limit 10""")
def top01(spark, d):
    return search.search(t.listings(spark, d), GOLDEN).select("announcement_id", F.col("monthly").cast("double").alias("monthly"), "total")


@query("top01_search_newest_paged", f"select announcement_id from listings where {SEARCH_WHERE} order by created_at desc, announcement_id desc limit 20 offset 15")
def top01_newest(spark, d):
    return search.search(t.listings(spark, d), Criteria(sort="newest", limit=20, offset=15)).select("announcement_id")


@query("top02_price_desc_nulls_last", f"select announcement_id, cast(monthly as double) as monthly from listings where {SEARCH_WHERE} order by monthly desc nulls last, created_at desc, announcement_id desc limit 50")
def top02(spark, d):
    return search.search(t.listings(spark, d), Criteria(sort="price_desc", limit=50)).select("announcement_id", F.col("monthly").cast("double").alias("monthly"))


@query("win01_total_beside_page", f"""select announcement_id, count(*) over () as total from listings where {SEARCH_WHERE} and rooms = 2
  order by created_at desc, announcement_id desc limit 10""")
def win01(spark, d):
    return search.search(t.listings(spark, d), Criteria(rooms=2)).select("announcement_id", "total")


@query("agg01_daily_stats", """select (select count(*) from listings where status = 'active' and parent_id is null) as active_count,
  (select count(*) from listings where cast(created_at as date) = date '2024-01-15') as day_total,
  (select count(*) from listings where cast(created_at as date) = date '2024-01-15' and parent_id is not null) as day_duplicates,
  (select round(avg(cast(monthly as double)), 4) from listings where status = 'active' and parent_id is null and price_basis = 'total' and currency = 'USD') as average_price""")
def agg01(spark, d):
    return content.daily_stats(t.listings(spark, d), "2024-01-15")


@query("agg02_district_stats", """select district, count(*) as n, round(avg(cast(monthly as double)), 4) as average_price, cast(min(monthly) as double) as least_price, cast(max(monthly) as double) as greatest_price
  from listings where status = 'active' and parent_id is null and monthly > 0 and currency = 'USD' and price_period <> 'one_time'
  group by district having count(*) >= 2 order by n desc, average_price, district limit 10""")
def agg02(spark, d):
    return content.district_stats(t.listings(spark, d), 10)


@query("agg03_media_json", """select announcement_id, coalesce((select string_agg(media_id || ':' || phash, ',' order by media_id) from media m where m.announcement_id = l.announcement_id), '') as media
  from listings l""")
def agg03(spark, d):
    rows = search.with_media(t.listings(spark, d).select("announcement_id"), t.media(spark, d))
    return rows.select("announcement_id", F.array_join(F.transform("media", lambda m: F.concat_ws(":", m["media_id"].cast("string"), m["phash"])), ",").alias("media"))


@query("agg04_distinct", "select distinct district, rooms from listings")
def agg04(spark, d):
    return t.listings(spark, d).select("district", "rooms").distinct()


@query("agg05_source_count", "select coalesce(parent_id, announcement_id) as parent, greatest(1, count(*)) as source_count from listings group by 1")
def agg05(spark, d):
    return t.listings(spark, d).groupBy(F.coalesce("parent_id", "announcement_id").alias("parent")).agg(F.greatest(F.lit(1).cast("bigint"), F.count("*")).alias("source_count"))


@query("agg06_optional_count", "select count(*) as n from listings where status = 'manual_review'")
def agg06(spark, d):
    return t.listings(spark, d).where(predicates.when_given("manual_review", F.col("status") == "manual_review")).agg(F.count("*").alias("n"))


@query("join01_listing_media", """select l.announcement_id, count(m.media_id) as n, min(m.phash) as first_hash from listings l left join media m using (announcement_id) group by 1""")
def join01(spark, d):
    lists = t.media(spark, d).groupBy("announcement_id").agg(F.count("*").alias("n"), F.min("phash").alias("first_hash"))
    return t.listings(spark, d).select("announcement_id").join(lists, "announcement_id", "left").select("announcement_id", F.coalesce("n", F.lit(0)).alias("n"), "first_hash")


@query("join26_or_self_lookup", "select announcement_id from listings where announcement_id = 32 or parent_id = 32")
def join26(spark, d):
    return t.listings(spark, d).where("announcement_id = 32 or parent_id = 32").select("announcement_id")


@query("top03_top_offers", """select announcement_id, cast(monthly as double) as monthly, sources from (
    select l.*, (select count(*) from listings c where c.parent_id = l.announcement_id) + 1 as sources from listings l)
  where status = 'active' and parent_id is null and monthly > 0 and currency in ('USD', 'UZS') and price_period <> 'one_time'
  order by monthly, sources desc, created_at, announcement_id limit 5""")
def top03(spark, d):
    return content.top_offers(t.listings(spark, d), 5).select("announcement_id", F.col("monthly").cast("double").alias("monthly"), "sources")


@query("top07_pagination", "select p_partkey, (select count(*) from part) as total from part order by p_partkey limit 25 offset 50")
def top07(spark, d):
    part = t.table(spark, d, "part")
    return search.page(part.select("p_partkey"), [F.col("p_partkey").asc()], 25, 50).crossJoin(F.broadcast(part.agg(F.count("*").alias("total"))))


@query("top10_audit_listing", "select coalesce(parent_id, announcement_id) as root, announcement_id, parent_id from listings order by 1, created_at, announcement_id limit 100")
def top10(spark, d):
    rows = t.listings(spark, d).select(F.coalesce("parent_id", "announcement_id").alias("root"), "announcement_id", "parent_id", "created_at")
    return search.page(rows, [F.col("root").asc(), F.col("created_at").asc(), F.col("announcement_id").asc()], 100).drop("created_at")


@query("top11_message_order", """select p_partkey, key, row_number() over (partition by brand order by coalesce(try_cast(key as bigint), 0), key, p_partkey) as place
  from (select p_partkey, p_brand as brand, case when p_partkey % 4 = 0 then p_name else cast(p_partkey * 7 % 100 as varchar) end as key from part)""")
def top11(spark, d):
    key = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise((F.col("p_partkey") * 7 % 100).cast("string"))
    rows = t.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), key.alias("key"))
    order = Window.partitionBy("brand").orderBy(F.coalesce(F.expr("try_cast(key as bigint)"), F.lit(0)), "key", "p_partkey")
    return rows.select("p_partkey", "key", F.row_number().over(order).cast("bigint").alias("place"))


@query("set07_union_distinct", "select n_name as name from nation union select r_name from region")
def set07(spark, d):
    return t.table(spark, d, "nation").select(F.col("n_name").alias("name")).union(t.table(spark, d, "region").select("r_name")).distinct()


@query("agg22_median_and_max", "select event_type, median(value) as p50, max(value) as greatest from events group by 1")
def agg22(spark, d):
    from listingloom.operators.selection import exact_medians

    rows = t.table(spark, d, "events").select("event_type", "value")
    most = rows.groupBy(F.col("event_type").alias("_t")).agg(F.max("value").alias("greatest"))
    return exact_medians(rows, "event_type", "value").join(most, F.col("event_type").eqNullSafe(F.col("_t"))).select("event_type", F.col("median").alias("p50"), "greatest")


@query("mat01_monthly_normalised", "select announcement_id, cast(monthly as double) as monthly from listings")
def mat01(spark, d):
    return t.listings(spark, d).select("announcement_id", F.col("monthly").cast("double").alias("monthly"))


@query("join25_alias_lookup", """select announcement_id, coalesce(canonical, district) as district from listings
  left join (values ('VIETNAM', 'Viet Nam'), ('RUSSIA', 'Russian Federation'), ('IRAN', 'Iran (Islamic Republic)')) a(alias, canonical) on upper(district) = alias""")
def join25(spark, d):
    from listingloom.functions.labels import canonical

    return t.listings(spark, d).select("announcement_id", canonical(F.col("district"), {"vietnam": "Viet Nam", "russia": "Russian Federation", "iran": "Iran (Islamic Republic)"}).alias("district"))
