"""Queries on typed requests, their tags, keys and notes, and on predicates of messages and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingloom.operators import requests
from listingloom.plans.registry import query
from listingloom.sources import tables as t

c = F.col

#: Model answers of saved filters: none to three districts, blank ones, and every condition present and absent.
ANSWERS = """with x as (select filter_id, list_filter([case when filter_id % 3 > 0 then district end, case when filter_id % 3 > 1 then 'Other  Place' end], lambda d: d is not null) as ds, rooms,
    case when filter_id % 2 = 0 then max_price end as budget, filter_id % 5 = 0 as pp, case filter_id % 4 when 0 then 'good' when 1 then '' end as ren, case filter_id % 7 when 0 then 'family' when 1 then 'students' when 2 then 'pets' end as tag,
    case when filter_id % 6 = 0 then ['near metro', 'additional_districts:A,B'] when filter_id % 6 = 1 then ['quiet'] else [] end as un from saved_filters),
  r as (select *, list_transform(ds, lambda d: regexp_replace(d, ' +', ' ', 'g')) as names from x)"""


def _answers(spark, d):
    k = c("filter_id")
    districts = F.array(F.when(k % 3 > 0, F.concat(F.lit(" "), c("district"))), F.lit("  "), F.when(k % 3 > 1, F.lit("Other  Place")))
    un = F.when(k % 6 == 0, F.array(F.lit("near metro"), F.lit("additional_districts:A,B"), F.lit("near metro"))).when(k % 6 == 1, F.array(F.lit("quiet")))
    raw = t.saved_filters(spark, d).select(
        k, districts.alias("districts"), "rooms", F.when(k % 2 == 0, c("max_price")).alias("monthly_budget"), F.when(k % 5 == 0, "include_per_person").alias("price_basis_preference"),
        F.when(k % 4 == 0, "good").when(k % 4 == 1, "").alias("renovation_level"), F.when(k % 7 == 0, "family").when(k % 7 == 1, "students").when(k % 7 == 2, "pets").alias("audience_tag"), un.alias("unapplied_conditions"),
    )
    return requests.extracted_criteria(raw)


@query("nrm02_extracted_criteria", ANSWERS + """ select filter_id, names[1] as district, array_to_string(names, ',') as districts, budget as max_price, pp as include_per_person, concat_ws(',', case when len(names) > 0 then 'districts' end, case when rooms is not null then 'rooms' end,
  case when budget is not null then 'max_price' end, case when pp then 'include_per_person' end, case when ren is not null then 'renovation_level' end, case when tag is not null then 'audience_tag' end) as applied, array_to_string(un, '|') as unapplied from r""")
def extracted(spark, d):
    rows = _answers(spark, d)
    return rows.select("filter_id", "criteria.district", F.array_join("criteria.districts", ",").alias("districts"), "criteria.max_price", "criteria.include_per_person", F.array_join("applied", ",").alias("applied"), F.array_join("unapplied", "|").alias("unapplied"))


@query("prj07_display_tags", ANSWERS + """, tags as (select filter_id, list_transform(names, lambda d: {'key': 'district', 'label': 'Tuman', 'value': d, 'applied': true})
    || list_filter([case when rooms is not null then {'key': 'rooms', 'label': 'Xona', 'value': rooms || ' xona', 'applied': true} end, case when budget is not null then {'key': 'max_price', 'label': 'Budjet', 'value': budget || ' gacha', 'applied': true} end,
      case when pp then {'key': 'include_per_person', 'label': 'Narx turi', 'value': 'Bir kishilik ham', 'applied': true} end, case when ren = 'good' then {'key': 'renovation_level', 'label': 'Remont', 'value': ren, 'applied': true} end,
      case when tag is not null then {'key': 'audience_tag', 'label': 'Kim uchun', 'value': case tag when 'family' then 'Yosh oila' when 'students' then 'Talabalar' else tag end, 'applied': true} end], lambda x: x is not null)
    || list_transform(un, lambda u: {'key': 'condition', 'label': 'Qo''shimcha shart', 'value': case when u like 'additional%' then 'A, B' else u end, 'applied': false}) as tags from r)
  select filter_id, (i - 1)::integer as place, x.key, x.label, x.value, x.applied from (select filter_id, unnest(tags) as x, generate_subscripts(tags, 1) as i from tags)""")
def display_tags(spark, d):
    return requests.display_tags(_answers(spark, d), "filter_id")


@query("str34_action_keys", """select filter_id, sha256('{"min_price":null,"max_price":' || case when max_price > 5000 then 'null' else '"' || max_price || '"' end || ',"include_per_person":' || include_per_person || ',"district":' || coalesce('"' || district || '"', 'null')
  || ',"districts":["' || coalesce(district, '') || '"],"rooms":' || coalesce(rooms::varchar, 'null') || ',"renovation_level":null,"audience_tag":"t' || filter_id % 3 || '","sort":"newest","limit":20,"offset":' || filter_id % 4 * 20 || '}') as action_key from saved_filters""")
def action_keys(spark, d):
    k = c("filter_id")
    none = F.lit(None)
    criteria = F.struct(
        none.cast("decimal(14,2)").alias("min_price"), F.when(c("max_price") <= 5000, c("max_price")).alias("max_price"), "include_per_person", "district", F.array(F.coalesce("district", F.lit(""))).alias("districts"), "rooms",
        none.cast("string").alias("renovation_level"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("audience_tag"), F.lit("newest").alias("sort"), F.lit(20).alias("limit"), (k % 4 * 20).alias("offset"),
    )
    return t.saved_filters(spark, d).select(k, requests.action_key(criteria).alias("action_key"))


@query("prj06_search_notes", """select filter_id, 'Search returns active canonical parent announcements only.|Sale/one_time listings are excluded from monthly rent search.' || case when max_price <= 5000 then '|Listings with null price_normalized_monthly are excluded by price filters.' else '' end
  || case when include_per_person then '|Per-person prices are matched as per-person values; they are not converted to total.' else '' end as notes, max_price > 5000 as null_price_included from saved_filters""")
def search_notes(spark, d):
    has_price = c("max_price") <= 5000
    return t.saved_filters(spark, d).select("filter_id", F.array_join(requests.search_notes(has_price, c("include_per_person")), "|").alias("notes"), (~has_price).alias("null_price_included"))


@query("fil17_message_siblings", """with m as (select event_id, user_id, case event_id % 5 when 0 then 'p' || user_id when 1 then 'p' || user_id || '::candidate::' || event_id % 3 when 2 then '::candidate::1' when 3 then 'p::candidate::' || user_id || '::candidate::' || event_id % 2 else 'p' || user_id || '::candidate::x' end as id from events),
  i as (select *, case when event_id % 5 = 1 then 'p' || user_id when event_id % 5 = 3 then 'p::candidate::' || user_id end as raw, case when event_id % 5 = 1 then event_id % 3 when event_id % 5 = 3 then event_id % 2 end as n from m),
  b as (select event_id, raw, n, lead(raw) over (partition by event_id % 5, user_id order by event_id) as raw2, lead(n) over (partition by event_id % 5, user_id order by event_id) as n2 from i)
  select event_id, raw, n::bigint as index, coalesce(raw = raw2 and n <> n2, false) as sibling_of_next from b""")
def message_siblings(spark, d):
    """Message ids with no mark, one, two, nothing before it or no number behind; each against the next of its user and kind."""
    from pyspark.sql import Window

    k, u = c("event_id"), c("user_id").cast("string")
    mark, n = F.lit("::candidate::"), lambda m: (k % m).cast("string")
    p = F.concat(F.lit("p"), u)
    ids = F.when(k % 5 == 0, p).when(k % 5 == 1, F.concat(p, mark, n(3))).when(k % 5 == 2, F.lit("::candidate::1")).when(k % 5 == 3, F.concat(F.lit("p"), mark, u, mark, n(2))).otherwise(F.concat(p, mark, F.lit("x")))
    rows = t.table(spark, d, "events").select("event_id", "user_id", ids.alias("id"))
    then = F.lead("id").over(Window.partitionBy(k % 5, "user_id").orderBy("event_id"))
    told = rows.withColumn("next", then).withColumn("i", requests.fanout_identity(c("id")))
    return told.select("event_id", "i.raw", c("i.index").cast("bigint").alias("index"), requests.fanout_siblings(c("id"), c("next")).alias("sibling_of_next"))


@query("fil15_forward_origins", "select event_id, case when event_id % 3 <> 0 and event_id % 4 <> 0 then event_id % 3 || ':' || event_id % 4 end as origin from events")
def forward_origins(spark, d):
    k = c("event_id")
    forward = F.when(k % 7 != 8, F.struct(F.when(k % 3 != 0, k % 3).alias("channel_id"), F.when(k % 4 != 0, k % 4).alias("message_id")))
    return t.table(spark, d, "events").select("event_id", requests.forward_origin(forward).alias("origin"))


@query("fil20_missing_fields", """select announcement_id, concat_ws(',', case when price is null then 'price' end, case when announcement_id % 3 <> 0 then 'address' end, case when announcement_id % 2 = 0 then 'phones' end, case when renovation is null then 'renovation' end, 'balcony') as missing from listings""")
def missing_fields(spark, d):
    rows = t.listings(spark, d).withColumn("address", F.when(c("announcement_id") % 3 == 1, " \t").when(c("announcement_id") % 3 == 0, c("address")))
    rows = rows.withColumn("phones", F.when(c("announcement_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("phone")))
    return rows.select("announcement_id", F.array_join(requests.missing_fields(rows, ("price", "address", "phones", "rooms", "renovation", "balcony")), ",").alias("missing"))


@query("nrm06_capped_bytes", "select doc_id, least(strlen(coalesce(text, '')), 600)::bigint as n, case when strlen(coalesce(text, '')) <= 600 then sha256(coalesce(text, '')) else null end as whole, case when strlen(coalesce(text, '')) > 600 then sha256(text) end as ends_in from documents")
def capped_bytes(spark, d):
    capped = requests.byte_cap(F.coalesce("text", F.lit("")).cast("binary"), 600)
    rows = t.table(spark, d, "documents").select("doc_id", capped.alias("b"), (F.octet_length(F.coalesce("text", F.lit(""))) > 600).alias("cut"))
    return rows.select("doc_id", F.octet_length("b").cast("bigint").alias("n"), F.when(~c("cut"), F.sha2("b", 256)).alias("whole"), F.when(c("cut"), F.lower(F.hex(F.substring("b", 569, 32)))).alias("ends_in"))
