"""Queries on scalar functions: each is one projection of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingloom.functions import labels, text
from listingloom.operators import extraction, fuzzy
from listingloom.plans.registry import query
from listingloom.sources import tables as t


def projection(name: str, source: str, key: str, column: str, expression: Callable[[], Column], sql: str | None) -> None:
    """Registers key and one computed column of a table or view."""

    def run(spark, d):
        rows = getattr(t, source)(spark, d) if hasattr(t, source) else t.table(spark, d, source)
        return rows.select(key, expression().alias(column))

    query(name, sql and f"select {key}, {sql} as {column} from {source}")(run)


c = F.col
WORD = lambda n: F.get(F.split("text", "\\s+"), F.lit(n))
SQL_WORD = lambda n: f"regexp_split_to_array(text, '\\s+')[{n + 1}]"

projection("str02_text_sha256", "documents", "doc_id", "hash", lambda: F.sha2("text", 256), "sha256(text)")
projection("str05_whitespace_collapse", "documents", "doc_id", "value", lambda: F.sha2(text.collapsed(c("text")), 256), "sha256(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''))")
projection("str06_lower_trimmed", "nation", "n_nationkey", "value", lambda: F.nullif(F.lower(F.trim("n_name")), F.lit("")), "nullif(lower(trim(n_name)), '')")
projection("str07_shortened", "part", "p_partkey", "value", lambda: text.shortened("p_name", 9), "case when length(p_name) <= 9 then p_name else rtrim(p_name[1:6]) || '...' end")
projection("str08_currency", "part", "p_partkey", "value", lambda: labels.currency(F.when(c("p_size") % 4 == 0, "$").when(c("p_size") % 4 == 1, " Sum").when(c("p_size") % 4 == 2, "eur")), "case p_size % 4 when 0 then 'USD' when 1 then 'UZS' when 2 then 'EUR' end")
projection("str09_alias_passthrough", "region", "r_regionkey", "value", lambda: labels.canonical(c("r_name"), {"asia": "Asia and Pacific", "africa": "Africa"}), "case lower(r_name) when 'asia' then 'Asia and Pacific' when 'africa' then 'Africa' else r_name end")
projection("str10_alias_or_null", "region", "r_regionkey", "value", lambda: labels.mapped(c("r_name"), {"asia": "Asia and Pacific", "africa": "Africa"}), "case lower(r_name) when 'asia' then 'Asia and Pacific' when 'africa' then 'Africa' end")
projection("str11_tag_key", "part", "p_partkey", "value", lambda: text.tag_key(F.concat(F.lit(" "), c("p_type"), F.lit("--"), c("p_brand"))), "trim(regexp_replace(lower(trim(p_type || '--' || p_brand)), '[^a-z0-9]+', '_', 'g'), '_')")
projection("str13_typed_price", "part", "p_partkey", "value", lambda: text.parsed_price(F.concat(c("p_size").cast("string"), F.lit(" 000,5"))).cast("double"), "cast(p_size * 1000 + 0.5 as double)")
projection("str14_name_list", "part", "p_partkey", "value", lambda: F.array_join(text.listed_names(F.concat_ws(", ", "p_name", F.concat(c("p_brand"), F.lit(" va "), c("p_type")), "p_type")), "|"), "array_to_string([p_name, p_brand, p_type], '|')")
projection("str15_first_integer", "part", "p_partkey", "value", lambda: text.first_integer(c("p_brand")), "cast(regexp_extract(p_brand, '([0-9]+)', 1) as integer)")
projection("str17_message_url", "nation", "n_nationkey", "value", lambda: text.message_url(F.concat(F.lit("@"), c("n_name")), c("n_nationkey")), "'https://t.me/' || n_name || '/' || n_nationkey")
projection("str18_event_key", "posts", "post_id", "value", lambda: text.event_key(F.lit("created"), c("channel_id"), c("message_id")), "'post:created:' || channel_id || ':' || message_id")
projection("str19_callback", "nation", "n_nationkey", "value", lambda: text.parsed_callback(text.action_callback("v1", F.lit("open"), F.concat_ws(":", "n_name", c("n_nationkey").cast("string"))))["id"], "n_name || ':' || n_nationkey")
projection("str21_referral_code_valid", "users", "user_id", "value", lambda: c("referral_code").rlike("^[A-Za-z0-9_-]{4,64}$"), "regexp_matches(referral_code, '^[A-Za-z0-9_-]{4,64}$')")
projection("str22_price_label", "listings", "announcement_id", "value", lambda: labels.price_label(c("price"), c("currency"), c("price_period")), "case when price is null then 'Price on request' else regexp_replace(printf('%.2f', cast(price as double)), '\\.00$', '') || ' ' || currency || case price_period when 'monthly' then ' / month' when 'daily' then ' / day' else '' end end")
projection("str22_rooms_label", "listings", "announcement_id", "value", lambda: labels.rooms_label(c("rooms")), "case when rooms = 1 then '1 room' else rooms || ' rooms' end")
projection("str26_channel_text", "documents", "doc_id", "value", lambda: F.length(text.channel_text(c("text"), 500)).cast("bigint"), "(select case when length(t) > 500 then length(rtrim(t[1:499])) + 1 else length(t) end from (select regexp_replace(text, '(?m)[ \\t]+$', '', 'g') as t))")
projection("str27_safe_url", "pages", "page_id", "value", lambda: text.safe_url(c("url")), "case when url like 'https://%' or url like 'http://%' then url else '' end")
projection("str28_object_key", "part", "p_partkey", "value", lambda: text.object_key(c("p_brand"), c("p_type"), c("p_size"), F.sha2("p_name", 256)), "'media/' || sha256(p_brand)[1:16] || '/' || lpad(cast(p_size as varchar), 3, '0') || '-' || sha256(p_type)[1:12] || '-' || sha256(p_name)[1:16]")
projection("str29_content_phash", "part", "p_partkey", "value", lambda: F.substring(F.sha2(F.concat(F.encode("p_name", "UTF-8"), F.encode(c("p_size").cast("string"), "UTF-8")), 256), 1, 16), "sha256(p_name || p_size)[1:16]")
projection("str30_media_reference_hash", "part", "p_partkey", "value", lambda: text.media_reference_hash(F.when(c("p_size") % 2 == 0, "photo").otherwise("video"), F.when(c("p_size") % 3 == 0, c("p_name")), c("p_brand")), "case when p_size % 2 = 0 then sha256(case when p_size % 3 = 0 then p_name else p_brand end)[1:16] end")
projection("str31_query_length_valid", "documents", "doc_id", "value", lambda: F.length(F.trim("text")).between(1, 140), "length(trim(text)) between 1 and 140")
projection("str33_source_key", "part", "p_partkey", "value", lambda: text.source_key(F.concat(c("p_name"), F.lit("!"))), "trim(regexp_replace(lower(p_name), '[^a-z0-9]', '-', 'g'), '-')")
projection("str34_criteria_key", "saved_filters", "filter_id", "value", lambda: F.sha2(F.to_json(F.struct("district", "rooms")), 256), "sha256(case when rooms is null then '{\"district\":\"' || district || '\"}' else '{\"district\":\"' || district || '\",\"rooms\":' || rooms || '}' end)")
projection("str01_normalised_text", "documents", "doc_id", "hash", lambda: F.sha2(text.normalise_listing_text("text"), 256), None)
projection("str03_phone_numbers", "documents", "doc_id", "phones", lambda: F.array_join(text.phone_numbers(c("text")), ","), None)
projection("str04_word_tokens", "documents", "doc_id", "n", lambda: F.size(text.word_tokens(F.lower("text"))).cast("bigint"), "len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_$]+')))")
projection("str16_redacted", "documents", "doc_id", "hash", lambda: F.sha2(text.redacted(c("text")), 256), None)
projection("str32_label_normalised", "nation", "n_nationkey", "value", lambda: text.normalise_label("n_name"), "lower(n_name)")
projection("mat06_half_even", "part", "p_partkey", "value", lambda: F.bround(c("p_size").cast("decimal(12,4)") / 2, 0).cast("int"), "cast(case when p_size % 2 = 0 then p_size // 2 when (p_size // 2) % 2 = 0 then p_size // 2 else p_size // 2 + 1 end as integer)")
projection("fil18_marker_matches", "documents", "doc_id", "value", lambda: F.size(F.filter(F.array(*map(F.lit, ("(?i)(?:^|\\P{L})the(?:$|\\P{L})", "(?i)(?:^|\\P{L})der(?:$|\\P{L})", "(?i)(?:^|\\P{L})que(?:$|\\P{L})"))), lambda p: F.rlike("text", p))).cast("bigint"), "cast(regexp_matches(text, '(?i)(?:^|\\P{L})the(?:$|\\P{L})')::int + regexp_matches(text, '(?i)(?:^|\\P{L})der(?:$|\\P{L})')::int + regexp_matches(text, '(?i)(?:^|\\P{L})que(?:$|\\P{L})')::int as bigint)")
projection("fil20_required_fields", "listings", "announcement_id", "missing", lambda: F.array_join(F.array_compact(F.array(*(F.when(c(x).isNull(), F.lit(x)) for x in ("price", "renovation", "source_url")))), ","), "array_to_string(list_filter([case when price is null then 'price' end, case when renovation is null then 'renovation' end, case when source_url is null then 'source_url' end], lambda x: x is not null), ',')")
projection("set08_replace_distinct", "part", "p_partkey", "value", lambda: F.array_join(F.array_distinct(F.transform(F.split("p_name", " "), lambda x: F.when(x == "large", "big").otherwise(x))), " "), "replace(p_name, 'large', 'big')")
projection("set10_first_spelling", "part", "p_partkey", "value", lambda: F.array_join(F.aggregate(F.array("p_type", F.lower("p_type"), "p_brand"), F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x))), ","), "p_type || ',' || p_brand")
projection("jsn02_tolerant_json", "events", "event_id", "k", lambda: F.coalesce(F.from_json(F.when(c("event_id") % 3 == 0, F.lit("{bad")).otherwise(c("props")), "k int")["k"], F.lit(-1)), "case when event_id % 3 = 0 then -1 else cast(json_extract_string(props, '$.k') as integer) end")
projection("jsn03_path_read", "events", "event_id", "k", lambda: F.variant_get(F.parse_json("props"), "$.k", "int"), "cast(json_extract_string(props, '$.k') as integer)")
projection("fil14_json_path_equality", "events", "event_id", "hit", lambda: F.get_json_object("props", "$.k") == "7", "json_extract_string(props, '$.k') = '7'")
projection("arr01_sorted_union", "part", "p_partkey", "value", lambda: F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.array("p_type"))), ","), "array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || [p_type])), ',')")
projection("ded06_district_folded", "nation", "n_nationkey", "value", lambda: F.lower(F.trim(F.concat(F.lit(" "), c("n_name")))), "lower(n_name)")
projection("mat05_fit_dimensions", "part", "p_partkey", "value", lambda: extraction.fitted(c("p_size") * 37, c("p_size") * 10)[0], "cast(least(p_size * 37, 800) as integer)")


def raw_fields(spark, d):
    """Model-like fields of the listings: some lack period, basis or price, some contradict themselves."""
    k = c("announcement_id")
    return t.listings(spark, d).select(
        "announcement_id", F.when(k % 6 != 0, c("price")).alias("price"), c("currency"), F.when(k % 4 != 0, c("price_period")).alias("price_period"), F.when(k % 5 != 0, c("price_basis")).alias("price_basis"),
        F.when(k % 9 == 0, "sale").when(k % 9 < 5, "rent").alias("listing_type"), F.when(k % 6 != 0, c("rooms")).alias("rooms"), F.when(k % 12 != 0, c("district")).alias("district"),
        c("address"), F.array().cast("array<string>").alias("phone_numbers"), F.lit(None).cast("string").alias("owner_type"), F.when(k % 15 == 0, "Hi").otherwise(c("description")).alias("description"),
        ((k % 100) / 100).alias("confidence"), F.when(k % 7 == 0, False).when(k % 7 < 4, True).alias("is_rental"), F.when(k % 8 == 0, 0.3).alias("rental_confidence"), F.lit("").alias("source_text"),
    )


RAW_SQL = """raw as (select announcement_id, case when k % 6 <> 0 then price end as price, case when k % 4 <> 0 then price_period end as price_period, case when k % 5 <> 0 then price_basis end as price_basis,
  case when k % 9 = 0 then 'sale' when k % 9 < 5 then 'rent' end as listing_type, case when k % 6 <> 0 then rooms end as rooms, case when k % 12 <> 0 then district end as district,
  case when k % 15 = 0 then 'Hi' else description end as description, (k % 100)::double / 100 as confidence, case when k % 7 = 0 then false when k % 7 < 4 then true end as is_rental,
  case when k % 8 = 0 then 0.3::double end as rental_confidence from (select *, announcement_id as k from listings)), flags as (select *,
  coalesce(is_rental and listing_type = 'sale' or not is_rental and listing_type = 'rent', false) as conflict, coalesce(is_rental, coalesce(listing_type <> 'sale', true)) as rental,
  price is not null or rooms is not null or district is not null as essential from raw), gate as (select *, length(description) < 5 or not essential as junk from flags)"""


@query("nrm01_normalise_listing", f"""with {RAW_SQL} select announcement_id, coalesce(price_period, 'monthly') as price_period, coalesce(price_basis, 'total') as price_basis,
  cast(case coalesce(price_period, 'monthly') when 'daily' then price * 30 when 'monthly' then price end as double) as monthly,
  concat_ws(',', case when price_period is null then 'price_period_defaulted_monthly' end, case when price_basis is null then 'price_basis_defaulted_total' end) as assumptions from raw""")
def normalise_listing(spark, d):
    rows = extraction.normalised(raw_fields(spark, d))
    return rows.select("announcement_id", "price_period", "price_basis", c("monthly").cast("double").alias("monthly"), F.array_join("assumptions", ",").alias("assumptions"))


@query("fil19_quality_gate", f"""with {RAW_SQL} select announcement_id, case when conflict or not rental or coalesce(rental_confidence, confidence) <= 0.5 or confidence < 0.4 or junk and confidence < 0.6 then 'failed'
    when price is null or junk or confidence < 0.7 then 'manual_review' else 'succeeded' end as status,
  case when conflict then 'contradictory_rental_classification' when not rental then 'not_a_rental_announcement' when coalesce(rental_confidence, confidence) <= 0.5 then 'rental_confidence_below_threshold'
    when (confidence < 0.4 or junk and confidence < 0.6) and not essential then 'rejected_not_real_estate_listing' when confidence < 0.4 or junk and confidence < 0.6 then 'low_relevance_score'
    when price is null then 'source_required_fields_missing:price' when junk then 'missing_essential_fields' when confidence < 0.7 then 'low_confidence' end as reason from gate""")
def quality_gate(spark, d):
    return extraction.gated(extraction.normalised(raw_fields(spark, d)), 0.7, ("price",)).select("announcement_id", "status", "reason")


@query("jsn05_strict_answers", "select announcement_id, announcement_id % 5 not in (0, 1) as valid, case when announcement_id % 5 not in (0, 1) then rooms end as rooms from listings")
def strict_answers(spark, d):
    k = c("announcement_id")
    good = F.to_json(F.struct("rooms", "district"))
    payload = F.when(k % 5 == 0, F.lit("{broken")).when(k % 5 == 1, F.lit('{"rooms":1,"mood":"good"}')).otherwise(good)
    rows = extraction.parsed(t.listings(spark, d).select("announcement_id", payload.alias("payload")))
    return rows.select("announcement_id", "valid", F.when(c("valid"), c("rooms")).alias("rooms"))


@query("str12_fuzzy_tag", "select p_partkey, lower(p_type) as value from part")
def fuzzy_tag(spark, d):
    """Tags written with a letter too many, against the table of tags in use."""
    part = t.table(spark, d, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("s")).alias("text"), F.lower("p_type").alias("name"))
    names = part.groupBy("name").agg(F.min("p_partkey").alias("place"))
    return part.select("p_partkey", "text").join(fuzzy.fuzzy_matches(part, names), "text", "left").select("p_partkey", F.col("name").alias("value"))


#: Twice the longest common prefix and suffix over all letters: what the ratio is for two names with one letter changed in the middle.
@query("str12_fuzzy_part_names", """with n as (select distinct split_part(p_name, ' ', 1) as name from part), x as (select name, name[1:1] || '#' || name[2:] as text from n)
  select text, name, 2.0::double * length(name) / (2 * length(name) + 1) as ratio from x""")
def fuzzy_part_names(spark, d):
    """First words of part names with a mark put in, against all first words: the word itself is the most alike."""
    names = t.table(spark, d, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name")).groupBy("name").agg(F.lit(0).alias("place"))
    texts = names.select(F.concat(F.substring("name", 1, 1), F.lit("#"), F.expr("substring(name, 2)")).alias("text"))
    return fuzzy.fuzzy_matches(texts, names)
