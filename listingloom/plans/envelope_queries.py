"""Queries on shown texts, message and job envelopes, configuration tables and recipe modes."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from listingloom.functions import rendering, similarity
from listingloom.operators import content, dedup, envelopes, metrics, parsing, predicates, prededup, settings
from listingloom.plans.parsing_queries import SEGMENTS, digests
from listingloom.plans.registry import query
from listingloom.sources import messages, plugins, web
from listingloom.sources import tables as t

c = F.col

SOURCES_SQL = """children as (select parent_id as announcement_id, count(*) as children from listings where parent_id is not null group by 1),
  pictured as (select distinct announcement_id, true as has_media from media),
  full_rows as (select l.*, 1 + coalesce(k.children, 0) as source_count, coalesce(m.has_media, false) as has_media from listings l left join children k using (announcement_id) left join pictured m using (announcement_id)),
  cards as (select *, left(concat_ws(chr(10), 'Narx: ' || coalesce(trim(monthly || ' ' || currency || case when price_basis = 'per_person' then '/kishiga' else '/oy' end), 'Noma''lum'),
    'Davr/asos: ' || price_period || '/' || price_basis, 'Tuman: ' || district, 'Xona: ' || rooms, 'Remont: ' || coalesce(renovation, 'Noma''lum'), 'Manbalar: ' || source_count,
    'Rasm: ' || case when has_media then 'bor' else 'yoq' end, 'Link: ' || source_url, left(description, 280)), 900) as card from full_rows)"""


def full_rows(spark, d):
    """Listings with their number of sources and whether they have a picture."""
    rows = t.listings(spark, d)
    children = rows.where("parent_id is not null").groupBy(c("parent_id").alias("announcement_id")).agg(F.count("*").alias("children"))
    pictured = t.media(spark, d).select("announcement_id").distinct().withColumn("has_media", F.lit(True))
    joined = rows.join(children, "announcement_id", "left").join(pictured, "announcement_id", "left")
    return joined.withColumn("source_count", F.coalesce("children", F.lit(0)) + 1).withColumn("has_media", F.coalesce("has_media", F.lit(False)))


@query("str25_card", f"with {SOURCES_SQL} select announcement_id, card as value from cards")
def cards(spark, d):
    return full_rows(spark, d).select("announcement_id", rendering.card(F.struct("*")).alias("value"))


@query("str25_result_page", f"""with {SOURCES_SQL}, placed as (select *, row_number() over (partition by district, rooms order by monthly nulls last, announcement_id) as place from cards where status = 'active' and parent_id is null)
  select district, rooms, left(string_agg(card, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place), 3900) as page from placed where place <= 10 group by 1, 2""")
def result_pages(spark, d):
    """The first page of results of every district and number of rooms."""
    newest = Window.partitionBy("district", "rooms").orderBy(c("monthly").asc_nulls_last(), "announcement_id")
    rows = full_rows(spark, d).where("status = 'active' and parent_id is null").withColumn("place", F.row_number().over(newest)).where("place <= 10")
    told = rows.select("district", "rooms", F.struct("place", rendering.card(F.struct("*")).alias("card")).alias("p"))
    listed = told.groupBy("district", "rooms").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return listed.select("district", "rooms", rendering.page(F.transform("p", lambda x: x["card"])).alias("page"))


@query("str23_notification_text", f"""with {SOURCES_SQL}, asked as (select *, announcement_id as k, case announcement_id % 3 when 0 then true when 1 then false end as furniture,
    case when announcement_id % 5 = 0 then repeat(description || '. ', 6) when announcement_id % 4 = 0 then description || ' ' || phone when announcement_id % 7 <> 0 then description else '' end as said from full_rows),
  cut as (select *, case when k % 5 <> 0 and k % 4 = 0 then description || ' [REDACTED]' else trim(said) end as whole from asked)
  select announcement_id, concat_ws(chr(10), 'Siz saqlagan filtringizga mos yangi e''lon topildi.' || chr(10), 'Filtr: rooms ' || rooms,
    'Narxi: ' || coalesce(case when price_period = 'daily' then 'kuniga ' when price_period = 'one_time' then '' else 'oyiga ' end
      || case when price = floor(price) then cast(cast(price as bigint) as varchar) else cast(price as varchar) end || ' ' || currency || case when price_period = 'one_time' then ' (sotuv uchun)' else '' end
      || case when price_basis = 'per_person' then ', bir kishi uchun' else '' end, 'ko''rsatilmagan'),
    'Joylashuvi: ' || district, 'Xonalar: ' || rooms || ' ta', 'Maydoni: ' || area || ' m2', 'Ta''miri: ' || case renovation when 'good' then 'yaxshi ta''mir' else renovation end,
    'Mebel: ' || case when furniture then 'bor' when not furniture then 'yo''q' end, 'Manzil: ' || address,
    chr(10) || 'Qisqacha: ' || nullif(case when length(whole) <= 220 then whole else rtrim(left(whole, 217)) || '...' end, ''),
    case when source_count > 1 then 'Bu e''lon ' || source_count || ' ta kanalda uchradi.' end, 'Manba: ' || source_url) as value from cut""")
def notifications(spark, d):
    k = c("announcement_id")
    said = F.when(k % 5 == 0, F.repeat(F.concat("description", F.lit(". ")), 6)).when(k % 4 == 0, F.concat_ws(" ", "description", "phone")).when(k % 7 != 0, c("description")).otherwise("")
    rows = full_rows(spark, d).withColumn("furniture", F.when(k % 3 == 0, True).when(k % 3 == 1, False)).withColumn("filter_name", F.concat(F.lit("rooms "), c("rooms").cast("string")))
    return rows.withColumn("description", said).select("announcement_id", rendering.notification(F.struct("*")).alias("value"))


@query("str24_stats_post", """select concat_ws(chr(10), 'Listingloom kunlik shaffoflik hisoboti', 'Sana: 1996-01-15', 'Tekshirilgan e''lonlar: ' || count(*) filter (cast(created_at as date) = date '1996-01-15'),
  'Dublikatlar: ' || count(*) filter (cast(created_at as date) = date '1996-01-15' and parent_id is not null), 'Faol e''lonlar: ' || count(*) filter (status = 'active' and parent_id is null),
  'O''rtacha oylik narx: ' || coalesce(cast(round(avg(cast(monthly as double)) filter (status = 'active' and parent_id is null and price_basis = 'total' and currency = 'USD'), 0) as bigint) || ' USD', 'narx yetarli emas')) as post from listings""")
def stats_post(spark, d):
    row = content.daily_stats(t.listings(spark, d), "1996-01-15")
    return row.select(rendering.stats_post(F.lit("1996-01-15"), c("day_total"), c("day_duplicates"), c("active_count"), c("average_price")).alias("post"))


OFFERS_SQL = "offers as (select * from listings where status = 'active' and parent_id is null and monthly > 0 and price_period <> 'one_time')"


@query("str24_district_post", f"""with {OFFERS_SQL}, s as (select district, count(*) as n, round(avg(cast(monthly as double)), 4) as mean, min(monthly) as lo, max(monthly) as hi from offers where currency = 'USD' group by 1 having count(*) >= 2),
  top as (select * from s order by n desc, mean, district limit 5)
  select 'Tumanlar bo''yicha bozor narxi statistikasi' || chr(10) || 'Sana: 1996-01-15' || chr(10) || 'Faqat active canonical, umumiy oylik ijara e''lonlari hisoblandi.' || chr(10)
    || string_agg(district || ': o''rtacha ' || cast(round(mean, 0) as bigint) || ' USD (' || n || ' ta, min ' || cast(round_even(lo, 0) as bigint) || ', max ' || cast(round_even(hi, 0) as bigint) || ')', chr(10) order by n desc, mean, district) as post from top""")
def district_post(spark, d):
    rows = content.district_stats(t.listings(spark, d), 5)
    order = F.struct((-c("n")).alias("o"), "average_price", "district", "n", "least_price", "greatest_price")
    return rows.agg(F.array_sort(F.collect_list(order)).alias("d")).select(rendering.district_post(F.lit("1996-01-15"), c("d")).alias("post"))


@query("str24_offer_post", f"""with {OFFERS_SQL}, ch as (select parent_id, count(*) as n from listings where parent_id is not null group by 1),
  top as (select o.* from offers o left join ch on ch.parent_id = o.announcement_id where currency in ('USD', 'UZS') order by monthly, coalesce(ch.n, 0) desc, created_at, announcement_id limit 1)
  select concat_ws(chr(10), 'Bugungi konservativ top taklif', 'Tuman: ' || district, 'Xona: ' || rooms, 'Oylik narx: ' || cast(round_even(monthly, 0) as bigint) || ' ' || currency,
    'Ranking sababi: umumiy oylik narxi aniq, active canonical e''lonlar ichida arzon kandidat.', 'Eslatma: bu kafolat yoki tavsiya emas; ma''lumotni manbadan tekshiring.', 'Manba: ' || source_url) as post from top""")
def offer_post(spark, d):
    rows = content.top_offers(t.listings(spark, d), 1)
    return rows.select(rendering.offer_post(c("district"), c("rooms"), c("monthly"), c("currency"), c("source_url")).alias("post"))


def audit_events(spark, d):
    k = c("event_id")
    return t.table(spark, d, "events").select(
        "event_id", c("event_type").alias("flag_name"), (k % 2 == 0).alias("previous_enabled"), (k % 3 == 0).alias("new_enabled"), (k % 5).cast("int").alias("previous_version"),
        (k % 5 + 1).cast("int").alias("new_version"), F.concat(F.lit("user "), c("user_id").cast("string")).alias("actor"), F.when(k % 4 == 0, "rollout").otherwise("").alias("reason"), c("ts").alias("occurred_at"),
    )


STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
LINE = f"event_type || '|' || (event_id % 2 = 0)::int || '|' || (event_id % 3 = 0)::int || '|' || event_id % 5 || '|' || (event_id % 5 + 1) || '|user ' || user_id || '|' || case when event_id % 4 = 0 then 'rollout' else '' end || '|' || {STAMP}"


@query("str35_audit_line", f"select event_id, {LINE} as value from events")
def audit_lines(spark, d):
    return audit_events(spark, d).select("event_id", envelopes.audit_line(F.struct("*")).alias("value"))


@query("str35_audit_parsed", """select event_id, event_id % 7 <> 1 as known, case when event_id % 7 <> 1 then event_type end as flag_name, case when event_id % 7 <> 1 then event_id % 2 = 0 end as previous_enabled, case when event_id % 7 <> 1 then event_id % 3 = 0 end as new_enabled,
  case when event_id % 7 = 0 then 0 when event_id % 7 <> 1 then event_id % 5 end::int as previous_version, case when event_id % 7 = 0 then 0 when event_id % 7 <> 1 then event_id % 5 + 1 end::int as new_version,
  case when event_id % 7 <> 1 then 'user ' || user_id end as actor, case when event_id % 7 <> 1 then epoch_us(ts) end as at from events""")
def parsed_audits(spark, d):
    """Lines of eight parts, older ones of six, and broken ones."""
    rows = audit_events(spark, d).select("*", envelopes.audit_line(F.struct("*")).alias("line"))
    older = F.concat_ws("|", F.slice(F.split("line", r"\|"), 1, 3), F.slice(F.split("line", r"\|"), 6, 3))
    line = F.when(c("event_id") % 7 == 0, older).when(c("event_id") % 7 == 1, F.concat("line", F.lit("|more"))).otherwise(c("line"))
    told = rows.select("event_id", envelopes.parsed_audit_line(line).alias("a"))
    return told.select(
        "event_id", c("a").isNotNull().alias("known"), "a.flag_name", "a.previous_enabled", "a.new_enabled", "a.previous_version", "a.new_version", "a.actor", F.unix_micros(c("a.occurred_at")).alias("at")
    )


@query("str36_plain_reason", """select event_id, case event_id % 11 when 0 then 'AI modeli ' || event_type || ' ishonch darajasi past javob berdi. Javob vaqti: ' || user_id || ' ms.'
  when 1 then 'AI modeli m muvaffaqiyatli javob berdi. Zaxira bosqichi: ' || user_id || '. Xatolik turi: timeout.'
  when 2 then 'Telegram xabari dublikat tekshiruvdan o‘tdi. Qaror: AI tekshiruviga yuborildi. Manba: s' || user_id || '. Moslik belgilar soni: ' || event_id || '.'
  when 3 then 'E’lon AI tomonidan muvaffaqiyatli qayta ishlandi. Manba: s' || user_id || '. Saqlangan rasmlar soni: 0.'
  when 4 then 'E’lon avtomatik rad etildi. Manba: s' || user_id || '. Sabab: not a rental.'
  when 5 then 'E’lon rasmlarini storage''ga saqlashda muammo yuz berdi. Manba: noma''lum. Keyingi harakat: ' || case when event_id % 2 = 0 then 'qayta uriniladi' else 'qo‘lda tekshirish kerak' end || '.'
  when 6 then 'Bir nechta foydalanuvchiga notification yuborilmadi. Muammoli yuborishlar soni: ' || user_id || '.'
  when 7 then 'Saqlangan filtrlarni e’lonlar bilan solishtirishda xatolik yuz berdi. Xatolik turi: ' || event_type || '.'
  when 8 then 'Telegram listener acc' || user_id || ' vaqtincha cheklovga tushdi. Taxminiy kutish vaqti: ' || event_id || 's.'
  when 9 then 'Telegram listener acc' || user_id || ' holati o‘zgardi: Telegram vaqtincha chekladi.'
  else 'Tizim xabari: odd code ' || event_type || ': ' || user_id end as value from events""")
def plain_reasons(spark, d):
    k, user, kind = c("event_id"), c("user_id").cast("string"), c("event_type")
    parts = [
        F.concat(F.lit("llm_attempt model="), kind, F.lit(" status=low_confidence latency_ms="), user), F.concat(F.lit("llm_attempt model=m status=success stage="), user, F.lit(" error_type=timeout")),
        F.concat(F.lit("pre_ai_dedup decision=proceed_to_ai source=s"), user, F.lit(" signal_count="), k.cast("string")), F.concat(F.lit("ai_processing succeeded source=s"), user),
        F.concat(F.lit("ai_processing auto_rejected source=s"), user, F.lit(" reason=not_a_rental")), F.concat(F.lit("ai_processing storage_failure retryable="), F.when(k % 2 == 0, "True").otherwise("False")),
        F.concat(F.lit("notification delivery bulk failure count="), user), F.concat(F.lit("notification filter match failed: "), kind),
        F.concat(F.lit("Listener account acc"), user, F.lit(" hit FloodWait for "), k.cast("string"), F.lit("s")), F.concat(F.lit("Listener account acc"), user, F.lit(" health changed to flood_wait")),
    ]
    reason = F.concat(F.lit("odd_code "), kind, F.lit("="), user)
    for n, p in enumerate(parts):
        reason = F.when(k % 11 == n, p).otherwise(reason)
    return t.table(spark, d, "events").select("event_id", rendering.plain_reason(reason).alias("value"))


@query("str20_source_identifier", """select p_partkey, case p_partkey % 6 when 0 then '@' || replace(p_name, ' ', '_') when 1 then '@' || replace(p_name, ' ', '_') when 2 then '@' || replace(p_name, ' ', '_') when 3 then '-100' || p_partkey end as value from part""")
def identifiers(spark, d):
    k, name = c("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_"))
    given = (
        F.when(k % 6 == 0, F.concat(F.lit("  HTTPS://T.me/"), name)).when(k % 6 == 1, F.concat(F.lit("t.me/"), name)).when(k % 6 == 2, F.concat(F.lit("@"), name, F.lit(" ")))
        .when(k % 6 == 3, F.concat(F.lit("-100"), k.cast("string"))).when(k % 6 == 4, F.concat(F.lit("@"), c("p_brand"))).otherwise(F.lit("-100x"))
    )
    return t.table(spark, d, "part").select("p_partkey", envelopes.source_identifier(given).alias("value"))


@query("src21_suggestions", """with r as (select event_id, user_id, ts, case when event_type = 'error' then null else '@suggested_' || user_id % 400 end as identifier from events),
  f as (select identifier, min((ts, user_id)) as one from r where identifier is not null group by 1)
  select event_id, identifier, case when identifier is null then 'invalid' when substr(identifier, 12)::int < 50 then 'known' when (ts, user_id) = one then 'submitted' else 'repeated' end as result from r left join f using (identifier)""")
def suggested(spark, d):
    rows = t.table(spark, d, "events")
    name = F.concat(F.lit("suggested_"), (c("user_id") % 400).cast("string"))
    source = F.when(c("event_type") == "error", F.concat(F.lit("@no!"), name)).when(c("event_type") == "view", F.concat(F.lit("https://t.me/"), name)).otherwise(F.concat(F.lit("@"), name))
    known = rows.where("user_id % 400 < 50").select(F.concat(F.lit("@"), name).alias("identifier"))
    return envelopes.suggestions(rows.select("event_id", "user_id", source.alias("source"), c("ts").alias("at")), known).select("event_id", "identifier", "result")


@query("src05_message_encode", f"""select event_id, json_object('schema_version', 'raw.v1', 'event_type', case when event_id % 5 = 0 then 'edited' else 'created' end, 'idempotency_key', 'post:' || event_id, 'account_key', 'acc' || event_id % 10,
  'source_id', cast(user_id as varchar), 'source_channel_id', '-100' || user_id, 'source_message_id', cast(event_id as varchar), 'occurred_at', {STAMP}, 'text', case when event_id % 3 <> 0 then event_type end,
  'forward_metadata', case when event_id % 4 = 0 then {{'channel_id': '-777', 'message_id': cast(event_id // 4 as varchar)}} end, 'media', [{{'media_id': cast(event_id as varchar), 'media_type': 'photo', 'mime_type': null::varchar}}],
  'media_group_id', null::varchar, 'source_message_ids', [cast(event_id as varchar)], 'parser_mode', 'active')::varchar as payload from events""")
def encoded_messages(spark, d):
    k, text = c("event_id"), c("event_id").cast("string")
    forward = F.when(k % 4 == 0, F.struct(F.lit("-777").alias("channel_id"), F.floor(k / 4).cast("string").alias("message_id")))
    rows = t.table(spark, d, "events").select(
        F.lit("raw.v1").alias("schema_version"), F.when(k % 5 == 0, "edited").otherwise("created").alias("event_type"), F.concat(F.lit("post:"), text).alias("idempotency_key"),
        F.concat(F.lit("acc"), (k % 10).cast("string")).alias("account_key"), c("user_id").cast("string").alias("source_id"), F.concat(F.lit("-100"), c("user_id").cast("string")).alias("source_channel_id"),
        text.alias("source_message_id"), c("ts").alias("occurred_at"), F.when(k % 3 != 0, c("event_type")).alias("text"), forward.alias("forward_metadata"),
        F.array(F.struct(text.alias("media_id"), F.lit("photo").alias("media_type"), F.lit(None).cast("string").alias("mime_type"))).alias("media"), F.lit(None).cast("string").alias("media_group_id"),
        F.array(text).alias("source_message_ids"), F.lit("active").alias("parser_mode"),
    )
    return messages.encode(rows).select(F.get_json_object("payload", "$.source_message_id").cast("bigint").alias("event_id"), "payload")


@query("src23_job_payload", """select o_orderkey, o_orderkey % 6 = 1 as malformed, o_custkey as user_id, case when o_orderkey % 3 = 0 then 'pending' else 'sent' end as status, case when o_orderkey % 3 = 0 then 0 else 10 end as priority,
  case when o_orderkey % 3 = 0 then 'notifications.standard' else 'notifications.high' end as queue_name, case when o_orderkey % 3 = 0 then 0 else o_orderkey % 4 end::int as attempts,
  case when o_orderkey % 6 <> 1 then cast(o_orderdate as date) end as created, case when o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 then cast(o_orderdate as date) + 1 end as next_try from orders""")
def job_payload(spark, d):
    """Jobs encoded with all their fields, older ones without the optional ones, and some without a time."""
    k = c("o_orderkey")
    made, again = F.when(k % 6 != 1, c("o_orderdate")), F.when(k % 2 == 0, c("o_orderdate") + F.expr("interval 1 day"))
    core = [F.concat(F.lit("n"), k.cast("string")).alias("notification_id"), c("o_custkey").alias("user_id"), F.lit("f1").alias("filter_id"), k.cast("string").alias("announcement_id"), made.alias("created_at")]
    more = [F.lit("sent").alias("status"), F.lit(10).alias("priority"), F.lit("notifications.high").alias("queue_name"), (k % 4).cast("int").alias("attempts"), again.alias("next_attempt_at"), F.lit(None).cast("string").alias("telegram_message_id")]
    orders = t.table(spark, d, "orders")
    whole, older = orders.where(k % 3 != 0).select(*core, *more), orders.where(k % 3 == 0).select(*core)
    payloads = envelopes.encoded(whole).select("payload").unionByName(envelopes.encoded(older).select("payload"))
    rows = envelopes.decoded_jobs(payloads)
    return rows.select(
        c("announcement_id").cast("bigint").alias("o_orderkey"), "malformed", "user_id", "status", "priority", "queue_name", "attempts", F.to_date("created_at").alias("created"), F.to_date("next_attempt_at").alias("next_try")
    )


@query("src13_source_specs", """select c_custkey, case when c_custkey % 5 in (0, 1, 2) then case c_custkey % 5 when 2 then 0 else 2 end end::int as n, case when c_custkey % 5 in (0, 1) then 1 when c_custkey % 5 = 2 then 0 end::int as enabled,
  case when c_custkey % 5 in (0, 1) then '@' || c_mktsegment end as first from customer""")
def source_specs(spark, d):
    k = c("c_custkey")
    listed = F.concat(F.lit('[{"source_type":"telegram","identifier":"@'), c("c_mktsegment"), F.lit('"},{"source_type":"website","identifier":"https://x/'), k.cast("string"), F.lit('","enabled":false}]'))
    raw = (
        F.when(k % 5 == 0, listed).when(k % 5 == 1, F.concat(F.lit('{"sources":'), listed, F.lit("}"))).when(k % 5 == 2, F.lit("[]"))
        .when(k % 5 == 3, F.lit('[{"identifier":"@no_type"}]')).otherwise(F.concat(F.lit("{broken"), listed))
    )
    rows = t.table(spark, d, "customer").select("c_custkey", envelopes.source_specs(raw).alias("s"))
    return rows.select("c_custkey", F.when(c("s").isNotNull(), F.size("s")).alias("n"), F.when(c("s").isNotNull(), F.size(F.filter("s", lambda x: x["enabled"]))).alias("enabled"), F.get("s", F.lit(0))["identifier"].alias("first"))


BREAKDOWN_SQL = "(rooms = 4)::int * 10 + coalesce(renovation = 'good', false)::int * 30 + (source_url is not null)::int * 100"


@query("jsn01_breakdown_round_trip", f"""select announcement_id, case when announcement_id % 9 = 0 then 0 else {BREAKDOWN_SQL} end as score, case when announcement_id % 9 = 0 then '' else
  concat_ws(',', case when rooms = 4 then 'rooms' end, case when renovation = 'good' then 'similar_description' end, case when source_url is not null then 'source_url' end) end as names from listings""")
def breakdowns(spark, d):
    """Stored breakdowns of three signals read back; every ninth is no breakdown."""
    signals = (("rooms", 10, c("rooms") == 4), ("similar_description", 30, c("renovation") == "good"), ("source_url", 100, c("source_url").isNotNull()))
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), hit.alias("matched"), F.concat(F.lit(n + " of "), c("announcement_id").cast("string")).alias("reason")) for n, w, hit in signals))
    stored = F.when(c("announcement_id") % 9 == 0, F.lit('{"name": "rooms"')).otherwise(envelopes.breakdown_json(listed))
    rows = t.listings(spark, d).select("announcement_id", envelopes.breakdown_score(stored).alias("b"))
    return rows.select("announcement_id", "b.score", F.array_join("b.names", ",").alias("names"))


@query("jsn06_provider_answer", """select event_id, event_id % 7 < 3 as valid, case event_id % 7 when 0 then 0.5::double when 1 then 0.75::double when 2 then 0.0::double end as confidence,
  case when event_id % 7 < 3 then event_type end as answer, case when event_id % 7 = 5 then '' else 'm' || event_id % 3 end as model from events""")
def provider_answers(spark, d):
    """Objects, JSON texts, no confidence; then a list, a broken text, no choices, and a confidence that is no number."""
    k = c("event_id")
    inner = F.concat(F.lit('{"answer":"'), c("event_type"), F.lit('"'))
    as_text = lambda s: F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('\\"')), F.lit('"'))
    content_ = (
        F.when(k % 7 == 0, F.concat(inner, F.lit(',"confidence":0.5}'))).when(k % 7 == 1, as_text(F.concat(inner, F.lit(',"confidence":0.75}')))).when(k % 7 == 2, as_text(F.concat(inner, F.lit("}"))))
        .when(k % 7 == 3, F.lit("[1]")).when(k % 7 == 4, as_text(F.lit("{no"))).otherwise(F.concat(inner, F.lit(',"confidence":"high"}')))
    )
    model = F.concat(F.lit('"model":"m'), (k % 3).cast("string"), F.lit('"'))
    body = F.when(k % 7 == 5, F.lit('{"choices":[]}')).otherwise(F.concat(F.lit('{"choices":[{"message":{"content":'), content_, F.lit("}}],"), model, F.lit("}")))
    rows = t.table(spark, d, "events").select("event_id", envelopes.provider_answer(body).alias("a"))
    return rows.select("event_id", "a.valid", "a.confidence", F.when(c("a.valid"), F.get_json_object("a.content", "$.answer")).alias("answer"), "a.model")


@query("nrm07_envelope", """select event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(('0x' || h[17:17])::int % 4) + 1] || h[18:20] || '-' || h[21:32] as announcement_id,
  case when event_id % 4 = 0 then 'business_quality' when event_id % 4 = 1 then 'low_confidence' end as review_reason, case when event_id % 4 < 2 then 'manual_review' else 'active' end as status,
  case when event_id % 3 = 0 then event_id || ',' || (event_id + 1) else cast(event_id as varchar) end as message_ids
  from (select *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('post:' || event_type || ':' || event_id)) as h from events)""")
def envelope(spark, d):
    k = c("event_id")
    body = F.to_json(F.struct(
        F.concat_ws(":", F.lit("post"), "event_type", k.cast("string")).alias("idempotency_key"), c("user_id").cast("string").alias("source_id"), k.cast("string").alias("source_message_id"),
        F.when(k % 3 == 0, F.array(k.cast("string"), (k + 1).cast("string"))).alias("source_message_ids"), envelopes.iso(c("ts")).alias("occurred_at"),
        F.when(k % 4 == 0, "not_rental").when(k % 4 == 1, "low_confidence").when(k % 4 == 2, "").alias("manual_review_reason"),
    ))
    rows = envelopes.listing_envelope(t.table(spark, d, "events").select("event_id", body.alias("payload")))
    return rows.select("event_id", "announcement_id", "review_reason", "status", F.array_join("source_message_ids", ",").alias("message_ids"))


@query("prj05_admin_summary", """select announcement_id, cast(price as varchar) as price, cast(area as varchar) as area_sqm, rooms, case when announcement_id % 3 = 0 then description || ' [REDACTED]'
  when announcement_id % 3 = 1 then rtrim(left(trim(repeat(description || ' ', 12)), 419)) || '...' else description end as description, source_url from listings""")
def admin_summary(spark, d):
    k = c("announcement_id")
    said = F.when(k % 3 == 0, F.concat_ws("  ", "description", "phone")).when(k % 3 == 1, F.repeat(F.concat("description", F.lit(" \n")), 12)).otherwise(c("description"))
    rows = content.admin_summary(t.listings(spark, d).withColumn("description", said))
    return rows.select("announcement_id", "price", "area_sqm", "rooms", "description", "source_url")


@query("fil21_media_supported", """select p_partkey, 1 + (p_size % 2 = 0)::int + (p_size % 3 = 0)::int as kept from part""")
def supported(spark, d):
    item = lambda kind, mime: F.struct(c("p_name").alias("media_id"), F.lit(kind).alias("media_type"), mime.alias("mime_type"), F.lit(1).alias("size_bytes"), F.lit("x").alias("access_hash"))
    media = F.array(
        item("photo", F.lit(None).cast("string")), item("document", F.when(c("p_size") % 2 == 0, "image/png").otherwise("application/pdf")),
        item("image", F.when(c("p_size") % 3 == 0, "image/jpeg")), item("video", F.lit("image/gif")),
    )
    return t.table(spark, d, "part").select("p_partkey", F.size(messages.supported_media(media)).alias("kept"))


@query("fil23_cohort_policy", """with a as (select user_id as allowed_id from users where premium_until > timestamp '2024-01-01')
  select user_id, case when status = 'active' then true else allowed_id is not null end as allowed, case when status = 'active' then 'bot_enabled' when allowed_id is not null then 'allowlisted' else 'not_allowlisted' end as reason
  from users left join a on allowed_id = user_id""")
def cohort(spark, d):
    rows = t.users(spark, d)
    allow = rows.where("premium_until > timestamp_ntz'2024-01-01'").select("user_id")
    return plugins.cohort_access(rows.select("user_id", (c("status") == "active").alias("open")), allow, c("open")).select("user_id", "allowed", "reason")


@query("ext06_profile_strategies", """select event_id, case when event_id % 3 = 0 then event_type when event_id % 4 = 0 and event_id % 2 = 0 then '' when event_id % 4 = 1 and event_id % 5 = 0 then '' end as text from events""")
def strategies(spark, d):
    """Texts are null in two of three updates; half have media, a fifth an album."""
    k = c("event_id")
    update = F.struct(
        F.when(k % 3 == 0, c("event_type")).alias("text"), F.when(k % 2 == 0, F.array(k)).otherwise(F.array().cast("array<bigint>")).alias("media"), F.when(k % 5 == 0, k.cast("string")).alias("media_group_id"),
    )
    profile = F.when(k % 4 == 0, "caption_first").when(k % 4 == 1, " album_text_merge").when(k % 4 == 2, "other")
    return t.table(spark, d, "events").select("event_id", plugins.extracted_text(profile, update).alias("text"))


@query("par02_metadata_precedence", """select event_id, case when event_id % 5 = 0 then 'nested' when event_id % 3 = 0 then 'payload' when event_id % 2 = 0 then 'event' end as parser_key,
  case when event_id % 7 = 0 then 'shadow' when event_id % 2 = 0 then 'active' end as parser_mode from events""")
def precedence(spark, d):
    k = c("event_id")
    payload = F.to_json(F.struct(
        F.when(k % 3 == 0, "payload").otherwise("").alias("parser_key"),
        F.struct(F.when(k % 5 == 0, "nested").alias("parser_key"), F.when(k % 7 == 0, "shadow").otherwise("").alias("parser_mode")).alias("source_parser"),
    ))
    event = {"parser_key": F.when(k % 2 == 0, "event"), "parser_mode": F.when(k % 2 == 0, "active")}
    told = t.table(spark, d, "events").select("event_id", parsing.metadata(event, payload).alias("m"))
    return told.select("event_id", "m.parser_key", "m.parser_mode")


@query("par13_family_shortcuts", """select event_id, case event_id % 4 when 0 then 'buffer' when 1 then 'quarantine' end as decision,
  case event_id % 4 when 0 then 'stateful_buffer_required,buffer_not_configured' when 1 then 'custom_parser_plugin_required' end as reasons from events""")
def families(spark, d):
    k = c("event_id")
    family = F.when(k % 4 == 0, "buffered_thread").when(k % 4 == 1, "custom").when(k % 4 == 2, "mixed_feed").otherwise("single_listing")
    told = t.table(spark, d, "events").select("event_id", parsing.family_shortcut(family).alias("s"))
    return told.select("event_id", "s.decision", F.array_join("s.reasons", ",").alias("reasons"))


@query("par15_candidate_key", f"""with {SEGMENTS} select post_id, index, case when k = 1 then 'post:' || post_id else 'post:' || post_id || ':candidate:c' || index end as key, 'm' || post_id || '::candidate::' || index as message_id from told where policy = 'emit'""")
def candidate_keys(spark, d):
    rows = parsing.parse(digests(spark, d), parsing.RECIPES["generic.digest_blocks"])
    counted = rows.join(rows.groupBy("post_id").agg(F.count("*").alias("k")), "post_id").where("policy = 'emit'")
    post = c("post_id").cast("string")
    key = parsing.candidate_key(F.concat(F.lit("post:"), post), F.concat(F.lit("c"), c("index").cast("string")), c("k") == 1)
    return counted.select("post_id", "index", key.alias("key"), parsing.fanout_message_id(F.concat(F.lit("m"), post), c("index")).alias("message_id"))


@query("par16_modes", f"""with {SEGMENTS} select post_id, 'candidate' as kind, index from told where policy = 'emit' and post_id % 3 = 0
  union all select post_id, 'audit', index from told where post_id % 3 = 1 union all select distinct post_id, 'passthrough', 0 from told where post_id % 3 <> 0""")
def modes(spark, d):
    mode = F.when(c("post_id") % 3 == 0, "active").when(c("post_id") % 3 == 1, "shadow").otherwise("disabled")
    rows = parsing.by_mode(digests(spark, d).withColumn("mode", mode), parsing.RECIPES["generic.digest_blocks"])
    return rows.select("post_id", "kind", "index")


LINE_HASH = "('0x' || sha256(n_nationkey || ':' || n_name || ':' || n_regionkey)[1:15])::bigint"


@query("stm15_config_fingerprint", f"select sha256(count(*) || '|' || sum({LINE_HASH})::varchar || '|' || bit_xor({LINE_HASH})) as fingerprint from nation")
def config_fingerprint(spark, d):
    return settings.fingerprint(t.table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query("stm15_config_changes", """select c_custkey, case when c_custkey % 10 = 0 then 'removed' when c_custkey % 10 = 1 then 'added' else 'changed' end as change from customer where c_custkey % 10 in (0, 1) or c_mktsegment = 'BUILDING'""")
def config_changes(spark, d):
    """Two states of a table of bindings: some rows come, some go, those of a segment get another profile."""
    rows = t.table(spark, d, "customer").select("c_custkey", c("c_mktsegment").alias("profile"), "c_nationkey")
    before, after = rows.where("c_custkey % 10 <> 1"), rows.where("c_custkey % 10 <> 0").withColumn("profile", F.when(c("profile") == "BUILDING", "default").otherwise(c("profile")))
    return settings.changes(before, after, ["c_custkey"], ["profile", "c_nationkey"])


@query("set05_schema_drift", """with e as (select distinct source, lang from documents where lang is not null and doc_id in (select doc_id from labels)), a as (select distinct source, lang from documents where doc_id not in (select doc_id from labels))
  select source, lang, 'missing' as side from (select * from e except select * from a) union all select source, lang, 'unexpected' from (select * from a except select * from e)""")
def schema_drift(spark, d):
    """Pairs of (table, column) names: here the source and language of labelled documents against those of the others."""
    docs, labels = t.table(spark, d, "documents"), t.table(spark, d, "labels").select("doc_id")
    expected, actual = docs.join(labels, "doc_id", "left_semi").where("lang is not null"), docs.join(labels, "doc_id", "left_anti")
    e, a = (x.select("source", F.coalesce("lang", F.lit("\0")).alias("lang")) for x in (expected, actual))
    return settings.drift(e, a, ["source", "lang"]).withColumn("lang", F.nullif("lang", F.lit("\0")))


@query("mat03_hash_strength", """select a.announcement_id, a.media_id as a, b.media_id as b, 1 - bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint))::double / 64 as strength
  from media a join media b on a.announcement_id = b.announcement_id and a.media_id < b.media_id""")
def hash_strength(spark, d):
    m = t.media(spark, d)
    pairs = m.alias("a").join(m.alias("b"), (c("a.announcement_id") == c("b.announcement_id")) & (c("a.media_id") < c("b.media_id")))
    return pairs.select("a.announcement_id", c("a.media_id").alias("a"), c("b.media_id").alias("b"), similarity.hash_strength(similarity.hamming(c("a.phash"), c("b.phash"))).alias("strength"))


@query("join15_phone_overlap", "with f as (select phone, min(announcement_id) as first from listings group by 1) select announcement_id as post_id, first as phone_ref from listings join f using (phone) where first < announcement_id")
def phone_overlap(spark, d):
    """Posts that name the phone of a listing, against the first earlier post that does."""
    none = F.lit(None).cast("string")
    posts = t.listings(spark, d).select(
        c("announcement_id").alias("post_id"), F.concat_ws(", tel ", "description", "phone").alias("text"), none.alias("forward_key"), F.lit(None).cast("bigint").alias("parent_ref"), none.alias("phash")
    )
    return prededup.phone_matches(prededup.signals(posts))


@query("dat06_valid_windows", """select event_id, case event_id % 3 when 0 then ts - interval 1 hour else ts + to_hours((event_id % 80)::int) end > ts and event_id % 80 between 1 and 72 as valid from events""")
def valid_windows(spark, d):
    k = c("event_id")
    end = F.when(k % 3 == 0, c("ts") - F.expr("interval 1 hour")).otherwise(c("ts") + F.make_dt_interval(hours=(k % 80).cast("int")))
    return t.table(spark, d, "events").select("event_id", metrics.window_valid(c("ts"), end, k % 80).alias("valid"))


@query("nrm03_checked_requests", """select c_custkey, case when c_custkey % 4 = 0 then 'North side' else c_mktsegment end || case when c_custkey % 3 = 0 then '|south' else '' end as districts, case when c_custkey % 5 <> 0 then 'family' end as tag,
  case when c_custkey % 7 = 0 then 'min_price is above max_price' when c_custkey % 60 = 0 or c_custkey % 60 > 50 then 'limit is 1 to 50, offset 0 or more' when c_custkey % 11 = 0 then 'unknown sort' end as problem from customer""")
def checked_requests(spark, d):
    """Requests with repeated and blank districts, odd prices, limits and sorts."""
    k = c("c_custkey")
    name = F.when(k % 4 == 0, "North  side").otherwise(c("c_mktsegment"))
    given = F.when(k % 3 == 0, F.array(name, F.lit(" "), F.lit(" south"), F.upper(name))).otherwise(F.array(name, F.lower(name)))
    rows = t.table(spark, d, "customer").select(
        "c_custkey", given.alias("districts"), F.when(k % 7 == 0, 10).alias("min_price"), F.lit(5).alias("max_price"), F.when(k % 5 == 0, "  ").otherwise(" Family ").alias("tag"),
        (k % 60).alias("limit"), F.lit(0).alias("offset"), F.when(k % 11 == 0, "oldest").otherwise("newest").alias("sort"),
    )
    return predicates.checked_requests(rows).select("c_custkey", F.array_join("districts", "|").alias("districts"), "tag", "problem")


@query("nrm05_image_headers", """select p_partkey, case p_partkey % 3 when 0 then 'image/png' when 1 then 'image/webp' end as mime_type, case when p_partkey % 3 < 2 then p_size end as width, case when p_partkey % 3 < 2 then p_size + 300 end as height from part""")
def image_headers(spark, d):
    """First bytes of pictures of known sizes: PNG, extended WebP, and something else."""
    w, h = c("p_size"), c("p_size") + 300
    four = lambda x: F.lpad(F.hex(x.cast("bigint")), 8, "0")
    three = lambda x: F.concat(*(F.lpad(F.hex(F.shiftright(x - 1, s).bitwiseAND(F.lit(255)).cast("bigint")), 2, "0") for s in (0, 8, 16)))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(w), four(h), F.lit("0806000000"))
    webp = F.concat(F.lit("5249464600000000" + "57454250" + "56503858" + "0A000000" + "00000000"), three(w), three(h))
    raw = F.unhex(F.when(c("p_partkey") % 3 == 0, png).when(c("p_partkey") % 3 == 1, webp).otherwise(F.lit("00FF00FF")))
    rows = t.table(spark, d, "part").select("p_partkey", web.image_info(raw).alias("i"))
    return rows.select("p_partkey", "i.mime_type", "i.width", "i.height")


@query("ext02_own_matcher", """select l.announcement_id as incoming, coalesce(l.renovation = r.renovation, false) as renovation, l.floor = r.floor as floor,
  coalesce(l.renovation = r.renovation, false)::int * 7 + (l.floor = r.floor)::int * 5 as score from listings l join listings r on l.parent_id = r.announcement_id""")
def own_matcher(spark, d):
    """A matcher of one's own, with its own weight, beside a built-in one, on pairs of child and parent."""
    rows = t.listings(spark, d)
    pairs = rows.where("parent_id is not null").select(c("announcement_id").alias("incoming"), c("parent_id").alias("candidate"), c("created_at").alias("candidate_at"))
    own = {"renovation": lambda s: F.coalesce(c("l.renovation") == c("r.renovation"), F.lit(False)), "floor": dedup.MATCHERS["floor"]}
    scored = dedup.score(pairs, rows, dedup.Scoring(weights={"renovation": 7, "floor": 5}), own)
    return scored.select("incoming", "renovation", "floor", "score")


def answered(text: str) -> str:
    """Stands in for a model call: the number of words as JSON; refuses texts that are too short."""
    if len(text) < 5:
        raise ValueError("too short")
    return json.dumps({"words": len(text.split(" "))})


@query("ext05_injected_transport", "select p_partkey, case when length(p_name) >= 12 then len(string_split(p_name, ' ')) end::int as words from part")
def injected(spark, d):
    rows = t.table(spark, d, "part").select("p_partkey", F.when(F.length("p_name") >= 12, c("p_name")).otherwise(F.lit("no")).alias("text"))
    return web.extract_with(rows, answered).select("p_partkey", F.get_json_object("response", "$.words").cast("int").alias("words"))
