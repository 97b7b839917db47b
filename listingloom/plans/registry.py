"""Registers queries with the SQL that must give the same rows on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The domain views of ``sources.tables`` in SQL, in order of use.
VIEWS = {
    "listings": """
  select o_orderkey as announcement_id, price, price_period,
    cast(case price_period when 'monthly' then price when 'daily' then price * 30 end as decimal(14,2)) as monthly,
    case when o_orderkey % 7 = 0 then 'per_person' else 'total' end as price_basis,
    case when o_orderkey % 5 = 0 then 'UZS' else 'USD' end as currency,
    cast(o_custkey % 5 + 1 as integer) as rooms, cast(30 + o_orderkey % 90 as decimal(10,2)) as area,
    cast(o_orderkey % 12 + 1 as integer) as floor, n_name as district,
    'Block ' || (o_orderkey % 40) || ', ' || n_name as address,
    'Flat with ' || (o_custkey % 5 + 1) || ' rooms in ' || n_name || ' near ' || lower(o_orderpriority) as description,
    '+998' || lpad(cast(o_custkey % 1000 as varchar), 9, '7') as phone,
    case o_orderkey % 3 when 0 then 'good' when 1 then 'average' end as renovation,
    case when o_orderstatus = 'P' then 'manual_review' else 'active' end as status,
    case when o_orderkey % 11 = 0 and o_orderkey > 0 then o_orderkey - 1 end as parent_id,
    o_orderdate as created_at, 'src' || (o_custkey % 20) as source_id,
    case when o_orderkey % 6 = 0 then 'https://t.me/c' || (o_custkey % 20) || '/' || (o_orderkey // 12) end as source_url,
    o_orderpriority[1:1] as tag, case when o_orderkey % 17 = 0 then o_orderpriority[1:1] end as excluded_tag,
    cast(o_orderkey % 5 as integer) as trust
  from (select *, case when o_orderkey % 13 <> 0 then cast(cast(floor(o_totalprice / 100) as bigint) + 0.25 * (o_orderkey % 4) as decimal(14,2)) end as price,
      case when o_orderkey % 10 = 0 then 'one_time' when o_orderkey % 10 <= 2 then 'daily' else 'monthly' end as price_period
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)""",
    "media": """
  select l_orderkey as announcement_id, l_linenumber as media_id, min(sha256(cast(l_partkey as varchar))[1:16]) as phash
  from lineitem group by 1, 2""",
    "saved_filters": """
  select c_custkey as filter_id, c_custkey as user_id, n_name as district, cast(greatest(floor(c_acctbal), 100) as decimal(14,2)) as max_price,
    case when c_custkey % 3 = 0 then cast(c_custkey % 5 + 1 as integer) end as rooms, c_custkey % 4 <> 0 as enabled, c_custkey % 2 = 0 as include_per_person
  from customer join nation on c_nationkey = n_nationkey""",
    "users": """
  select c_custkey as user_id, case when c_custkey % 9 = 0 then 'blocked' else 'active' end as status, c_custkey % 8 <> 0 as notifications_enabled,
    case c_mktsegment when 'BUILDING' then timestamp '2024-06-01' when 'MACHINERY' then timestamp '2023-01-01' end as premium_until,
    'u' || lpad(cast(c_custkey as varchar), 10, '0') as referral_code, case when c_custkey > 1 and c_custkey % 4 <> 1 then c_custkey // 2 end as referrer_id
  from customer""",
    "product_events": """
  select event_id, case event_type when 'signup' then 'user_registered' when 'view' then 'search_completed' when 'purchase' then 'saved_filter_created'
      when 'click' then 'notification_action_open' when 'error' then 'notification_sent' end as event_name,
    ts as occurred_at, user_id, cast(event_id % 100 as varchar) as subject_id, cast(json_extract_string(props, '$.k') as integer) as k
  from events""",
    "technical_events": """
  select event_id, case event_type when 'signup' then 'queue_delay_ms' when 'view' then 'dedup_decision' when 'purchase' then 'listener_health'
      when 'click' then 'source_parser_decision' when 'error' then 'notification_retry' end as metric_name,
    ts as occurred_at, value, case when event_id % 7 <> 0 then 'acc' || (user_id % 10) end as subject_id,
    case k % 4 when 0 then 'exact_duplicate' when 1 then 'high_confidence_duplicate' when 2 then 'new' end as decision,
    case k % 3 when 0 then 'online' when 1 then 'flood_wait' end as state, case when event_id % 5 <> 0 then 'src' || (event_id % 6) end as source_id
  from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events)""",
    "posts": """
  select doc_id as post_id, coalesce(text, '') as text, source as source_id, '-100' || source as channel_id, cast(doc_id as varchar) as message_id,
    case when doc_id % 3 = 0 then '-777:' || (doc_id // 6) end as forward_key, case when doc_id % 5 = 0 then doc_id // 10 end as parent_ref,
    sha256(cast(doc_id // 4 as varchar))[1:16] as phash
  from documents""",
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; views named in ``sql`` become common table expressions in front of it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
            ctes = ", ".join(f"{v} as ({VIEWS[v]}\n)" for v in used)
            body = sql.strip()
            if ctes and (more := re.match(r"with (recursive )?", body)):
                body = f"with {more[1] or ''}{ctes}, {body[more.end():]}"
            elif ctes:
                body = f"with {ctes}\n{body}"
            ORACLE_SQL[name] = body
        return f

    return add
