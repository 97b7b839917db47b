"""All registered queries of the library, by name, and their SQL."""

from __future__ import annotations

from listingloom.plans import dedup_queries, delivery_queries, envelope_queries, function_queries, metric_queries, parsing_queries, request_queries, review_queries, search_queries, source_queries, write_queries  # noqa: F401
from listingloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "top01_search_cheapest"
