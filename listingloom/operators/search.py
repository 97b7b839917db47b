"""Search: predicate, total order, page and totals; each page is a top-k, never a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.operators.predicates import Criteria, matches


def sort_keys(sort: str) -> list[Column]:
    """Total orders: each ends in the id."""
    if sort == "cheapest":
        return [F.col("monthly").asc_nulls_last(), F.col("created_at").asc(), F.col("announcement_id").asc()]
    if sort == "price_desc":
        return [F.col("monthly").desc_nulls_last(), F.col("created_at").desc(), F.col("announcement_id").desc()]
    return [F.col("created_at").desc(), F.col("announcement_id").desc()]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def search(listings: DataFrame, criteria: Criteria) -> DataFrame:
    """The criteria's page, with the total of all matches beside each row (0 rows for an empty page)."""
    c = criteria.checked()
    found = listings.where(matches(c))
    total = found.agg(F.count("*").alias("total"))
    return page(found, sort_keys(c.sort), c.limit, c.offset).crossJoin(F.broadcast(total))


def search_metadata(listings: DataFrame, criteria: Criteria) -> DataFrame:
    """One row: the total, the rows of the page and the flags of the request."""
    c = criteria.checked()
    total = listings.where(matches(c)).agg(F.count("*").alias("total"))
    returned = F.greatest(F.lit(0), F.least(F.lit(c.limit), F.col("total") - c.offset)).cast("bigint")
    return total.select(
        "total", returned.alias("returned"), F.lit(c.limit).alias("page_limit"), F.lit(c.offset).alias("page_offset"),
        F.lit(c.include_per_person).alias("per_person_included"), F.lit(c.sort).alias("sort"),
        (F.col("total") > c.offset + c.limit).alias("has_more"),
    )


def with_media(rows: DataFrame, media: DataFrame) -> DataFrame:
    """rows with their media as a sorted array (empty, never null); media is aggregated before the join."""
    lists = media.groupBy("announcement_id").agg(F.sort_array(F.collect_list(F.struct("media_id", "phash"))).alias("media"))
    none = F.array().cast("array<struct<media_id:int,phash:string>>")
    return rows.join(lists, "announcement_id", "left").withColumn("media", F.coalesce("media", none))
