"""Messages: tolerant decoding of raw events, encoding, and projections of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEDIA = "array<struct<media_id:string,media_type:string,mime_type:string,size_bytes:int,access_hash:string>>"
RAW_EVENT = (
    "schema_version string, event_type string, idempotency_key string, source_id string, source_channel_id string, source_message_id string, "
    f"occurred_at string, text string, media_group_id string, media {MEDIA}, parser_key string, parser_mode string, attempts int, _corrupt string"
)


def supported_media(media: Column) -> Column:
    """Photos, and images or documents with an image type."""
    return F.filter(media, lambda m: (m["media_type"] == "photo") | (m["media_type"].isin("image", "document") & F.coalesce(m["mime_type"].startswith("image/"), F.lit(False))))


def decode(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON payloads as raw events with defaults; ``malformed`` rows keep their text for the dead-letter queue."""
    got = payloads.withColumn("e", F.from_json(column, RAW_EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    none = F.array().cast(MEDIA)
    bad = F.col("e").isNull() | F.col("e._corrupt").isNotNull() | F.col("e.source_id").isNull() | F.col("e.source_message_id").isNull()
    return got.select(
        *(F.col(c) for c in payloads.columns), bad.alias("malformed"), F.coalesce("e.schema_version", F.lit("raw.v1")).alias("schema_version"),
        F.coalesce("e.event_type", F.lit("created")).alias("event_type"), "e.source_id", "e.source_channel_id", "e.source_message_id",
        F.try_to_timestamp("e.occurred_at").alias("occurred_at"), "e.text", "e.media_group_id", supported_media(F.coalesce("e.media", none)).alias("media"),
        F.coalesce("e.parser_mode", F.lit("active")).alias("parser_mode"), F.coalesce("e.attempts", F.lit(0)).alias("attempts"),
    )


def encode(rows: DataFrame) -> DataFrame:
    """(payload): raw events with all their fields as JSON, nulls written out, times as ISO texts."""
    from listingloom.operators.envelopes import encoded

    return encoded(rows).select("payload")


def with_content(updates: DataFrame) -> DataFrame:
    """Updates that have text or media; a deletion has neither and yields nothing."""
    return updates.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.size(F.coalesce("media", F.array().cast(MEDIA))) > 0))


def deletions(updates: DataFrame) -> DataFrame:
    """One row for each id of a bulk deletion."""
    return updates.select("channel_id", F.explode("deleted_ids").alias("message_id"), F.lit("deleted").alias("event_type"))


def media_reference(photo: Column, document: Column) -> Column:
    """At most one reference: an image document before a photo."""
    image = F.when(F.coalesce(document["mime_type"].startswith("image/"), F.lit(False)), document)
    return F.coalesce(image, photo)


def normalised_url(url: Column) -> Column:
    """https by default, scheme and host in lower case, port kept, no trailing slashes; blank is null."""
    bare = F.nullif(F.trim(url), F.lit(""))
    whole = F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    head = F.lower(F.regexp_extract(whole, "^([^/]*//[^/?#]*)", 1))
    return F.regexp_replace(F.concat(head, F.substr(whole, F.length(head) + 1)), "/+$", "")
