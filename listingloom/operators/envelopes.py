"""Envelopes of messages and jobs: encoding with every field, tolerant decoding, identities and audit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a delivery job, in the order of its JSON; the defaults of absent ones (fixed values).
JOB_FIELDS = (
    "notification_id", "user_id", "filter_id", "announcement_id", "status", "priority", "queue_name", "created_at", "attempts", "next_attempt_at", "telegram_message_id",
)
JOB_SCHEMA = (
    "notification_id string, user_id bigint, filter_id string, announcement_id string, status string, priority int, queue_name string, "
    "created_at string, attempts int, next_attempt_at string, telegram_message_id string"
)
JOB_DEFAULTS = {"status": "pending", "priority": 0, "queue_name": "notifications.standard", "attempts": 0}
#: Namespace of name-based identifiers of URLs (fixed value).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
BREAKDOWN = "array<struct<name:string,weight:int,matched:boolean,reason:string>>"
SOURCE_SPEC = (
    "struct<source_type:string,identifier:string,display_name:string,enabled:boolean,parser_key:string,parser_version:string,parser_mode:string>"
)


def iso(at: Column) -> Column:
    """A UTC time as in the JSON of the messages."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def name_based_id(key: Column) -> Column:
    """Name-based (version 5) identifier of a key in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def encoded(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with all their columns as one JSON text, nulls written out and times as ISO texts."""
    fields = [iso(F.col(f"`{n}`")).alias(n) if kind.startswith("timestamp") else F.col(f"`{n}`") for n, kind in rows.dtypes]
    return rows.select("*", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(payload))


def decoded_jobs(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(JOB_FIELDS, malformed): absent fields have their defaults; a job without one of its ids or times is malformed."""
    j = F.from_json(F.col(column), JOB_SCHEMA)
    got = payloads.withColumn("_j", j)
    value = {n: F.col(f"_j.{n}") for n in JOB_FIELDS} | {n: F.coalesce(f"_j.{n}", F.lit(v)) for n, v in JOB_DEFAULTS.items()}
    for n in ("created_at", "next_attempt_at"):
        value[n] = F.try_to_timestamp(f"_j.{n}")
    needed = ("notification_id", "user_id", "filter_id", "announcement_id", "created_at")
    bad = F.lit(False)
    for n in needed:
        bad |= value[n].isNull()
    rest = [c for c in payloads.columns if c not in (*JOB_FIELDS, "malformed")]
    return got.select(*rest, *(value[n].alias(n) for n in JOB_FIELDS), F.coalesce(bad, F.lit(True)).alias("malformed"))


def breakdown_json(signals: Column) -> Column:
    """An array of (name, weight, matched, reason) as stored beside a decision."""
    return F.to_json(signals, {"ignoreNullFields": "false"})


def breakdown_score(stored: Column) -> Column:
    """(names, score) of the matched signals in a stored breakdown; no names and 0 for what is no breakdown."""
    matched = F.filter(F.coalesce(F.from_json(stored, BREAKDOWN), F.array().cast(BREAKDOWN)), lambda s: F.coalesce(s["matched"], F.lit(False)))
    score = F.aggregate(matched, F.lit(0), lambda total, s: total + F.coalesce(s["weight"], F.lit(0)))
    return F.struct(F.transform(matched, lambda s: s["name"]).alias("names"), score.alias("score"))


def listing_envelope(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A structured payload's envelope: name-based id, message ids (the one id where the list is absent), review reason and status."""
    shape = "idempotency_key string, source_id string, source_message_id string, source_message_ids array<string>, occurred_at string, manual_review_reason string"
    p = payloads.withColumn("_p", F.from_json(column, shape))
    ids = F.filter(F.coalesce("_p.source_message_ids", F.array().cast("array<string>")), lambda x: x.isNotNull())
    given = F.nullif(F.col("_p.manual_review_reason"), F.lit(""))
    reason = F.when(given == "low_confidence", "low_confidence").when(given.isNotNull(), "business_quality")
    return p.select(
        *payloads.columns, name_based_id(F.col("_p.idempotency_key")).alias("announcement_id"), "_p.source_id",
        F.when(F.size(ids) > 0, ids).otherwise(F.array("_p.source_message_id")).alias("source_message_ids"), F.try_to_timestamp("_p.occurred_at").alias("occurred_at"),
        reason.alias("review_reason"), F.when(reason.isNotNull(), "manual_review").otherwise("active").alias("status"),
    )


def provider_answer(body: Column) -> Column:
    """(valid, model, confidence, content, request_id) of a model provider's response.

    Content may be an object or a JSON text of one; anything else, no choice, or a confidence that is no number
    makes it malformed. Without a confidence it is 0.
    """
    content = F.get_json_object(body, "$.choices[0].message.content")
    value = F.try_parse_json(content)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    given = F.try_variant_get(value, "$.confidence", "string")
    number = F.when(given.isNull(), F.lit(0.0)).otherwise(given.try_cast("double"))
    return F.struct(
        (is_object & number.isNotNull()).alias("valid"), F.coalesce(F.get_json_object(body, "$.model"), F.lit("")).alias("model"),
        F.when(is_object, number).alias("confidence"), F.when(is_object, content).alias("content"), F.get_json_object(body, "$.id").alias("request_id"),
    )


def audit_line(event: Column) -> Column:
    """A struct (flag_name, previous_enabled, new_enabled, previous_version, new_version, actor, reason, occurred_at) as one line."""
    flags = [event[n].cast("int").cast("string") for n in ("previous_enabled", "new_enabled", "previous_version", "new_version")]
    return F.concat_ws("|", event["flag_name"], *flags, event["actor"], event["reason"], iso(event["occurred_at"]))


def parsed_audit_line(line: Column) -> Column:
    """The struct of a line of eight parts, or of six (without versions, which are 0); null for other lines."""
    parts = F.split(line, r"\|")
    whole = F.when(F.size(parts) == 8, parts).when(F.size(parts) == 6, F.concat(F.slice(parts, 1, 3), F.array(F.lit("0"), F.lit("0")), F.slice(parts, 4, 3)))
    at = lambda k: F.get(whole, F.lit(k))
    told = F.struct(
        at(0).alias("flag_name"), (at(1).try_cast("int") != 0).alias("previous_enabled"), (at(2).try_cast("int") != 0).alias("new_enabled"), at(3).try_cast("int").alias("previous_version"),
        at(4).try_cast("int").alias("new_version"), at(5).alias("actor"), at(6).alias("reason"), F.try_to_timestamp(at(7)).alias("occurred_at"),
    )
    return F.when(whole.isNotNull(), told)


def source_identifier(text: Column) -> Column:
    """``@name`` for a name or a t.me link, or a channel id as given; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^https?://t\.me/", "@"), r"(?i)^t\.me/", "@")
    return F.when(bare.rlike(r"^@[A-Za-z0-9_]{5,64}$") | bare.rlike(r"^-100[0-9]+$"), bare)


def source_specs(raw: Column) -> Column:
    """array<SOURCE_SPEC> of a JSON list of sources, or of an object with one; null where it is neither or a source lacks type or identifier."""
    listed = F.coalesce(F.from_json(F.get_json_object(raw, "$.sources"), f"array<{SOURCE_SPEC}>"), F.from_json(F.when(F.ltrim(raw).startswith("["), raw), f"array<{SOURCE_SPEC}>"))
    whole = F.forall(listed, lambda s: s["source_type"].isNotNull() & s["identifier"].isNotNull())
    filled = F.transform(listed, lambda s: s.withField("enabled", F.coalesce(s["enabled"], F.lit(True))))
    return F.when(whole, filled)


def suggestions(requests: DataFrame, known: DataFrame) -> DataFrame:
    """requests (user_id, source, at) with ``identifier`` and ``result``: invalid, known, repeated, or submitted (the first of an identifier)."""
    rows = requests.withColumn("identifier", source_identifier(F.col("source")))
    first = rows.where("identifier is not null").groupBy("identifier").agg(F.min(F.struct("at", "user_id")).alias("_first"))
    there = known.select("identifier", F.lit(True).alias("_known")).distinct()
    told = rows.join(first, "identifier", "left").join(there, "identifier", "left")
    result = (
        F.when(F.col("identifier").isNull(), "invalid").when(F.col("_known"), "known")
        .when(F.struct("at", "user_id") == F.col("_first"), "submitted").otherwise("repeated")
    )
    return told.select(*requests.columns, "identifier", result.alias("result"))
