"""Hints of source parsers, and what goes along with a parsed candidate into a queue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of hints that are passed on (fixed values), and how long texts, list items and lists may be.
HINT_KEYS = ("district", "language", "listing_type", "owner_type", "price_basis", "price_period", "required_fields", "recipe_hints", "source_format")
TEXT_CHARS, ITEM_CHARS, ITEMS = 200, 100, 20
#: Where a payload may have hints, the first that is there counts.
HINT_PATHS = ("$.source_parser_hints", "$.parser_hints", "$.extraction_hints", "$.source_parser.extraction_hints")


def _stripped(text: Column, most: int) -> Column:
    """White space at both ends dropped, then cut; null for nothing."""
    return F.nullif(F.substring(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 1, most), F.lit(""))


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))


def _once(value: Column, told) -> Column:
    """``told(value)`` with the value computed once, however often ``told`` names it."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


def safe_value(value: Column) -> Column:
    """A variant as the JSON of a hint: numbers and booleans as they are, cut texts, lists of cut texts; null for anything else and for what is empty."""
    kind = F.schema_of_variant(value)
    items = F.slice(F.try_variant_get(value, "$", "array<variant>"), 1, ITEMS)
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: _stripped(F.try_variant_get(x, "$", "string"), ITEM_CHARS))
    kept = F.array_compact(texts)
    return (
        F.when((kind == "BOOLEAN") | (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.to_json(value))
        .when(kind == "STRING", _quoted(_stripped(F.try_variant_get(value, "$", "string"), TEXT_CHARS))).when(kind.startswith("ARRAY") & (F.size(kept) > 0), F.to_json(kept))
    )


def parser_hints(payload: Column, *own: Column) -> Column:
    """The hints of an event as a JSON object with keys of HINT_KEYS in their order: ``own`` columns of JSON first, then HINT_PATHS of the payload.

    Where none is there, the defaults, required_fields and prompt_hints (as recipe_hints) of its ``source_parsing``. What is no object gives no hints.
    """
    given = F.coalesce(*own, *(F.get_json_object(payload, p) for p in HINT_PATHS))
    texts = F.struct(given.alias("given"), F.get_json_object(payload, "$.source_parsing").alias("recipe"))
    parsed = lambda x: F.struct(F.try_parse_json(x["given"]).alias("stated"), F.try_parse_json(F.when(x["given"].isNull(), x["recipe"])).alias("recipe"))

    def found(stated: Column, recipe: Column, key: str) -> Column:
        default = F.try_variant_get(recipe, f"$.defaults.{key}", "variant")
        lists = {"required_fields": "$.required_fields", "recipe_hints": "$.prompt_hints"}
        if key in lists:
            listed = F.try_variant_get(recipe, lists[key], "variant")
            default = F.coalesce(F.when(F.schema_of_variant(listed).startswith("ARRAY"), listed), default)
        return F.coalesce(F.try_variant_get(stated, f"$.{key}", "variant"), default)

    def told(x: Column) -> Column:
        parts = (F.concat(F.lit(f'"{key}":'), _once(found(x["stated"], x["recipe"], key), safe_value)) for key in HINT_KEYS)
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))

    return _once(_once(texts, parsed), told)


def provenance(raw: Column) -> Column:
    """Where a candidate comes from: fields of the raw event's struct (idempotency_key, schema_version, text, source_id, source_channel_id,
    source_message_id, source_message_ids, source_url, forward_metadata, media)."""
    names = {
        "raw_event_id": "idempotency_key", "raw_schema_version": "schema_version", "raw_text": "text", "source_id": "source_id", "source_channel_id": "source_channel_id",
        "source_message_id": "source_message_id", "source_message_ids": "source_message_ids", "source_url": "source_url", "raw_forward_metadata": "forward_metadata", "raw_media": "media",
    }
    return F.struct(*(raw[n].alias(k) for k, n in names.items()))


def queue_metadata(candidate: Column, raw: Column, count: Column, decision: Column, mode: Column, reasons: Column, diagnostics: Column, shadow: Column | None = None) -> Column:
    """What a queue message tells of its candidate, as a struct.

    ``candidate`` has parser_key, parser_version, parser_family, candidate_id, index, score, reasons, signals, defaults, required_fields,
    prompt_hints and diagnostics (maps of texts); the outcome's reasons stand before its own, each once, and its own diagnostics before the outcome's.
    """
    told = {
        "decision": decision, "mode": mode, **{n: candidate[n] for n in ("parser_key", "parser_version", "parser_family", "candidate_id")}, "candidate_index": candidate["index"],
        "candidate_count": count, "score": candidate["score"], "reasons": F.array_distinct(F.concat(reasons, candidate["reasons"])), "signals": candidate["signals"],
        "defaults": candidate["defaults"], "required_fields": candidate["required_fields"], "prompt_hints": candidate["prompt_hints"],
        "diagnostics": F.map_concat(F.map_filter(diagnostics, lambda k, v: ~F.map_contains_key(candidate["diagnostics"], k)), candidate["diagnostics"]), "provenance": provenance(raw),
    }
    if shadow is not None:
        told["shadow"] = shadow
    return F.struct(*(v.alias(k) for k, v in told.items()))


def candidate_event(candidate: Column, raw: Column, isolated: Column) -> Column:
    """The event of one candidate: the raw one with its key, text and parser, without media where it takes none, and where it comes from.

    ``candidate`` has idempotency_key, cleaned_text, parser_key, parser_version, candidate_id, index and include_media. ``isolated`` candidates have a message id
    of their own; the list of message ids stays.
    """
    from listingloom.operators.parsing import fanout_message_id

    message_id = F.when(isolated, fanout_message_id(raw["source_message_id"], candidate["index"])).otherwise(raw["source_message_id"])
    origin = F.struct(
        raw["idempotency_key"].alias("raw_event_id"), candidate["candidate_id"].alias("candidate_id"), candidate["index"].alias("candidate_index"), message_id.alias("candidate_source_message_id"),
        raw["source_message_id"].alias("raw_source_message_id"), raw["source_message_ids"].alias("raw_source_message_ids"), raw["source_url"].alias("raw_source_url"),
        raw["forward_metadata"].alias("raw_forward_metadata"), isolated.alias("source_identity_isolated"), F.lit("raw_message_id+candidate_index").alias("source_identity_strategy"),
        isolated.alias("source_identity_reorder_sensitive"),
    )
    changed = raw.withField("idempotency_key", candidate["idempotency_key"]).withField("text", candidate["cleaned_text"]).withField("source_message_id", message_id)
    changed = changed.withField("media", F.when(candidate["include_media"], raw["media"]).otherwise(F.slice(raw["media"], 1, 0)))
    return changed.withField("parser_key", candidate["parser_key"]).withField("parser_version", candidate["parser_version"]).withField("parser_provenance", origin)
