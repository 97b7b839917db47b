"""String functions. Built-ins wherever they are exact; vectorised UDFs where Unicode rules have no twin."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Phone numbers: nine digits, or twelve with the country code (fixed pattern).
PHONE = r"(?<!\d)(?:\+?998)?[\s()-]*(?:\d[\s()-]*){9,12}(?!\d)"
_PHONE, _HASHTAG = re.compile(PHONE), re.compile(r"(?<!\w)#\w+")
_OTHER = re.compile(r"[^\w$+]+|_+")


def _phone(match: re.Match) -> str:
    digits = re.sub(r"\D", "", match[0])
    digits = "998" + digits if len(digits) == 9 else digits
    return "+" + digits[-12:] if len(digits) >= 12 else match[0]


def normalised_text(text: str | None) -> str:
    """Compatibility form, case-folded, phones in one shape, no hashtags, only letters, digits, $ and +."""
    folded = _HASHTAG.sub(" ", _PHONE.sub(_phone, unicodedata.normalize("NFKC", text or "").casefold()))
    return " ".join(_OTHER.sub(" ", folded).split())


#: Values of an Arrow batch that are Python objects at a time.
SLICE = 256


def in_slices(one: Callable[[str | None], object], values: pa.Array, kind: pa.DataType) -> pa.Array:
    """``one`` of every value. Batches have thousands of long texts; only a slice of them is held as Python objects."""
    done = [pa.array([one(x) for x in values.slice(k, SLICE).to_pylist()], kind) for k in range(0, len(values), SLICE)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


@F.arrow_udf(StringType())
def normalise_listing_text(text: pa.Array) -> pa.Array:
    return in_slices(normalised_text, text, pa.string())


@F.arrow_udf(StringType())
def normalise_label(text: pa.Array) -> pa.Array:
    """Compatibility form, case-folded, white space collapsed."""
    return in_slices(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()), text, pa.string())


@F.pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def phone_numbers(text: Column) -> Column:
    """Sorted distinct phone numbers as +998...; runs of ten or eleven digits are none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1), lambda x: F.regexp_replace(x, "\\D", ""))
    whole = F.transform(found, lambda x: F.when(F.length(x) == 9, F.concat(F.lit("998"), x)).otherwise(x))
    kept = F.transform(F.filter(whole, lambda x: F.length(x) >= 12), lambda x: F.concat(F.lit("+"), F.right(x, F.lit(12))))
    return F.array_sort(F.array_distinct(kept))


def word_tokens(text: Column) -> Column:
    """Distinct Unicode words; $ counts as a letter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)([\w$]+)"), 1))


def collapsed_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def collapsed(text: Column) -> Column:
    """White space collapsed and trimmed; blank is null."""
    return F.nullif(collapsed_text(text), F.lit(""))


def shortened(name: str, limit: int) -> Column:
    """At most ``limit`` characters, the last three of a cut text being dots."""
    return F.when(F.length(name) <= limit, F.col(name)).otherwise(F.concat(F.rtrim(F.substring(name, 1, limit - 3)), F.lit("...")))


def tag_key(text: Column) -> Column:
    """A slug of letters, digits and underscores, null where none of 2 to 40 characters is left."""
    slug = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug.rlike("^[a-z0-9_]{2,40}$"), slug)


def source_key(text: Column) -> Column:
    """Lower-case with dashes for everything but letters and digits, at most 80 characters, never empty."""
    return F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "-"), F.lit("-")), 1, 80), F.lit("")), F.lit("unknown"))


def parsed_price(text: Column) -> Column:
    """The number in a typed price: blanks and thousands separators dropped, a comma before one or two last digits is a point."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "[\\s_']", ""), ",(\\d{1,2})$", ".$1")
    bare = F.regexp_replace(bare, ",", "")
    return F.when(bare.rlike("^\\d+(\\.\\d+)?$"), F.try_to_number(bare, F.lit("99999999999999.99")).cast("decimal(14,2)"))


def listed_names(text: Column) -> Column:
    """Names split at commas, semicolons, slashes and the words for and/or; first spellings, order kept."""
    parts = F.transform(F.split(text, r"(?iU)\s*[,;/]\s*|\s+(?:va|yoki|or|или|and)\s+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "([0-9]{1,9})", 1), F.lit("")).cast("int")


#: Bot tokens and API keys (fixed patterns), and words of keys whose values are secret (fixed values).
TOKENS = (r"\b\d{7,12}:[A-Za-z0-9_-]{25,}\b", r"(?i)\b(?:sk|or|r2)_[A-Za-z0-9_-]{16,}\b", PHONE)
SENSITIVE = (
    "api_key", "api_hash", "announcement_text", "authorization", "bot_token", "message_text", "password", "raw_announcement", "raw_text", "secret", "session", "token",
)
REDACTED = "[REDACTED]"


def redacted(text: Column) -> Column:
    """Bot tokens, API keys and phone numbers replaced by a mark."""
    for pattern in TOKENS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def _redacted_value(value: object) -> object:
    if isinstance(value, dict):
        return {k: REDACTED if any(w in k.lower() for w in SENSITIVE) else _redacted_value(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_redacted_value(v) for v in value]
    if isinstance(value, str):
        for pattern in TOKENS:
            value = re.sub(pattern, REDACTED, value)
    return value


@F.pandas_udf(StringType())
def redacted_json(text: pd.Series) -> pd.Series:
    """A JSON text with secret keys' values and secret texts masked at any depth; what is no JSON is null."""

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(_redacted_value(json.loads(value)), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


def message_url(username: Column, message_id: Column) -> Column:
    """Public link of a post; null without a plain user name."""
    name = F.regexp_replace(F.trim(username), "^@", "")
    return F.when(name.rlike("^[A-Za-z][A-Za-z0-9_]{3,31}$"), F.concat(F.lit("https://t.me/"), name, F.lit("/"), message_id.cast("string")))


def safe_url(url: Column) -> Column:
    return F.when(url.startswith("https://") | url.startswith("http://"), url).otherwise("")


def event_key(kind: Column, channel: Column, message: Column) -> Column:
    """Idempotency key of a post event; it leaves the account out, so two accounts share it."""
    return F.concat_ws(":", F.lit("post"), kind, channel, message)


def candidate_id(raw_id: Column, parser: Column, version: Column, index: Column, text: Column) -> Column:
    joined = F.concat_ws("\u001f", raw_id, parser, version, index.cast("string"), F.coalesce(text, F.lit("")))
    return F.concat(F.lit("spc_"), F.substring(F.sha2(joined, 256), 1, 32))


def channel_text(text: Column, limit: int = 4096) -> Column:
    """Lines without trailing blanks, at most ``limit`` characters."""
    tidy = F.regexp_replace(text, "(?m)[ \\t]+$", "")
    return F.when(F.length(tidy) > limit, F.concat(F.rtrim(F.substring(tidy, 1, limit - 1)), F.lit("…"))).otherwise(tidy)


def object_key(event: Column, media: Column, index: Column, content: Column) -> Column:
    event_part, media_part = F.substring(F.sha2(event, 256), 1, 16), F.substring(F.sha2(media, 256), 1, 12)
    return F.concat_ws("/", F.lit("media"), event_part, F.concat_ws("-", F.lpad(index.cast("string"), 3, "0"), media_part, F.substring(content, 1, 16)))


def media_reference_hash(kind: Column, access: Column, media: Column) -> Column:
    """Sixteen hex digits of a stable reference of a photo, image or document."""
    seed = F.coalesce(F.nullif(access, F.lit("")), F.nullif(media, F.lit("")))
    return F.when(kind.isin("photo", "image", "document"), F.substring(F.sha2(seed, 256), 1, 16))


def action_callback(version: str, action: Column, identifier: Column) -> Column:
    return F.concat_ws(":", F.lit("n"), F.lit(version), action, identifier)


def parsed_callback(text: Column) -> Column:
    """struct<action, id> of a callback, null where malformed."""
    parts = F.split(text, ":", 4)
    good = (F.size(parts) == 4) & (parts[0] == "n") & (parts[1] == "v1")
    return F.when(good, F.struct(parts[2].alias("action"), parts[3].alias("id")))


