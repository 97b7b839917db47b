"""Alias maps, canonical values and display labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of currencies (fixed values).
CURRENCIES = {"$": "USD", "usd": "USD", "dollar": "USD", "y.e": "USD", "у.е": "USD", "у.е.": "USD", "uzs": "UZS", "so'm": "UZS", "som": "UZS", "sum": "UZS", "сум": "UZS"}
RENOVATION_LABELS = {"good": "Good renovation", "average": "Average renovation", "needs_repair": "Needs repair"}


def mapped(value: Column, names: Mapping[str, str]) -> Column:
    """The alias map's value for a trimmed, lower-cased key; null if there is none."""
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    return F.try_element_at(pairs, F.lower(F.trim(value)))


def canonical(value: Column, names: Mapping[str, str]) -> Column:
    """As ``mapped``, but unknown values pass through trimmed; blank ones become null."""
    return F.coalesce(mapped(value, names), F.nullif(F.trim(value), F.lit("")))


def currency(value: Column) -> Column:
    """A known currency code, else the upper-cased spelling; blank is null."""
    return F.coalesce(mapped(value, CURRENCIES), F.nullif(F.upper(F.trim(value)), F.lit("")))


def price_label(price: Column, code: Column, period: Column) -> Column:
    amount = F.regexp_replace(F.format_string("%.2f", price.cast("double")), "\\.00$", "")
    unit = F.when(period == "monthly", " / month").when(period == "daily", " / day").otherwise("")
    return F.when(price.isNull(), "Price on request").otherwise(F.concat(amount, F.lit(" "), F.coalesce(code, F.lit("")), unit))


def rooms_label(rooms: Column) -> Column:
    return F.when(rooms.isNull(), "rooms unknown").when(rooms == 1, "1 room").otherwise(F.concat(rooms.cast("string"), F.lit(" rooms")))


def flag_label(value: Column, yes: str, no: str, unknown: str) -> Column:
    """A label of a three-valued flag."""
    return F.when(value.isNull(), unknown).when(value, yes).otherwise(no)
