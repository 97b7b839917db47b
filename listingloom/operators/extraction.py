"""From extracted fields to canonical listings, and the gate that decides what happens to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions.labels import currency
from listingloom.functions.text import collapsed, phone_numbers

#: Fixed values of the gate.
AUTO_REJECT, JUNK_REJECT, RENTAL_LEAST, LEAST_TEXT = 0.40, 0.60, 0.50, 5
RAW = (
    "price decimal(14,2), currency string, price_period string, price_basis string, listing_type string, rooms int, area decimal(10,2), floor int, district string, address string, "
    "phone_numbers array<string>, owner_type string, description string, confidence double, is_rental boolean, rental_confidence double"
)


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON answers as raw fields; ``valid`` is false where the text isn't an object of the schema or has other fields."""
    names = F.array(*(F.lit(f.split()[0]) for f in RAW.replace("decimal(14,2)", "d").replace("decimal(10,2)", "d").split(", ")))
    got = payloads.withColumn("r", F.from_json(column, RAW)).withColumn("keys", F.json_object_keys(column))
    valid = F.col("r").isNotNull() & F.col("keys").isNotNull() & (F.size(F.array_except("keys", names)) == 0)
    return got.select(*payloads.columns, F.coalesce(valid, F.lit(False)).alias("valid"), "r.*")


def normalised(raw: DataFrame, source_text: str = "source_text") -> DataFrame:
    """raw fields as a canonical listing: defaults with a note for each, phones of the model and the text together."""
    assumptions = F.array_compact(F.array(F.when(F.col("price_period").isNull(), "price_period_defaulted_monthly"), F.when(F.col("price_basis").isNull(), "price_basis_defaulted_total")))
    period = F.coalesce("price_period", F.lit("monthly"))
    phones = F.array_sort(F.array_union(F.coalesce("phone_numbers", F.array().cast("array<string>")), phone_numbers(F.coalesce(source_text, F.lit("")))))
    out = {
        "price_period": period, "price_basis": F.coalesce("price_basis", F.lit("total")), "currency": currency(F.col("currency")), "monthly": monthly(F.col("price"), period),
        "address": collapsed(F.col("address")), "phone_numbers": phones, "owner_type": F.coalesce("owner_type", F.lit("unknown")),
        "description": F.coalesce(collapsed(F.col("description")), collapsed(F.col(source_text)), F.lit("")), "assumptions": assumptions,
    }
    return raw.withColumns(out)


def monthly(price: Column, period: Column) -> Column:
    """Thirty days for a daily price; none for a sale."""
    return F.when(period == "daily", price * 30).when(period != "one_time", price).cast("decimal(14,2)")


def gated(rows: DataFrame, least: float, required: tuple[str, ...] = ()) -> DataFrame:
    """Canonical rows with ``status`` and ``reason``: what is no rental or unfit fails, doubt goes to review."""
    conflict = F.coalesce((F.col("is_rental") & (F.col("listing_type") == "sale")) | (~F.col("is_rental") & (F.col("listing_type") == "rent")), F.lit(False))
    rental = ~conflict & F.coalesce("is_rental", F.coalesce(F.col("listing_type") != "sale", F.lit(True)))
    sure = F.coalesce("rental_confidence", "confidence") > RENTAL_LEAST
    essential = F.col("price").isNotNull() | F.col("rooms").isNotNull() | F.col("district").isNotNull() | (F.size("phone_numbers") > 0)
    junk = (F.length(F.trim("description")) < LEAST_TEXT) | ~essential
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in required))), ",") if required else F.lit("")
    unfit = (F.col("confidence") < AUTO_REJECT) | (junk & (F.col("confidence") < JUNK_REJECT))
    verdict = (
        F.when(conflict, "failed:contradictory_rental_classification").when(~rental, "failed:not_a_rental_announcement").when(~sure, "failed:rental_confidence_below_threshold")
        .when(unfit & ~essential, "failed:rejected_not_real_estate_listing").when(unfit, "failed:low_relevance_score")
        .when(missing != "", F.concat(F.lit("manual_review:source_required_fields_missing:"), missing))
        .when(junk, "manual_review:missing_essential_fields").when(F.col("confidence") < least, "manual_review:low_confidence").otherwise("succeeded:")
    )
    parts = F.split(verdict, ":", 2)
    return rows.withColumn("status", parts[0]).withColumn("reason", F.nullif(parts[1], F.lit("")))


def fitted(width: Column, height: Column, most_wide: int = 800, most_high: int = 600) -> tuple[Column, Column]:
    """Width and height scaled down to fit, rounded half to even, at least one."""
    ratio = F.least(F.lit(most_wide) / width, F.lit(most_high) / height, F.lit(1.0))
    return tuple(F.greatest(F.lit(1), F.bround(x * ratio, 0).cast("int")) for x in (width, height))
