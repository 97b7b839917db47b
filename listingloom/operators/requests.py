"""Typed search requests read from a model's answer: criteria, what was applied, tags to show, keys and notes; and small predicates on listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions.text import collapsed
from listingloom.operators.parsing import FANOUT

#: Labels of tags and names of audiences as users see them (fixed values).
LABELS = {
    "district": "Tuman", "rooms": "Xona", "max_price": "Budjet", "include_per_person": "Narx turi", "renovation_level": "Remont", "audience_tag": "Kim uchun",
    "condition": "Qo'shimcha shart",
}
AUDIENCES = {"family": "Yosh oila", "students": "Talabalar", "foreigners": "Chet elliklar"}
PER_PERSON, MORE_DISTRICTS = "Bir kishilik ham", "additional_districts:"
#: Notes of a search's answer (fixed values).
NOTES = (
    "Search returns active canonical parent announcements only.", "Sale/one_time listings are excluded from monthly rent search.",
    "Listings with null price_normalized_monthly are excluded by price filters.", "Per-person prices are matched as per-person values; they are not converted to total.",
)


def extracted_criteria(raw: DataFrame, canonical=None) -> DataFrame:
    """raw answers with ``criteria``, ``applied`` and ``unapplied``.

    ``raw`` has districts, rooms, monthly_budget, price_basis_preference, renovation_level, audience_tag and unapplied_conditions. Districts
    are brought to their names by ``canonical`` (a function of a column; collapsed white space by default), blank ones dropped; the first is the
    district. Applied fields are named in the order of the criteria, unapplied conditions once each.
    """
    canonical = canonical or collapsed
    districts = F.array_compact(F.transform(F.coalesce("districts", F.array().cast("array<string>")), canonical))
    per_person = F.coalesce(F.col("price_basis_preference") == "include_per_person", F.lit(False))
    criteria = F.struct(
        F.col("monthly_budget").alias("max_price"), per_person.alias("include_per_person"), F.get(districts, F.lit(0)).alias("district"), districts.alias("districts"), "rooms",
        "renovation_level", "audience_tag",
    )
    hits = {
        "districts": F.size(districts) > 0, "rooms": F.col("rooms").isNotNull(), "max_price": F.col("monthly_budget").isNotNull(), "include_per_person": per_person,
        "renovation_level": F.col("renovation_level").isNotNull(), "audience_tag": F.col("audience_tag").isNotNull(),
    }
    applied = F.array_compact(F.array(*(F.when(hit, name) for name, hit in hits.items())))
    unapplied = F.array_distinct(F.coalesce("unapplied_conditions", F.array().cast("array<string>")))
    return raw.withColumns({"criteria": criteria, "applied": applied, "unapplied": unapplied})


def display_tags(requests: DataFrame, *keep: str) -> DataFrame:
    """(keep.., place, key, label, value, applied): a row for each condition of ``extracted_criteria`` as it is shown.

    Each district is a tag; further districts that weren't applied are listed with spaces. A request without conditions has no rows.
    """
    c = F.col

    def tag(key: str, value: Column, applied: bool = True) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit(LABELS[key]).alias("label"), value.alias("value"), F.lit(applied).alias("applied"))

    names = F.create_map(*(F.lit(x) for pair in AUDIENCES.items() for x in pair))
    one = F.array_compact(F.array(
        F.when(c("criteria.rooms").isNotNull(), tag("rooms", F.concat(c("criteria.rooms").cast("string"), F.lit(" xona")))),
        F.when(c("criteria.max_price").isNotNull(), tag("max_price", F.concat(c("criteria.max_price").cast("string"), F.lit(" gacha")))),
        F.when(c("criteria.include_per_person"), tag("include_per_person", F.lit(PER_PERSON))),
        F.when(F.coalesce("criteria.renovation_level", F.lit("")) != "", tag("renovation_level", c("criteria.renovation_level"))),
        F.when(F.coalesce("criteria.audience_tag", F.lit("")) != "", tag("audience_tag", F.coalesce(F.try_element_at(names, c("criteria.audience_tag")), c("criteria.audience_tag")))),
    ))
    shown = lambda x: F.when(x.startswith(MORE_DISTRICTS), F.replace(F.substr(x, F.lit(len(MORE_DISTRICTS) + 1)), F.lit(","), F.lit(", "))).otherwise(x)
    every = F.concat(F.transform("criteria.districts", lambda x: tag("district", x)), one, F.transform("unapplied", lambda x: tag("condition", shown(x), False)))
    return requests.select(*keep, F.posexplode(every).alias("place", "t")).select(*keep, "place", "t.*")


#: The fields of a request's key in their order.
CRITERIA = ("min_price", "max_price", "include_per_person", "district", "districts", "rooms", "renovation_level", "audience_tag", "sort", "limit", "offset")


def action_key(criteria: Column) -> Column:
    """The SHA-256 of a request's JSON, all fields of CRITERIA in their order with nulls written out, prices as texts: one key for one request."""
    price = lambda n: criteria[n].cast("string").alias(n)
    fields = [price(n) if n.endswith("price") else criteria[n].alias(n) for n in CRITERIA]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def search_notes(has_price: Column, per_person: Column) -> Column:
    """What a search's answer says about itself; with a price filter listings without a price are left out."""
    return F.array_compact(F.array(F.lit(NOTES[0]), F.lit(NOTES[1]), F.when(has_price, NOTES[2]), F.when(per_person, NOTES[3])))


def fanout_identity(message_id: Column) -> Column:
    """(raw, index) of a candidate's message id, split at its last mark; null where there is none, nothing before it or no number behind."""
    parts = F.split(message_id, FANOUT)
    last = F.element_at(parts, -1)
    raw = F.substr(message_id, F.lit(1), F.length(message_id) - F.length(last) - len(FANOUT))
    whole = (F.size(parts) > 1) & (raw != "") & last.rlike("^[0-9]+$")
    return F.when(whole, F.struct(raw.alias("raw"), last.cast("decimal(38,0)").alias("index")))


def fanout_siblings(left: Column, right: Column) -> Column:
    """Whether two message ids are different candidates of one post."""
    a, b = fanout_identity(left), fanout_identity(right)
    return F.coalesce((a["raw"] == b["raw"]) & (a["index"] != b["index"]), F.lit(False))


def forward_origin(forward: Column) -> Column:
    """``channel:message`` of a struct (channel_id, message_id); null if either is missing."""
    return F.when(forward["channel_id"].isNotNull() & forward["message_id"].isNotNull(), F.concat_ws(":", forward["channel_id"].cast("string"), forward["message_id"].cast("string")))


def missing_fields(rows: DataFrame, required: tuple[str, ...]) -> Column:
    """Names of the required fields without a value: null, a text of white space, an empty list; or no such field. Zero and false are values."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def empty(name: str) -> Column:
        kind = kinds.get(name)
        if kind is None:
            return F.lit(True)
        value = F.col(name)
        more = F.regexp_replace(value, r"(?U)\s", "") == "" if kind == "string" else F.size(value) == 0 if kind.startswith(("array", "map")) else F.lit(False)
        return value.isNull() | more

    return F.array_compact(F.array(*(F.when(empty(n), F.lit(n)) for n in required)))


def byte_cap(content: Column, most: int) -> Column:
    """Binary content of at most ``most`` bytes: a longer one is cut and ends in the SHA-256 of the whole."""
    digest = F.unhex(F.sha2(content, 256))
    keep = max(0, most - 32)
    return F.when(F.octet_length(content) <= most, content).otherwise(F.concat(F.substring(content, 1, keep), digest))
