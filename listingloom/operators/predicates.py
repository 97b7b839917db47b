"""Search criteria and the predicates they compile to; search and filter matching share them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.functions.text import collapsed_text

SORTS = ("newest", "cheapest", "price_desc")


@dataclass(frozen=True)
class Criteria:
    """A search request; ``None`` and empty mean no condition. ``checked`` normalises and validates it."""

    min_price: float | None = None
    max_price: float | None = None
    include_per_person: bool = False
    districts: tuple[str, ...] = field(default=())
    rooms: int | None = None
    renovation: str | None = None
    tag: str | None = None
    sort: str = "newest"
    limit: int = 10
    offset: int = 0

    def checked(self) -> Criteria:
        seen: dict[str, str] = {}
        for d in self.districts:
            d = " ".join(d.split())
            if d:
                seen.setdefault(d.casefold(), d)
        if self.min_price is not None and self.max_price is not None and self.min_price > self.max_price:
            raise ValueError("min_price is above max_price")
        if not 1 <= self.limit <= 50 or self.offset < 0:
            raise ValueError("limit is 1 to 50, offset 0 or more")
        if self.sort not in SORTS:
            raise ValueError(f"sort is one of {SORTS}")
        return replace(self, districts=tuple(seen.values()), tag=(self.tag or "").strip().lower() or None)


def checked_requests(requests: DataFrame) -> DataFrame:
    """Stored requests (min_price, max_price, districts, tag, sort, limit, offset) normalised as ``Criteria.checked`` does, with ``problem``.

    Districts are collapsed, blank ones dropped, the first spelling of each kept; problem is null for a valid request.
    """
    clean = F.filter(F.transform("districts", collapsed_text), lambda d: d != "")
    once = F.aggregate(clean, F.array().cast("array<string>"), lambda a, d: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(d)), a).otherwise(F.array_append(a, d)))
    problem = (
        F.when(F.col("min_price") > F.col("max_price"), "min_price is above max_price").when(~F.col("limit").between(1, 50) | (F.col("offset") < 0), "limit is 1 to 50, offset 0 or more")
        .when(~F.col("sort").isin(*SORTS), "unknown sort")
    )
    return requests.withColumn("districts", F.coalesce(once, F.array().cast("array<string>"))).withColumn("tag", F.nullif(F.lower(F.trim("tag")), F.lit(""))).withColumn("problem", problem)


def user_facing() -> Column:
    """Active announcements that are their own parent."""
    return (F.col("status") == "active") & F.col("parent_id").isNull()


def rentable() -> Column:
    return F.coalesce(F.col("price_period") != "one_time", F.lit(True))


def priced(low: object = None, high: object = None) -> Column:
    """Monthly price within inclusive bounds; an unknown price fails any bound."""
    parts = [F.col("monthly") >= F.lit(low).cast("decimal(14,2)")] if low is not None else []
    parts += [F.col("monthly") <= F.lit(high).cast("decimal(14,2)")] if high is not None else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_districts(districts: tuple[str, ...]) -> Column:
    return F.lower("district").isin([d.lower() for d in districts]) if districts else F.lit(True)


def tagged(tag: str | None) -> Column:
    """Carries the tag and doesn't exclude it."""
    if tag is None:
        return F.lit(True)
    return F.coalesce(F.lower("tag") == tag.lower(), F.lit(False)) & ~F.coalesce(F.lower("excluded_tag") == tag.lower(), F.lit(False))


def basis_allowed(include_per_person: bool) -> Column:
    return F.lit(True) if include_per_person else ~F.coalesce(F.col("price_basis") == "per_person", F.lit(False))


def matches(c: Criteria) -> Column:
    """The whole search predicate as one column expression."""
    out = user_facing() & rentable() & basis_allowed(c.include_per_person) & priced(c.min_price, c.max_price) & in_districts(c.districts) & tagged(c.tag)
    if c.rooms is not None:
        out &= F.col("rooms") == c.rooms
    if c.renovation is not None:
        out &= F.col("renovation") == c.renovation
    return out


def when_given(value: object, condition: Column) -> Column:
    """An optional-parameter predicate: no condition where the parameter is not given."""
    return F.lit(True) if value is None else condition


def within(ts: str, start: str, end: str) -> Column:
    """Half-open time range."""
    return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))


def fanout_siblings(parent: str, item: str, left: str = "l", right: str = "r") -> Column:
    """Two candidates cut from one post: the same parent, different items."""
    return F.coalesce((F.col(f"{left}.{parent}") == F.col(f"{right}.{parent}")) & (F.col(f"{left}.{item}") != F.col(f"{right}.{item}")), F.lit(False))


def prices_comparable(left: str = "l", right: str = "r") -> Column:
    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    total = (col(left, "price_basis") == "total") & (col(right, "price_basis") == "total")
    rent = (col(left, "price_period") != "one_time") & (col(right, "price_period") != "one_time")
    known = col(left, "monthly").isNotNull() & col(right, "monthly").isNotNull()
    return F.coalesce(total & rent & known & (col(left, "currency") == col(right, "currency")), F.lit(False))


def area_close(left: str = "l", right: str = "r", tolerance: int = 3) -> Column:
    return F.coalesce(F.abs(F.col(f"{left}.area") - F.col(f"{right}.area")) < tolerance, F.lit(False))


def price_close(left: str = "l", right: str = "r", percent: int = 5) -> Column:
    """Difference within ``percent`` of the larger price, compared in exact decimals."""
    a, b = F.col(f"{left}.monthly"), F.col(f"{right}.monthly")
    return prices_comparable(left, right) & F.coalesce(F.abs(a - b) * 100 <= F.greatest(F.abs(a), F.abs(b)) * percent, F.lit(False))
