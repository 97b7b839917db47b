"""Linking children to their parent: every child in order, one merged parent, an audit row a child."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.operators.dedup import is_empty
from listingloom.sources.tables import checkpointed


@dataclass(frozen=True)
class Linked:
    """``parents``: merged rows with source_count and latest_source_id; ``children``: rows with their parent_id;
    ``audit``: (parent_id, child_id, merge_policy, conflicts array<struct<field, parent, child>>).
    """

    parents: DataFrame
    children: DataFrame
    audit: DataFrame


def _kinds(rows: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in rows.schema}


def survivors(parents: DataFrame, children: DataFrame, fields: list[str], order: Column) -> DataFrame:
    """(announcement_id, fields): a parent's value of each field or, where that is empty, that of its first child that has one.

    ``children`` have ``parent_id``; ``order`` puts those of one parent in order (then their ids). What a merge child by child
    leaves is the first value that isn't empty, so one least struct a field and parent is enough: it is combined before
    the shuffle, and a parent's children are never gathered.
    """
    kinds = _kinds(parents)
    place = F.struct(order.alias("o"), F.col("announcement_id").alias("id"))
    firsts = (F.min(F.when(~is_empty(F.col(f), kinds[f]), F.struct(place, F.col(f).alias("v")))).alias(f"_{f}") for f in fields)
    first = children.groupBy(F.col("parent_id").alias("_parent")).agg(*firsts)
    both = parents.join(first, F.col("announcement_id") == F.col("_parent"), "left")
    merged = (F.when(is_empty(F.col(f), kinds[f]), F.coalesce(F.col(f"_{f}.v"), F.col(f))).otherwise(F.col(f)).alias(f) for f in fields)
    return both.select("announcement_id", *merged)


def conflicts(children: DataFrame, merged: DataFrame, fields: list[str]) -> DataFrame:
    """(parent_id, child_id, conflicts) for each child: its values that differ from the parent's as they were when it came.

    A field's value stands from the first child that has one, so whoever has another one came later.
    """
    kinds = _kinds(children)
    own = children.select("parent_id", F.col("announcement_id").alias("child_id"), F.struct(*fields).alias("_child"))
    kept = merged.select(F.col("announcement_id").alias("_id"), F.struct(*fields).alias("_kept"))
    told = []
    for f in fields:
        mine, theirs = F.col(f"_child.{f}"), F.col(f"_kept.{f}")
        differ = ~is_empty(mine, kinds[f]) & ~is_empty(theirs, kinds[f]) & ~mine.eqNullSafe(theirs)
        told.append(F.when(differ, F.struct(F.lit(f).alias("field"), theirs.cast("string").alias("parent"), mine.cast("string").alias("child"))))
    both = own.join(kept, F.col("parent_id") == F.col("_id"))
    return both.select("parent_id", "child_id", F.array_compact(F.array(*told)).alias("conflicts"))


def link_children(listings: DataFrame, links: DataFrame, fields: list[str], order: str = "seq", policy: str = "merge_parent_fields") -> Linked:
    """Links children to parents in the order of ``links`` (child_id, parent_id and the order's column).

    ``listings`` have announcement_id, parent_id, source_id and the fields. A link of a child that has that parent already is void, a child's
    first link counts, and links to a parent that isn't there are void. A parent's source_count counts it and all its
    children, those linked before included, and latest_source_id is the source of its last new child.
    """
    first = links.groupBy("child_id").agg(F.min_by(F.struct("parent_id", order), order).alias("l")).select("child_id", F.col("l.parent_id").alias("_to"), F.col(f"l.{order}").alias("_seq"))
    there = listings.select(F.col("announcement_id").alias("_there"))
    first = first.join(there, F.col("_to") == F.col("_there"), "left_semi")
    new = listings.join(first, F.col("announcement_id") == F.col("child_id")).where(F.col("parent_id").isNull() | (F.col("parent_id") != F.col("_to")))
    new = checkpointed(new.select("announcement_id", F.col("_to").alias("parent_id"), "_seq", "source_id", *fields))
    touched = new.groupBy(F.col("parent_id").alias("_touched")).agg(F.max_by("source_id", F.struct("_seq", "announcement_id")).alias("_latest"))
    parents = checkpointed(listings.join(touched, F.col("announcement_id") == F.col("_touched")).select("announcement_id", "_latest", *fields))
    merged = checkpointed(survivors(parents, new, fields, F.col("_seq")))
    moved = new.select(F.col("announcement_id").alias("_moved"), F.col("parent_id").alias("_to"))
    now = listings.select("announcement_id", "parent_id").join(moved, F.col("announcement_id") == F.col("_moved"), "left")
    counts = now.groupBy(F.coalesce("_to", "parent_id").alias("_of")).agg(F.count("*").alias("n")).where("_of is not null")
    refreshed = merged.join(parents.select("announcement_id", F.col("_latest").alias("latest_source_id")), "announcement_id").join(counts, F.col("announcement_id") == F.col("_of"), "left")
    source_count = F.greatest(F.lit(1), F.coalesce("n", F.lit(0)) + 1)
    audit = conflicts(new, merged, fields).withColumn("merge_policy", F.lit(policy))
    return Linked(
        refreshed.select("announcement_id", *fields, source_count.cast("bigint").alias("source_count"), "latest_source_id"),
        new.select("announcement_id", "parent_id", F.lit("active").alias("status"), F.lit(1).cast("bigint").alias("source_count"), F.col("source_id").alias("latest_source_id"), *fields),
        audit.select("parent_id", "child_id", "merge_policy", "conflicts"),
    )
