"""Writes as snapshot functions: each returns the new rows or the whole new table from the old one and a batch."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def absent_rows(stored: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows of a batch whose key is not stored, the first of each key by ``order`` (insert, on conflict do nothing)."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
    return first.join(stored.select(*keys).distinct(), keys, "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The table after a batch: its last row of each key by ``order`` replaces the stored one."""
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
    return stored.join(last.select(*keys), keys, "left_anti").select(*stored.columns).unionByName(last.select(*stored.columns))


def update_from(stored: DataFrame, changes: DataFrame, keys: list[str], values: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... FROM: rows with a matching change get new values; ``changes`` must have one row a key."""
    marked = stored.join(changes.select(*keys, F.lit(True).alias("_hit"), *[c for c in changes.columns if c not in stored.columns]), keys, "left")
    return marked.select(*(F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns))


def capped_insert(stored: DataFrame, batch: DataFrame, owner: str, order: str, most: int) -> DataFrame:
    """Rows of a batch that fit while an owner has at most ``most`` rows, in order."""
    have = stored.groupBy(owner).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    rows = batch.withColumn("_place", place).join(have, owner, "left")
    return rows.where(F.col("_place") + F.coalesce("_n", F.lit(0)) <= most).select(*batch.columns)


def extended(until: Column, now: Column, days: int) -> Column:
    """A premium end pushed by ``days`` from the later of now and the old end."""
    return F.greatest(F.coalesce(until, now), now) + F.make_dt_interval(F.lit(days))


def touched_users(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(user_id, referral_code, status, created_at, updated_at) after the users of ``seen`` (user_id, at) came by.

    New ones are active, with a code made of their id; known ones keep everything but updated_at, which is their last visit if that is later.
    """
    visits = seen.groupBy("user_id").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    rows = stored.join(visits, "user_id", "full_outer")
    return rows.select(
        "user_id", F.coalesce("referral_code", F.format_string("u%010d", F.col("user_id").cast("bigint"))).alias("referral_code"), F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce("created_at", "_first").alias("created_at"), F.greatest("updated_at", "_last").alias("updated_at"),
    )


def create_or_enable(stored: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Sources after requests to have them, and what came of each: created, enabled again, or unchanged.

    ``stored`` has the key, enabled and deleted_at; deleted ones come back. A key asked for twice is one request.
    """
    wanted = asked.select(key).distinct().withColumn("_asked", F.lit(True))
    rows = stored.select(key, "enabled", "deleted_at", F.lit(True).alias("_there")).join(wanted, key, "full_outer")
    on = F.coalesce(F.col("enabled") & F.col("deleted_at").isNull(), F.lit(False))
    result = F.when(F.col("_there").isNull(), "created").when(~on, "enabled").otherwise("unchanged")
    told = rows.where("_asked").select(key, result.alias("result"))
    return rows.select(key, F.when(F.col("_asked"), True).otherwise(F.col("enabled")).alias("enabled"), F.when(F.col("_asked").isNull(), F.col("deleted_at")).alias("deleted_at")), told


def replay_guard(events: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """events with ``action``: what was processed and published before is returned, what was only processed is published, the rest is processed.

    ``processed`` has rows (key, status, published) of all runs; a run that didn't succeed counts for nothing.
    """
    done = processed.where(F.col("status") == "succeeded").groupBy(key).agg(F.max(F.coalesce("published", F.lit(False))).alias("_published"))
    action = F.when(F.col("_published"), "return").when(~F.col("_published"), "publish_only").otherwise("process")
    return events.join(done, key, "left").withColumn("action", action).drop("_published")


def tag_changes(stored: DataFrame, asked: DataFrame, audited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags after requests (tag, action, seq, request_key), and the new audit lines, one a request_key.

    ``stored`` has tag and status, ``audited`` the request_keys seen before, whose requests are void. Of a key's requests the first counts. In order of seq:
    upsert_pending adds a tag that isn't there as pending and leaves others; approve and reject set the status of a tag that is there.
    A tag's status is that of its last approve or reject behind its first upsert, so no request has to wait for another.
    """
    first = asked.groupBy("request_key").agg(F.min_by(F.struct("tag", "action", "seq"), "seq").alias("r")).join(audited.select("request_key"), "request_key", "left_anti").select("request_key", "r.*")
    born = first.where("action = 'upsert_pending'").groupBy("tag").agg(F.min("seq").alias("_born"))
    rows = first.join(born, "tag", "left").join(stored.select("tag", "status"), "tag", "left")
    counts = F.col("action").isin("approve", "reject") & (F.col("status").isNotNull() | (F.col("seq") > F.col("_born")))
    last = rows.where(counts).groupBy("tag").agg(F.max_by(F.when(F.col("action") == "approve", "approved").otherwise("rejected"), "seq").alias("_last"))
    every = stored.select("tag").union(born.select("tag")).distinct()
    tags = every.join(stored, "tag", "left").join(last, "tag", "left").select("tag", F.coalesce("_last", "status", F.lit("pending")).alias("status"))
    done = counts | ((F.col("action") == "upsert_pending") & F.col("status").isNull() & (F.col("seq") == F.col("_born")))
    return tags, rows.select("request_key", "tag", "action", F.coalesce(done, F.lit(False)).alias("changed"))


def remapped(values: Column, old: str, new: str) -> Column:
    """An array with a tag replaced and the result made distinct, order kept."""
    return F.array_distinct(F.transform(values, lambda x: F.when(x == old, F.lit(new)).otherwise(x)))


def remap_tag(listings: DataFrame, filters: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings and filters with one tag in place of another, and a row of counts (announcements_updated, filters_updated).

    ``listings`` have the arrays tags and excluded_tags, ``filters`` a JSON text ``filters`` whose ``criteria.audience_tag`` is replaced
    where it is the old one; the rest of the text stays as it is, in its order of keys. Null arrays stay null.
    """
    has = lambda c: F.coalesce(F.array_contains(c, old), F.lit(False))
    touched = has(F.col("tags")) | has(F.col("excluded_tags"))
    lists = listings.withColumn("_touched", touched).withColumns({c: F.when(F.col("_touched"), remapped(F.col(c), old, new)).otherwise(F.col(c)) for c in ("tags", "excluded_tags")})
    # The criteria object runs to its own closing brace: it holds no objects.
    asked = F.coalesce(F.get_json_object("filters", "$.criteria.audience_tag") == old, F.lit(False))
    value = lambda tag: F.to_json(F.struct(F.lit(tag).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.lit(tag).alias("v")))) - 6)
    pattern = F.concat(F.lit('("criteria"\\s*:\\s*\\{[^{}]*"audience_tag"\\s*:\\s*)\\Q'), value(old), F.lit("\\E"))
    swapped = F.call_function("regexp_replace", F.col("filters"), pattern, F.concat(F.lit("$1"), value(new)))
    stored = filters.withColumn("_asked", asked).withColumn("filters", F.when(F.col("_asked"), swapped).otherwise(F.col("filters")))
    counts = lists.agg(F.count_if("_touched").alias("announcements_updated")).crossJoin(stored.agg(F.count_if("_asked").alias("filters_updated")))
    return lists.drop("_touched"), stored.drop("_asked"), counts


def compare_and_set(flags: DataFrame, requests: DataFrame) -> DataFrame:
    """(flag_name, version, enabled, applied) after requests (flag_name, expected_version, enabled, seq).

    In order of seq a request applies if it expects the current version, and adds one to it. What applies
    depends on what applied before, so each flag's requests stream in order through a fold whose state is
    one version number.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, version = None, 0
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.flag_name != name:
                    name, version = r.flag_name, r.version
                if r.expected_version == version:
                    version += 1
                    out.append((name, version, bool(r.wanted)))
            yield pd.DataFrame(out, columns=["flag_name", "version", "wanted"])

    asked = requests.select("flag_name", "expected_version", F.col("enabled").alias("wanted"), "seq").join(flags.select("flag_name", "version"), "flag_name")
    dealt = asked.repartition("flag_name").sortWithinPartitions("flag_name", "seq")
    steps = dealt.mapInPandas(fold, "flag_name string, version int, wanted boolean")
    done = steps.groupBy("flag_name").agg(F.count("*").alias("applied"), F.max_by("wanted", "version").alias("_e"))
    out = flags.join(done, "flag_name", "left")
    applied = F.coalesce("applied", F.lit(0))
    return out.select("flag_name", (F.col("version") + applied).alias("version"), F.coalesce("_e", "enabled").alias("enabled"), applied.alias("applied"))
