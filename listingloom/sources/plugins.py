"""Extension points: parser plugins as table functions, source adapters, extraction strategies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

#: A plugin cuts one text into (index, text) candidates.
Parser = Callable[[str], Iterator[tuple[int, str]]]


def register_parser(spark: SparkSession, name: str, parser: Parser) -> None:
    """Registers a plugin as the table function ``name(text)``; its own errors give no candidates."""

    class Plugin:
        def eval(self, text: str):
            try:
                yield from parser(text) if text is not None else ()
            except ValueError:
                return

    spark.udtf.register(name, F.udtf(Plugin, returnType="index int, segment string"))


def register_adapter(spark: SparkSession, adapter: type[DataSource]) -> str:
    """Registers a source adapter; ``spark.read.format(name)`` and ``readStream`` then use it."""
    spark.dataSource.register(adapter)
    return adapter.name()


def by_profile(profile: Column, strategies: dict[str, Column], fallback: Column) -> Column:
    """The extraction strategy of a source profile."""
    out = fallback
    for name, value in strategies.items():
        out = F.when(profile == name, value).otherwise(out)
    return out


def extracted_text(profile: Column, update: Column) -> Column:
    """An update's text by its source's profile: captions of media, and of albums, count as empty rather than missing."""
    text, name = update["text"], F.coalesce(F.nullif(F.trim(profile), F.lit("")), F.lit("default"))
    with_media = F.coalesce(text, F.when(F.size(update["media"]) > 0, F.lit("")))
    with_album = F.coalesce(text, F.when(F.coalesce(update["media_group_id"], F.lit("")) != "", F.lit("")))
    return by_profile(name, {"caption_first": with_media, "album_text_merge": with_album}, text)


def cohort_access(users: DataFrame, allow: DataFrame, is_open: Column) -> DataFrame:
    """users with ``allowed`` and ``reason``: all where access is open, else those of the allow list (user_id)."""
    listed = allow.select("user_id", F.lit(True).alias("_listed")).distinct()
    empty = F.lit(allow.isEmpty())
    rows = users.withColumn("_open", is_open).join(listed, "user_id", "left")
    reason = F.when(F.col("_open"), "bot_enabled").when(F.col("_listed"), "allowlisted").when(empty, "allowlist_empty").otherwise("not_allowlisted")
    return rows.select(*users.columns, (F.col("_open") | F.coalesce("_listed", F.lit(False))).alias("allowed"), reason.alias("reason"))


def gate(rows: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """rows if the flag is on, else none; the flag table is one small row set, joined by broadcast."""
    on = flags.where((F.col("flag_name") == flag) & F.col("enabled")).select(F.lit(True).alias("_on")).limit(1)
    return rows.join(F.broadcast(on), F.lit(True), "left_semi")
