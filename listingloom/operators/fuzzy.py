"""Fuzzy names: the entries of a table most alike to a text by matching blocks, as a filter-and-verify join."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from listingloom.sources.tables import checkpointed


def _pairs_of_letters(text: Column) -> Column:
    """Pairs of neighbouring characters, each with the number of times it came before; a text of one character is that."""
    last = F.length(text) - 1
    grams = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(text, k, F.lit(2)))).otherwise(F.array(text))
    seen = F.transform(F.array_distinct(grams), lambda g: F.transform(F.sequence(F.lit(1), F.size(F.filter(grams, lambda x: x == g))), lambda n: F.concat(g, n.cast("string"))))
    return F.flatten(seen)


def _letters(text: Column) -> Column:
    """Characters, each with its number of occurrences before, as an array of distinct values."""
    chars = F.split(text, "")
    return F.flatten(F.transform(F.array_distinct(chars), lambda g: F.transform(F.sequence(F.lit(1), F.size(F.filter(chars, lambda x: x == g))), lambda n: F.concat(g, n.cast("string")))))


@F.pandas_udf(DoubleType())
def matching_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the characters in matching blocks of b within a, over all characters of both."""
    matcher = difflib.SequenceMatcher()
    for a, b in batches:
        out = []
        for x, y in zip(a, b):
            matcher.set_seqs(x, y)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype="float64")


def fuzzy_matches(texts: DataFrame, names: DataFrame, least: float = 0.82) -> DataFrame:
    """(text, name, ratio): for each distinct text of ``texts`` the name of ``names`` most alike, at a ratio of ``least`` or more.

    ``texts`` have a column ``text``, ``names`` name and place; of equals the first place counts. Null and empty texts match nothing. With M
    characters in matching blocks of T in all, the blocks are at most 1 + T - 2M, as there is a character left out between any two; so
    two texts share 3M - T - 1 letter pairs at least, and M is least * T / 2 or more. Pairs of texts therefore meet on the rarest of their
    letter pairs only, as many as make a miss impossible; lengths and common letters rule out more, and the ratio of what is
    left is computed in Arrow batches. Above four fifths one pair at least is shared, whatever the lengths; ``least`` must be above.
    """
    if not 0.8 < least <= 1:
        raise ValueError("least must lie above four fifths")

    def sides(rows: DataFrame, *columns: str) -> DataFrame:
        return checkpointed(rows.where("t is not null and t <> ''").select("t", *columns, F.length("t").alias("size"), _pairs_of_letters(F.col("t")).alias("grams"), _letters(F.col("t")).alias("letters")))

    a, b = sides(texts.select(F.col("text").alias("t")).distinct()), sides(names.groupBy(F.col("name").alias("t")).agg(F.min("place").alias("place")), "place")
    counts = b.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def prefixes(rows: DataFrame) -> DataFrame:
        shortest = F.ceil(F.col("size") * (least / (2 - least)) - 1e-9)
        shared = F.greatest(F.lit(1), F.ceil((F.col("size") + shortest) * (1.5 * least - 1) - 1 - 1e-9)).cast("int")
        each = rows.select("t", (F.size("grams") - shared + 1).alias("reach"), F.explode("grams").alias("gram")).join(counts, "gram", "left")
        ranked = each.groupBy("t", "reach").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("r"))
        return ranked.select("t", F.explode(F.slice("r", F.lit(1), F.greatest(F.col("reach"), F.lit(1)))).alias("x")).select("t", "x.gram")

    met = prefixes(a).select(F.col("t").alias("text"), "gram").join(prefixes(b).select(F.col("t").alias("name"), "gram"), "gram").select("text", "name").distinct()
    both = met.join(a.select(F.col("t").alias("text"), F.col("size").alias("m"), F.col("letters").alias("x")), "text").join(b.select(F.col("t").alias("name"), "place", F.col("size").alias("n"), F.col("letters").alias("y")), "name")
    able = 2 * F.least("m", "n") >= (F.col("m") + F.col("n")) * F.lit(least) - 1e-9
    bag = 2 * F.size(F.array_intersect("x", "y")) >= (F.col("m") + F.col("n")) * F.lit(least) - 1e-9
    told = both.where(able).where(bag).select("text", "name", "place", matching_ratio("text", "name").alias("ratio")).where(F.col("ratio") >= least)
    best = told.groupBy("text").agg(F.max_by(F.struct("name", "ratio"), F.struct("ratio", (-F.col("place")).alias("p"))).alias("b"))
    return best.select("text", "b.name", "b.ratio")
