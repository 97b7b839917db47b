"""Near-duplicate images thinned out: a greedy choice in order, found in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.functions.similarity import apart, block_keys
from listingloom.operators.joins import _blocks
from listingloom.sources.tables import checkpointed


#: Distinct hashes of a group that is folded in one place; the rounds are for larger ones.
SMALL_GROUP = 1024


def greedy_distinct(rows: DataFrame, group: str, order: list[str], hash_col: str, most: int = 8) -> DataFrame:
    """rows with ``kept``: in the order of a group's rows, one is kept if no kept one before has a 64-bit hash within ``most`` bits.

    ``hash_col`` is a bigint. Rows without a hash are kept, null groups are one. Equal hashes fare like their first row, so the
    rounds work on distinct ones. A hash is decided once no undecided one before it could rule it out. While that settles half of what is left,
    a round looks only at the first hash of every block key, so that a dense cluster goes in one round without its pairs; what
    remains is sparse, and its pairs of near hashes are followed. A group of more than SMALL_GROUP hashes is never one array or one task;
    smaller ones are folded one by one, without keys or pairs.
    """
    item = [F.col(group).alias("g"), F.col(hash_col).alias("h")]
    ranked = rows.select(*item, F.struct(*order).alias("o"))
    reps = checkpointed(ranked.where("h is not null").groupBy("g", "h").agg(F.min("o").alias("o")).withColumn("g", F.struct("g")))
    large = checkpointed(reps.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_GROUP))
    largest = large.agg(F.max("n")).first()[0] or 0
    few = reps.join(large, "g", "left_anti") if largest else reps
    add = lambda acc, x: F.when(F.exists(acc, lambda y: apart(x["h"], y["h"]) <= most), acc).otherwise(F.array_append(acc, x))
    lists = few.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("o", "h"))).alias("x"))
    folded = lists.select("g", F.explode(F.aggregate("x", F.slice("x", 1, 0), add)).alias("x")).select("g", "x.h", "x.o")
    reps = reps.join(large.select("g"), "g", "left_semi") if largest else reps.limit(0)
    keys = block_keys(F.col("h"), _blocks(largest, most), most)

    def keyed(nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("key", F.explode(keys))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """(g, a, b): hashes a of left and later ones b of right within reach."""
        l, r = keyed(left).alias("l"), keyed(right).alias("r")
        same = (F.col("l.g") == F.col("r.g")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.o") < F.col("r.o")) & (apart(F.col("l.h"), F.col("r.h")) <= most)
        return l.join(r, same).select(F.col("l.g").alias("g"), F.col("l.h").alias("a"), F.col("r.h").alias("b")).distinct()

    def without(nodes: DataFrame, gone: DataFrame, name: str) -> DataFrame:
        return nodes.join(gone.select("g", F.col(name).alias("h")), ["g", "h"], "left_anti")

    open_, kept, left = reps, reps.limit(0), reps.count() if largest else 0
    while left:
        placed = checkpointed(keyed(open_))
        leaders = placed.groupBy("g", "key").agg(F.min("o").alias("lead"))
        new = checkpointed(placed.join(leaders, ["g", "key"]).groupBy("g", "h", "o").agg(F.every(F.col("o") == F.col("lead")).alias("first")).where("first").drop("first"))
        kept = kept.unionByName(new)
        open_ = checkpointed(without(without(open_, new, "h"), near(new, open_), "b"))
        before, left = left, open_.count()
        if 2 * left > before:
            break
    edges = checkpointed(near(open_, open_)) if left else None
    while left:
        new = checkpointed(without(open_, edges, "b"))
        gone = checkpointed(edges.join(new.select("g", F.col("h").alias("a")), ["g", "a"]).select("g", "b").distinct())
        kept = kept.unionByName(new)
        open_ = checkpointed(without(without(open_, new, "h"), gone, "b"))
        still = open_.select("g", F.col("h").alias("a"))
        edges = checkpointed(edges.join(still, ["g", "a"], "left_semi").join(still.withColumnRenamed("a", "b"), ["g", "b"], "left_semi"))
        left = open_.count()
    chosen = checkpointed(kept.unionByName(folded)).select(F.col("g.g").alias("_g"), F.col("h").alias("_h"), F.col("o").alias("_o"))
    mine = F.col(group).eqNullSafe(F.col("_g")) & (F.col(hash_col) == F.col("_h")) & (F.struct(*order) == F.col("_o"))
    told = rows.join(chosen, mine, "left")
    return told.withColumn("kept", F.col("_h").isNotNull() | F.col(hash_col).isNull()).drop("_g", "_h", "_o")
