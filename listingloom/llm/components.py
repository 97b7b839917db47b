"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges stay distributed; each half-round is a minimum per node (combined before the shuffle)
and an equi-join with it. Every half-round is written to the shared folder, so both join sides
are shuffled tables of their own and a hub's rows can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import forget, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(rows: DataFrame, keep_larger_only: bool) -> DataFrame:
    """rows (u, v). Links v to the least node m of u's neighbourhood, and u too in a small star."""
    least = written(rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = rows.join(least, "u")
    if keep_larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    done = written(out.where("u <> v").distinct())
    forget(least)
    return done


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of an orderable type -> (node, component): the least node reachable.

    Only nodes with an edge to another node are returned. Nulls, loops, repeated and reversed edges
    are ignored; no edges give no rows. Raises RuntimeError if ``max_rounds`` rounds don't settle
    (they are about log2 of the longest path).
    """
    tidy = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = written(tidy.distinct())
    before = _signature(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = written(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _star(both, True)
        last, now = now, _star(large, False)
        forget(last, both, large)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected_components: not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
