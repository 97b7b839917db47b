"""Sharding with sampled splitters, in DataFrame functions only.

Law ``bytes``: records are laid out in the order (hash of the text, id) and cut into shards of near
equal size. A size-weighted sample gives splitters; records fall into the ranges between them; ranges
with too many rows are subdivided at splitters of a second sample, inside a hot text too; running sums
inside the pieces plus the pieces' offsets give each record its place in the whole order. Equal texts are
neighbours, so a group of copies is cut over shards only where it is large against a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingloom.llm.common import hash_below, quoted, text_or_empty, written

SHARDS = 24
RANGES_PER_SHARD = 8
#: Expected rows of the sample for each range; the driver holds about SHARDS * RANGES_PER_SHARD * this many keys.
SAMPLE_PER_RANGE = 40
#: A range with more rows is subdivided.
RANGE_ROWS = 1_000_000
#: A group of equal texts up to this share of a shard is never cut.
WHOLE_GROUP = 0.004


def _choose_splitters(sample: list, ranges: int, least_weight: float) -> list[tuple]:
    """sample: rows (h, id, seq, weight). Weighted quantiles as (h, id, seq); (h,) where the whole text group goes right."""
    total, run, out = sum(max(r["weight"], least_weight) for r in sample), 0.0, []
    for r in sorted(sample, key=lambda r: (r["h"], r["id"] is not None, r["id"] if r["id"] is not None else 0, r["seq"])):
        if run >= (len(out) + 1) * total / ranges and len(out) < ranges - 1:
            at = (r["h"], r["id"], r["seq"]) if out and out[-1][0] == r["h"] else (r["h"],)
            if not out or out[-1] != at:
                out.append(at)
        run += max(r["weight"], least_weight)
    return out


def _range_of(splitters: list[tuple], id_type: str, low: int = 0) -> Column:
    """Number of splitters at or below (h, id, seq), as a balanced tree of comparisons."""
    if not splitters:
        return F.lit(low)
    mid = len(splitters) // 2
    h, *rest = splitters[mid]
    right = F.col("h") >= F.lit(h)
    if rest:
        right = F.struct("h", "id", "seq") >= F.struct(F.lit(h).cast("bigint").alias("h"), F.lit(rest[0]).cast(id_type).alias("id"), F.lit(rest[1]).cast("bigint").alias("seq"))
    return F.when(right, _range_of(splitters[mid + 1 :], id_type, low + mid + 1)).otherwise(_range_of(splitters[:mid], id_type, low))


def _pieces(ranged: DataFrame, shape: str) -> tuple[DataFrame, set[int]]:
    """``ranged`` with ``piece``: 0, or the place among the splitters of an overfull range; and the texts that are cut.

    The driver holds about SAMPLE_PER_RANGE keys for each RANGE_ROWS rows of overfull ranges.
    """
    spark = ranged.sparkSession
    full = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > RANGE_ROWS).collect()}
    if not full:
        return ranged.withColumn("piece", F.lit(0)), set()
    some = hash_below(min(1.0, SAMPLE_PER_RANGE / RANGE_ROWS), F.col("h"), F.col("id"), F.col("seq"))
    drawn: dict[int, list] = {k: [] for k in full}
    for r in ranged.where(F.col("range").isin(*full) & some).select("range", "h", "id", "seq", F.lit(1).alias("weight")).collect():
        drawn[r["range"]].append(r)
    splits = {k: _choose_splitters(rows, -(-full[k] // RANGE_ROWS) * 2, 1) for k, rows in drawn.items()}
    # A splitter (h,) is before all rows of h: a null id and the least seq sort first.
    rows = [(k, [(*s, None, -1)[:3] if len(s) == 1 else s for s in v]) for k, v in splits.items()]
    sides = spark.createDataFrame(rows, f"range int, splits array<struct<{shape}>>")
    piece = F.coalesce(F.size(F.filter("splits", lambda x: x <= F.struct("h", "id", "seq"))), F.lit(0))
    told = ranged.join(F.broadcast(sides), "range", "left").withColumn("piece", F.when(F.col("splits").isNull(), 0).otherwise(piece)).drop("splits")
    return told, {s[0] for v in splits.values() for s in v if len(s) > 1}


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row; law is ``bytes``.

    size: UTF-8 bytes of the text (null: none) plus 8. Shards are equal up to the longest record and
    WHOLE_GROUP of a shard; slots run from 0 without gaps; grown_shard is null under this law. Null ids
    come first in their text's group, repeated rows take a slot each, an empty table gives no rows. Other
    columns are not read.
    """
    spark, text = docs.sparkSession, text_or_empty(quoted(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(
        docs.select(
            quoted(id_col).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("seq"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 1
    ranges = shards * RANGES_PER_SHARD
    rate = ranges * SAMPLE_PER_RANGE / total
    drawn = F.pmod(F.xxhash64(F.lit(7), "h", "id", "seq"), F.lit(1 << 30)) < F.col("size") * F.lit(rate * (1 << 30))
    splitters = _choose_splitters(rows.where(drawn).select("h", "id", "seq", F.col("size").alias("weight")).collect(), ranges, 1 / rate)
    ranged, inside = _pieces(rows.withColumn("range", _range_of(splitters, kind)), f"h:bigint,id:{kind},seq:bigint")

    before_bytes = before_rows = 0
    offsets = []
    for r in sorted(ranged.groupBy("range", "piece").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()):
        offsets.append((r["range"], r["piece"], before_bytes, before_rows))
        before_bytes, before_rows = before_bytes + r["b"], before_rows + r["n"]
    starts = spark.createDataFrame(offsets, "range int, piece int, byte_start bigint, row_start bigint")

    place = Window.partitionBy("range", "piece").orderBy("h", "id", "seq")
    group = Window.partitionBy("range", "piece", "h")
    laid = written(
        ranged.withColumn("before", F.coalesce(F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("nth", F.row_number().over(place))
        .withColumn("first", F.min("before").over(group))
        .withColumn("group_size", F.sum("size").over(group))
        .join(F.broadcast(starts), ["range", "piece"])
        .select("id", "size", "text_crc32", "h", (F.col("byte_start") + F.col("before")).alias("at"), (F.col("byte_start") + F.col("first")).alias("group_at"), "group_size", (F.col("row_start") + F.col("nth") - 1).alias("rank"))
    )
    # The texts that a splitter cuts are groups over several pieces.
    cut = spark.createDataFrame([(h,) for h in sorted(inside | {s[0] for s in splitters if len(s) > 1})], "h bigint")
    whole = written(laid.join(F.broadcast(cut), "h", "left_semi").groupBy("h").agg(F.min("at").alias("whole_at"), F.sum("size").alias("whole_size")))
    laid = laid.join(F.broadcast(whole), "h", "left")
    small = F.coalesce("whole_size", "group_size") <= F.lit(int(total / shards * WHOLE_GROUP))
    at = F.when(small, F.coalesce("whole_at", "group_at")).otherwise(F.col("at"))
    shard = F.least(F.floor(at * F.lit(shards) / F.lit(total)).cast("int"), F.lit(shards - 1))
    placed = written(laid.select("id", "size", "text_crc32", shard.alias("shard"), "rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes ``docs`` as one folder a shard under ``path``, rows in slot order within each file.

    Ids must be unique. Each shard is dealt over several tasks by slot, so no task holds a whole shard.
    """
    rows = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    (
        rows.withColumn("_part", F.floor(F.col("slot") / F.lit(100_000)))
        .repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part")
        .write.partitionBy("shard").parquet(path)
    )
