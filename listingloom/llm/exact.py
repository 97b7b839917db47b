"""Exact dedup with two Bloom passes, in DataFrame functions only.

Pass 1 adds every row's hash to a counting Bloom filter: a slot number is all that a row sends, combined within
tasks, and only slots that two rows met are kept. Pass 2 folds those slots into bitmaps that every task gets and
looks each row up. A row whose bit isn't set has no equal and passes straight through; only possibly repeated rows
are shuffled to find their groups. Whole documents are shuffled only where they are, or look like, copies that go
(``common.without``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import CHUNK_BITS, in_filter, key_filter, quoted, text_or_empty, whole_row, without, written

#: Slots of the counting filter for each row. Two different texts meet in one by chance with probability 1 in this; that costs a shuffled row.
SLOTS_PER_ROW = 32
#: Every run of white space that is not one space already.
RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), RUNS, " ")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the columns _sha (hex) and _h (bigint) of the normalised ``_text``, which goes."""
    return rows.withColumn("_text", normalised(F.col("_text"))).withColumn("_sha", F.sha2("_text", 256)).withColumn("_h", F.xxhash64("_text")).drop("_text")


def met_slots(hashes: DataFrame, n: int) -> DataFrame:
    """(slot): the slots of the counting filter that two rows of ``_h`` or more fall into."""
    mask = (1 << max(CHUNK_BITS, (SLOTS_PER_ROW * max(n, 1) - 1).bit_length())) - 1
    return hashes.groupBy(F.col("_h").bitwiseAND(F.lit(mask)).alias("slot")).agg(F.count("*").alias("n")).where("n > 1").select("slot")


def flag_repeats(keys: DataFrame) -> DataFrame:
    """keys with ``_maybe``: false only for rows whose ``_h`` is certainly the only one of its value."""
    met = written(met_slots(keys.select("_h"), keys.count()))
    found, bits = key_filter(met, met.count())
    return in_filter(keys, "_h", written(found), bits, "_maybe")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when identical after every run of ASCII white space became one space; null counts as
    empty. The least id of a group stays; a null id stays only in a group without any other. A repeated
    (id, text) row counts in group_size and is kept with its id. Other columns are not read; an empty
    table gives no rows.
    """
    flagged = flag_repeats(written(_keyed(docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")))))
    alone = flagged.where("not _maybe").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "_sha")
    maybe = flagged.where("_maybe").select("_id", "_sha")
    groups = written(maybe.groupBy("_sha").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size")))
    told = maybe.join(groups, "_sha").select("_id", "keep_id", "group_size", "_sha").unionByName(alone)
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return told.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text of ``docs`` with all its columns: a row of the id that ``exact_groups`` keeps.

    Of several rows of that id and text one stays (any, where their other columns differ). Rows whose text has no
    copy are not shuffled, and of the others only their text's hash decides. Columns may have any names; an
    empty table stays empty.
    """
    keys = written(_keyed(docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))))
    each = written(flag_repeats(keys).where("_maybe").groupBy("_sha", "_h", "_id").agg(F.count("*").alias("rows")))
    keep = each.groupBy("_sha").agg(F.min("_id").alias("_keep"), F.sum("rows").alias("n")).where("n > 1")
    told = written(each.join(written(keep), "_sha").select("_h", "_id", "rows", F.col("_id").eqNullSafe(F.col("_keep")).alias("stays")))
    key = [F.xxhash64(normalised(quoted(text_col))), quoted(id_col)]
    left = without(docs, key, written(told.where("not stays").select("_h", "_id")))
    again = written(told.where("stays and rows > 1").select("_h", "_id"))
    if again.isEmpty():
        return left
    repeated = left.select(whole_row(left).alias("_row"), *(k.alias(f"_k{i}") for i, k in enumerate(key)))
    again = again.select(F.col("_h").alias("_k0"), F.col("_id").alias("_id"))
    one = repeated.join(again, (repeated["_k0"] == again["_k0"]) & repeated["_k1"].eqNullSafe(again["_id"]), "left_semi").dropDuplicates(["_k0", "_k1"])
    return without(left, key, again).unionByName(one.select("_row.*"))
