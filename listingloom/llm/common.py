"""Helpers shared by the operators: table readers, written intermediate tables and key filters."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of the names of written tables.
WRITTEN = "listingloom-"
#: Rows of a narrow table that may be broadcast whole.
BROADCAST_ROWS = 1 << 18
#: Bits of a key filter for each key, and log2 of the most it may have (64 MB, whatever the input).
BITS_PER_KEY, MOST_BITS = 16, 29
#: Bits of one row of a key filter (fixed by Spark's bitmap functions).
CHUNK_BITS = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none, as in tests, one is made and set; on a cluster that is an error,
    as executors don't see the driver's own folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage: later stages read the files, so neither a lost executor nor a second
    use computes ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{WRITTEN}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` once everything that reads them is written itself; other files are let be."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if not folder.rpartition("/")[2].startswith(WRITTEN):
                continue
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns added beside it clash with none of them; ``x.*`` gives them back."""
    return F.struct(*(quoted(c) for c in df.columns))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``: the split into held-out folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def hash_below(share: float, *cols: Column) -> Column:
    """True for about ``share`` of all values of ``cols``, the same ones on every run and retry."""
    return F.pmod(F.xxhash64(F.lit(977), *cols), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def key_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(chunk, bitmap) rows and the filter's bits, for a table of one bigint column with ``n`` rows.

    A Bloom filter with one function, the key's low bits: keys must be hashes. It never has more than
    2**MOST_BITS bits; with more keys than it is made for, more rows that are not in it look as if they were.
    """
    bits = 1 << min(MOST_BITS, max(CHUNK_BITS, (BITS_PER_KEY * max(n, 1) - 1).bit_length()))
    slot = quoted(keys.columns[0]).bitwiseAND(F.lit(bits - 1))
    rows = keys.select(F.shiftright(slot, CHUNK_BITS).alias("chunk"), slot.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).alias("at"))
    return rows.groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bitmap")), bits


def in_filter(rows: DataFrame, key: str, found: DataFrame, bits: int, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where the bigint column ``key`` is certainly not in the filter."""
    slot = F.col(key).bitwiseAND(F.lit(bits - 1))
    chunk, at = F.shiftright(slot, CHUNK_BITS), slot.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))
    joined = rows.join(F.broadcast(found.withColumnRenamed("bitmap", f"{key}_bits").withColumnRenamed("chunk", f"{key}_chunk")), chunk == F.col(f"{key}_chunk"), "left")
    byte = F.conv(F.hex(F.substring(f"{key}_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(f"{key}_bits", f"{key}_chunk")


def without(rows: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """``rows`` but for those whose ``keys`` are, nulls included, a row of ``gone``, a written table of as many columns.

    Few keys are broadcast. Beyond BROADCAST_ROWS a filter of bounded size lets rows that are certainly not
    gone pass straight through, and only the rest are shuffled.
    """
    n, names = gone.count(), [f"_key{k}" for k in range(len(keys))]
    keyed = rows.select(whole_row(rows).alias("_row"), *(k.alias(name) for k, name in zip(keys, names)))
    gone = gone.select(*(quoted(c).alias(f"_gone{k}") for k, c in enumerate(gone.columns)))
    same = reduce(lambda a, b: a & b, (F.col(f"_key{k}").eqNullSafe(F.col(f"_gone{k}")) for k in range(len(keys))))
    if n <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(gone), same, "left_anti").select("_row.*")
    found, bits = key_filter(gone.select(F.xxhash64(*gone.columns).alias("h")), n)
    flagged = in_filter(keyed.withColumn("_h", F.xxhash64(*names)), "_h", written(found), bits, "_maybe")
    rest = flagged.where("_maybe").join(gone, same, "left_anti")
    return flagged.where("not _maybe").select("_row.*").unionByName(rest.select("_row.*"))
