"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short item in a long document has a tiny Jaccard similarity, so signatures of whole documents
miss it. Instead each item keeps the least hashes of its own shingles, as many as its size class
needs: an item of at most u shingles that is contained to 80 % lacks at most u - ceil(0.8 u) of them,
so one more than that many least hashes always leave one that a containing document has. A document
with no such hash can't contain an item; the others are verified by counting shared shingles by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import quoted, text_or_empty, without, written

WORDS = 5
#: Least containment as a fraction.
SHARE, OF = 4, 5
#: log2 of the bits of each look-up bitmap. Fixed, so what is broadcast is 2 x 8 MB for any benchmark.
BITMAP_BITS = 26
SPACE = "[\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    lower = F.translate(text_or_empty(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, SPACE), lambda w: w != "")


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, shingle, h, n, in_sketch): distinct five-word shingles of each item and its MinHash sketch.

    n: the item's distinct shingles. The sketch has the m least h, where m follows from the largest
    size of the item's class (powers of two).
    """
    words = items.select(F.col(id_col).alias("item_id"), _words(F.col(text_col)).alias("w")).where(F.size("w") >= WORDS)
    each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (WORDS - 1)), lambda i: F.array_join(F.slice("w", i, WORDS), " ")))
    listed = words.select("item_id", each.alias("s"))
    by_hash = F.array_sort(F.transform("s", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("shingle"))))
    sized = listed.select("item_id", F.size("s").alias("n"), by_hash.alias("s"))
    top = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("int")
    need = top - F.ceil(top * F.lit(SHARE) / F.lit(OF)).cast("int") + 1
    return sized.select("item_id", "n", need.alias("need"), F.posexplode("s").alias("pos", "x")).select(
        "item_id", "x.shingle", "x.h", "n", (F.col("pos") < F.col("need")).alias("in_sketch")
    )


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The hashes' low BITMAP_BITS as set bits of 64-bit words; at most 2**(BITMAP_BITS - 6) rows reach the driver."""
    slot = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = (
        hashes.select(F.shiftright(slot, 6).alias("word"), F.lit(1).cast("bigint").alias("one"), slot.alias("slot"))
        .groupBy("word").agg(F.expr("bit_or(shiftleft(one, cast(slot & 63 as int)))").alias("bits")).toPandas()
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64((1 << BITMAP_BITS) - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def document_hits(docs: DataFrame, shingles: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, shingle): for documents with a sketch hash, their distinct shingles that an item may have."""
    from listingloom.llm.simhash import shingle_hashes

    sketch = docs.sparkSession.sparkContext.broadcast(_bitmap(shingles.where("in_sketch").select("h")))
    every = docs.sparkSession.sparkContext.broadcast(_bitmap(shingles.select("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                h = shingle_hashes(text or "", WORDS)
                if len(h) and _has(sketch.value, h).any():
                    words = text.encode().lower().split()
                    if len(words) >= WORDS:
                        own = {b" ".join(words[k : k + WORDS]) for k in np.flatnonzero(_has(every.value, h)).tolist()}
                        found.extend(own)
                        at.extend([i] * len(own))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.binary()).cast(pa.string())], ["id", "shingle"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, shingle string")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_id, n_shared, n_shingles, containment) where a document holds 80 % of an item's shingles.

    Shingles are five words, A-Z lower-cased, split at ASCII white space, counted once each. An item of
    fewer than five words has none and is never found; null and empty texts contain nothing; ids should be
    unique: rows of one id count as one document; rows of a null id are left out; empty tables give no rows.
    """
    shingles = written(item_shingles(items))
    hits = written(document_hits(docs.where(quoted(id_col).isNotNull()), shingles, id_col, text_col).distinct())
    # Sketch shingles first: only a document and an item that met in one are candidates, and only their shingles are counted.
    met = written(hits.join(shingles.where("in_sketch").select("shingle", "item_id"), "shingle").select("id", "item_id").distinct())
    held = hits.groupBy("id").agg(F.count("*").alias("n_hits"))
    sizes = shingles.groupBy("item_id").agg(F.first("n").alias("n"))
    # A document with fewer hits than four fifths of an item's shingles can't contain it.
    asked = written(met.join(held, "id").join(sizes, "item_id").where(F.col("n_hits") * F.lit(OF) >= F.col("n") * F.lit(SHARE)).select("id", "item_id", "n"))
    counted = asked.join(shingles.select("item_id", "shingle"), "item_id").join(hits, ["id", "shingle"]).groupBy("id", "item_id", "n").agg(F.count("*").alias("n_shared"))
    enough = counted.where(F.col("n_shared") * F.lit(OF) >= F.col("n") * F.lit(SHARE))
    return enough.select(F.col("id").alias(id_col), "item_id", "n_shared", F.col("n").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all columns, whatever their names; rows with a null id stay."""
    return without(docs, [quoted(id_col)], written(contained_items(docs, items, id_col, text_col).select(quoted(id_col)).distinct()))
