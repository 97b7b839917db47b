"""Near copies by SimHash at a similarity of 0.8 in five-word shingles, every link verified exactly.

A radius that finds pairs of similarity 0.8 (19 of 128 bits on average) leaves no block of bits that is
both shared by every such pair and rare, so the buckets come from the shingles and SimHash compares within them:

1. A text's distinct shingles give ``BANDS`` keys of ``ROWS`` MinHash values each. Two texts of similarity s
   share a key with probability 1 - (1 - s**ROWS)**BANDS: 0.9999 at 0.8, more above. Of buckets with the same
   texts one is kept, so a pair that shares many keys meets once.
2. A bucket is cut into cells of bounded size. In a cell, 128-bit SimHash fingerprints are compared bit-sliced
   (``simhash.cell_pairs``); pairs within ``RADIUS`` bits that aren't in one component yet are verified, nearest
   first: a pair is a link if the exact Jaccard of its shingle sets is at least the threshold.
3. Where a bucket of several cells still holds several components, the texts outside its largest one meet every
   other text of the bucket, cell by cell. So no link between components is missed, and copies aren't expanded to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import BROADCAST_ROWS, forget, quoted, text_or_empty, without, written
from listingloom.llm.components import connected_components
from listingloom.llm.simhash import cell_pairs

WORDS, BANDS, ROWS = 5, 24, 5
#: Least similarity as a fraction.
SHARE, OF = 4, 5
#: Bits of 128 that a pair may differ in. A pair of similarity s differs in about 128 * acos(2 s / (1 + s)) / pi:
#: 19 (standard deviation 4) at 0.8, so 38 leaves out fewer than one pair in 100,000. Sets of four or five
#: shingles differ by 24 bits on average; of their pairs one in a thousand or so is left out.
RADIUS = 38
#: Texts and shingles of a cell; expected values, as texts are dealt to cells by hash.
CELL, CELL_SHINGLES = 192, 1 << 19
#: Rows and shingles gathered before a bit-sliced pass over whole cells.
PASS_ROWS, PASS_SHINGLES = 1 << 12, 1 << 20
#: Shingles hashed in one pass.
STEP = 1 << 12
_RNG = np.random.default_rng(31)
_MULTIPLY, _ADD = _RNG.integers(0, 1 << 31, (2, BANDS * ROWS, 1)).astype(np.uint32)
_MULTIPLY = _MULTIPLY * np.uint32(2) + np.uint32(1)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word runs; A-Z lower-cased, ASCII white space splits; a shorter text is one run."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    if len(parts) <= words:
        return np.array([h(b" ".join(parts))], np.uint64)
    runs = zip(*(parts[k:] for k in range(words)))
    return np.unique(np.fromiter(map(h, map(b" ".join, runs)), np.uint64, len(parts) - words + 1))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard of two sorted sets is SHARE / OF or more; decided by the sizes alone where they differ too much."""
    if OF * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return OF * n >= SHARE * (len(both) - n)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """(BANDS,) int64 keys of a non-empty shingle set."""
    high, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(high), STEP):
        np.minimum(least, (high[i : i + STEP] * _MULTIPLY + _ADD).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """(2,) uint64: the bits set in over half of the shingles' 128-bit hashes, their own 64 bits and as many mixed from them."""
    mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(128, np.int64)
    for i in range(0, len(shingles), STEP):
        part = np.stack([x[i : i + STEP] for x in (shingles, mixed ^ (mixed >> np.uint64(29)))], axis=1)
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8").astype(np.uint64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (key, node, size): the keys of every text that has a word."""
    for b in batches:
        nodes, sizes, keys = [], [], []
        for node, text in zip(b.column(0).to_pylist(), b.column(1)):
            found = shingle_set(text.as_py())
            if len(found):
                nodes.append(node)
                sizes.append(len(found))
                keys.append(band_keys(found))
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        each = (np.repeat(np.array(x, np.int64), BANDS) for x in (nodes, sizes))
        yield pa.RecordBatch.from_arrays([pa.array(flat), *map(pa.array, each)], ["key", "node", "size"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, text) -> (node, id, x, y, shingles): the fingerprint's words and the set as bytes."""
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(2)]
        prints = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "id", "x", "y", "shingles"]
        )


def _links(cell: np.ndarray, role: np.ndarray, group: np.ndarray, node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Verified links of rows sorted by cell: enough to join all alike texts of different roles (or of role 0) and groups in a cell."""
    found = [(i, j) for i, j in cell_pairs(cell, fp, RADIUS)]
    if not found:
        return [], []
    i, j = (np.concatenate(x) for x in zip(*found))
    use = ((role[i] != role[j]) | (role[i] == 0)) & (group[i] != group[j])
    i, j = i[use], j[use]
    near = np.argsort(np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1), kind="stable")
    parent: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    cells, groups, u, v = cell.tolist(), group.tolist(), [], []
    for a, b in zip(i[near].tolist(), j[near].tolist()):
        x, y = root((cells[a], groups[a])), root((cells[b], groups[b]))
        if x != y and alike(sets[a], sets[b]):
            parent[x] = y
            u.append(int(node[a]))
            v.append(int(node[b]))
    return u, v


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, role, group, node, x, y, shingles) sorted by cell (key, a, b) -> links (u, v)."""

    def done(rows: list, sets: list) -> pa.RecordBatch:
        flat = np.concatenate(rows)
        cell = np.cumsum(np.r_[0, (flat[1:, :3] != flat[:-1, :3]).any(axis=1)])
        u, v = _links(cell, flat[:, 3], flat[:, 4], flat[:, 5], flat[:, 6:8].copy().view(np.uint64), sets)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    rows: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    held = shingles = 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:8]], axis=1)
        starts = np.flatnonzero(np.r_[last is None or (flat[0, :3] != last).any(), (flat[1:, :3] != flat[:-1, :3]).any(axis=1)])
        bounds = [0, *(s for s in starts.tolist() if s), len(flat)]
        for a, b in zip(bounds, bounds[1:]):
            fresh = rows and (a > 0 or (flat[0, :3] != last).any())
            if fresh and (held >= PASS_ROWS or shingles >= PASS_SHINGLES):
                yield done(rows, sets)
                rows, sets, held, shingles = [], [], 0, 0
            rows.append(flat[a:b])
            sets += [np.frombuffer(s.as_py(), np.uint64) for s in batch.column(8).slice(a, b - a)]
            held, shingles = held + b - a, shingles + sum(map(len, sets[held:]))
        last = flat[-1, :3]
    if rows:
        yield done(rows, sets)


def _cells(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """placed (key, a, b, role, group, node) -> verified links (u, v), written."""
    rows = placed.join(sets.select("node", "x", "y", "shingles"), "node").select("key", "a", "b", "role", "group", "node", "x", "y", "shingles")
    return written(rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_verify, "u bigint, v bigint"))


def node_of(id_: Column, text: Column) -> Column:
    """A row's name here: its id and text as one hash, so that ids may be null or repeated."""
    return F.xxhash64(id_, text_or_empty(text))


def _once(rows: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """rows, but of those of ``nodes`` one for each ``key``; the others are not shuffled."""
    same = rows.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, "node", "left_semi").dropDuplicates(key)
    return without(rows, [F.col("node")], nodes).unionByName(same)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, id, component), written: the rows linked with another, and the name of their component."""
    narrow = docs.select(node_of(quoted(id_col), quoted(text_col)).alias("node"), quoted(id_col).alias("id"), quoted(text_col).alias("text")).where("text is not null")
    keys = written(narrow.select("node", "text").mapInArrow(_keys, "key bigint, node bigint, size bigint"))
    again = written(keys.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > BANDS).select("node"))
    if not again.isEmpty():  # equal rows are one text: else a bucket would count them twice and look like another
        keys = written(_once(keys, again, ["key", "node"]))
        narrow = _once(narrow, again, ["node"])
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    chosen = buckets.groupBy("n", "members").agg(F.min(F.struct("key", "total")).alias("k")).select("k.key", F.ceil(F.greatest(F.col("n") / CELL, F.col("k.total") / CELL_SHINGLES)).cast("int").alias("cells"))
    kept = written(keys.join(written(chosen), "key").select("key", "node", "cells"))
    nodes = written(kept.select("node").distinct())
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    kind = docs.schema[id_col].dataType.simpleString()
    sets = written(narrow.join(nodes, "node", "left_semi").mapInArrow(_sets, f"node bigint, id {kind}, x bigint, y bigint, shingles binary"))
    forget(keys)

    own = F.pmod(F.xxhash64("node", "key"), F.col("cells")).cast("int")
    first = _cells(kept.select("key", own.alias("a"), F.lit(0).alias("b"), F.lit(0).alias("role"), F.col("node").alias("group"), "node"), sets)
    named = connected_components(first)

    wide = written(kept.where("cells > 1").join(named, "node", "left").select("key", "node", "cells", own.alias("own"), F.coalesce("component", "node").alias("group")))
    held = wide.groupBy("key", "group").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("groups"), F.sum("m").alias("n"), F.max(F.struct("m", "group")).alias("most"))
    left = written(held.where("groups > 1").select("key", F.col("most.group").alias("most"), F.ceil((F.col("n") - F.col("most.m")) / CELL).cast("int").alias("others")))
    rest = wide.join(left, "key")
    members = rest.select("key", F.col("own").alias("a"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("b"), F.lit(1).alias("role"), "group", "node")
    askers = rest.where("group <> most").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("a"), F.pmod(F.xxhash64("key", "node"), F.col("others")).cast("int").alias("b"), F.lit(2).alias("role"), "group", "node"
    )
    second = _cells(members.unionByName(askers), sets)

    linked = connected_components(first.unionByName(second)).select("node", "component")
    return written(sets.select("node", "id").join(linked, "node"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) of the rows linked with another, directly or through verified links.

    component_id is the least id of the component, null only if it has no other. Texts are compared as sets of
    five-word runs, A-Z lower-cased; null and empty texts and texts of white space have none and link with
    nothing. Equal rows are one text, other rows of a repeated id are texts of their own. Other columns are not
    read; an empty table gives no rows.
    """
    told = near_components(docs, id_col, text_col)
    least = written(told.groupBy("component").agg(F.min("id").alias("component_id")))
    return told.join(least, "component").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, but of each group of ``near_groups`` only the one with the least id.

    Of several texts of that id the one with the least hash stays; equal rows stay or go together. Rows without a
    link stay, null and empty texts among them. Columns may have any names; an empty table stays empty.
    """
    told = near_components(docs, id_col, text_col)
    first = told.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"))
    gone = told.join(written(first), "component").where("node <> first.node").select("node")
    return without(docs, [node_of(quoted(id_col), quoted(text_col))], written(gone.distinct()))
