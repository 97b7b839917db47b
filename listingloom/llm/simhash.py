"""SimHash near-dedup with bit-sliced Hamming comparison.

1. Each text becomes a 64-bit fingerprint: the bits set in over half of its shingles' hashes.
2. Distinct fingerprints are banded: five blocks of bits, a key for every pair of blocks. Two
   fingerprints at most three bits apart agree on two whole blocks at least, so they share a key.
3. Rows of a key are compared bit-sliced. Buckets over ``CELL_ROWS`` are cut into groups, and each
   pair of groups is a cell of its own, so no task holds an unbounded bucket.
4. Cells emit a spanning forest of their links, never all pairs; components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import written
from listingloom.llm.components import connected_components

RADIUS = 3
#: Rows of a bucket that are compared in one piece.
CELL_ROWS = 2048
#: Rows gathered before a bit-sliced pass over whole cells; (query, block) items in one pass.
BATCH_ROWS, PASS_ITEMS = 1 << 14, 1 << 15
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
VOTE_ROWS = 1 << 14


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; A-Z lower-cased, ASCII white space splits."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, seed)], np.uint64)
    ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(parts) - words + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``; 0 for none."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), VOTE_ROWS):
        part = hashes[i : i + VOTE_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp bigint) for every row; a null text counts as empty and has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [majority_bits(shingle_hashes(t.as_py() or "", words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def band_keys(fp: Column, widths: tuple[int, ...], match: int) -> Column:
    """array<bigint>: for each choice of ``match`` blocks, their bits under the choice's number."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    block = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, widths)]
    keys = []
    for n, chosen in enumerate(combinations(range(len(widths)), match)):
        key = F.lit(n).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(block[i])
        keys.append(key)
    return F.array(*keys)


def bit_planes(lanes: np.ndarray) -> np.ndarray:
    """lanes (blocks, 64) uint64 -> planes (64, blocks): bit b of the 64 lanes of a block in one word."""
    out = np.empty((64, len(lanes)), np.uint64)
    for b in range(64):
        bits = ((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def lanes_within(query: np.ndarray, planes: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For items (query fingerprint, block number): lane masks within ``radius``, and the items they are of.

    query: (items, words); planes: (64 * words, blocks). Planes are added one by one to carry-save counters,
    one bit of every lane's count to a word. They start so far below their end that the carry out of the last
    one comes exactly when a count passes the radius; ``over`` keeps those lanes. Every eight planes, items
    whose wanted lanes are all over are abandoned. ``lanes``: the lanes of the block that count for the item.
    """
    at = np.arange(len(query))
    width = max(1, radius.bit_length())
    preset = (1 << width) - 1 - radius
    counts = [np.full(len(query), ALL if preset >> k & 1 else 0, np.uint64) for k in range(width)]
    over = ~lanes
    for b in range(len(planes)):
        carry = planes[b][block] ^ (np.uint64(0) - ((query[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
        for c in counts:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if b % 8 == 7:
            live = over != ALL
            if not live.all():
                at, query, block, over = (x[live] for x in (at, query, block, over))
                counts = [c[live] for c in counts]
            if not len(at):
                break
    return ~over, at


def _join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Least label of each component of links u-v, in place."""
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            return
        label[:] = new


def cell_pairs(cell: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by cell, fp (rows, words) uint64 -> row numbers (i, j) of all pairs of a cell within ``radius``, some at a time."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, n])
    blocks = -(-size // 64)
    begin = np.cumsum(blocks) - blocks
    which = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[which]
    row_block, row_lane = begin[which] + place // 64, place % 64
    lanes, row_of = np.zeros((fp.shape[1], blocks.sum(), 64), np.uint64), np.zeros((blocks.sum(), 64), np.int64)
    lanes[:, row_block, row_lane] = fp.T
    row_of[row_block, row_lane] = np.arange(n)
    filled = np.zeros(blocks.sum(), np.uint64)
    np.bitwise_or.at(filled, row_block, np.uint64(1) << row_lane.astype(np.uint64))
    planes = np.concatenate([bit_planes(x) for x in lanes])
    items = begin[which] + blocks[which] - row_block  # each row meets its own block and the later ones of its cell
    ends = np.cumsum(items)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PASS_ITEMS)))
        row = np.repeat(np.arange(a, b), items[a:b])
        step = np.arange(len(row)) - np.repeat(np.cumsum(items[a:b]) - items[a:b], items[a:b])
        block = row_block[row] + step
        wanted = filled[block].copy()
        own = step == 0
        wanted[own] &= ~((np.uint64(2) << row_lane[row[own]].astype(np.uint64)) - np.uint64(1))
        some = wanted != 0
        row, block, wanted = row[some], block[some], wanted[some]
        masks, at = lanes_within(fp[row], planes, block, wanted, radius)
        if len(at):
            hit = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            item, lane = np.nonzero(hit)
            yield row[at[item]], row_of[block[at[item]], lane]
        a = b


def forest(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by cell, fp (rows, words) uint64. Edges (u, v) of nodes: a forest whose trees are the cells' components within ``radius``."""
    label = np.arange(len(fp))
    for i, j in cell_pairs(cell, fp, radius):
        _join_labels(label, i, j)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return node[linked], node[label[linked]]


def _forests(radius: int):
    """A mapInArrow function over rows (key, a, b, node, fp words...) sorted by cell (key, a, b); cells are whole within it."""

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        cell = np.cumsum(np.r_[0, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        u, v = forest(cell, rows[:, 4:].view(np.uint64), rows[:, 3], radius)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= BATCH_ROWS:
                rows = np.concatenate(held)
                changes = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
                cut = int(changes[-1]) + 1 if len(changes) else 0
                held = [rows[cut:]]
                if cut:
                    yield edges(rows[:cut])
        if held:
            yield edges(np.concatenate(held))

    return run


def bucket_links(banded: DataFrame, words: list[str], radius: int) -> DataFrame:
    """(key, node, fp words) -> edges (u, v) of nodes: a forest per bucket that joins all fingerprints within ``radius``."""
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    groups = F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("int")
    placed = (
        banded.join(written(shared), "key")
        .withColumn("g", groups)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    )
    cells = placed.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", *words)
    dealt = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(_forests(radius), "u bigint, v bigint")


def fingerprint_links(fps: DataFrame, widths: tuple[int, ...] = (13, 13, 13, 13, 12), match: int = 2) -> DataFrame:
    """Distinct fp -> edges (u, v): a forest per bucket that joins all fingerprints within RADIUS."""
    banded = written(fps.select(F.explode(band_keys(F.col("fp"), widths, match)).alias("key"), F.col("fp").alias("node"), "fp"))
    return bucket_links(banded, ["fp"], RADIUS)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp bigint, component_id): documents whose fingerprints link, directly or through others.

    ``component_id`` is the least id of the component, the row's own included. Null and empty texts
    (and texts of white space) have fingerprint 0 and link like any other; repeated ids stay repeated
    rows; null ids keep their row and take part, but never name a component unless it has no other id;
    an empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words))
    each = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    linked = connected_components(fingerprint_links(each))
    named = written(each.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = written(named.join(least, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select(id_col, "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
