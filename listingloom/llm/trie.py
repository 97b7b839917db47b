"""Conversation prefix trie: a node for each distinct sequence of first turns, with its members and savings.

Conversations become paths of 16-byte turn keys, sorted and cut by range into shards. A shard writes its trie as
balanced parentheses: ``find_close`` over a range min-max tree of excess blocks delimits subtrees, ranks count
nodes and leaf pairs, cumulative arrays give the sums over a subtree. Only nodes on the first or last path of a
shard (its spines) can have members in another one; their parts meet in one small trie of spines at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import BROADCAST_ROWS, quoted, written

#: Bytes of a turn's key, and of a node's.
KEY = 16
#: Parentheses of an excess block.
BLOCK = 64
#: Nodes and conversations of a shard, about; tasks with more cut their range.
SHARD = 1 << 17
_FAR = np.iinfo(np.int64).max
_NONE = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with the least excess of each block and a binary tree above the blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        blocks = -(-len(bits) // BLOCK)
        self._excess = np.full(blocks * BLOCK, len(bits) + 1, np.int32)
        self._excess[: len(bits)] = excess
        self._levels = [self._excess.reshape(blocks, BLOCK).min(axis=1)]
        while len(self._levels[-1]) > 1:
            below = self._levels[-1]
            if len(below) % 2:
                below = self._levels[-1] = np.append(below, np.int32(len(bits) + 1))
            self._levels.append(below.reshape(-1, 2).min(axis=1))
        self._rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self._leaves = np.concatenate([[0], np.cumsum((bits[:-1] == 1) & (bits[1:] == 0), dtype=np.int64), [0]])
        self._leaves[-1] = self._leaves[-2]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opening parentheses before ``at``."""
        return self._rank[at]

    def leaf_rank(self, at: np.ndarray) -> np.ndarray:
        """Leaf pairs that begin before ``at``."""
        return self._leaves[at]

    def _in_block(self, block: np.ndarray, want: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The first position of each block behind ``after`` with excess ``want`` or less, -1 where there is none."""
        out = np.full(len(block), -1, np.int64)
        for k in range(0, len(block), 1 << 14):
            cut = slice(k, k + (1 << 14))
            at = block[cut, None] * BLOCK + np.arange(BLOCK)
            hit = (self._excess[at] <= want[cut, None]) & (at > after[cut, None])
            out[cut] = np.where(hit.any(axis=1), block[cut] * BLOCK + hit.argmax(axis=1), -1)
        return out

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        at = np.asarray(at, np.int64)
        want = self._excess[at] - 1
        found = self._in_block(at // BLOCK, want, at)
        left = np.flatnonzero(found < 0)
        if not len(left):
            return found
        node, goal, level_of = at[left] // BLOCK + 1, want[left], np.full(len(left), -1)
        for level, least in enumerate(self._levels):  # up; a left child is looked at with its parent
            open_ = level_of < 0
            hit = open_ & (node % 2 == 1) & (least[np.minimum(node, len(least) - 1)] <= goal)
            level_of[hit] = level
            rise = open_ & ~hit
            node[rise] = (node[rise] + 1) // 2
        for level in range(len(self._levels) - 1, 0, -1):  # down to the first block that is low enough
            here = level_of == level
            below = self._levels[level - 1]
            first = 2 * node[here]
            node[here] = np.where(below[first] <= goal[here], first, first + 1)
            level_of[here] = level - 1
        found[left] = self._in_block(node, goal, at[left])
        return found


class Trie:
    """The trie of sorted paths; node 0 is the root, nodes are in preorder."""

    def __init__(self, paths: list[bytes], chars: list):
        self.paths = paths
        size = np.array([len(p) // KEY for p in paths], np.int64)
        common = np.zeros(len(paths), np.int64)
        parents, stack, ends = [], [0], []
        n = 1
        for i, path in enumerate(paths):
            if i:
                common[i] = shared_turns(paths[i - 1], path)
            del stack[common[i] + 1 :]
            for _ in range(int(size[i] - common[i])):
                parents.append(stack[-1])
                stack.append(n)
                n += 1
            ends.append(stack[-1])
        opened = size - common
        closed = np.concatenate([[0], size[:-1] - common[1:]]).astype(np.int64)
        runs = np.concatenate([[1], np.stack([closed, opened], axis=1).ravel(), [size[-1] + 1]])
        marks = np.concatenate([[1], np.tile([0, 1], len(paths)), [0]])
        self.pairs = Parentheses(np.repeat(marks, runs).astype(np.uint8))
        self.parent = np.array([-1, *parents], np.int64)
        row = np.repeat(np.arange(len(paths)), opened)
        self.depth = np.concatenate([[0], np.concatenate([np.arange(c + 1, s + 1) for c, s in zip(common, size)]) if n > 1 else []]).astype(np.int64)
        self.chars = np.array([0, *(chars[r][d - 1] for r, d in zip(row, self.depth[1:]))], np.int64)
        self.opens = np.flatnonzero(self.pairs.bits)
        self.closes = self.pairs.find_close(self.opens)
        self.ends = self.pairs.rank(self.closes)
        self.leaf = self.closes == self.opens + 1
        self.end_node = np.array(ends, np.int64)

    def line(self, node: int) -> list[int]:
        """The nodes from the root to ``node``."""
        out = [int(node)]
        while out[-1]:
            out.append(int(self.parent[out[-1]]))
        return out[::-1]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over each node's subtree, its top included."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.ends] - total[: len(values)]

    def leaves(self) -> np.ndarray:
        """Leaf pairs between each node's parentheses, a leaf's own included."""
        return self.pairs.leaf_rank(self.closes) - self.pairs.leaf_rank(self.opens)

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least of ``values`` in each node's subtree."""
        levels, width = [values], 1
        while 2 * width <= len(values):
            below = levels[-1]
            levels.append(np.minimum(below[: len(below) - width], below[width:]))
            width *= 2
        begin, n = np.arange(len(values)), self.ends - np.arange(len(values))
        out = np.empty(len(values), np.int64)
        power = np.frexp(n)[1] - 1
        for k, level in enumerate(levels):
            at = power == k
            out[at] = np.minimum(level[begin[at]], level[self.ends[at] - (1 << k)])
        return out

    def children(self) -> np.ndarray:
        return np.bincount(self.parent[1:], minlength=len(self.parent)).astype(np.int64)


def shared_turns(a: bytes, b: bytes) -> int:
    """Leading turn keys that two paths share."""
    k, n = 0, min(len(a), len(b))
    while k < n and a[k : k + KEY] == b[k : k + KEY]:
        k += KEY
    return k // KEY


def node_keys(path: bytes) -> list[bytes]:
    """The keys of the nodes of a path: a chain of digests, so that a node's key stands for the whole prefix."""
    out = [bytes(KEY)]
    for k in range(0, len(path), KEY):
        out.append(hashlib.blake2b(out[-1] + path[k : k + KEY], digest_size=KEY).digest())
    return out


NODE = (
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
)
NODE_SQL = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_LONGS = pa.list_(pa.int64())
#: A spine: a shard's first or last path, with what its nodes have besides other spine nodes; ``ids`` of the
#: conversations that end at its last node in this shard.
SPINE = (("path", pa.binary()), ("chars", _LONGS), ("first", pa.int64()), ("ids", pa.string()), *((k, _LONGS) for k in ("members", "least", "kids", "leaves", "saved")), ("digests", pa.list_(pa.string())))
SPINE_SQL = "path binary, chars array<bigint>, first bigint, ids string, members array<bigint>, least array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>, digests array<string>"


def _batch(shape: tuple, columns: list) -> list[pa.Array]:
    return [pa.array(c, kind) for (_, kind), c in zip(shape, columns)]


def _shard(paths: list[bytes], chars: list, ids: list[int]) -> pa.RecordBatch:
    """The finished nodes of a shard, and its spines."""
    trie = Trie(paths, chars)
    n = len(trie.parent)
    first, last = (trie.line(trie.end_node[k]) for k in (0, -1))
    spine = np.zeros(n, bool)
    spine[first], spine[last] = True, True
    members = np.bincount(trie.end_node, minlength=n).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], trie.end_node[1:] != trie.end_node[:-1]]))
    least = np.full(n, _FAR)
    least[trie.end_node[begins]] = np.array(ids, np.int64)[begins]  # ids of one path are ascending
    runs = {int(trie.end_node[a]): ",".join(map(str, ids[a:b])) for a, b in zip(begins, [*begins[1:], len(ids)])}
    digests = [hashlib.sha256(runs[k].encode()).hexdigest() if k in runs else _NONE for k in range(n)]
    n_convs, smallest, kids = trie.sums(members), trie.least(least), trie.children()
    saved = trie.sums(np.where(spine, 0, (n_convs - 1) * trie.chars))
    leaves = trie.leaves() - trie.sums((spine & trie.leaf).astype(np.int64))
    done = np.flatnonzero(~spine)
    up = trie.parent[done]
    hangs = spine[up]
    keys = dict(zip(first, node_keys(paths[0]))) | dict(zip(last, node_keys(paths[-1])))
    nodes = [
        smallest[done], trie.depth[done], [None if h else int(smallest[u]) for h, u in zip(hangs, up)], n_convs[done], kids[done],
        leaves[done], saved[done], [digests[k] for k in done],
    ]
    rest = {"members": n_convs.copy(), "leaves": leaves.copy(), "saved": saved.copy(), "kids": kids.copy()}
    below = np.flatnonzero(spine)[1:]
    for name, part in (("members", n_convs), ("leaves", leaves), ("saved", saved), ("kids", np.ones(n, np.int64))):
        np.subtract.at(rest[name], trie.parent[below], part[below])
    lines = [(first, 0, 0), (last, len(paths) - 1, len(set(first) & set(last)))][: 1 if first == last else 2]
    spines = []
    for line, row, told in lines:
        # what both paths share is told by the first one
        mine = [(k if j >= told else None) for j, k in enumerate(line)]
        run = runs[line[-1]]
        spines.append((
            paths[row], [int(c) for c in trie.chars[line[1:]]], int(run.partition(",")[0]), run,
            [0 if k is None else int(rest["members"][k]) for k in mine], [None if k is None else int(smallest[k]) for k in mine],
            *([0 if k is None else int(rest[name][k]) for k in mine] for name in ("kids", "leaves", "saved")),
            [None if k is None or k == line[-1] or k not in runs else digests[k] for k in mine],
        ))
    a, b = len(done), len(spines)
    left = _batch(NODE, nodes) + [pa.array([keys[int(u)] if h else None for h, u in zip(hangs, up)], pa.binary())]
    right = _batch(SPINE, list(zip(*spines)))
    columns = [pa.concat_arrays([c, pa.nulls(b, c.type)]) for c in left] + [pa.concat_arrays([pa.nulls(a, c.type), c]) for c in right]
    return pa.RecordBatch.from_arrays(columns, [k for k, _ in NODE] + ["parent_node"] + [k for k, _ in SPINE])


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    paths, chars, ids, size = [], [], [], 0
    for batch in batches:
        for conv, path, counts in zip(*(c.to_pylist() for c in batch.columns)):
            paths.append(path)
            chars.append(counts)
            ids.append(conv)
            size += 1 + len(counts)
            if size >= most:
                yield _shard(paths, chars, ids)
                paths, chars, ids, size = [], [], [], 0
    if paths:
        yield _shard(paths, chars, ids)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all spines, from the spines sorted by path and first id."""
    rows, hashers = [], []
    for batch in batches:
        for path, chars, _, ids, *parts in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][0] == path:
                hashers.append(hashers[-1])
                hashers[-1].update(b"," + ids.encode())
            else:
                hashers.append(hashlib.sha256(ids.encode()))
            rows.append((path, chars, parts))
    if not rows:
        return
    trie = Trie([r[0] for r in rows], [r[1] for r in rows])
    n = len(trie.parent)
    values = {name: np.zeros(n, np.int64) for name in ("members", "kids", "leaves", "saved")}
    least, digests, keys = np.full(n, _FAR), [_NONE] * n, [bytes(KEY)] * n
    for (path, _, (members, smallest, kids, leaves, saved, told)), hasher, end in zip(rows, hashers, trie.end_node):
        line = trie.line(end)
        for name, part in (("members", members), ("kids", kids), ("leaves", leaves), ("saved", saved)):
            values[name][line] += part
        for k, x, digest in zip(line, smallest, told):
            least[k] = least[k] if x is None else min(least[k], x)
            digests[k] = digest or digests[k]
        for k, key in zip(line, node_keys(path)):
            keys[k] = key
        digests[end] = hasher.hexdigest()
    n_convs, smallest = trie.sums(values["members"]), trie.least(least)
    childless = trie.leaf & (values["kids"] == 0)
    columns = [
        smallest, trie.depth, [None, *smallest[trie.parent[1:]].tolist()], n_convs, values["kids"] + trie.children(),
        trie.sums(values["leaves"] + childless), trie.sums(values["saved"] + (n_convs - 1) * trie.chars), digests,
    ]
    yield pa.RecordBatch.from_arrays([*_batch(NODE, columns), pa.array(keys, pa.binary())], [*(k for k, _ in NODE), "node"])


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, keys array<string>, chars array<bigint>) of turns (conv_id, turn, role, text), a row a conversation.

    Turns are in order of turn (null first), those of one turn in order of role and then of their text's hash; repeated
    rows stay. A null role or text is empty. A key is 128 bits of the SHA-256 of role and text, as hex digits; texts
    are hashed where they are read and never shuffled. Rows of a null conv_id belong to no conversation and are
    left out. Other columns are not read; an empty table gives no rows.
    """
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    each = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("bigint").alias("chars")).alias("t")
    )
    rows = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.key").alias("keys"), F.col("t.chars").alias("chars"))


def graft(paths: DataFrame, most: int = 6, block: int = 100) -> DataFrame:
    """Conversations that begin like the one at the head of their block: the first h turns of conversation
    ``c - c % block`` (all if fewer, none if it is absent), then c's own turns after its first h, h = crc32(c) % most.
    """
    paths = written(paths)
    heads = paths.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head"), *(F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("keys", "chars")))
    both = paths.join(heads, F.col("head") == F.col("conv_id") - F.col("conv_id") % block, "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")

    def joined(c: str) -> Column:
        head = F.coalesce(F.slice(f"head_{c}", F.lit(1), h), F.slice(c, F.lit(1), F.lit(0)))
        return F.concat(head, F.slice(c, h + 1, F.size(c))).alias(c)

    return both.select("conv_id", joined("keys"), joined("chars"))


def prefix_trie(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie's nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``paths`` are rows (conv_id, keys, chars) as ``conversation_paths`` gives them, one a conversation, turnless ones
    with empty arrays. A node stands for a distinct sequence of first turns; its members begin with it, conv_id is the
    smallest and parent_conv_id its parent's (null for the root). saved_tokens sums (n_convs - 1) * chars of
    the last turn over the node's subtree, n_leaves counts its childless nodes, ends_sha256 is the digest of the
    ascending ids of the members that end there, joined by commas. An empty table has no nodes.

    A task holds one shard (``shard`` nodes and conversations, at least one conversation) at a time. Equal paths may lie in
    many shards: the ids at a node are then hashed from each shard's part, streaming. The last step is one task over two
    spines a shard, some 10^5 rows for 10^10 turns.
    """
    flat = written(paths.select("conv_id", F.unhex(F.array_join("keys", "")).alias("path"), "chars"))
    sorted_ = flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "path", "chars")
    parts = written(sorted_.mapInArrow(lambda batches: _shards(batches, shard), f"{NODE_SQL}, parent_node binary, {SPINE_SQL}"))
    spines = parts.where("path is not null").select(*(k for k, _ in SPINE))
    tops = written(spines.repartition(1).sortWithinPartitions("path", "first").mapInArrow(_merged, f"{NODE_SQL}, node binary"))
    names = [k for k, _ in NODE]
    parents = tops.select("node", F.col("conv_id").alias("_up"))
    parents = F.broadcast(parents) if tops.count() <= BROADCAST_ROWS else parents
    nodes = parts.where("path is null").select(*names, "parent_node").join(parents, F.col("parent_node") == F.col("node"), "left")
    nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    return nodes.select(*names).unionByName(tops.select(*names))
