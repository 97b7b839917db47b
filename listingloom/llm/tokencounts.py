"""Edit-aware token counts over a byte-level BPE vocabulary.

A document's pre-tokens stand in leaves under a segment tree of (characters, tokens) sums. An edit
finds its leaf by the sums, goes back to a boundary that the edit can't move, splits and counts again
only until a new boundary meets an old one, and updates the sums above the leaves it touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.bpe import Cache, merge

#: The pre-token pattern of the vocabulary (fixed by it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a leaf when a tree is built; a leaf that grows to GROWN times that has its tree rebuilt.
LEAF, GROWN = 64, 8
#: A match may depend on so many characters after its start, or on one after the character that ends it.
REACH = 2


class Vocabulary:
    """Ranks of a vocabulary file: base64 bytes and rank on each line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN)
        self.counts = Cache(self._count)

    def _count(self, piece: str) -> int:
        raw = piece.encode()
        return 1 if raw in self.rank else len(merge([raw[i : i + 1] for i in range(len(raw))], self.rank.get))


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The vocabulary of a file, once per worker."""
    return Vocabulary(path)


class TokenTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.counted = 0
        self._build(text)

    def _build(self, text: str) -> None:
        tokens = self.vocabulary.split.findall(text)
        counts = list(map(self.vocabulary.counts.__getitem__, tokens))
        self.counted += len(tokens)
        self.leaves = [(tokens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(tokens), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + len(self.leaves)] = [sum(map(len, t)) for t, _ in self.leaves]
        self.tokens[self.width : self.width + len(self.leaves)] = [sum(c) for _, c in self.leaves]
        w = self.width
        while w > 1:
            for sums in (self.chars, self.tokens):
                sums[w // 2 : w] = sums[w : 2 * w].reshape(-1, 2).sum(axis=1)
            w //= 2

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_pretokens(self) -> int:
        return sum(len(t) for t, _ in self.leaves)

    def text(self) -> str:
        return "".join("".join(t) for t, _ in self.leaves)

    def _find(self, pos: int) -> tuple[int, int]:
        """(leaf, character where it begins) of the character at ``pos``; the last leaf for the end."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if pos >= begin + self.chars[node] and self.chars[node + 1]:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin

    def _put(self, leaf: int, tokens: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (tokens, counts)
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(map(len, tokens)), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, pos: int, deleted: int, inserted: str) -> int:
        """Replaces ``deleted`` characters at ``pos``, both clipped to the text; returns the pre-tokens counted again."""
        pos = max(0, min(pos, self.n_chars))
        deleted = max(0, min(deleted, self.n_chars - pos))
        first, begin = self._find(pos)
        last, _ = self._find(pos + deleted)
        # Back to a boundary before which no pre-token can see the edit.
        while True:
            tokens = self.leaves[first][0]
            starts = list(accumulate(map(len, tokens), initial=begin))
            keep = 0
            while keep < len(tokens) and starts[keep] + REACH < pos and starts[keep + 1] + 1 < pos:
                keep += 1
            if keep or first == 0:
                break
            first -= 1
            begin -= int(self.chars[self.width + first])
        restart = starts[keep]
        while True:
            old = [t for leaf in range(first, last + 1) for t in self.leaves[leaf][0]]
            bounds = list(accumulate(map(len, old), initial=begin))
            window = "".join(old)
            new = window[restart - begin : pos - begin] + inserted + window[pos + deleted - begin :]
            shift = len(inserted) - deleted
            old_at = {b + shift: i for i, b in enumerate(bounds) if b >= pos + deleted}
            whole = last == len(self.leaves) - 1
            found, meet = [], None
            for m in self.vocabulary.split.finditer(new):
                if not whole and m.end() + REACH + 1 > len(new):
                    break
                found.append(m[0])
                if (meet := old_at.get(restart + m.end())) is not None:
                    break
            if meet is not None or whole:
                break
            last += 1
        counts = list(map(self.vocabulary.counts.__getitem__, found))
        self.counted += len(found)
        old_counts = [c for leaf in range(first, last + 1) for c in self.leaves[leaf][1]]
        tail = meet if meet is not None else len(old)
        tokens = old[:keep] + found + old[tail:]
        counts = old_counts[:keep] + counts + old_counts[tail:]
        if len(tokens) > GROWN * LEAF:
            for leaf in range(first, last + 1):
                self._put(leaf, [], [])
            self.leaves[first] = (tokens, counts)
            self._regroup()
        else:
            self._put(first, tokens, counts)
            for leaf in range(first + 1, last + 1):
                self._put(leaf, [], [])
        return len(found)

    def _regroup(self) -> None:
        """Leaves of LEAF pre-tokens again; nothing is split or counted."""
        tokens = [t for leaf in self.leaves for t in leaf[0]]
        counts = [c for leaf in self.leaves for c in leaf[1]]
        self.leaves = [(tokens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(tokens), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        for i, (t, c) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, t)), sum(c)
        for node in range(self.width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]


def count_under_edits(text: Column, edits: Column, path: str) -> Column:
    """struct<n_pretokens, n_tokens, recounted, edited_chars, edited_tokens>.

    edits: array<struct<pos, deleted, inserted>> in order, in code points of the text as it then is.
    A null text is empty; null or empty arrays change nothing; an edit with a null pos is skipped, null
    deleted and inserted mean none; positions beyond the text are clipped. It is a column function: repeated
    rows are counted each, an empty table gives no rows, and other columns stay as they are.
    """
    fields = ["n_pretokens", "n_tokens", "recounted", "edited_chars", "edited_tokens"]

    @F.pandas_udf(", ".join(f"{f} bigint" for f in fields))
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        vocabulary = load(path)
        for texts, lists in batches:
            out = []
            for text, changes in zip(texts, lists):
                tree = TokenTree(text or "", vocabulary)
                row = [tree.n_pretokens, tree.n_tokens]
                again = 0
                for e in changes if changes is not None else ():
                    if e["pos"] is not None:
                        again += tree.edit(int(e["pos"]), int(e["deleted"] or 0), e["inserted"] or "")
                out.append([*row, again, tree.n_chars, tree.n_tokens])
            yield pd.DataFrame(np.array(out, np.int64).reshape(-1, len(fields)), columns=fields)

    return count(text, edits)


def gathered_edits(edits: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, pos, deleted, inserted) -> (doc_id, edits) in order of seq; a document's edits are one value.

    Rows of a null doc_id are one document; repeated rows are repeated edits; an empty table gives no rows; other
    columns are not read.
    """
    return edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "deleted", "inserted"))).alias("e")).select(
        "doc_id", F.transform("e", lambda x: F.struct(x["pos"].alias("pos"), x["deleted"].alias("deleted"), x["inserted"].alias("inserted"))).alias("edits")
    )
