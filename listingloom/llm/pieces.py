"""SentencePiece encoding and decoding that keeps source offsets.

``PieceModel`` reads a BPE model file. Encoding normalises with the model's compiled character map
(longest matching prefix) and records which source byte each normalised character came from; merges
run on fragments that no piece can cross, cached per worker; every piece is then projected back to a
byte span of the source text. Decoding undoes pieces, byte pieces and the dummy prefix.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from listingloom.llm.bpe import CACHE, SHORT, Cache, PairTable, merge
from listingloom.llm.common import quoted, whole_row

MARK = "▁"
#: Tokens of one output batch.
BATCH_TOKENS = 1 << 18
#: Rows of an Arrow batch that are Python objects at once.
SLICE = 256
#: Characters of texts whose fragments are resolved together, and fragments merged together.
CHARS_AT_ONCE, MERGED_AT_ONCE = 1 << 21, 1 << 12
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            c = buf[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while i < len(buf):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, buf[i : i + n]
            i += n


class CharMap:
    """The compiled map: a double-array trie over UTF-8 bytes and a pool of replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest entry that is a prefix of text[at:]."""
        found, node = None, self._offset(self.units[0])
        for n in range(at, len(text)):
            node ^= text[n]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[n]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                found = (n + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1] : end]


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        trainer = dict(next(_fields_of(fields, 2), []))
        norm = dict(next(_fields_of(fields, 3), []))
        pieces = [dict(x) for x in _fields_of(fields, 1)]
        self.pieces = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or UNUSED in kinds or USER in kinds or trainer.get(24, 0):
            raise ValueError(f"{path}: only BPE models without unused or user-defined pieces and with space marks in front")
        self.charmap = CharMap(norm[2]) if norm.get(2) else None
        self.dummy, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        if not self.escape:
            raise ValueError(f"{path}: only models that escape white space")
        score = np.frombuffer(b"".join(p.get(2, b"\0\0\0\0") for p in pieces), "<f4").tolist()
        normal = [i for i, k in enumerate(kinds) if k == NORMAL]
        self.id = {self.pieces[i]: i for i in normal}
        self.rank = {self.pieces[i]: -score[i] for i in normal}
        self.unk = kinds.index(UNKNOWN)
        byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.byte = [byte[b] for b in range(256)] if trainer.get(35, 0) and len(byte) == 256 else None
        self.joins = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        #: Whether a fragment may always be cut before a mark that follows another character.
        self.cuts = not any(j[1] == MARK and j[0] != MARK for j in self.joins)
        surface = trainer.get(44, " ⁇ ".encode())
        plain = [p.replace(MARK, " ").encode() for p in self.pieces]
        self.out = [bytes([int(self.pieces[i][3:5], 16)]) if k == BYTE else b"" if k == CONTROL else surface if k == UNKNOWN else plain[i] for i, k in enumerate(kinds)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.is_control = np.array([k == CONTROL for k in kinds])
        self.source_len = np.array([1 if k == BYTE else len(plain[i]) for i, k in enumerate(kinds)], np.int32)
        #: Cached ids are packed; bytes are smaller than tuples and join fast.
        self.packed = "H" if len(pieces) <= 1 << 16 else "I"
        self.fragments = Cache(self._merge)
        #: Ids of words with the mark in front, in two generations: a full one replaces the older.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs = PairTable(self.rank)
        self.id_of_symbol = np.array([self.id.get(x, -1) for x in self.pairs.symbols], np.int64)

    # -- encoding

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and the source byte at which each of its characters begins, plus the end."""
        raw, at, out, source = text.encode(), 0, [], []

        def put(chars: str, begin: int) -> None:
            for c in chars:
                c = MARK if c == " " else c
                if self.squeeze and c == MARK and (not out or out[-1] == MARK):
                    continue
                out.append(c)
                source.append(begin)

        begin = 0
        first = True
        while at < len(raw):
            hit = self.charmap.longest(raw, at) if self.charmap else None
            if hit is None:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, raw[at : at + n]
            chars = hit[1].decode()
            if first and self.squeeze and chars.strip(" ") == "":
                at += hit[0]
                continue
            if first:
                begin = at
                if self.dummy:
                    out.append(MARK)
                    source.append(begin)
                first = False
            put(chars, at)
            at += hit[0]
        if self.squeeze:
            while out and out[-1] == MARK:
                out.pop()
                at = source.pop()
        return "".join(out), np.array([*source, at], np.int64)

    def _merge(self, fragment: str) -> bytes:
        """Packed ids of a fragment: the best-scored pair is merged first, the leftmost among equals."""
        pieces = merge(list(fragment), self.rank.get)
        try:
            return array(self.packed, map(self.id.__getitem__, pieces)).tobytes()
        except KeyError:  # a character that is no piece
            ids = (self.byte_ids(p) if p not in self.id else (self.id[p],) for p in pieces)
            return array(self.packed, chain.from_iterable(ids)).tobytes()

    def byte_ids(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character, or the unknown piece where the model has none."""
        return (self.unk,) if self.byte is None else tuple(self.byte[b] for b in char.encode())

    def _fragment_ids(self, fragment: str) -> bytes:
        """Packed ids of a fragment, cut further between characters that no piece has side by side."""
        if fragment[1:].isalpha():
            return self._merge(fragment)
        cuts = [i for i in range(1, len(fragment)) if fragment[i - 1 : i + 1] not in self.joins]
        if not cuts:
            return self.fragments[fragment]
        return b"".join(self.fragments[fragment[a:b]] for a, b in zip([0, *cuts], [*cuts, len(fragment)]))

    def _ids(self, norm: str) -> np.ndarray:
        """Ids of a normalised text; it is cut before marks where no piece can cross them."""
        parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", norm) if self.cuts else [norm]
        return np.frombuffer(b"".join(map(self._fragment_ids, parts)), self.packed).astype(np.int32)

    def learn(self, words: set[str]) -> None:
        """Puts the ids of all ``words``, each after a mark, into the cache; new ones of similar length are merged together."""
        missing = words.difference(self.words)
        if len(self.words) + len(missing) > CACHE and missing:
            self.older, self.words, missing = self.words, {}, words
        new = []
        for w in missing:
            ids = self.older.get(w)
            if ids is not None:
                self.words[w] = ids
            elif len(w) < SHORT:
                new.append(w)
            else:
                self.words[w] = self._fragment_ids(MARK + w)
        new.sort(key=len)
        for a in range(0, len(new), MERGED_AT_ONCE):
            part = new[a : a + MERGED_AT_ONCE]
            sizes = np.array([len(w) + 1 for w in part])
            filled = np.arange(sizes.max()) < sizes[:, None]
            symbols = np.full(filled.shape, -1, np.int32)
            symbols[filled] = self.pairs.split(np.frombuffer((MARK + MARK.join(part)).encode("utf-32-le"), "<u4"))
            odd = (filled & (symbols < 0)).any(axis=1)  # a character in no piece: byte pieces
            symbols[odd] = -1
            merged, count = self.pairs.merge(symbols)
            ids = self.id_of_symbol[np.maximum(merged, 0)]
            odd |= ((ids < 0) & (np.arange(ids.shape[1]) < count[:, None])).any(axis=1)
            wide = array(self.packed).itemsize
            raw, width = ids.astype(f"<u{wide}").tobytes(), ids.shape[1] * wide
            for w, at, n, one in zip(part, range(0, len(raw), width), (count * wide).tolist(), odd.tolist()):
                self.words[w] = self._fragment_ids(MARK + w) if one else raw[at : at + n]

    def _plain_words(self, text: str) -> list[str] | None:
        """The words of a text whose normalised form has one mark before each and is otherwise equal, or None."""
        if self.charmap is not None or self.squeeze or not self.dummy or not self.cuts or self.byte is None or MARK in text:
            return None
        words = text.split(" ")
        return None if "" in words else words

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of every text, some at a time: their distinct words are looked up or merged once."""
        at = 0
        while at < len(texts):
            cut, own, chars = [], set(), 0
            while at < len(texts) and chars < CHARS_AT_ONCE:
                words = self._plain_words(texts[at])
                own.update(words or ())
                cut.append((texts[at], words))
                chars += len(texts[at])
                at += 1
            self.learn(own)
            for text, words in cut:
                if words is None:
                    yield self.encode(text)
                else:
                    yield self._spans(np.frombuffer(b"".join(map(self.words.__getitem__, words)), self.packed).astype(np.int32))

    def _spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends) of a plain text: each piece covers its own bytes, the mark put in front none."""
        ends = np.cumsum(self.source_len[ids], dtype=np.int32)
        if self.dummy:
            ends -= 1
        return ids, np.r_[np.int32(0), ends[:-1]], ends

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): each piece and the source bytes it covers."""
        if not text:
            none = np.empty(0, np.int32)
            return none, none, none
        if self.charmap is None and not self.squeeze and self.byte is not None and MARK not in text:
            return self._spans(self._ids((MARK if self.dummy else "") + text.replace(" ", MARK)))
        norm, source = self.normalise(text)
        ids = self._ids(norm)
        # Positions in the normalised text, in bytes, then the source bytes of those positions.
        wide = np.array([len(c.encode()) for c in norm], np.int64)
        size = np.where(self.is_byte[ids], 1, np.array([len(self.pieces[i].encode()) for i in ids.tolist()], np.int64))
        if self.byte is None and (ids == self.unk).any():
            size = self._unknown_sizes(norm, ids)
        edge = np.r_[0, np.cumsum(size)]
        char = np.searchsorted(np.cumsum(wide), edge, side="right")
        inside = edge - np.r_[0, np.cumsum(wide)][char]
        at = source[char] + np.where(inside > 0, np.minimum(inside, source[np.minimum(char + 1, len(norm))] - source[char]), 0)
        return ids, at[:-1].astype(np.int32), at[1:].astype(np.int32)

    def _unknown_sizes(self, norm: str, ids: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for i in ids.tolist():
            piece = norm[at] if i == self.unk else self.pieces[i]
            out.append(len(piece.encode()))
            at += len(piece)
        return np.array(out, np.int64)

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        spoken = ids[~self.is_control[ids]]
        raw = b"".join(map(self.out.__getitem__, spoken.tolist()))
        lead = len(spoken) and (self.dummy or self.squeeze) and self.pieces[spoken[0]].startswith(MARK)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(spoken)
        return text[1:] if lead else text

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Runs of byte pieces that are not UTF-8: one replacement character for each byte that is no part of a character."""
        out, run = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.out[i]
                continue
            k = 0
            while k < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[k : k + n].decode())
                        k += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k += 1
            run.clear()
            if i >= 0:
                out.append(self.out[i].decode())
        return "".join(out)


def _fields_of(fields: list, number: int) -> Iterator[list]:
    return (list(_fields(v)) for f, v in fields if f == number)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of a file, once per worker; what Arrow holds back of a worker's earlier stages goes first."""
    pa.default_memory_pool().release_unused()
    return PieceModel(path)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int32)))


def _encoded(batches: Iterator[pa.RecordBatch], model: PieceModel, decoded: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of ``encode_documents`` for batches of (id, text); SLICE texts at a time are Python objects."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            held, tokens, first = [], 0, 0
            for i, found in enumerate(model.encode_all([t.as_py() or "" for t in b.column(1)])):
                held.append(found)
                tokens += len(found[0])
                if tokens >= BATCH_TOKENS or i == b.num_rows - 1:
                    text = [pa.array([model.decode(x[0]) for x in held], pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), *map(_lists, zip(*held)), *text], names)
                    held, tokens, first = [], 0, i + 1


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids, begins, ends array<int>) for every row, with ``decoded`` also the text that the ids decode to.

    Spans are UTF-8 byte offsets of the source text. No begin or end ids. A null or empty text has empty arrays and
    decodes to an empty text; rows stay one to one, repeated and null ids too; other columns are not read; an empty
    table gives no rows.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    names = ["id", "ids", "begins", "ends", *["decoded"] * decoded]
    out = narrow.mapInArrow(lambda batches: _encoded(batches, load(model_path), decoded, names), f"id {kind}, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as ``text_col``; null ids count as none and give an empty text.

    A column that is named ``text_col`` already is replaced; others may have any names. Repeated rows stay; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            col = b.column(0)
            flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            text = [model.decode(flat[x:y]) for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], ["ids", "row", "decoded"])

    rest = [c for c in encoded.columns if c.lower() != text_col.lower()]
    packed = encoded.select(F.coalesce(quoted(ids_col), F.array().cast("array<int>")).alias("ids"), whole_row(encoded.select(*map(quoted, rest))).alias("row"))
    told = packed.mapInArrow(run, StructType([*packed.schema, StructField("decoded", StringType())]))
    return told.select("row.*", F.col("decoded").alias(text_col))
