"""Decisions on posts as they come, against a history of signals that grows with every kept post."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from listingloom.functions.similarity import bits64
from listingloom.operators.prededup import HAMMING, NEAR_TEXT, signals

DECISIONS = "scope string, post_id bigint, decision string, reasons string, reference bigint"
#: Blocks of an image hash: one more than the bits that may differ, so one block is always equal.
BLOCKS = HAMMING + 1
_BITS = [64 // BLOCKS + (k < 64 % BLOCKS) for k in range(BLOCKS)]


def _blocks(h: int) -> list[int]:
    """The hash's blocks, each with its number, as whole keys."""
    out, at = [], 0
    for k, width in enumerate(_BITS):
        out.append(k << 8 | (h >> at & (1 << width) - 1))
        at += width
    return out


class SignalHistory(StatefulProcessor):
    """One scope's history: the first post of every exact signal, and indexes that find similar posts.

    ``first`` maps (kind, value) to the first kept post with it and that post's parent; ``lists`` are growing lists as
    (kind, value, n) entries, so that adding one touches one entry; ``posts`` holds what is compared exactly. Near texts share a token
    among the first few of a fixed order of tokens, near images share a block of bits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = "kind string, value string"
        self.first = handle.getMapState("first", key, "post_id bigint, parent_ref string")
        self.sizes = handle.getMapState("sizes", key, "n bigint")
        self.lists = handle.getMapState("lists", f"{key}, n bigint", "post_id bigint")
        self.posts = handle.getMapState("posts", "post_id bigint", "tokens array<bigint>, image bigint")

    def _listed(self, kind: str, value: object) -> list[int]:
        size = self.sizes.getValue((kind, str(value)))
        return [self.lists.getValue((kind, str(value), n))[0] for n in range(size[0] if size else 0)]

    def _add(self, kind: str, value: object, post_id: int) -> None:
        size = self.sizes.getValue((kind, str(value)))
        n = size[0] if size else 0
        self.lists.updateValue((kind, str(value), n), (post_id,))
        self.sizes.updateValue((kind, str(value)), (n + 1,))

    def _forward(self, p: Row) -> int | None:
        """The first kept post of the forward key that is no sibling."""
        found = self.first.getValue(("forward", p.forward_key)) if p.forward_key is not None else None
        if found and found[1] is not None and found[1] == p.parent_ref:
            found = self.first.getValue(("forward of another parent", p.forward_key))
        return found[0] if found else None

    def _exact(self, kind: str, value: str | None) -> int | None:
        found = self.first.getValue((kind, value)) if value is not None else None
        return found[0] if found else None

    @staticmethod
    def _prefix(tokens: list[int]) -> list[int]:
        return tokens[: len(tokens) - ceil(len(tokens) * NEAR_TEXT - 1e-9) + 1]

    def _near_text(self, tokens: list[int]) -> int | None:
        mine, near = set(tokens), []
        for q in {q for token in self._prefix(tokens) for q in self._listed("token", token)}:
            other = self.posts.getValue((q,))[0]
            both = len(mine.intersection(other))
            near.append((-both / (len(mine) + len(other) - both), q))
        best = min(near, default=(0, None))
        return best[1] if -best[0] >= NEAR_TEXT else None

    def _near_image(self, image: int) -> int | None:
        near = [((self.posts.getValue((q,))[1] ^ image).bit_count(), q) for q in {q for b in _blocks(image) for q in self._listed("block", b)}]
        best = min(near, default=(HAMMING + 1, None))
        return best[1] if best[0] <= HAMMING else None

    def _keep(self, p: Row, tokens: list[int], image: int | None) -> None:
        me = (p.post_id, p.parent_ref)
        if p.forward_key is not None:
            first = self.first.getValue(("forward", p.forward_key))
            if first is None:
                self.first.updateValue(("forward", p.forward_key), me)
            elif (first[1] is None or first[1] != p.parent_ref) and self.first.getValue(("forward of another parent", p.forward_key)) is None:
                self.first.updateValue(("forward of another parent", p.forward_key), me)
        for kind, value in (("hash", p.text_hash), *(("phone", x) for x in p.phones)):
            if value is not None and self.first.getValue((kind, value)) is None:
                self.first.updateValue((kind, value), me)
        self.posts.updateValue((p.post_id,), (tokens, image))
        for token in self._prefix(tokens) if tokens else []:
            self._add("token", token, p.post_id)
        for b in _blocks(image) if image is not None else []:
            self._add("block", b, p.post_id)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for p in sorted(rows, key=lambda r: r.post_id):
            told = {"forward_origin": self._forward(p), "text_hash": self._exact("hash", p.text_hash)}
            sure = [(k, v) for k, v in told.items() if v is not None][:1]
            tokens, image = list(p.tokens), p.image & (1 << 64) - 1 if p.image is not None else None
            if not sure:
                phones = [q for q in (self._exact("phone", x) for x in p.phones) if q is not None]
                similar = {"near_text": self._near_text(tokens) if tokens else None, "phash": self._near_image(image) if image is not None else None, "phone": min(phones, default=None)}
                found = [(k, v) for k, v in similar.items() if v is not None]
                self._keep(p, tokens, image - (1 << 64) if image is not None and image >> 63 else image)
            else:
                found = sure
            decision = "high_confidence_duplicate" if sure else "needs_reviewable_signal" if found else "proceed_to_ai"
            yield Row(scope=key[0], post_id=p.post_id, decision=decision, reasons=",".join(k for k, _ in found), reference=found[0][1] if found else None)

    def close(self) -> None:
        pass


def decided_as_they_come(posts: DataFrame, scope: str) -> DataFrame:
    """A stream of decisions (scope, post_id, decision, reasons, reference) on posts (post_id, text, forward_key, parent_ref, phash).

    Each scope has a history of its own, whose decisions are those of ``prededup.decide`` on its posts if these come in order of
    id (a micro-batch is put in order first). One scope is one task with state on disk (RocksDB), so a scope should be a city or a
    group of channels, not the whole feed; beyond that use ``prededup.decide``, which has no scopes. Histories only
    grow: no post is forgotten. Null scopes are one. The tokens are kept as 64-bit hashes.
    """
    tokens = F.array_sort(F.transform("tokens", lambda x: F.xxhash64(x)))
    rows = signals(posts.withColumn("parent_ref", F.col("parent_ref").cast("string")), scope).select(
        scope, F.col("post_id").cast("bigint").alias("post_id"), "forward_key", "parent_ref", "text_hash", tokens.alias("tokens"), "phones", bits64(F.col("phash")).alias("image")
    )
    return rows.groupBy(scope).transformWithState(statefulProcessor=SignalHistory(), outputStructType=DECISIONS, outputMode="Append", timeMode="None")
