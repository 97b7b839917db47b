"""Saved filters of users: created, changed and deleted in order, a limited number each."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Filters that a user may have, and characters of a name.
MOST_FILTERS, NAME_CHARS = 10, 80
FILTER = "filter_id string, name string, criteria string, enabled boolean, created_seq bigint, updated_seq bigint"
_FIELDS = ("filter_id", "name", "criteria", "enabled", "created_seq", "updated_seq")


def changed_filters(stored: DataFrame, actions: DataFrame, most: int = MOST_FILTERS) -> tuple[DataFrame, DataFrame]:
    """Filters after actions, and each action's result: (user_id, FILTER) and (user_id, seq, action, result).

    ``stored`` has user_id and FILTER, ``actions`` user_id, seq, action, filter_id, name, criteria and enabled. In order of seq: create adds an enabled filter, refused as
    ``invalid_name`` for a blank or long name, ``exists`` for an id that is taken, ``limit_reached`` at ``most``; update changes what isn't null and delete removes, both
    ``not_found`` for a filter that the user doesn't have. Whether an action is let through depends on those before, so a user's actions stream in order
    through a fold whose state is that user's filters, ``most`` or so. A null user is one user.
    """
    kind = actions.schema["user_id"].dataType.simpleString()
    none = lambda kind: F.lit(None).cast(kind)
    old = stored.select("user_id", F.lit(None).cast("bigint").alias("seq"), none("string").alias("action"), *_FIELDS)
    new = actions.select("user_id", F.col("seq").cast("bigint").alias("seq"), "action", "filter_id", "name", "criteria", "enabled", none("bigint").alias("created_seq"), none("bigint").alias("updated_seq"))
    dealt = old.unionByName(new).repartition("user_id").sortWithinPartitions("user_id", F.col("seq").asc_nulls_first(), "filter_id")

    def step(mine: dict, seq: int, action: str, filter_id: str, name: str | None, criteria: str | None, enabled: bool | None) -> str:
        if action == "create":
            if not (name or "").strip() or len(name.strip()) > NAME_CHARS:
                return "invalid_name"
            if filter_id in mine:
                return "exists"
            if len(mine) >= most:
                return "limit_reached"
            mine[filter_id] = [filter_id, name.strip(), criteria, True, seq, seq]
            return "created"
        if filter_id not in mine:
            return "not_found"
        if action == "delete":
            del mine[filter_id]
            return "deleted"
        if name is not None and (not name.strip() or len(name.strip()) > NAME_CHARS):
            return "invalid_name"
        held = mine[filter_id]
        mine[filter_id] = [filter_id, held[1] if name is None else name.strip(), held[2] if criteria is None else criteria, held[3] if enabled is None else enabled, held[4], seq]
        return "updated"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in chain([first], batches))
        shape = [("user_id", first.schema.field(0).type), ("seq", pa.int64()), ("action", pa.string()), ("result", pa.string())]
        shape += [("filter_id", pa.string()), ("name", pa.string()), ("criteria", pa.string()), ("enabled", pa.bool_()), ("created_seq", pa.int64()), ("updated_seq", pa.int64())]
        out: list[tuple] = []
        for user, mine_rows in groupby(rows, key=lambda r: r[0]):
            mine: dict[str, list] = {}
            for _, seq, action, *values in mine_rows:
                if action is None:
                    mine[values[0]] = list(values)
                else:
                    out.append((user, seq, action, step(mine, seq, action, *values[:4]), *[None] * 6))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), shape)], [n for n, _ in shape])
                    out = []
            out += [(user, None, None, None, *f) for f in mine.values()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), shape)], [n for n, _ in shape])

    from listingloom.sources.tables import checkpointed

    told = checkpointed(dealt.mapInArrow(fold, f"user_id {kind}, seq bigint, action string, result string, {FILTER}"))
    return told.where("action is null").select("user_id", *_FIELDS), told.where("action is not null").select("user_id", "seq", "action", "result")
