"""Configuration: JSON limits, merging of inline settings, safe patterns, fingerprints and changes of configuration tables."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of settings and patterns (fixed values).
MOST_BYTES, MOST_DEPTH = 32 * 1024, 8
MOST_PATTERN_CHARS, MOST_REPEAT = 1000, 10_000
#: Settings that may stand at the top level, and the section each belongs to (fixed values).
SECTIONS = {
    "cleanup": ("strip_patterns", "unicode_form", "collapse_inline_whitespace", "collapse_blank_lines", "trim"),
    "split": ("split_patterns", "min_segment_chars", "max_candidates", "keep_unsplit_if_no_match"),
    "filters": ("include_any", "exclude_any", "unmatched_policy", "excluded_policy", "empty_text_policy"),
}


def checked_json(value: Any, depth: int = 0) -> Any:
    """``value`` if it is JSON with text keys, finite numbers and at most MOST_DEPTH levels; ValueError otherwise."""
    if depth > MOST_DEPTH:
        raise ValueError("settings are nested too deeply")
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("numbers must be finite")
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("keys must be texts")
        return {k: checked_json(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [checked_json(v, depth + 1) for v in value]
    if value is None or isinstance(value, str | bool | int | float):
        return value
    raise ValueError(f"{type(value).__name__} is no JSON value")


def checked_settings(value: Any) -> dict[str, Any]:
    """A copy of a settings object within the limits of depth and size; ValueError otherwise."""
    if not isinstance(value, Mapping):
        raise ValueError("settings must be an object")
    out = checked_json(value)
    if len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode()) > MOST_BYTES:
        raise ValueError("settings are too large")
    return out


def sectioned(settings: Mapping[str, Any]) -> dict[str, Any]:
    """Inline settings with top-level names moved into their sections, over what the sections have already."""
    out = {k: v for k, v in settings.items() if k != "parser_mode" and not any(k in names for names in SECTIONS.values())}
    for section, names in SECTIONS.items():
        moved = {("patterns" if n == "split_patterns" else n): settings[n] for n in names if n in settings}
        if moved or settings.get(section):
            out[section] = {**(settings.get(section) or {}), **moved}
    return out


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; objects on both sides are merged, anything else is replaced."""
    both = {k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}
    return {**base, **both}


#: A token of a pattern: escaped character, class, start of a group, a counted or plain repeat, or one character.
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?(?:P<\w+>|P=\w+\)|[a-zA-Z-]*[:)]|<?[=!]))?|\{\d+(?:,\d*)?\}|.", re.S)


def check_pattern(pattern: str) -> None:
    """ValueError for a pattern that may backtrack without bound, or is too long or no pattern at all.

    Refused: back-references, look-around (but for ``(?=^`` at a split), counts over MOST_REPEAT, and an unbounded
    repeat of a group that holds a repeat or an alternation at any depth.
    """
    if not pattern or len(pattern) > MOST_PATTERN_CHARS:
        raise ValueError(f"pattern of {len(pattern)} characters")
    re.compile(pattern, re.I | re.M)
    unsafe = [False]  # for each open group: holds a repeat or an alternation
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(pattern)]
    closed: bool | None = None  # of the group that ended just before
    for token, at in tokens:
        ended, closed = closed, None
        if re.fullmatch(r"\\[1-9]", token) or token.startswith("(?P="):
            raise ValueError(f"back-reference in {pattern!r}")
        if re.fullmatch(r"\(\?<?[=!]", token) and not pattern.startswith("(?=^", at):
            raise ValueError(f"look-around in {pattern!r}")
        if token.startswith("(") and not token.endswith(")"):
            unsafe.append(False)
        elif token == "|":
            unsafe[-1] = True
        elif token == ")" and len(unsafe) > 1:
            closed = unsafe.pop()
            unsafe[-1] |= closed
        elif token in ("*", "+", "?") or re.fullmatch(r"\{\d+(,\d*)?\}", token):
            bounds = [int(x) for x in re.findall(r"\d+", token)]
            if any(b > MOST_REPEAT for b in bounds):
                raise ValueError(f"repeat over {MOST_REPEAT} in {pattern!r}")
            if ended and (token in ("*", "+") or token.endswith(",}")):
                raise ValueError(f"nested repeat in {pattern!r}")
            unsafe[-1] = True


# -- configuration tables


def row_line(columns: list[str]) -> Column:
    """The columns of a row as one text."""
    return F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in columns))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a text that changes with any row, whatever their order. Rows are hashed and combined, never gathered."""
    h = F.conv(F.substring(F.sha2(row_line(columns), 256), 1, 15), 16, 10).cast("bigint")
    told = rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"))
    return told.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256).alias("fingerprint"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed rows between two states of a table."""
    a = before.select(*keys, F.sha2(row_line(columns), 256).alias("_a"))
    b = after.select(*keys, F.sha2(row_line(columns), 256).alias("_b"))
    told = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, keys, "full_outer").select(*keys, told.alias("change")).where("change is not null")


def drift(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, side): what only the expected side has (missing) and what only the actual one has (unexpected), once each."""
    e, a = (x.select(*columns).distinct() for x in (expected, actual))
    return e.join(a, columns, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, columns, "left_anti").withColumn("side", F.lit("unexpected")))


def refreshed(read: Callable[[], DataFrame], columns: list[str], handle: Callable[[DataFrame, DataFrame, int, bool], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads a configuration table anew for every batch.

    ``handle(batch, configuration, batch_id, changed)`` gets whether its fingerprint differs from the batch before's.
    """
    known: list[str] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        configuration = read()
        now = fingerprint(configuration, columns).first()[0]
        handle(batch, configuration, batch_id, known[-1:] != [now])
        known[:] = [now]

    return run
