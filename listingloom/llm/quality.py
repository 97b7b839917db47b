"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, each chosen pair a table over a coarse grid. Tables are
learnt by cyclic boosting: in turn, every feature gets one shallow tree on the current residuals, added
with a small rate. Scoring is binning and additions of table entries for a whole batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import crc_fold, hash_below

#: Expected labelled rows that training reads: the bound of what reaches the driver.
TRAIN_ROWS = 20_000
BINS, GRID, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LAMBDA = 150, 60, 0.15, 2.0
THRESHOLD = 0.7

FEATURES = (
    "log_chars", "mean_word", "letters", "upper", "digits", "spaces", "stops", "symbols", "distinct_words", "log_line",
    "repeated_lines", "ended_lines", "odd_words", "longest_word", "top_word", "byte_entropy", "short_words", "upper_words",
    "repeated_pairs", "bang_words",
)
_KINDS = np.zeros(256, np.uint8)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\f", 4), (b".,;:!?'\"-", 5)):
    _KINDS[list(_chars)] = _kind
_KINDS[0x80:] = 1
_KINDS[[c for c in range(128) if not _KINDS[c]]] = 6
_ODD = re.compile(r"[^\w.,;:!?'\"\-]|[.,;:!?]{2}")


def features(text: str) -> list[float]:
    """FEATURES of a whole text; all zero for an empty one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    if not len(raw) or not words:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KINDS, weights=bytes_, minlength=7) / len(raw)
    p = bytes_[bytes_ > 0] / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:])))
    n = len(words)
    return [
        float(np.log1p(len(text))), float(sizes.mean()), kinds[1] + kinds[2], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6],
        len(seen) / n, float(np.log1p(len(text) / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), sum(c for w, c in seen.items() if _ODD.search(w)) / n,
        float(np.log1p(sizes.max())), max(seen.values()) / n, float(-(p * np.log2(p)).sum()), float((sizes <= 3).mean()),
        sum(c for w, c in seen.items() if w.isupper() and len(w) > 1) / n, 1 - pairs / max(1, n - 1), sum(c for w, c in seen.items() if w.endswith("!")) / n,
    ]


def _shallow(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values per ordered bin of a tree of ``depth`` on sums of gradients and hessians."""
    out = np.full(len(g), g.sum() / (h.sum() + LAMBDA))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + LAMBDA) + (g.sum() - gl) ** 2 / (h.sum() - hl + LAMBDA)
    k = int(gain.argmax()) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + LAMBDA) + 1e-9:
        return out
    return np.concatenate([_shallow(g[:k], h[:k], depth - 1), _shallow(g[k:], h[k:], depth - 1)])


def _shallow_grid(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree on a grid: one split of one axis, then a split of the other on each side."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            value = np.vstack([np.tile(_shallow(a[s].sum(axis=0), b[s].sum(axis=0), 1), (len(a[s]), 1)) for s in (slice(k), slice(k, None))])
            gain = (value * a).sum()
            if gain > best:
                best, out = gain, value.T if flip else value
    return out


@dataclass(frozen=True)
class QualityModel:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # bin -> grid cell
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        for (i, j), g in zip(self.pairs, self.grids):
            f += g[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-f))


def fit(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Cyclic boosting of the main tables, then of grids for the pairs that explain most of what is left."""
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], cuts)) for j in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    model = QualityModel(edges, [np.zeros(len(e) + 1) for e in edges], [np.arange(len(e) + 1) * GRID // (len(e) + 1) for e in edges], [], [], float(np.log(share / (1 - share))))
    b = model.bins(x)
    f = np.full(len(y), model.bias)
    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _shallow(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)))
            t += step
            f += step[b[:, j]]
    p = 1 / (1 + np.exp(-f))
    cells = [c[b[:, j]] for j, c in enumerate(model.coarse)]

    def grid(values: np.ndarray, i: int, j: int) -> np.ndarray:
        return np.bincount(cells[i] * GRID + cells[j], values, GRID * GRID).reshape(GRID, GRID)

    gains = {(i, j): float((grid(y - p, i, j) ** 2 / (grid(p * (1 - p), i, j) + LAMBDA)).sum()) for i, j in combinations(range(x.shape[1]), 2)}
    model.pairs.extend(sorted(gains, key=gains.get, reverse=True)[:PAIRS])
    model.grids.extend(np.zeros((GRID, GRID)) for _ in model.pairs)
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.grids):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _shallow_grid(grid(y - p, i, j), grid(p * (1 - p), i, j))
            t += step
            f += step[cells[i], cells[j]]
    return model


def features_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "") for t in texts])

    return compute(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fits on a sample of at most about TRAIN_ROWS labelled rows, drawn by a hash of the id.

    Rows with a null label or text teach nothing; without any row every score is one half.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    n = known.count()
    drawn = known.where(hash_below(TRAIN_ROWS / max(n, 1), F.col("id")))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = texts.join(F.broadcast(drawn), "id").select("id", "y", features_of(F.col("text")).alias("x")).toPandas().sort_values(["id", "y"], kind="stable")
    if not len(got):
        return fit(np.zeros((1, len(FEATURES))), np.array([0.5]))
    return fit(np.stack(got["x"]), got["y"].to_numpy())


def score_of(model: QualityModel, text: Column) -> Column:
    """Probability-like score of a text column; null and empty texts are scored as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES))))

    return score(text)


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; labels of the held-out fold are never read.

    Repeated rows each get their score; a document's labels, lang, source and id are no inputs of it;
    an empty table gives no rows. Other columns are not read, whatever their names; several labels of an id
    each teach.
    """
    out = F.coalesce(crc_fold(F.col("doc_id"), folds) == held, F.lit(False))
    model = train(docs.where(~out), labels.where(~out))
    told = docs.select("doc_id", out.alias("held_out"), score_of(model, F.col("text")).alias("score"))
    return told.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
