"""Language ID with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel is the blended spectrum of presence: how many character 1-, 2- and 3-grams two texts share,
over the root of the product of their counts. Landmark texts span the feature space (Nyström); one
ridge regression per language is fitted there. A score is kernel block times dual weights; as the
kernel is linear in the presence bits, that is one batched product of bit rows with a gram table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingloom.llm.common import crc_fold, quoted

#: Character classes: 0 for anything but letters, a-z, and hashed classes for all other letters.
CLASSES = 64
GRAMS = CLASSES + CLASSES**2 + CLASSES**3
#: Expected training rows of a language, and landmarks among them: the bound of what training collects.
ROWS_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 400, 48
#: Languages that are learnt: those with the most rows. It bounds the model where ``lang`` holds junk.
MOST_LANGUAGES = 256
RIDGE = 1e-3
#: Steepness of the softmax that turns regression outputs into a confidence.
SHARPNESS = 6.0
#: Characters handled at once, and texts of one matrix product.
CHUNK, BLOCK = 1 << 20, 64
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], np.int64)
    out[letters] = 27 + (letters * 40503 >> 4) % (CLASSES - 27)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


def presence(text: str, flags: np.ndarray) -> bool:
    """Sets in ``flags`` (GRAMS bools, cleared first) the grams of a text. False if it has no letter."""
    flags[:] = False
    lower, some = text.lower(), False
    for i in range(0, len(lower), CHUNK):
        part = lower[i : i + CHUNK + 2].encode("utf-32-le", "replace")
        c = _class_of()[np.frombuffer(part, "<u4")].astype(np.int32)
        some = some or bool(c.any())
        flags[c] = True
        two = c[:-1] * CLASSES + c[1:]
        flags[CLASSES + two] = True
        flags[CLASSES + CLASSES**2 + two[:-1] * CLASSES + c[2:]] = True
    return some


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    grams: np.ndarray  # the grams that some landmark has
    weights: np.ndarray  # (grams, languages)
    bias: np.ndarray

    def predict(self, texts: Iterator[str | None]) -> tuple[list[str], list[float]]:
        texts = list(texts)
        flags, best, score = np.zeros(GRAMS, bool), [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = np.zeros((min(BLOCK, len(texts)), len(self.grams)), np.float32)
        for a in range(0, len(texts) if self.languages else 0, BLOCK):
            part = texts[a : a + BLOCK]
            norm, some = np.ones(len(part)), np.zeros(len(part), bool)
            for i, text in enumerate(part):
                some[i] = bool(text) and presence(text, flags)
                rows[i] = flags[self.grams] if some[i] else 0
                norm[i] = np.sqrt(max(1, np.count_nonzero(flags)))
            f = rows[: len(part)] @ self.weights / norm[:, None] + self.bias
            p = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            for i in np.flatnonzero(some).tolist():
                best[a + i], score[a + i] = self.languages[int(f[i].argmax())], float(p[i].max())
        return best, score.tolist()


def _sampled(docs: DataFrame, text_col: str, lang_col: str, id_col: str) -> DataFrame:
    known = docs.where(quoted(lang_col).isNotNull() & quoted(text_col).rlike("\\p{L}")).select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    counts = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, ROWS_PER_LANGUAGE / r["count"])))) if counts else F.create_map().cast("map<string,double>")
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    drawn = F.pmod(F.xxhash64(F.lit(977), "id", "text"), F.lit(1 << 30)) < share * F.lit(1 << 30)
    return known.where(drawn)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Learns from text and lang of the rows given; ids only seed the bounded sample.

    About ROWS_PER_LANGUAGE rows of each of the MOST_LANGUAGES commonest languages are drawn by hash; their gram
    lists reach the driver. Rows with null lang or without a letter teach nothing, repeated rows count as often as
    they stand there; without any row (an empty table) every text is undetermined. Other columns may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(GRAMS, bool)
        for b in batches:
            for i in range(b.num_rows):
                presence(b.column(0)[i].as_py(), flags)
                grams = pa.array([np.flatnonzero(flags).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1), b.column(2).slice(i, 1), grams], ["lang", "k", "grams"])

    rows = _sampled(docs, text_col, lang_col, id_col).select("text", "lang", F.xxhash64("text").alias("k"))
    got = rows.mapInArrow(run, "lang string, k bigint, grams array<int>").toPandas().sort_values(["lang", "k"], kind="stable").reset_index(drop=True)
    languages = tuple(sorted(got["lang"].unique()))
    if not languages:
        return LanguageModel((), np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0))
    # Sorted by a hash of the text, the first rows of a language are a random choice of landmarks.
    marks = np.concatenate([g.index.to_numpy()[:LANDMARKS_PER_LANGUAGE] for _, g in got.groupby("lang")])
    grams = np.unique(np.concatenate([got["grams"][i] for i in marks]))
    place = np.full(GRAMS, -1)
    place[grams] = np.arange(len(grams))
    norms = np.sqrt([len(g) for g in got["grams"]])
    marked = np.zeros((len(marks), len(grams)), np.float32)
    for r, i in enumerate(marks):
        marked[r, place[got["grams"][i]]] = 1 / norms[i]
    kernel = np.empty((len(got), len(marks)))
    for i, g in enumerate(got["grams"]):
        at = place[g]
        kernel[i] = marked[:, at[at >= 0]].sum(axis=1) / norms[i]
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > values.max() * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    y = np.stack([np.where(got["lang"] == x, 1.0, -1.0) for x in languages], axis=1)
    counts = got["lang"].map(got["lang"].value_counts()).to_numpy(float)
    weight = (len(got) / len(languages) / counts)[:, None]
    mean, target = (weight * phi).mean(axis=0) / weight.mean(), (weight * y).mean(axis=0) / weight.mean()
    centred = phi - mean
    dual = root @ np.linalg.solve(centred.T @ (weight * centred) + RIDGE * len(got) * np.eye(phi.shape[1]), centred.T @ (weight * (y - target)))
    # bias: the regression is on centred features
    bias = target - mean @ np.linalg.lstsq(root, dual, rcond=None)[0]
    return LanguageModel(languages, grams, (marked.T @ dual).astype(np.float32), bias)


def language_of(model: LanguageModel, text: Column) -> Column:
    """struct<lang, score> of a text column; ``und`` and 0 for null and for texts without a letter."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = model.predict(texts)
        return pd.DataFrame({"lang": lang, "score": score})

    return predict(text)


def identify_held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learnt from folds other than 0 only.

    Null or letterless texts give ``und`` and 0. Repeated rows each get their prediction; ids, lang and
    source are no inputs of it; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    held = crc_fold(F.col("doc_id"), folds) == 0
    model = train(docs.where(~F.coalesce(held, F.lit(False))))
    told = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), language_of(model, F.col("text")).alias("l"))
    return told.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))
