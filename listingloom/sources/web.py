"""Web pages, replay files, images and other outside inputs."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from listingloom.functions.text import in_slices


class _Text(HTMLParser):
    """All text nodes, and the first one inside a title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: str | None = None
        self.in_title = False

    def handle_starttag(self, tag, attrs) -> None:
        self.in_title = tag == "title"

    def handle_endtag(self, tag) -> None:
        self.in_title = False

    def handle_data(self, data) -> None:
        if self.in_title and self.title is None and data.strip():
            self.title = data
        self.parts.append(data)


_PAGE = pa.struct([("title", pa.string()), ("text", pa.string())])


def _page(source: str | None) -> dict[str, str | None]:
    p = _Text()
    p.feed(source or "")
    p.close()
    return {"title": " ".join(p.title.split()) if p.title else None, "text": " ".join(" ".join(p.parts).split())}


@F.arrow_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def page_text(html: pa.Array) -> pa.Array:
    """Title and all text of a page, white space collapsed; scripts and styles count as text."""
    return in_slices(_page, html, _PAGE)


def replay_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each case of a replay file: (case_id, event, expected)."""
    data = spark.read.json(path, multiLine=True)
    return data.select(F.explode("cases").alias("c")).select("c.*")


def image_header(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(mime type, width, height) from the first bytes of a PNG, JPEG or extended WebP; unknown parts are None."""
    if not data:
        return None, None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return ("image/png", *struct.unpack(">II", data[16:24])) if len(data) >= 24 else ("image/png", None, None)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X" and len(data) >= 30:
            return "image/webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        return "image/webp", None, None
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return "image/jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + size
        return "image/jpeg", None, None
    return None, None, None


@F.pandas_udf(StructType([StructField("mime_type", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_info(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_header(x) for x in content], columns=["mime_type", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def extract_with(rows: DataFrame, transport: Callable[[str], str], text_col: str = "text") -> DataFrame:
    """rows with ``response``: an injected model call for each text, in Arrow batches; its errors become null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for value in b[text_col]:
                try:
                    answers.append(transport(value))
                except (ValueError, OSError):
                    answers.append(None)
            yield b.assign(response=answers)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, response string")
