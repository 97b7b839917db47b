"""From raw documents to token ids: five stages, each written as Parquet and read again for the next.

Every stage but the last returns rows of ``documents`` with their columns; what a stage rejects is gone
for the later ones. ``run`` applies them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.llm import decontaminate, exact, langid, near, pieces
from listingloom.llm.common import forget, table, written
from listingloom.llm.queries import piece_model_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of ``docs``; documents of undetermined language go.

    Those are the null and empty texts and the ones without a letter. Repeated rows fare alike, other columns may
    have any names, and an empty table (or one that teaches nothing, where every language is undetermined) gives no rows.
    """
    model = langid.train(docs)
    return docs.where(langid.language_of(model, F.col("text"))["lang"] != langid.UNDETERMINED)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, null counting as empty, one row with the least doc_id stays.

    A null doc_id stays only where its text has no other. Other columns may have any names; an empty table stays empty.
    """
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in five-word shingles, the one with the least doc_id stays.

    Texts without a word link with nothing and stay. Rows of a repeated doc_id are told apart by their texts. Other
    columns may have any names; an empty table stays empty.
    """
    return near.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go: all rows of their doc_id.

    Null and empty texts contain nothing, and rows with a null doc_id stay. Other columns may have any names; an
    empty table stays empty, an empty benchmark removes nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, begins, ends) of every document left, a row for each row.

    Null and empty texts have no ids; other columns are not read; an empty table gives no rows.
    """
    encoded = pieces.encode_documents(docs, piece_model_path())
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "begins", "ends")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: Model training, fingerprints and piece merges have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
