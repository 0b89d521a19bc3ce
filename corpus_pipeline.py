"""From raw documents to token ids: quality, near-duplicates, benchmark passages, personal data, BPE.

``run`` applies STAGES in order; each result is written as Parquet to the shared folder and reread, so
that every stage works on all that its predecessor kept and no plan crosses stages.

Cases, for every stage but the last, which keeps three columns of its own: columns pass through, whatever
their names; null and empty texts are left out by the first stage, as nothing tells their quality, and pass
all others; very long texts are taken whole; repeated rows share their fate, also where they repeat a
doc_id; a null doc_id is linked with nothing; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import bpe, decontaminate, neardup, pii, quality
from quillforge.llm.shared import stage, table

#: Transducer states of a worker: fewer than by default, as the stages before have left the executors less memory.
STATES = 80_000
#: Percent of shared five-word shingles from which documents are near-duplicates.
SIMILAR = 80


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the importance-resampled sample; what the classifier rejects goes."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of documents whose shingles are alike by SIMILAR.

    Rows that repeat a kept doc_id are one document and stay together.
    """
    name = "_" * (1 + max(map(len, docs.columns)))
    gone = neardup.near_duplicates(docs, SIMILAR).where("doc_id is not null").groupBy(F.col("doc_id").alias(name)).agg(F.bool_or("kept").alias("kept")).where("not kept").select(name)
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs (coverage limit 0)."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), coverage=0.0)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every personal span replaced by its kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids (little-endian unsigned 32-bit integers), their number and the decoded text."""
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, STATES)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", select_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("byte-level BPE encoding and decoding", encode),
]

#: Hashed features, sketches and merges are beyond SQL; tests/llm holds each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
