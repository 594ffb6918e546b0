"""From raw documents to encoded training text: filter by quality, remove copies, mix, tokenise.

Each stage takes what the one before has kept. Nulls, empty texts, repeated rows, empty tables and extra
columns are treated as the stage's operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel.llm.bpe import round_trip
from heliopanel.llm.common import shared_path, table, without
from heliopanel.llm.exact_dedup import drop_exact_duplicates
from heliopanel.llm.minhash_dedup import drop_near_duplicates
from heliopanel.llm.mixing import mixed_documents
from heliopanel.llm.quality_crf import good_documents, train


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; the scorer learns from those of them that have labels."""
    return good_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return drop_near_duplicates(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, their texts as the ids decode."""
    docs = without(docs, "token_ids", "n_tokens", "decoded")
    others = [c for c in docs.columns if c != "text"]
    coded = round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=tuple(others))
    return coded.select(*[F.col("decoded").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                        "token_ids", F.size("token_ids").alias("n_tokens"))


STAGES = [
    ("quality classifier", of_good_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", to_target_weights),
    ("byte-level BPE encoding and decoding", encoded),
]

#: No SQL for a fitted classifier, MinHash samples or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            path = shared_path(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
