"""A corpus cleaned in five stages, each of which works on all that the one before kept.

Toxic documents go, one document of each group of near copies stays, contaminated documents go, secrets are
masked in the text, and what is left is packed into training sequences. Stages but the last return the
columns of `documents`. The classifier and the index have no SQL form, so ORACLE_SQL is None; the tests
hold each stage against a brute-force version.

Every stage judges a row by its own text. Rows without an id and rows without words are never copies of others and
stay; of rows that repeat id and text one stays; texts under one id are judged each for itself. Null texts stay null
and are packed as their end id. Ties between copies go to the smallest id, then to the smaller hash of the text.
An empty table passes through all stages. Other columns travel with their row, whatever their names. A text is one
unit of work in every stage, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import fm_index, jaccard, packing, secret_scan, toxicity
from voxelloom.llm.storage import new_folder, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on labelled documents of this input, rejects."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth of the words or more lies in benchmark windows."""
    return fm_index.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted anew."""
    masked = secret_scan.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:  # nothing reads it any more
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
