"""From raw documents to packed token sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``; none of them drops a clean document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import exactdedup, minhash, packing, pii
from tablemill.llm.toxicity import Scorer
from tablemill.plans.registry import query
from tablemill.session import tune, work_path

VOCABULARY = "byte_bpe_50k.json"
# A cluster passes its own secret here.
KEY = "tablemill"
# Python workers live on from stage to stage, so the last one holds a part of what it would hold alone.
PART = 4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below one half; learned from the labelled ones among them."""
    tune(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return Scorer(docs, labels).score(docs).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest id."""
    return exactdedup.keep_first(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at a similarity of 0.8 or more."""
    return minhash.keep_one(docs, percent=80).select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for private data; a column ``n_chars`` follows the text."""
    out = pii.pseudonymise(docs, KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in sequences of 2048."""
    pieces = packing.tokenise(docs, public_tokenizers.path(VOCABULARY), part=PART)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("pii", hide_private),
    ("packing", pack),
]

# Learned scores, near copies and token ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, t) -> DataFrame:
    """Packed sequences of the documents that stay."""
    return run(spark, t.folder)
