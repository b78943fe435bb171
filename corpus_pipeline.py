"""A training-data pipeline over the table documents: STAGES in order, each a function of
(spark, docs, sf_dir) that works on all that its predecessor kept. All but the last return
the columns of docs; the last returns the pieces of packed sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import minhash, mixing, packing, store, substring
from quillgraph.llm import toxicity as toxic
from quillgraph.session import share_code


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on `labels`, finds toxic go."""
    share_code(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxic.toxicity(docs, labels).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the least id
    stays, and only that one where ids repeat or are missing."""
    share_code(spark)
    return minhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words that occur elsewhere go; other texts stay as they are."""
    share_code(spark)
    hit = F.col("n_removed") > 0
    out = substring.removed(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(hit, F.col("kept")).otherwise(F.col("text"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion 1, 2, 3, ... by words; a document comes once per epoch."""
    share_code(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: one row per piece of a document."""
    share_code(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Networks, signatures and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{store.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
