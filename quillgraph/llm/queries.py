"""The queries opN_<name>: each operator over its whole table, digested to the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import removed

    return removed(_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .capfilter import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scores

    return scores(_table(spark, sf_dir, "documents"))


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import round_trip

    return round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import deduplicated

    return deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infilled

    out = infilled(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives, quantized

    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label")
    return hard_negatives(_table(spark, sf_dir, "embeddings").select("vec_id", label, quantized("embedding", 256).alias("vector"), F.expr("vec_id % 100 = 0").alias("anchor")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict:
    from . import imatch, infill, linededup, mixing, negatives

    return {"op1_mixing": mixing.SQL, "op10_fingerprints": imatch.SQL, "op11_line_dedup": linededup.SQL, "op12_fill_in_middle": infill.SQL, "op13_hard_negatives": negatives.SQL}
