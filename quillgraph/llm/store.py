"""Where an operator keeps what it must cut from its lineage, and bounds of what it handles at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillgraph.session import shared_folder, written

__all__ = ["parts", "shared_folder", "small_batches", "written"]


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds what Spark hands to a Python worker at a time by bytes, as rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
