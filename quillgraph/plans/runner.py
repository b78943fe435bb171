"""Named stages over tables in a folder, run in order from one to another."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]]


def run(spark: SparkSession, stages: Sequence[Stage], folder: str, first: str | None = None, last: str | None = None, only: set[str] | None = None, tables: dict[str, DataFrame] | None = None) -> list[str]:
    """Runs stages and writes each result as folder/name; earlier results are read where a run begins
    later. A stage that fails ends the run. Returns the names that ran."""
    names = [n for n, _ in stages]
    lo, hi = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    known, done = dict(tables or {}), []
    for i, (name, f) in enumerate(stages):
        if lo <= i <= hi and (only is None or name in only):
            f(spark, known).write.mode("overwrite").parquet(f"{folder}/{name}")
            done.append(name)
        elif i > hi:
            break
        known[name] = spark.read.parquet(f"{folder}/{name}")
    return done
