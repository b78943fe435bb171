"""Running sums and numbers over orders too long for one task: sums of ranges first, then inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import written


ROWS = 1 << 20  # of a range, about


def _ranges(rows: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """rows with _part, the number of the range they are in, and _at, their place; written, so that both stay."""
    n = parts or max(1, min(-(-rows.count() // ROWS), 1 << 20), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(d.select(*rows.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")


def running(rows: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """rows with the sums of the values over all rows of the key up to each, in the order given. Rows are
    dealt in ranges of key and order of about equal size, whatever the values; sums of ranges come first (a row
    for a key and range), then those inside each, so no task holds a key."""
    d = _ranges(rows, key, order)
    per = d.groupBy(F.col(key).alias("_key"), "_part").agg(*(F.sum(v).alias(f"_in_{n}") for n, v in values.items()))
    before = Window.partitionBy("_key").orderBy("_part")
    per = per.select("_key", F.col("_part").alias("_p"), *((F.sum(f"_in_{n}").over(before) - F.col(f"_in_{n}")).alias(f"_before_{n}") for n in values))
    inside = Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    j = d.join(per, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return j.withColumns({n: F.col(f"_before_{n}") + F.sum(v).over(inside) for n, v in values.items()}).select(*rows.columns, *values)


def numbered(rows: DataFrame, order: list[Column | str], name: str, first: Column | int = 0, parts: int | None = None) -> DataFrame:
    """rows with their place in the order, from `first` on. Ranges of the order are sorted on their own;
    a row per range says where it begins."""
    d = _ranges(rows, *order, parts=parts)
    per = d.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    per = per.withColumn("_begin", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # one row per range
    j = d.join(F.broadcast(per), "_part")
    return j.withColumn(name, F.col("_begin") + F.col("_at") - F.col("_first") + first).select(*rows.columns, name)
