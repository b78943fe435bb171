"""Deterministic draws, quotas and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the parts, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(16**13)


def weighted_draw(u: Column, weights: dict[str, int]) -> Column:
    """The category whose share of the cumulative weights holds u (in [0, 1))."""
    total, upto, out = sum(weights.values()), 0, None
    for name, w in weights.items():
        upto += w
        hit = u < upto / total
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(list(weights)[-1]))


def shuffled(seed: Column, n: int = 4) -> Column:
    """A permutation of 0..n-1 by hashed keys."""
    return F.transform(F.array_sort(F.array(*(F.struct(F.md5(F.concat_ws("|", seed, F.lit(str(i)))).alias("h"), F.lit(i).alias("i")) for i in range(n)))), lambda x: x["i"])


def one_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def round_robin(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Rows in turns over the keys (keys by their first row), `limit` in all: only the first rows of a
    key can be among them, so each key is cut to `limit` before the final order."""
    w = Window.partitionBy(key).orderBy(*order)
    turn = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    return turn.orderBy("turn", *order).limit(limit)


def stratified_quota(rows: DataFrame, stratum: str, order: list[Column], target: int, n_strata: int) -> DataFrame:
    """max(1, target // n_strata) of each stratum by the order, then the best of the rest up to target."""
    w = Window.partitionBy(stratum).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= target)  # no row beyond can be taken
    picked = ranked.withColumn("filled", (F.col("_n") > max(1, target // n_strata)).cast("int"))
    return picked.orderBy("filled", *order).limit(target).drop("_n")
