"""Guarded rates and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import written


def rate(part: Column | str, whole: Column | str, places: int = 4) -> Column:
    """part / whole, rounded; 0 where whole is 0 or null."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), places), F.lit(0.0))


SKETCH = 4096  # of a quantile sketch; its ranks are off by ERROR at most, but in one case of a hundred
ERROR = 2.3 / SKETCH**0.9
MOST_INSIDE = 1 << 20  # distinct values of a bracket that are ordered in one task


def _quantile(ranks: str) -> str:
    """Of the sketch q; null where it holds no value (all were nan)."""
    return f"CASE WHEN kll_sketch_get_n_double(q) > 0 THEN kll_sketch_get_quantile_double(q, {ranks}) END"


def _both(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by key (null is a key) and name."""
    b = b.withColumnsRenamed({"k": "_k", "name": "_n"})
    return a.join(b, F.col("k").eqNullSafe(F.col("_k")) & (F.col("name") == F.col("_n")), how).drop("_k", "_n")


def _inside(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """(k, name, v, c): the values in each bracket, and as null those below, with their counts."""
    part = rows.join(brackets.select(F.col("k").alias("_k"), "name", "lo", "hi"), F.col("k").eqNullSafe(F.col("_k")) & (F.col("v") <= F.col("hi")))
    return part.groupBy("k", "name", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))


def _narrowed(inside: DataFrame, brackets: DataFrame, cells: int) -> DataFrame:
    """Brackets cut down to that of so many cells, about equal in distinct values, that holds the place."""
    ranks = ", ".join(f"{i / cells}D" for i in range(1, cells))
    cuts = inside.where("v IS NOT NULL").groupBy("k", "name").agg(F.kll_sketch_agg_double("v", SKETCH).alias("q")).select("k", "name", F.expr(_quantile(f"array({ranks})")).alias("cuts"))
    cell = F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < F.col("v"))))
    per = _both(inside, cuts).groupBy("k", "name", cell.alias("cell")).agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("c").over(Window.partitionBy("k", "name").orderBy("cell"))  # cells + 1 rows
    at = _both(per.withColumn("upto", upto), brackets.drop("lo", "hi"))
    return at.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place"))).select(brackets.columns)


def order_stats(df: DataFrame, key: str, value: str, shares: dict[str, float], cells: int = 64, ends: bool = False) -> DataFrame:
    """Per key: n, mean and, for each share p, the value at place min(floor(p * n), n - 1) of the
    ascending order, exactly; nan is the greatest value. With `ends`, also min and max.

    A key may hold any number of rows. A quantile sketch per key, made in one aggregation, gives each place a
    bracket of values; one more pass counts what lies below a bracket and the values inside, of which
    the running sum picks the place. A bracket that misses its place (a sketch may err) is widened to all values;
    one with more than MOST_INSIDE distinct values is narrowed to one of so many cells until they can be ordered."""
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    names = list(shares)
    total = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("min"), F.max("v").alias("max"), F.kll_sketch_agg_double("v", SKETCH).alias("q"))
    edge = lambda p, off: _quantile(f"{min(1.0, max(0.0, p + off))}D")  # noqa: E731  ranks are constants
    few = F.col("n") <= SKETCH  # a place is not close to its share then
    parts = [F.struct(F.lit(x).alias("name"), F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1).alias("place"), F.expr(edge(p, -4 * ERROR)).alias("lo"), F.expr(edge(p, 4 * ERROR)).alias("hi")) for x, p in shares.items()]
    brackets = total.select("k", "n", "s", "min", "max", F.explode(F.array(*parts)).alias("w")).select("k", "n", "s", "min", "max", "w.*")
    brackets = brackets.withColumns({"lo": F.when(few | F.col("lo").isNull(), F.col("min")).otherwise(F.col("lo")), "hi": F.when(few | F.col("hi").isNull(), F.col("max")).otherwise(F.col("hi"))})
    brackets = written(brackets, "brackets")
    inside = written(_inside(rows, brackets), "inside")
    while True:
        below = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0))
        state = _both(brackets, inside.groupBy("k", "name").agg(F.count("v").alias("values"), below.alias("below"), F.sum("c").alias("upto")), "left")
        missed = F.col("below").isNull() | (F.col("place") < F.col("below")) | (F.col("place") >= F.col("upto"))
        lost, most = state.agg(F.coalesce(F.bool_or(missed), F.lit(False)), F.coalesce(F.max("values"), F.lit(0))).first()
        if lost:
            wide = state.withColumns({"lo": F.when(missed, F.col("min")).otherwise(F.col("lo")), "hi": F.when(missed, F.col("max")).otherwise(F.col("hi"))})
            brackets = written(wide.select(brackets.columns), "brackets")
            inside = written(_inside(rows, brackets), "inside")
        elif most > MOST_INSIDE:
            brackets = written(_narrowed(inside, brackets, cells), "brackets")
            own = _both(inside, brackets.select("k", "name", "lo", "hi")).where("v IS NULL OR v <= hi")
            inside = written(own.groupBy("k", "name", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.sum("c").alias("c")), "inside")
        else:
            break
    upto = F.sum("c").over(Window.partitionBy("k", "name").orderBy(F.col("v").asc_nulls_first()))
    found = _both(inside.withColumn("upto", upto), brackets).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
    out = found.groupBy("k").agg(F.max("n").cast("long").alias("_n"), F.round(F.max("s") / F.max("n"), 2).alias("_mean"), F.max("min").alias("_min"), F.max("max").alias("_max"), *(F.max(F.when(F.col("name") == x, F.col("v"))).alias(f"_{x}") for x in names))
    return out.select(F.col("k").alias(key), *(F.col(f"_{x}").alias(x) for x in ["n", "mean", *names, *(["min", "max"] if ends else [])]))
