"""Mixing sources to target weights (native: DataFrame functions only).

Each row gets a hash-random key; within a source the rows are ordered by it and the
prefix sums of their sizes are cut at the source's budget. As the key is uniform, its
leading hex digits deal the rows of even the hottest source into equal key ranges: the
sums of the ranges are added up first (one row per source and range), then each range
is added up on its own, so no task sees a whole source.

Defined results: null or empty text has size 0 and takes 0; a null source is a source
of its own, after all others; rows that repeat get equal keys, hence neighbouring
places; an empty table gives an empty result; other columns are kept unless one of them
carries the name of a result column, which then replaces it; helper columns have names
that no column of docs has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # of the key, for the ranges: 4096 of each source


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weight: Column | None = None, most: int = 3, share: int = 100) -> DataFrame:
    """Adds weight and target to a table (source, source_size) of one row per source.

    Targets are in proportion to the weights (1, 2, 3 repeating in code point order, null
    last, unless given), add up to share % of all sizes and stop at most x the source's
    size, the excess going to the others by weight: target = min(cap, level x weight),
    where the level follows from the sources in order of cap / weight.
    The windows below run over one row per source, never over rows of data.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = (F.row_number().over(order) - 1) % 3 + 1 if weight is None else weight
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (
        s.withColumn("left", (F.sum("source_size").over(every) * share / 100).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("cap").cast("double") * F.col("weights") <= F.col("left") * F.col("weight"))
    )
    # the first source that does not fill up sets the level; every later one gets it too
    place = F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))
    level = F.min_by(F.struct("left", "weights"), place).over(every)
    s = s.withColumn("level", level)
    return s.select(
        "source", "source_size", "weight",
        F.when(F.col("full") | F.col("level").isNull(), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("level.left") / F.col("level.weights")).alias("target"),
    )


def mix(docs: DataFrame, seed: str = "mix", weight: Column | None = None, most: int = 3, share: int = 100) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted).

    A budget of q whole epochs and a rest takes every row q times and, in order of the
    keys, rows up to the rest; the row at the cut gives just the words that are missing.
    """
    spare = spare_names(docs)
    key, digits, in_range, before_range, s_, r_, g_, w_ = (spare(x) for x in ("key", "digits", "in_range", "before_range", "s", "r", "g", "weight"))
    d = docs.drop("size", "source_size", "target", "taken")
    d = d.withColumns({"size": n_words(), key: F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))})
    d = d.withColumn(digits, F.substring(key, 1, DIGITS))
    ranges = d.groupBy(F.col("source").alias("source"), F.col(digits).alias(r_)).agg(F.sum("size").alias(in_range))
    goal = targets(ranges.groupBy("source").agg(F.sum(in_range).alias("source_size")), weight, most, share)
    goal = goal.withColumnsRenamed({"source": g_, "weight": w_}).drop(w_)
    by = Window.partitionBy("source").orderBy(r_)
    starts = ranges.withColumn(before_range, F.sum(in_range).over(by) - F.col(in_range)).withColumnRenamed("source", s_)
    starts = starts.join(goal, F.col(s_).eqNullSafe(F.col(g_))).drop(g_, in_range)
    j = d.join(starts, F.col("source").eqNullSafe(F.col(s_)) & (F.col(digits) == F.col(r_))).drop(s_, r_)
    inside = Window.partitionBy("source", digits).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col(before_range) + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.expr("try_divide(floor(target), source_size)"), F.lit(0))
    rest = budget - F.floor(epochs).cast("long") * F.col("source_size")
    taken = F.floor(epochs).cast("long") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before)).cast("long")
    return j.withColumn("taken", taken).drop(key, digits, before_range)


def spare_names(docs: DataFrame):
    """Names that docs does not have, whatever it has (names ignore case)."""
    known = {c.lower() for c in docs.columns}

    def name(x: str) -> str:
        x = f"_{x}"
        while x in known:
            x += "_"
        return x

    return name


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each row once per epoch, and the row at
    the cut shortened to the words it gives (joined by one space)."""
    keep = docs.columns
    spare = spare_names(docs)
    own = {c: spare(f"own_{c}") for c in keep if c.lower() in ("size", "source_size", "target", "taken")}
    n_ = spare("n")
    m = mix(docs.withColumnsRenamed(own), **options)
    whole = F.coalesce(F.expr("try_divide(taken, size)"), F.lit(0)).cast("long")
    # each element: how many words this copy gives
    copies = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.when(F.col("taken") > whole * F.col("size"), F.array(F.col("taken") - whole * F.col("size"))).otherwise(F.array().cast("array<bigint>")))
    m = m.withColumn(n_, F.explode(copies))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col(n_).cast("int")), " ")
    m = m.withColumn("text", F.when(F.col(n_) < F.col("size"), cut).otherwise(F.col("text")))
    if "n_chars" in keep:
        m = m.withColumn("n_chars", F.when(F.col(n_) < F.col("size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return m.select(*(F.col(own.get(c, c)).alias(c) for c in keep))


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS room,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap::DOUBLE * weights <= room * weight AS filled FROM f),
l AS (SELECT room, weights FROM g WHERE NOT filled ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (SELECT g.source, source_size,
             CASE WHEN filled THEN cap::DOUBLE ELSE weight * (SELECT room FROM l) / (SELECT weights FROM l) END AS target FROM g),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) * size ELSE 0 END
   + greatest(0, least(size, floor(target) - CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) * source_size ELSE 0 END - before)))::BIGINT AS taken
FROM p
"""
