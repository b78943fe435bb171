"""Review work: applying verdicts, progress, merged review items, changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_parts(cases: DataFrame, column: str = "case_id") -> DataFrame:
    """kind, sample and index of a case id; ids of another form are an error."""
    p = r"^(vf|us)_(\w+)_[cl](\d+)$"
    part = lambda g: F.regexp_extract(F.col(column), p, g)
    bad = F.raise_error(F.concat(F.lit("bad case id: "), F.col(column)))
    return cases.withColumn("kind", F.when(part(1) == "", bad.cast("string")).otherwise(part(1))).withColumn("sample", part(2)).withColumn("idx", F.when(part(3) != "", part(3)).cast("int"))


def apply_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims (sample, kind, idx, section, relevance) after verdicts (sample, kind, idx, verdict,
    repoint_to): drop_sample, drop, repoint and demote; the old value stays beside a changed one."""
    gone = verdicts.where("verdict = 'drop_sample'").select("sample").distinct()
    own = verdicts.where("verdict <> 'drop_sample'").groupBy("sample", "kind", "idx").agg(F.max_by(F.struct("verdict", "repoint_to"), F.struct("verdict", "repoint_to")).alias("v"))
    d = claims.join(gone, "sample", "left_anti").join(own, ["sample", "kind", "idx"], "left").where("v IS NULL OR v.verdict <> 'drop'")
    moved, demoted = F.coalesce(F.col("v.verdict") == "repoint", F.lit(False)), F.coalesce(F.col("v.verdict") == "demote", F.lit(False))
    return d.select(
        "sample", "kind", "idx", F.when(moved, F.col("v.repoint_to")).otherwise(F.col("section")).alias("section"), F.when(moved, F.col("section")).alias("repointed_from"),
        F.when(demoted, F.lit("supporting")).otherwise(F.col("relevance")).alias("relevance"), F.when(demoted, F.col("relevance")).alias("demoted_from"),
    )


def progress(items: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """One row: all, done, remaining and the first item not done."""
    d = items.join(done.select(key).distinct().withColumn("_d", F.lit(1)), key, "left")
    return d.agg(F.count("*").alias("total"), F.count("_d").alias("done"), (F.count("*") - F.count("_d")).alias("remaining"), F.min_by(key, F.when(F.col("_d").isNull(), F.col(order))).alias("first_open"))


def merge_reasons(sources: list[DataFrame]) -> DataFrame:
    """Items (id, reason) of several sources as one row per id: distinct reasons in order of source."""
    every = None
    for i, d in enumerate(sources):
        one = d.select("id", F.lit(i).alias("o"), "reason")
        every = one if every is None else every.unionByName(one)
    items = F.array_sort(F.collect_set(F.struct("o", "reason")))
    return every.groupBy("id").agg(F.array_distinct(F.transform(items, lambda x: x["reason"])).alias("reasons"), F.count_distinct("o").alias("sources"))
