"""Gates over ensemble votes in long form: qid, provider, answer, truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def right_votes(votes: DataFrame, key: str = "qid") -> DataFrame:
    """Per question the votes and the right ones."""
    return votes.groupBy(key).agg(F.count("*").alias("votes"), F.count_if(F.col("answer") == F.col("truth")).alias("right"))


def gate_a(votes: DataFrame, threshold: int = 2) -> DataFrame:
    """Questions answerable without the papers go: discarded from `threshold` right votes."""
    return right_votes(votes).withColumn("passed", F.col("right") < threshold)


def gate_b(votes: DataFrame, threshold: int = 2) -> DataFrame:
    """votes with column paper: whether any single paper suffices."""
    per = votes.groupBy("qid", "paper").agg(F.count_if(F.col("answer") == F.col("truth")).alias("right"))
    return per.groupBy("qid").agg(F.max("right").alias("best"), F.bool_or(F.col("right") >= threshold).alias("sufficient"))


def gate_c(votes: DataFrame, papers: DataFrame, threshold: int = 2) -> DataFrame:
    """Questions stay that get `threshold` right votes with all papers; below two papers all votes count as right."""
    d = right_votes(votes).join(papers, "qid", "left")
    right = F.when(F.coalesce("papers", F.lit(0)) < 2, F.col("votes")).otherwise(F.col("right"))
    return d.select("qid", right.alias("right"), ((F.coalesce("papers", F.lit(0)) < 2) | (F.col("right") >= threshold)).alias("passed"))


def gates(votes: DataFrame, a: int = 2, b: int = 2, c: int = 2) -> DataFrame:
    """gate_a, gate_b and gate_c in one pass (a_passed, sufficient, c_right, c_passed), their thresholds given; all papers
    of a question's votes are its papers. One grouping per paper inside one per question, which share a distribution by qid."""
    per = votes.groupBy("qid", "paper").agg(F.count("*").alias("votes"), F.count_if(F.col("answer") == F.col("truth")).alias("right"))
    d = per.groupBy("qid").agg(F.sum("votes").alias("votes"), F.sum("right").alias("right"), F.count("paper").alias("papers"), F.bool_or(F.col("right") >= b).alias("sufficient"))
    few = F.col("papers") < 2
    return d.select("qid", "votes", "right", (F.col("right") < a).alias("a_passed"), "sufficient", F.when(few, F.col("votes")).otherwise(F.col("right")).alias("c_right"), (few | (F.col("right") >= c)).alias("c_passed"))


def tier(a: Column, c: Column, a_passed: Column) -> Column:
    """gold: none right alone and all three together; silver: all three together; rejected where gate A
    fails; bronze otherwise."""
    return F.when(~a_passed, F.lit("rejected")).when((a == 0) & (c == 3), F.lit("gold")).when((a != 0) & (c == 3), F.lit("silver")).otherwise(F.lit("bronze"))
