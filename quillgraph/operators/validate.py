"""Integrity checks: one wide row of conditions, an array of the issues that hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(checks: list[tuple[Column, Column | str]], fatal: int = 0) -> Column:
    """Names of the checks that hold, in order; if one of the first `fatal` holds, it alone."""
    name = lambda n: F.lit(n) if isinstance(n, str) else n
    held = lambda cs: F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), name(n)) for c, n in cs)), lambda x: x.isNotNull())
    if not fatal:
        return held(checks)
    first = held(checks[:fatal])
    return F.when(F.size(first) > 0, F.slice(first, 1, 1)).otherwise(held(checks[fatal:]))


def issue_histogram(rows: DataFrame, column: str = "issues") -> DataFrame:
    """How many rows have each issue, by its name before a colon."""
    return rows.select(F.explode(column).alias("x")).groupBy(F.split("x", ":")[0].alias("issue")).agg(F.count("*").alias("n"))


def single_target_checks() -> list[tuple[Column, str]]:
    """Over columns terminal, seed, depth, bridge, terminal_sections, seed_sections, keywords_found, options."""
    c = F.col
    return [
        (c("terminal").isNull() | (c("terminal") == ""), "MISSING_TERMINAL"), (c("seed").isNull() | (c("seed") == ""), "MISSING_SEED"),
        (c("terminal") == c("seed"), "SELF_REFERENCE"), ((c("depth") == 2) & c("bridge").isNull(), "NO_BRIDGE_PATH"),
        (F.coalesce("terminal_sections", F.lit(0)) == 0, "TERMINAL_NO_CONTENT"), (F.coalesce("seed_sections", F.lit(0)) == 0, "SEED_NO_CONTENT"),
        (F.coalesce(F.size("options"), F.lit(0)) != 4, "BAD_OPTIONS"), (F.coalesce("keywords_found", F.lit(0)) == 0, "WARN_NO_KEYWORDS"),
    ]


def drop_flagged(rows: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    return rows.join(flagged.select(key).distinct(), key, "left_anti")
