"""The whole evaluation report: every figure as a row, and all of them as one nested row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.numbers import order_stats, rate
from quillgraph.functions.text import option_letter

SUMS = {"regular_input": "total_prompt_tokens", "cache_read": "cache_read_tokens", "cache_creation": "cache_creation_tokens", "completion": "total_completion_tokens"}
ERRORS = {"api_error_total": "api_error_count", "transient_retry_total": "transient_retry_count", "tool_call_error_total": "tool_errors"}
MEANS = {"budget": "budget_used", "turns": "total_turns", "wall_time": "wall_time_s", "prompt": "total_prompt_tokens", "completion": "total_completion_tokens"}
SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95}


def _or(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("?"))


def _keys() -> dict[str, Column]:
    """Which bucket of each grouping a run is in; null: in none."""
    two = (F.col("question_type") == "multi-target") & (F.col("depth") == 2)
    bridge = F.when(F.col("bridge_necessary"), "necessary").when(~F.col("bridge_necessary"), "optional").otherwise("unlabeled")
    letter = lambda c: F.when(F.col(c).between(0, 3), option_letter(F.col(c)))
    return {
        "by_type": _or("question_type"), "by_depth": F.concat(F.lit("d"), F.coalesce("depth", F.lit(0)).cast("string")), "by_reasoning": _or("reasoning_type"), "by_venue": _or("venue"),
        "by_tier": _or("tier"), "by_agreement": F.concat(F.lit("agree_"), _or("filter_agreement")), "by_bridge": F.when(two, bridge), "by_termination": F.coalesce("terminated_by", F.lit("")),
        "predicted": letter("predicted_index"), "correct_position": letter("correct_index"), "retry_count": F.coalesce("retry_count", F.lit(0)).cast("string"), "overall": F.lit("all"),
    }


def _failure() -> Column:
    kind = F.get("distractor_types", F.col("predicted_index"))
    return F.when(F.coalesce("predicted_index", F.lit(-1)) < 0, "no_answer").when(kind.isNull() | (kind == "correct"), "unknown").otherwise(kind)


def report_rows(runs: DataFrame) -> DataFrame:
    """(section, key, n, correct, value): counts with accuracies, failures with rates, sums with means,
    order statistics. runs: one row per sample with its trajectory's totals. The groupings are one
    pass with partial sums; no list of samples is gathered (retry_lists has them)."""
    ok = F.coalesce("is_correct", F.lit(False))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in _keys().items())))
    hit = F.count_if(F.col("ok"))
    groups = runs.select(ok.alias("ok"), each.alias("g")).select("ok", "g.*").where("key IS NOT NULL").groupBy("section", "key")
    groups = groups.agg(F.count("*").alias("n"), hit.alias("correct"), rate(hit, F.count("*")).alias("value"))
    letters = runs.sparkSession.createDataFrame([(s, x) for s in ("predicted", "correct_position") for x in "ABCD"], "section string, key string")
    none = letters.join(groups, ["section", "key"], "left_anti").select("section", "key", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("correct"), F.lit(0.0).alias("value"))

    wrong = runs.where(~ok).groupBy(_failure().alias("key")).agg(F.count("*").alias("n"))
    total = wrong.agg(F.sum("n").alias("of"))
    failures = wrong.join(F.broadcast(total)).select(F.lit("failure").alias("section"), "key", "n", F.lit(0).cast("long").alias("correct"), rate("n", "of").alias("value"))  # one row

    one = runs.agg(F.count("*").alias("runs"), *(F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(k) for k, c in SUMS.items()), *(F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(k) for k, c in ERRORS.items()), *(F.avg(F.coalesce(c, F.lit(0))).alias(f"mean_{k}") for k, c in MEANS.items()))
    input_ = F.col("regular_input") + F.col("cache_read") + F.col("cache_creation")
    figure = lambda section, key, n, value: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), n.cast("long").alias("n"), F.lit(0).cast("long").alias("correct"), value.cast("double").alias("value"))
    figures = [figure("tokens", k, F.col(k), F.round(F.col(k) / F.col("runs"), 1)) for k in SUMS] + [figure("tokens", "total_input", input_, rate("cache_read", input_))]
    figures += [figure("errors", k, F.col(k), F.lit(0.0)) for k in ERRORS] + [figure("means", k, F.col("runs"), F.round(F.col(f"mean_{k}"), 1)) for k in MEANS]
    sums = one.where("runs > 0").select(F.explode(F.array(*figures)).alias("f")).select("f.*")

    out = groups.unionByName(none).unionByName(failures).unionByName(sums)
    for section, c in (("turns", "total_turns"), ("wall_time", "wall_time_s")):
        stats = order_stats(runs.select(F.lit(1).alias("k"), F.coalesce(c, F.lit(0)).alias("v")), "k", "v", SHARES)
        shown = F.explode(F.array(*(F.struct(F.lit(x).alias("key"), F.col(x).cast("double").alias("value")) for x in ("mean", *SHARES)))).alias("f")
        out = out.unionByName(stats.select(F.lit(section).alias("section"), "n", F.lit(0).cast("long").alias("correct"), shown).select("section", "f.key", "n", "correct", "f.value"))
    return out


def evaluation(runs: DataFrame, fingerprint: dict[str, str] | None = None) -> DataFrame:
    """The report as one row: fingerprint, total, correct and sections, a map of section to a map of key
    to (n, correct, value). Keys are kinds, never samples, so the row stays small."""
    rows = report_rows(runs)
    per = rows.groupBy("section").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "correct", "value")))).alias("figures"))
    out = per.agg(F.map_from_entries(F.collect_list(F.struct("section", "figures"))).alias("sections"))
    facts = F.create_map(*(F.lit(x) for kv in (fingerprint or {}).items() for x in kv)) if fingerprint else F.lit(None).cast("map<string,string>")
    whole = F.element_at(F.element_at("sections", "overall"), "all")
    return out.select(facts.alias("fingerprint"), F.coalesce(whole["n"], F.lit(0)).alias("total"), F.coalesce(whole["correct"], F.lit(0)).alias("correct"), "sections")


def retry_lists(runs: DataFrame) -> DataFrame:
    """(list, sample_id): samples with transient retries, those rerun with success and those rerun in vain."""
    again = F.coalesce("retry_count", F.lit(0)) > 0
    failed = F.coalesce("terminated_by", F.lit("")) == "error"
    of = F.array_compact(F.array(F.when(F.coalesce("transient_retry_count", F.lit(0)) > 0, "transient"), F.when(again & ~failed, "succeeded"), F.when(again & failed, "failed")))
    return runs.select(F.explode(of).alias("list"), "sample_id").orderBy("list", "sample_id")


def filter_report(chains: DataFrame) -> DataFrame:
    """(section, key, n, value) of a chain filter: decisions, context types, pairs of them, and least,
    middle and greatest reference overlap. chains: decision, type1, type2, jaccard."""
    count = lambda section, key: chains.select(F.lit(section).alias("section"), key.alias("key")).groupBy("section", "key").agg(F.count("*").alias("n")).withColumn("value", F.lit(0.0))
    types = chains.select(F.explode(F.array("type1", "type2")).alias("t"))
    out = count("decision", F.col("decision")).unionByName(count("pair", F.concat_ws("+", "type1", "type2")))
    out = out.unionByName(types.groupBy(F.col("t").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), "key", "n", F.lit(0.0).alias("value")))
    return out.unionByName(spread(chains.select(F.lit("jaccard").alias("section"), F.col("jaccard").alias("v")), "section", "v"))


def spread(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(section, key, n, value): least, middle (at place n // 2) and greatest value per key."""
    j = order_stats(rows, key, value, {"median": 0.5}, ends=True)
    shown = F.explode(F.array(*(F.struct(F.lit(x).alias("key"), F.col(x).cast("double").alias("value")) for x in ("min", "median", "max")))).alias("f")
    return j.select(F.col(key).cast("string").alias("section"), "n", shown).select("section", "f.key", "n", "f.value")


def tally(rows: DataFrame, *parts: Column) -> DataFrame:
    """Counts by the parts joined by a colon, as in type:verdict."""
    return rows.groupBy(F.concat_ws(":", *parts).alias("key")).agg(F.count("*").alias("n"))


def means_by(rows: DataFrame, key: str, columns: list[str], places: int = 1) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.round(F.avg(c), places).alias(f"mean_{c}") for c in columns))


def coverage(rows: DataFrame, column: str, full: str, slim: str) -> DataFrame:
    """Share of rows with a text, and how many times smaller one form is than another."""
    has = F.count_if(F.coalesce(F.col(column), F.lit("")) != "")
    return rows.agg(F.count("*").alias("n"), has.alias("have"), rate(has, F.count("*")).alias("share"), rate(F.sum(F.octet_length(full)), F.sum(F.octet_length(slim)), 2).alias("ratio"))
