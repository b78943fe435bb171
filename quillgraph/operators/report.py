"""The evaluation report over trajectories: accuracy, failures, retrieval, navigation, tools, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.numbers import rate
from quillgraph.functions.text import option_letter, section_match


def _accuracy(ok: str = "is_correct") -> list[Column]:
    hit = F.count_if(F.col(ok))
    return [F.count("*").alias("n"), hit.alias("correct"), rate(hit, F.count("*")).alias("accuracy")]


def bucket_accuracy(rows: DataFrame, sets: list[list[str]], ok: str = "is_correct") -> DataFrame:
    """n, correct and accuracy for several groupings in one pass (a column outside a grouping is null)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("level"), *_accuracy(ok))


# The fields of a sample with their types and what stands for a missing one (None: it stays null).
SAMPLE = {
    "id": ("string", ""), "question_type": ("string", ""), "depth": ("int", 0), "reasoning_type": ("string", ""), "cognitive_skill": ("string", ""), "venue": ("string", ""), "consensus_tier": ("string", ""),
    "question": ("string", ""), "options": ("array<string>", []), "correct_index": ("int", 0), "distractor_types": ("array<string>", None), "seed_paper_id": ("string", ""), "seed_arxiv_id": ("string", ""), "seed_title": ("string", ""),
    "gold_paper_ids": ("array<string>", []), "gold_arxiv_ids": ("array<string>", []), "bridge_paper_ids": ("array<string>", []), "bridge_arxiv_ids": ("array<string>", []), "filter_agreement": ("string", None),
}


def samples(rows: DataFrame) -> DataFrame:
    """The fields of SAMPLE, in their order and types, of rows that may lack any of them or hold nulls; other columns go."""
    out = []
    for name, (kind, default) in SAMPLE.items():
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        given = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
        out.append((value if default is None else F.coalesce(value, given)).alias(name))
    return rows.select(*out)


def by_bridge(rows: DataFrame) -> DataFrame:
    """Accuracy of two-step multi-target samples by whether the bridge is needed (three-valued)."""
    d = rows.where("question_type = 'multi-target' AND depth = 2")
    state = F.when(F.col("bridge_necessary"), F.lit("necessary")).when(~F.col("bridge_necessary"), F.lit("optional")).otherwise(F.lit("unlabeled"))
    return d.groupBy(state.alias("bridge")).agg(*_accuracy())


def position_bias(rows: DataFrame) -> DataFrame:
    """For each of A to D: how often predicted, how often right, accuracy where it is right."""
    pred = rows.where("predicted_index BETWEEN 0 AND 3").groupBy(option_letter(F.col("predicted_index")).alias("letter")).agg(F.count("*").alias("predicted"))
    true = rows.where("correct_index BETWEEN 0 AND 3").groupBy(option_letter(F.col("correct_index")).alias("letter")).agg(F.count("*").alias("correct_at"), F.count_if("is_correct").alias("hits"))
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in "ABCD"], "letter string")
    zero = F.lit(0)
    return every.join(pred, "letter", "left").join(true, "letter", "left").select("letter", F.coalesce("predicted", zero).alias("predicted"), F.coalesce("correct_at", zero).alias("correct_at"), rate("hits", "correct_at").alias("accuracy"))


def failure_attribution(rows: DataFrame) -> DataFrame:
    """Wrong answers by the kind of distractor taken; no answer and unknown apart."""
    kind = F.get("distractor_types", F.col("predicted_index"))
    why = F.when(F.col("predicted_index") < 0, F.lit("no_answer")).when(kind.isNull() | (kind == "correct"), F.lit("unknown")).otherwise(kind)
    n = rows.where(~F.coalesce("is_correct", F.lit(False))).groupBy(why.alias("failure")).agg(F.count("*").alias("n"))
    return n.withColumn("rate", rate(F.col("n"), F.sum("n").over(Window.partitionBy())))  # a row per kind of failure


def first_label_hits(reads: DataFrame, labels: DataFrame) -> DataFrame:
    """Per read of a gold paper (sample, read, paper, section): the first label of that paper whose
    section it matches, and whether that label is a direct one."""
    j = reads.join(labels.select("sample", "paper", F.col("pos").alias("label_pos"), F.col("section").alias("label_section"), "relevance"), ["sample", "paper"])
    hit = j.where(section_match(F.col("section"), F.col("label_section")))
    first = hit.groupBy("sample", "read").agg(F.min_by("relevance", "label_pos").alias("relevance"))
    return first.select("sample", "read", (F.col("relevance") == "direct").alias("direct"))


def retrieval(samples: DataFrame, reads: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of retrieval metrics. samples: sample, is_correct, gold, bridges (arrays); reads:
    sample, read, paper, section; labels: sample, paper, pos, section, relevance."""
    r = reads.join(samples.select("sample", "gold", "bridges"), "sample")
    r = r.withColumn("role", F.when(F.array_contains("gold", F.col("paper")), F.lit("gold")).when(F.array_contains("bridges", F.col("paper")), F.lit("bridge")).otherwise(F.lit("wasted")))
    hits = first_label_hits(r.where("role = 'gold'"), labels)
    h = hits.groupBy("sample").agg(F.bool_or("direct").alias("hard"), F.lit(True).alias("soft"))
    per = r.groupBy("sample").agg(F.count("*").alias("reads"), F.count_if(F.col("role") == "wasted").alias("wasted"), F.bool_or(F.col("role") == "gold").alias("reached"))
    d = samples.join(per, "sample", "left").join(h, "sample", "left")
    n = F.count("*")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return d.agg(
        n.alias("n"), rate(yes("reached"), n).alias("paper_recall"), rate(yes("hard"), n).alias("section_recall_hard"), rate(yes("soft"), n).alias("section_recall_soft"),
        rate(F.count_if(F.coalesce("reached", F.lit(False)) & F.col("is_correct")), yes("reached")).alias("conversion"), rate(F.coalesce(F.sum("wasted"), F.lit(0)), F.coalesce(F.sum("reads"), F.lit(0))).alias("wasted_rate"),
    )


def navigation(records: DataFrame) -> DataFrame:
    """Navigation patterns: group (kind and depth), bucket, n, share, correct, accuracy. records:
    question_type, depth, targets, bridges (reached), all_targets, used_search, is_correct."""
    t, b, all_ = F.col("targets"), F.col("bridges"), F.col("all_targets")
    single = F.when((b > 0) & (t > 0), F.lit("bridge_and_target")).when(t > 0, F.when(F.col("used_search"), F.lit("target_only_via_search")).otherwise(F.lit("target_only_skipped_bridge"))).when(b > 0, F.lit("bridge_only")).otherwise(F.lit("neither"))
    reach = F.when(t >= all_, F.lit("reached_all")).otherwise(F.concat(F.lit("reached_"), t.cast("string"), F.lit("_of_"), all_.cast("string")))
    route = F.when(b > 0, F.lit("via_bridge")).when(F.col("used_search"), F.lit("via_search")).otherwise(F.lit("via_seed_cite"))
    multi1 = F.when(t == 0, F.lit("reached_0")).otherwise(reach)
    multi2 = F.when(t == 0, F.when(b > 0, F.lit("reached_0_bridge")).otherwise(F.lit("reached_0"))).otherwise(F.concat(reach, F.lit("__"), route))
    two = F.col("depth") == 2
    d = records.where("question_type IN ('multi-target', 'single-target')").select(
        F.when(F.col("question_type") == "multi-target", F.concat(F.lit("mt_d"), F.col("depth").cast("string"))).when(two, F.lit("st_d2")).otherwise(F.lit("st_d1")).alias("grp"),
        F.when(F.col("question_type") == "multi-target", F.when(two, multi2).otherwise(multi1)).when(two, single).otherwise(F.when(t > 0, F.lit("reached_target")).otherwise(F.lit("missed"))).alias("bucket"), "is_correct",
    )
    n = d.groupBy("grp", "bucket").agg(*_accuracy())
    return n.withColumn("share", rate(F.col("n"), F.sum("n").over(Window.partitionBy("grp"))))  # a few rows per group


def tool_usage(calls: DataFrame) -> DataFrame:
    """calls (sample, tool, cost, rejected): per tool calls, per sample, budget and its share, rejections."""
    samples = calls.agg(F.count_distinct("sample").alias("samples"))
    per = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("cost").alias("budget"), F.count_if("rejected").alias("rejected"))
    d = per.crossJoin(F.broadcast(samples))  # one row
    return d.select("tool", "calls", F.round(F.col("calls") / F.col("samples"), 4).alias("per_sample"), "budget", rate(F.col("budget"), F.sum("budget").over(Window.partitionBy())).alias("budget_share"), rate("rejected", "calls").alias("rejection_rate"))


def turn_profile(turns: DataFrame, value: str) -> DataFrame:
    """Mean of a value by the place of a turn in its trajectory (turns: sample, ordered by ord)."""
    w = Window.partitionBy("sample").orderBy("ord")
    return turns.withColumn("k", F.row_number().over(w) - 1).groupBy("k").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def cost(prompt: Column, completion: Column, read: Column, created: Column, price: Column) -> Column:
    """Dollars by part, rounded to 6 places; price: struct in_per_m, out_per_m, read_mult, write_mult."""
    parts = {
        "regular_input_usd": prompt * price["in_per_m"] / 1e6, "cache_read_usd": read * price["in_per_m"] * price["read_mult"] / 1e6,
        "cache_creation_usd": created * price["in_per_m"] * price["write_mult"] / 1e6, "output_usd": completion * price["out_per_m"] / 1e6,
    }
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    return F.struct(*(F.round(v, 6).alias(k) for k, v in (parts | {"total_usd": total}).items()))


def token_cap(rows: DataFrame, sample: str, order: list[str], value: str, cap: float) -> DataFrame:
    """Running total per sample and whether it is past the cap."""
    w = Window.partitionBy(sample).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(value).over(w)).withColumn("over", F.col("used") > cap)


def retry_histogram(rows: DataFrame, count: str = "retries") -> DataFrame:
    """How many samples had each number of retries, and how many retries in all."""
    return rows.groupBy(F.coalesce(count, F.lit(0)).alias("retries")).agg(F.count("*").alias("n"), F.sum(F.coalesce(count, F.lit(0))).alias("total"))


def read_section_name(output: Column, asked: Column) -> Column:
    """The section a read resolved to: from the output's header line, else as asked; null if refused."""
    named = F.regexp_extract(output, r"^===\s*(.+?)\s*===", 1)
    return F.when(F.startswith(output, F.lit("REJECTED")) | F.startswith(output, F.lit("[ERROR")), F.lit(None)).when(named != "", named).otherwise(F.coalesce(asked, F.lit("")))


def section_reads(trajectories: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sections that trajectories (sample_id, turns) read: sample, read (its place), paper, section; nodes:
    sample, pid, arxiv_id. Refused reads and papers without an arXiv id are left out."""
    t = trajectories.select(F.col("sample_id").alias("sample"), F.posexplode("turns").alias("t", "turn")).select("sample", "t", F.posexplode("turn.tool_results").alias("k", "r"))
    arg = lambda name: F.element_at("r.args", F.lit(name))
    t = t.where("r.name = 'read_section'").select("sample", (F.col("t") * 1000 + F.col("k")).alias("read"), arg("paper_id").alias("pid"), read_section_name(F.coalesce("r.output", F.lit("")), arg("section")).alias("section"))
    named = nodes.where("arxiv_id <> ''").select("sample", "pid", F.col("arxiv_id").alias("paper"))
    return t.where("section IS NOT NULL").join(named, ["sample", "pid"]).select("sample", "read", "paper", "section")
