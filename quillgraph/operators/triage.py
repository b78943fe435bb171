"""Cases for review, batches for an audit, and checks of questions with several targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.sections import any_match
from quillgraph.operators.joins import first_title

MOST_CHARS = 800_000


def triage_cases(claims: DataFrame, labels: DataFrame, pool: DataFrame) -> DataFrame:
    """First claims that were found false (claims: sample, idx, verified, title, section), then direct
    labels whose section their paper lacks (labels: sample, idx, relevance, arxiv_id, title, section).

    pool: arxiv_id, pos, title, sections. A claim's paper goes by its title, equal or beginning alike;
    a label's by its id, or by its title where the pool lacks the id. Of equal titles the last paper
    counts. Returns ord, case_id, type, sample, arxiv_id, section, n_sections."""
    name = F.lower(F.trim("title"))
    named = pool.where("title <> ''").groupBy(name.alias("title")).agg(F.max_by("arxiv_id", "pos").alias("tid"), F.min("pos").alias("pos"))
    papers = pool.groupBy("arxiv_id").agg(F.max_by("sections", "pos").alias("sections"))
    size = F.coalesce(F.size("sections"), F.lit(0))
    false = claims.where("verified = false").withColumn("case_id", F.concat(F.lit("vf_"), "sample", F.lit("_c"), "idx"))
    of = first_title(false.select(F.col("case_id").alias("qid"), "title"), named).select(F.col("qid").alias("case_id"), F.col("tid").alias("arxiv_id"))
    vf = false.join(of, "case_id", "left").join(papers, "arxiv_id", "left")
    vf = vf.select(F.lit(0).alias("ord"), "case_id", F.lit("verified_false").alias("type"), "sample", F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"), "section", F.greatest(size, F.lit(0)).alias("n_sections"))

    direct = labels.where("relevance = 'direct' AND coalesce(arxiv_id, '') <> ''")
    direct = direct.join(papers.select("arxiv_id", F.lit(True).alias("known")), "arxiv_id", "left")
    titles = named.select(F.col("title").alias("_t"), "tid")
    direct = direct.join(titles, (F.lower(F.trim("title")) == F.col("_t")) & F.col("known").isNull(), "left").withColumn("arxiv_id", F.coalesce("tid", "arxiv_id")).drop("_t", "tid", "known")
    # headers are compared once for each paper and section, however many labels name them
    pairs = direct.select("arxiv_id", F.col("section").alias("_s")).distinct().join(papers, "arxiv_id", "left")
    pairs = pairs.where(~F.coalesce(any_match(F.col("sections"), F.col("_s")), F.lit(False))).withColumnRenamed("arxiv_id", "_a")
    missing = direct.join(pairs, (F.col("arxiv_id") == F.col("_a")) & F.col("section").eqNullSafe(F.col("_s")))
    us = missing.select(F.lit(1).alias("ord"), F.concat(F.lit("us_"), "sample", F.lit("_l"), "idx").alias("case_id"), F.lit("unresolved_section").alias("type"), "sample", "arxiv_id", "section", F.greatest(size, F.lit(0)).alias("n_sections"))
    return vf.unionByName(us)


def audit_requests(samples: DataFrame, system: str, most: int = MOST_CHARS) -> DataFrame:
    """samples (id, kind, seed_text, bridges and targets: arrays of texts, question, answer) as requests
    (custom_id, prompt, n_chars); those whose prompts hold more than `most` characters are left out."""
    part = lambda name, c: F.concat(F.lit(f"## {name}\n"), c)
    many = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, "\n")).otherwise(F.lit(none))
    prompt = F.concat_ws(
        "\n\n", F.concat(F.lit("Sample: "), "id", F.lit("\n"), "kind"), part("Seed paper", F.coalesce("seed_text", F.lit(""))), part("Bridge papers", many("bridges", "[none]")),
        part("Target papers", many("targets", "[none]")), part("Question", F.col("question")), part("Correct answer", F.col("answer")),
    )
    d = samples.select(F.col("id").alias("custom_id"), prompt.alias("prompt")).withColumn("n_chars", F.length("prompt") + len(system))
    return d.where(F.col("n_chars") <= most)


def multi_target_checks() -> Column:
    """Issues, then warnings, of a question with several targets, over the columns seed_refs (array),
    targets (array of id, title, has_text, second_step: found by way of a reference, found: the answer's
    keywords in it), depth and keywords. A seed without references has that issue alone."""
    t = F.col("targets")
    short = lambda x: F.concat(F.substring(x["id"], 1, 16), F.lit("..."))
    each = lambda test, say: F.transform(F.filter(t, test), say)
    ghosts = each(lambda x: F.coalesce(x["title"], F.lit("")) == "", lambda x: F.concat(F.lit("TARGET_GHOST: "), short(x)))
    bare = each(lambda x: ~F.coalesce(x["has_text"], F.lit(False)), lambda x: F.concat(F.lit("TARGET_NO_CONTENT: "), short(x)))
    far = each(lambda x: ~F.array_contains(F.col("seed_refs"), x["id"]) & (F.col("depth") == 2) & ~F.coalesce(x["second_step"], F.lit(False)), lambda x: F.concat(F.lit("TARGET_UNREACHABLE: "), short(x)))
    lost = (F.size("keywords") > 0) & (F.size(t) > 0) & ~F.exists(t, lambda x: F.coalesce(x["found"], F.lit(False)))
    warn = F.when(lost, F.array(F.concat(F.lit("ANSWER_NOT_IN_TARGETS: 0/"), F.size("keywords").cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size("seed_refs"), F.lit(0)) <= 0, F.array(F.lit("SEED_NO_REFS"))).otherwise(F.concat(ghosts, bare, far, warn))
