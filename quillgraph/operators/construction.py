"""Steps that build questions: seeds, chains, distractors, model calls in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import is_survey, numeric_overlap, strip, word_jaccard

# Context types that promise a question, and those that do not.
PROMISING = ("limitation_resolution", "comparison", "evolution", "provenance", "evidence_assessment")
WEAK = ("data_reuse", "background_cite")


def eligible_seeds(papers: DataFrame, excluded: DataFrame, least: int = 15, most: int = 50) -> DataFrame:
    """papers (paperId, arxivId, title, referenceCount, publicationTypes, pos) that may be seeds, the
    first of each id."""
    ok = papers.where((F.coalesce("paperId", F.lit("")) != "") & (F.coalesce("arxivId", F.lit("")) != "") & F.coalesce("referenceCount", F.lit(0)).between(least, most))
    ok = ok.where(~is_survey(F.col("title"), F.col("publicationTypes"))).join(excluded.select("paperId").distinct(), "paperId", "left_anti")
    w = Window.partitionBy("paperId").orderBy("pos")
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def recent_enough(year: Column, floor: int = 2020) -> Column:
    """False only for a known year below the floor."""
    return ~F.coalesce((year < floor) & (year != 0), F.lit(False))


def trim_tiers(seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """The best covered seeds of each tier (seeds: tier, coverage, pos; targets: tier, target)."""
    w = Window.partitionBy("tier").orderBy(F.col("coverage").desc(), "pos")
    return seeds.withColumn("place", F.row_number().over(w)).join(targets, "tier").where(F.col("place") <= F.col("target")).drop("target")


def fixed_chains(edges: DataFrame, seeds: DataFrame, first: int = 10, second: int = 5) -> DataFrame:
    """Two-step chains: the best `first` references of a seed and the best `second` of each; edges: src,
    dst, pos, score. A node may end several chains."""
    w = Window.partitionBy("src").orderBy(F.col("score").desc(), "pos")
    top = edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(first, second))
    a = top.where(F.col("rank") <= first).join(seeds.select(F.col("seed").alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("hop1"), F.col("score").alias("s1"))
    b = top.where(F.col("rank") <= second).select(F.col("src").alias("hop1"), F.col("dst").alias("hop2"), F.col("score").alias("s2"))
    return a.join(b, "hop1").where("hop2 <> seed").select("seed", "hop1", "hop2", (F.col("s1") + F.col("s2")).alias("chain_score"))


def chain_decision(jaccard: Column, type1: Column, type2: Column, least: float = 0.08, with_model: bool = False) -> Column:
    """What becomes of a chain by reference overlap and its two context types, before any model."""
    strong = type1.isin(*PROMISING) & type2.isin(*PROMISING)
    weak = type1.isin(*WEAK) & type2.isin(*WEAK)
    d = F.when(weak, F.lit("drop_l2"))
    if with_model:
        return d.otherwise(F.lit("pending_llm"))
    return d.when(strong & (jaccard >= least), F.lit("keep_no_llm")).when(strong, F.lit("keep_no_llm_marginal")).otherwise(F.lit("drop_no_llm"))


def inventory(chains: DataFrame) -> DataFrame:
    """Papers of chains (seed, path: array of ids, terminal) with their first role and least depth:
    seed before path before terminal."""
    roles = [chains.select(F.col("seed").alias("id"), F.lit(0).alias("o"), F.lit("seed").alias("role"), F.lit(0).alias("depth"))]
    roles.append(chains.select(F.posexplode("path").alias("d", "id")).select("id", F.lit(1).alias("o"), F.lit("path").alias("role"), (F.col("d") + 1).alias("depth")))
    roles.append(chains.select(F.col("terminal").alias("id"), F.lit(2).alias("o"), F.lit("terminal").alias("role"), (F.size("path") + 1).alias("depth")))
    every = roles[0].unionByName(roles[1]).unionByName(roles[2]).where("id IS NOT NULL AND id <> ''")
    return every.groupBy("id").agg(F.min_by("role", "o").alias("role"), F.min("depth").alias("depth"), F.count("*").alias("uses"))


def valid_distractors(candidates: DataFrame, needed: int = 3, most_words: float = 0.6, most_numbers: float = 0.5) -> DataFrame:
    """candidates (qid, ord, kind, text, answer): those that are neither empty, nor the answer or an
    earlier one again, nor too like the answer; only questions with `needed` of them."""
    t = strip(F.col("text"))
    d = candidates.withColumn("text", t).withColumn("answer", strip(F.col("answer"))).where("text <> '' AND lower(text) <> lower(answer)")
    d = d.where((word_jaccard(F.col("text"), F.col("answer")) <= most_words) & (numeric_overlap(F.col("answer"), F.col("text")) <= most_numbers))
    first = Window.partitionBy("qid", F.lower("text")).orderBy("ord")
    d = d.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return d.withColumn("valid", F.count("*").over(Window.partitionBy("qid"))).where(F.col("valid") >= needed)  # a handful per question


def sibling_choice(siblings: DataFrame, pool: DataFrame, most: int = 3) -> DataFrame:
    """Per question (qid): the first with content of its first `most` siblings (qid, pos, arxiv_id)
    that are not the target."""
    w = Window.partitionBy("qid").orderBy("pos")
    near = siblings.where("arxiv_id <> '' AND arxiv_id <> target").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return near.join(pool.select("arxiv_id").distinct(), "arxiv_id", "left_semi").groupBy("qid").agg(F.min_by("arxiv_id", "pos").alias("sibling"))


def fold_retries(attempts: DataFrame, sums: list[str]) -> DataFrame:
    """attempts (sample, attempt, ...): the last attempt of each sample with the costs of all."""
    last = [c for c in attempts.columns if c not in ("sample", "attempt", *sums)]
    g = attempts.groupBy("sample").agg(F.max("attempt").alias("retry_count"), F.max_by(F.struct(*last), "attempt").alias("_last"), *(F.sum(c).alias(c) for c in sums))
    return g.select("sample", "retry_count", *sums, "_last.*")


def ask_model(prompts: DataFrame, client: Callable[[list[str]], list[str | None]], batch: int = 32, failed: str = '{"score": 0, "reasoning": "error"}') -> DataFrame:
    """prompts (id, prompt) with reply: a client answers lists of prompts in order; a row it fails on,
    or a batch that raises, gets the default. The client runs on the executors."""
    kind = dict(prompts.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                some = f.iloc[i : i + batch]
                try:
                    replies = client(some["prompt"].tolist())
                except Exception:  # noqa: BLE001  any failure of a client is a row's default
                    replies = [None] * len(some)
                yield pd.DataFrame({"id": some["id"], "reply": [failed if r is None else r for r in replies]})

    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, reply string")
