"""Views of chains, groups and samples that later steps look things up in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.ranges import running


def sibling_index(chains: DataFrame) -> DataFrame:
    """chains (seed, terminal, arxiv_id, title, pos): each seed's terminals in order, each once, as rows
    (seed, place, terminal, arxiv_id, title). Rows, not lists, as a seed may have any number."""
    d = chains.where((F.coalesce("seed", F.lit("")) != "") & (F.coalesce("terminal", F.lit("")) != ""))
    one = d.groupBy("seed", "terminal").agg(F.min(F.struct("pos", F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"), F.coalesce("title", F.lit("")).alias("title"))).alias("_f"))
    one = one.select("seed", "terminal", "_f.*")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("pos"))).drop("pos")


def by_seed(chains: DataFrame) -> DataFrame:
    """Chains of a named seed, with the fields that steps ask for: contexts, context types, screen score,
    terminal id; what is missing is empty."""
    text = F.array().cast("array<string>")
    return chains.where(F.coalesce("seed", F.lit("")) != "").select(
        "seed", "pos", F.coalesce("contexts", text).alias("contexts"), F.coalesce("context_types", text).alias("context_types"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("terminal", F.lit("")).alias("terminal"),
    )


def seed_arxiv(files: DataFrame) -> DataFrame:
    """Per seed the arXiv id of the first chain of a file (file, pos, seed, arxiv_id); of several files
    the last in order of name."""
    first = files.groupBy("file").agg(F.min(F.struct("pos", "seed", "arxiv_id")).alias("f")).select("file", "f.seed", "f.arxiv_id")
    return first.where("coalesce(seed, '') <> '' AND coalesce(arxiv_id, '') <> ''").groupBy("seed").agg(F.max_by("arxiv_id", "file").alias("arxiv_id"))


def question_ids(single: Column, chain_seed: Column, chain_terminal: Column, group_seed: Column, targets: Column) -> tuple[Column, Column]:
    """(seed, ids of what the question is about): of the chain for a single target, of the group else;
    blank ids are left out."""
    own = F.when(F.coalesce(chain_terminal, F.lit("")) != "", F.array(chain_terminal)).otherwise(F.array().cast("array<string>"))
    many = F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(single, chain_seed).otherwise(group_seed), F.when(single, own).otherwise(many)


def gold_map(chains: DataFrame, groups: DataFrame) -> DataFrame:
    """What is known to be right per question, of chains (id, seed, terminal, path) and groups (id, seed,
    targets, sources) alike."""
    return chains.select("id", "seed", "terminal", "path").unionByName(groups.select("id", "seed", "targets", "sources"), allowMissingColumns=True)


def analysis(raw: Column, schema: str) -> Column:
    """An analysis that came as JSON text; what is no JSON is null."""
    return F.from_json(raw, schema, {"mode": "PERMISSIVE"})


def keyed(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The last row of each key, blank keys left out."""
    rest = [c for c in rows.columns if c != key]
    d = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return d.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("_last")).select(key, "_last.*")


def distractor_types(seed_text: Column, wrong_text: Column) -> Column:
    """Kinds of distractors a question has material for."""
    some = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.lit(name))
    return F.filter(F.array(some(seed_text, "seed_only"), some(wrong_text, "wrong_paper"), F.lit("no_context")), lambda x: x.isNotNull())


def wrong_paper_text(content: Column, fact: Column) -> Column:
    """A sibling's content, after the one fact that is kept of a question with several targets."""
    kept = F.concat(F.lit("=== FACT FROM PAPER 1 ===\n"), fact, F.lit("\n\n=== PAPER 2 CONTENT ===\n"), content)
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit("")).when(F.coalesce(fact, F.lit("")) != "", kept).otherwise(content)


def has_all(types: Column, needed: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, needed)), types)) == 0


def all_with_content(members: DataFrame, key: str, member: str, pool: DataFrame) -> DataFrame:
    """Keys all of whose members (key, member) have content in the pool (member, n_sections)."""
    some = pool.where("n_sections > 0").select(F.col(member).alias("_m")).distinct().withColumn("_ok", F.lit(True))
    d = members.join(some, F.col(member) == F.col("_m"), "left")
    return d.groupBy(key).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("ok")).where("ok").select(key)


def answered(rows: DataFrame, question: str = "question", error: str = "error") -> DataFrame:
    """Rows with a question and without an error."""
    return rows.where((F.coalesce(F.col(question), F.lit("")) != "") & (F.coalesce(F.col(error), F.lit("")) == ""))


def screened(chains: DataFrame, least: int = 3) -> DataFrame:
    return chains.where(F.coalesce("score", F.lit(0)) >= least)


def cached_results(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Results (label, idx, answer) of a filter's cache, valid only where it has as many as are wanted now
    (label, size)."""
    n = cache.groupBy("label").agg(F.count("*").alias("size"))
    return cache.join(n.join(wanted, ["label", "size"], "left_semi").select("label"), "label", "left_semi")


def batch_results(asked: DataFrame, replies: DataFrame, default: str) -> DataFrame:
    """A reply for each asked idx in order; the default where the batch has none."""
    got = replies.groupBy("idx").agg(F.max("reply").alias("reply"))
    return asked.select("idx").join(got, "idx", "left").select("idx", F.coalesce("reply", F.lit(default)).alias("reply"))


def killed(runs: DataFrame, limit: int) -> DataFrame:
    """runs (pos, tokens) with `run`: whether a run still began, as all tokens before it are below the
    limit."""
    d = running(runs.withColumn("_all", F.lit(0)), "_all", "pos", {"_upto": F.col("tokens")})
    return d.withColumn("run", F.col("_upto") - F.col("tokens") < limit).drop("_upto", "_all")
