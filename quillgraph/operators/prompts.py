"""Question modes and the texts a model is asked with. The wording is our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import context_list, cut, relation
from quillgraph.operators.sampling import unit_hash, weighted_draw

# Relations, skills and their shares in percent.
RELATIONS = ("METHOD", "RESULT", "MOTIVE", "GROUND")
SKILLS = {"retrieve": 30, "reason": 25, "contrast": 15, "assess": 10, "synthesize": 10, "justify": 10}


def modes(rows: DataFrame, key: str, types: Column, seed: int = 42, shares: dict[str, int] = SKILLS) -> DataFrame:
    """rows with relation (by vote of the context types) and skill (drawn by weight from a hash of the
    key, so that it depends on no order of rows)."""
    return rows.withColumns({"relation": relation(types), "skill": weighted_draw(unit_hash(F.lit(str(seed)), F.col(key).cast("string")), shares)})


def with_instructions(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (relation, skill, question_type) with the guidance of a table (relation, skill, question_type,
    hint, rule, example) as one block of text; the table has a row per combination, 48 in all."""
    j = rows.join(F.broadcast(table), ["relation", "skill", "question_type"], "left")
    head = F.concat(F.lit("=== QUESTION MODE: "), "relation", F.lit(" × "), "skill", F.lit(" ==="))
    return j.withColumn("instructions", F.concat_ws("\n", head, F.concat(F.lit("Relation: "), "hint"), F.concat(F.lit("Skill: "), "rule"), "example")).drop("hint", "rule", "example")


def path_text(titles: Column, years: Column) -> Column:
    """A chain's papers in order, one line each."""
    return F.array_join(F.transform(F.arrays_zip(titles.alias("t"), years.alias("y")), lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(p["t"], F.lit("?")), F.lit(" ("), F.coalesce(p["y"].cast("string"), F.lit("?")), F.lit(")"))), "\n")


def screen_prompt(title: Column, abstract: Column, contexts: Column, most: int = 400, n: int = 3) -> Column:
    """The question whether a citation promises a good one: cut abstract, first contexts."""
    return F.concat_ws("\n", F.concat(F.lit("Paper: "), title), F.concat(F.lit("Abstract: "), cut(F.coalesce(abstract, F.lit("")), most)), F.lit("Cited as:"), context_list(F.slice(contexts, 1, n)), F.lit("Score the citation from 1 to 5."))


def question_prompt(instructions: Column, path: Column, papers: Column, contexts: Column) -> Column:
    """All parts that are there, under headings; papers: array of texts."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), c))
    return F.concat_ws("\n\n", part("Mode", instructions), part("Path", path), part("Papers", F.array_join(papers, "\n\n")), part("Contexts", context_list(contexts)))


def audit_split(labels: Column) -> Column:
    """Labels (array of section, relevance) as text: direct ones, then supporting ones."""
    some = lambda kind: F.transform(F.filter(labels, lambda x: x["relevance"] == kind), lambda x: F.concat(F.lit("- "), x["section"]))
    return F.array_join(F.concat(F.array(F.lit("Direct:")), some("direct"), F.array(F.lit("Supporting:")), some("supporting")), "\n")


def presets(given: DataFrame, preset: DataFrame, default: dict[str, str], known: list[str]) -> DataFrame:
    """Settings (key, value) of a run: what is given, else the preset's, else the default; unknown keys of
    the preset or of what is given are an error row."""
    spark = given.sparkSession
    base = spark.createDataFrame(list(default.items()), "key string, value string")
    j = base.withColumnRenamed("value", "d").join(preset.withColumnRenamed("value", "p"), "key", "full").join(given.withColumnRenamed("value", "g"), "key", "full")
    return j.select("key", F.coalesce("g", "p", "d").alias("value"), (~F.col("key").isin(*known)).alias("unknown"))


def registry(entries: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """(ord, prefix, provider) rows of a dimension: prefixes in lower case, the last of equal ones."""
    last = {prefix.lower(): provider for prefix, provider in entries}
    return [(i, p, v) for i, (p, v) in enumerate(last.items())]
