"""Samples with their citation graph and the papers in it; packaging; verification of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import claim_band, claim_terms, normalize_header, words

NODES = "map<string,struct<title:string,arxivId:string,year:int,abstract:string>>"


def load(qa: DataFrame, graphs: DataFrame, pool: DataFrame) -> DataFrame:
    """qa (id, ...) with nodes, edges and content (arXiv id to sections) of its graph (sample_id, nodes,
    edges); samples without a graph, and nodes without content, stay with empty maps."""
    node = graphs.select("sample_id", F.explode(F.map_values("nodes")).alias("n")).select("sample_id", F.col("n.arxivId").alias("arxiv_id")).where("arxiv_id <> ''").distinct()
    held = node.join(pool.select("arxiv_id", "sections"), "arxiv_id").groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("arxiv_id", "sections"))).alias("content"))
    return qa.join(graphs.withColumnRenamed("sample_id", "id"), "id", "left").join(held.withColumnRenamed("sample_id", "id"), "id", "left")


def package(hops: DataFrame, papers: DataFrame) -> DataFrame:
    """(seed, mid, node) pairs as one graph per seed: nodes (with attributes) and ordered neighbour lists."""
    ids = hops.select("seed", F.explode(F.array("seed", "mid", "node")).alias("id")).distinct()
    attrs = F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("arxivId", F.lit("")).alias("arxivId"), "year", "abstract")
    nodes = ids.join(papers, "id", "left").groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("id", attrs))).alias("nodes"))
    pairs = hops.select("seed", F.col("seed").alias("a"), F.col("mid").alias("b")).unionByName(hops.select("seed", F.col("mid").alias("a"), F.col("node").alias("b"))).distinct()
    lists = pairs.groupBy("seed", "a").agg(F.array_sort(F.collect_list("b")).alias("bs")).groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("a", "bs"))).alias("edges"))
    return nodes.join(lists, "seed").withColumnRenamed("seed", "sample_id")


def prune(samples: DataFrame, keep: DataFrame) -> DataFrame:
    """content only of the arXiv ids that keep (id, ids) lists."""
    d = samples.join(keep, "id", "left")
    return d.withColumn("content", F.map_filter("content", lambda k, v: F.array_contains(F.coalesce("ids", F.array().cast("array<string>")), k))).drop("ids")


def verify_claims(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """claims (sample, claim_id, claim, source_section) against all sections (sample, pos, header, text)
    of their sample. The section is the first that the strategies give, in this order: header in
    either direction, normalised header so, most words shared (60 % at least), the name in the text.
    Samples bound the pairs; candidates are ranked by partial aggregation."""
    c = claims.withColumn("terms", claim_terms(F.col("claim"))).withColumn("q", F.lower("source_section")).withColumn("qn", normalize_header(F.col("source_section")))
    s = sections.select("sample", "pos", F.lower("header").alias("h"), normalize_header(F.col("header")).alias("hn"), F.lower("text").alias("body"))
    word_set = lambda n: F.array_distinct(words(F.col(n)))
    j = c.select("sample", "claim_id", "terms", "q", "qn", word_set("qn").alias("qw")).join(s.withColumn("hw", word_set("hn")), "sample")
    share = F.when((F.size("qw") >= 2) & (F.size("hw") > 0), F.size(F.array_intersect("qw", "hw")) / F.size("qw")).otherwise(F.lit(0.0))
    ways = [
        F.contains("h", F.col("q")) | F.contains("q", F.col("h")), (F.col("qn") != "") & (F.contains("hn", F.col("qn")) | F.contains("qn", F.col("hn"))),
        share >= 0.6, (F.length("qn") >= 5) & (F.contains("body", F.col("qn")) | F.contains("body", F.col("q"))),
    ]
    how = F.when(ways[0], 1).when(ways[1], 2).when(ways[2], 3).otherwise(4)
    hits = j.where(ways[0] | ways[1] | ways[2] | ways[3]).withColumn("how", how)
    order = F.struct("how", F.when(F.col("how") == 3, -share).otherwise(F.lit(0.0)).alias("share"), "pos")
    best = hits.groupBy("sample", "claim_id").agg(F.min_by(F.struct(claim_band(F.col("terms"), F.col("body")).alias("band"), "how", "pos"), order).alias("m"))
    d = c.join(best, ["sample", "claim_id"], "left")
    empty = (F.coalesce("claim", F.lit("")) == "") | (F.coalesce("source_section", F.lit("")) == "")
    band = F.when(empty, F.lit("skip_empty")).when(F.size("terms") == 0, F.lit("skip_no_terms")).otherwise(F.coalesce("m.band", F.lit("section_not_found")))
    return d.select("sample", "claim_id", band.alias("band"), F.when(~empty, F.col("m.how")).alias("how"))
