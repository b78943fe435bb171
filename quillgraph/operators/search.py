"""Keyword search: the best k documents of each query, cut by upper bounds.

A document's score is the number of a query's distinct tokens that it has, so its own number of query
tokens bounds every score. Two plans with the same result, by the size of the query set:

Queries of MOST_TOKENS tokens at most are sent to all tasks (`scanned`). A task takes its documents in
blocks, in descending order of their bound. A block's bound for a query is the number of the query's tokens
that any of its documents has; queries whose running k-th score is above it, or above the bound of the
block's first document, are left out before tokens meet queries. A task returns k rows a query at most.

Larger query sets are joined with lists of documents per token (`joined`). A first look at the documents
with most tokens, and at those of the rarest tokens, gives each query a floor. A document that has
only the floor - 1 most frequent tokens of a query stays below the floor, so only lists of the rarer, essential
tokens are read, and in them only documents with as many tokens as the floor.

A document or a query without tokens, or with null ones only, has no rows; repeated documents are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import written

MOST_TOKENS = 1_000_000  # of queries that are sent to all tasks
BLOCK = 256  # documents
LOOK, DEPTH = 3, 32  # rarest tokens of a query, and documents of each, that give the floor


class _Kept:
    """The k best rows of each query: the highest score, then the least pos."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.kth = k, np.zeros(queries, np.int64)
        self.q = self.score = self.pos = self.at = np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, pos: np.ndarray, at: np.ndarray) -> None:
        q, score, pos, at = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.pos, pos), (self.at, at)))
        order = np.lexsort((at, pos, -score, q))
        q, score, pos, at = q[order], score[order], pos[order], at[order]
        first = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        full = rank == self.k - 1
        self.kth[q[full]] = score[full]
        self.q, self.score, self.pos, self.at = q[keep], score[keep], pos[keep], at[keep]


def _scan(words: pa.Array, first: np.ndarray, of: np.ndarray, qids: pa.Array, k: int):
    """Documents (doc, pos, tokens) past the queries: token i is in the queries of[first[i]:first[i + 1]]."""

    def blocks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, tokens, rows) with the largest documents first; a token counts once in a document."""
        lists = b.column(2)
        ids = pc.index_in(lists.flatten(), value_set=words)
        row = pc.list_parent_indices(lists).to_numpy()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        pair = np.unique(row[known].astype(np.int64) * len(words) + ids.drop_null().to_numpy())
        row, tok = pair // len(words), pair % len(words)
        size = np.bincount(row, minlength=len(b))
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        begin = np.concatenate([[0], np.cumsum(size)])
        for i in range(0, len(order), BLOCK):
            docs = order[i : i + BLOCK]
            n = size[docs]
            inside = np.repeat(np.arange(len(docs)), n)
            yield docs, tok[np.arange(len(inside)) - np.repeat(np.cumsum(n) - n, n) + begin[docs][inside]], inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen, count = _Kept(len(qids), k), [], 0
        for b in batches:
            pos = b.column(1).to_numpy(zero_copy_only=False)
            for docs, tok, inside in blocks(b):
                here = np.unique(tok)
                bound = np.bincount(of[_spread(first, here)[0]], minlength=len(qids))
                bound = np.minimum(bound, np.bincount(inside).max())
                on = bound >= np.maximum(kept.kth, 1)
                if not on.any():
                    continue
                at, whose = _spread(first, tok)
                q = of[at]
                take = on[q]
                pairs, score = np.unique(q[take] * len(docs) + inside[whose[take]], return_counts=True)
                q, d = pairs // len(docs), pairs % len(docs)
                good = score >= kept.kth[q]
                q, d, score = q[good], d[good], score[good]
                kept.add(q, score, pos[docs[d]], docs[d] + count)
            # of a batch only what is among the best is held
            used = np.unique(kept.at[kept.at >= count])
            old = pa.concat_arrays(seen) if seen else b.column(0).slice(0, 0)
            still = np.unique(kept.at[kept.at < count])
            seen = [old.take(pa.array(still)), b.column(0).take(pa.array(used - count))]
            kept.at = np.searchsorted(np.concatenate([still, used]), kept.at)
            count = len(still) + len(used)
        if len(kept.q):
            doc = pa.concat_arrays(seen).take(pa.array(kept.at))
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(kept.q)), doc, pa.array(kept.pos), pa.array(kept.score)], ["qid", "doc", "pos", "overlap"])

    return run


def _spread(first: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all queries of the tokens, and for each the place of its token."""
    n = first[tok + 1] - first[tok]
    whose = np.repeat(np.arange(len(tok)), n)
    return np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n) + first[tok][whose], whose


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("overlap").desc(), "pos", "doc")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scanned(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """asked (qid, w): MOST_TOKENS rows at most."""
    t = asked.toArrow().combine_chunks()
    qids, words = (t.column(c).combine_chunks().dictionary_encode() for c in ("qid", "w"))
    w, q = words.indices.to_numpy(), qids.indices.to_numpy()
    order = np.lexsort((q, w))
    first = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=len(words.dictionary)))]).astype(np.int64)
    kinds = dict(asked.dtypes) | dict(docs.dtypes)
    hits = docs.select("doc", F.col("pos").cast("long").alias("pos"), "tokens").mapInArrow(
        _scan(words.dictionary, first, q[order].astype(np.int64), qids.dictionary, k), f"qid {kinds['qid']}, doc {kinds['doc']}, pos long, overlap long"
    )
    return _best(hits, k)


def joined(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    queries = asked.groupBy("qid").agg(F.collect_list("w").alias("tokens"))
    row = F.monotonically_increasing_id().alias("row")
    every = written(docs.select(row, "doc", F.col("pos").cast("long").alias("pos"), F.array_distinct("tokens").alias("tokens")), "documents")
    of = every.select("row", F.explode("tokens").alias("w")).join(asked.select("w").distinct(), "w").groupBy("row").agg(F.collect_list("w").alias("ts"))
    own = written(of.join(every.select("row", "doc", "pos"), "row").withColumn("size", F.size("ts")), "tokens")
    lists = own.select("row", "pos", "size", F.explode("ts").alias("w"))
    often = lists.groupBy("w").agg(F.count("*").alias("df"))
    ranked = asked.join(often, "w").withColumns({"i": F.row_number().over(Window.partitionBy("qid").orderBy("df", "w")), "m": F.count("*").over(Window.partitionBy("qid"))})
    ranked = written(ranked.select("qid", "w", "i", "m"), "ranked")

    def scored(pairs: DataFrame) -> DataFrame:
        overlap = F.size(F.array_intersect("tokens", "ts")).cast("long").alias("overlap")
        return pairs.join(own.select("row", "doc", "pos", "ts"), "row").join(queries, "qid").select("qid", "row", "doc", "pos", overlap)

    rare = ranked.where(F.col("i") <= LOOK)
    deep = Window.partitionBy("w").orderBy(F.col("size").desc(), "pos")
    tops = lists.join(rare.select("w").distinct(), "w", "left_semi").withColumn("n", F.row_number().over(deep)).where(F.col("n") <= DEPTH)
    largest = F.broadcast(own.orderBy(F.col("size").desc(), "pos").select("row").limit(DEPTH))  # DEPTH rows
    look = rare.join(tops, "w").select("qid", "row").unionByName(queries.select("qid").crossJoin(largest)).distinct()
    floor = _best(scored(look).where("overlap > 0"), k).where(F.col("rank") == k).select("qid", F.col("overlap").alias("floor"))
    need = ranked.join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
    essential = written(need.where(F.col("i") <= F.col("m") - F.col("floor") + 1).select("qid", "w", "floor"), "essential")
    pairs = lists.join(essential, "w").where(F.col("size") >= F.col("floor")).select("qid", "row").distinct()
    return _best(scored(pairs), k)


def token_overlap_search(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """docs (doc, pos, tokens) by the number of a query's (qid, tokens) distinct tokens they have; above 0;
    k (1 to 10) per query, equal scores in order of pos, then of doc. Returns qid, doc, pos, overlap, rank."""
    k = min(max(k, 1), 10)
    asked = written(queries.select("qid", F.explode("tokens").alias("w")).where("w IS NOT NULL").distinct(), "asked")
    plan = scanned if asked.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS else joined
    return plan(asked, docs, k).select("qid", "doc", "pos", "overlap", "rank")
