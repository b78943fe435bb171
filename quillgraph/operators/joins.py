"""Joins with an order of preference."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.packed import MEET, meet, meet_batch, pack, packed_texts, texts_of
from quillgraph.session import written


def prefix_join(rows: DataFrame, name: str, dim: DataFrame, longest: bool = True) -> DataFrame:
    """Left join on the longest (or, by column ord, the first) prefix of `name` in dim (ord, prefix, ...).

    Each distinct name meets its own prefixes by equality, up to the longest of dim, so this needs no nested loop."""
    most = dim.agg(F.max(F.length("prefix"))).first()[0] or 0
    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    own = names.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(name), F.lit(most)))), lambda n: F.substring(F.col(name), F.lit(1), n))))
    rank = F.struct((-F.length("prefix") if longest else F.col("ord")).alias("a"), F.col("ord").alias("b"))
    rest = [c for c in dim.columns if c != "prefix"]
    best = own.join(dim, "prefix").groupBy(name).agg(F.min_by(F.struct("prefix", *rest), rank).alias("_best"))
    return rows.join(best.select(name, "_best.*"), name, "left")


def first_source(keys: DataFrame, key: str, value: str, sources: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Per key the value of the first source (in order) that has one its condition accepts."""
    parts = [d.where(ok).select(key, F.col(value).alias(value), F.lit(i).alias("prio")) for i, (d, ok) in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy(key).agg(F.min_by(F.struct(value, "prio"), F.struct("prio", value)).alias("_best"))
    return keys.join(best.select(key, f"_best.{value}", "_best.prio"), key, "left")


def keep_first(rows: DataFrame, key: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first in the order, or the last."""
    names = rows.columns
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = rows.groupBy(*key).agg((F.max_by if last else F.min_by)(F.struct(*names), place).alias("_best"))
    return best.select(*[f"_best.{n}" for n in names])


HEADS = 50_000  # of an automaton: some 2 million states
SLICES = 4  # of titles for each partition that Spark shuffles to


def _head_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
        yield meet_batch([(k, kind, place, pack(**packed_texts(x.values))) for k, kind, place, x in zip(*(col[c].to_pylist() for c in ("key", "kind", "place")), col["texts"])])


def _title_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield meet_batch([(0, 1, 0, pack(pos=b.column(1).to_numpy(zero_copy_only=False), **packed_texts(b.column(0))))])


def _found(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Titles of a slice past the automaton of a shard of heads: for each head found the first title with it."""
    here, heads, automaton, best = None, [], None, {}

    def batch() -> pa.RecordBatch:
        at = list(best)
        pos, title = zip(*best.values())
        return pa.RecordBatch.from_arrays([pa.array([heads[i] for i in at]), pa.array(title), pa.array(pos, pa.int64())], ["head", "t", "pos"])

    for key, kind, _, x in rows:
        if key != here:
            if best:
                yield batch()
            here, heads, automaton, best = key, [], None, {}
        if kind == 0:
            import ahocorasick

            heads, automaton = texts_of(x), ahocorasick.Automaton()
            for i, h in enumerate(heads):
                automaton.add_word(h, i)
            automaton.make_automaton()
        elif automaton is not None:
            for title, pos in zip(texts_of(x), x["pos"].tolist()):
                for i in {i for _, i in automaton.iter(title)}:
                    if i not in best or pos < best[i][0]:
                        best[i] = pos, title
    if best:
        yield batch()


def first_containing(heads: DataFrame, titles: DataFrame) -> DataFrame:
    """(head, t): for each of the distinct heads found in one of the distinct titles (t, pos), the title of
    least pos that contains it.

    Heads are dealt to automata of Aho and Corasick, HEADS in each at most on average; titles are cut into
    slices, and each slice streams through each automaton in a task of its own, which returns a
    row for a head at most. So a head that very many titles contain is found in all of them, but a row only
    once for a slice."""
    spark = heads.sparkSession
    shards = max(1, -(-heads.count() // HEADS))
    slices = SLICES * int(spark.conf.get("spark.sql.shuffle.partitions")) if shards == 1 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.groupBy(F.pmod(F.xxhash64("head"), F.lit(shards)).alias("shard")).agg(F.collect_list("head").alias("texts"))
    dealt = dealt.select((F.col("shard") * slices).alias("first"), "texts").select(F.explode(F.sequence("first", F.col("first") + slices - 1)).alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), "texts")
    blocks = titles.select("t", "pos").mapInArrow(_title_block, MEET).withColumn("at", F.pmod(F.xxhash64("data"), F.lit(slices)))
    blocks = blocks.select(F.explode(F.sequence("at", F.col("at") + (shards - 1) * slices, F.lit(slices).cast("long"))).alias("key"), "kind", "place", "data")
    hits = meet(dealt.mapInArrow(_head_shard, MEET).unionByName(blocks), _found, "head string, t string, pos long")
    return hits.groupBy("head").agg(F.min_by("t", "pos").alias("t"))


def first_title(queries: DataFrame, titles: DataFrame, most: int = 40) -> DataFrame:
    """For queries (qid, title): the titles (tid, pos, title) row equal to it (trimmed, case ignored),
    else the first that contains its first `most` characters.

    Equal titles and equal beginnings are handled once. An empty or null title finds nothing."""
    norm = lambda c: F.lower(F.trim(c))
    q = queries.select("qid", norm(F.col("title")).alias("q")).where("q <> ''")
    t = written(titles.groupBy(norm(F.col("title")).alias("t")).agg(F.min_by("tid", "pos").alias("tid"), F.min("pos").cast("long").alias("pos")).where("t <> ''"), "titles")
    both = q.join(t.select(F.col("t").alias("q"), "tid", F.lit(0).alias("exact")), "q", "left").withColumn("head", F.when(F.col("exact").isNull(), F.substring("q", 1, most)))
    both = written(both.select("qid", "tid", "exact", "head"), "titled")
    found = first_containing(both.where("head IS NOT NULL").select("head").distinct(), t).join(t.select("t", F.col("tid").alias("inside")), "t")
    out = both.join(found.select("head", "inside", F.lit(1).alias("part")), "head", "left").withColumn("rank", F.coalesce("exact", "part")).where("rank IS NOT NULL")
    out = out.select("qid", F.when(F.col("rank") == 0, F.col("tid")).otherwise(F.col("inside")).alias("tid"), "rank")
    return queries.select("qid").join(out, "qid", "left")


def title_in_scope(queries: DataFrame, nodes: DataFrame, scope: str, most: int = 30) -> DataFrame:
    """As first_title, among the nodes (scope, node, pos, title) of the query's (qid, scope, title) own
    sample: an equal title, else one that holds the query's first characters, case ignored."""
    q, n = queries.where("title <> ''"), nodes.select(scope, "node", "pos", F.col("title").alias("t"))
    j = q.join(n, scope)
    rank = F.when(F.col("t") == F.col("title"), 0).when(F.contains(F.lower("t"), F.lower(F.substring("title", 1, most))), 1)
    best = j.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("qid").agg(F.min_by(F.struct("node", "rank"), F.struct("rank", "pos")).alias("_best"))
    return queries.select("qid").join(best.select("qid", "_best.*"), "qid", "left")


def by_either_id(rows: DataFrame, table: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """rows with the value of a table (key, value) under their new id, else under their old one."""
    one = table.select(F.col(key).alias("_k"), F.col(value).alias(value))
    new = rows.join(one.withColumnsRenamed({"_k": first, value: "_new"}), first, "left")
    both = new.join(one.withColumnsRenamed({"_k": second, value: "_old"}), second, "left")
    return both.withColumn(value, F.coalesce("_new", "_old")).drop("_new", "_old")


def provider_of(rows: DataFrame, name: str, dim: DataFrame, override: str) -> DataFrame:
    """rows with provider: the override where given, else that of the first prefix of the name in dim."""
    return prefix_join(rows, name, dim, longest=False).withColumn("provider", F.coalesce(F.nullif(F.col(override), F.lit("")), F.col("provider")))
