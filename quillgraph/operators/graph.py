"""Citation graphs: edges (src, dst, pos, ...), neighbour order in pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import bucketed, staying


def edge_score(influential: Column, contexts: Column, intents: Column, least: int = 80) -> Column:
    """Relevance of a reference: 10 if influential, 2 per context of `least` characters, half per any
    context, 5 for methodology, 3 for result, 2 or 1 for contexts of over 200 or 120 on average."""
    some = F.filter(F.coalesce(contexts, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "")
    long = F.filter(some, lambda c: F.length(c) >= least)
    mean = F.try_divide(F.aggregate(long, F.lit(0), lambda s, c: s + F.length(c)).cast("double"), F.size(long))
    has = lambda x: F.coalesce(F.array_contains(intents, x), F.lit(False)).cast("int")
    return (
        F.coalesce(influential, F.lit(False)).cast("int") * 10.0 + F.size(long) * 2 + F.size(some) * 0.5 + has("methodology") * 5 + has("result") * 3
        + F.when(mean > 200, 2).when(mean > 120, 1).otherwise(0)
    )


def top_references(edges: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best edges of each source; equal scores keep the order of pos."""
    w = Window.partitionBy("src").orderBy(F.col(score).desc(), "pos")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def two_hop(edges: DataFrame, seeds: DataFrame, width: int = 30) -> DataFrame:
    """(seed, mid, node): the first `width` neighbours of the first `width` neighbours of seeds."""
    near = edges.where(F.col("pos") <= width).select("src", "dst")
    one = near.join(seeds.select(F.col("seed").alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("mid"))
    return one.join(near.select(F.col("src").alias("mid"), F.col("dst").alias("node")), "mid").where("node <> seed").select("seed", "mid", "node")


def bridges(edges: DataFrame, pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """For (seed, terminal): the first neighbour of the seed whose neighbours hold the terminal. The steps that meet
    are dealt to so many tasks, if given."""
    dealt = lambda d: d.repartition(tasks, "mid", "terminal") if tasks else d
    ends = pairs.select("terminal").distinct()
    a = pairs.distinct().join(edges.select(F.col("src").alias("seed"), F.col("dst").alias("mid"), F.col("pos").alias("p")), "seed")
    b = edges.select(F.col("src").alias("mid"), F.col("dst").alias("terminal")).join(ends, "terminal", "left_semi")
    return dealt(a).join(dealt(b), ["mid", "terminal"], "left_semi").groupBy("seed", "terminal").agg(F.min_by("mid", "p").alias("bridge"))


def reference_jaccard(edges: DataFrame, pairs: DataFrame, tasks: int | None = None) -> DataFrame:
    """For (a, b): shared references, and their Jaccard similarity (0 where a side has none). The references of both
    sides meet by pair and target, dealt to so many tasks, if given."""
    one, two = pairs.distinct(), edges.select("src", "dst")
    sides = [one.join(two.withColumnRenamed("src", x), x).select("a", "b", "dst", F.lit(x == "a").alias("of_a"), F.lit(x == "b").alias("of_b")) for x in ("a", "b")]
    rows = sides[0].unionByName(sides[1])
    rows = rows.repartition(tasks, "a", "b") if tasks else rows
    each = rows.groupBy("a", "b", "dst").agg(F.bool_or("of_a").alias("of_a"), F.bool_or("of_b").alias("of_b"))
    n = each.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("of_a") & F.col("of_b") & F.col("dst").isNotNull()).alias("shared"), F.count_if(F.col("of_a") & F.col("of_b")).alias("same"))
    shared = F.coalesce("shared", F.lit(0))
    either = F.coalesce(F.col("n") + F.col("same") - F.col("shared"), F.lit(0))
    return one.join(n, ["a", "b"], "left").select("a", "b", shared.cast("long").alias("shared"), F.round(F.coalesce(F.try_divide(shared.cast("double"), either), F.lit(0.0)), 4).alias("jaccard"))


#: The turns of a seed's parents in order: what they take, and all that is taken by then.
TURNS = """aggregate(turns, named_struct('seen', seen, 'picked', cast(array() AS array<struct<node: string, score: double, parent: string, path: array<string>>>)),
  (s, x) -> transform(array(array_except(x.strong, s.seen)), good -> transform(array(slice(if(size(good) > 0, good, array_except(x.weak, s.seen)), 1, {width})), nodes -> named_struct(
    'seen', concat(s.seen, nodes),
    'picked', concat(s.picked, transform(nodes, y -> named_struct('node', y, 'score', if(size(good) > 0, x.strong_of[array_position(x.strong, y) - 1], x.weak_of[array_position(x.weak, y) - 1]),
      'parent', x.parent, 'path', concat(x.path, array(y)))))))[0])[0])"""


def candidates(edges: DataFrame, most: int, least: float) -> DataFrame:
    """Per source the targets of the `most` best edges of a score of `least` (strong) and of the `most` most cited
    (weak), each in order, of equal targets the first, and what they score in the same order (strong_of, weak_of). No
    choice can reach further, so a hub's other edges go here. Edges dealt by src stay where they are."""
    one = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min_by(F.struct(F.col("score").cast("double").alias("score"), F.col("cited").cast("double").alias("cited"), "pos"), "pos").alias("e")).select("src", "dst", "e.*")
    one = one.withColumn("rest", F.least(F.col("cited") / 100.0, F.lit(50.0)))
    place = lambda *order: F.row_number().over(Window.partitionBy("src").orderBy(*order, "pos"))
    strong = F.coalesce(F.col("score") >= least, F.lit(False))
    one = one.withColumns({"s": F.when(strong, place(strong.desc(), F.col("score").desc())), "w": place(F.col("rest").desc())}).where((F.col("s") <= most) | (F.col("w") <= most))
    own = lambda n, value: F.array_sort(F.collect_list(F.when(F.col(n) <= most, F.struct(n, "dst", F.col(value).alias("v")))))
    both = one.groupBy("src").agg(own("s", "score").alias("s"), own("w", "rest").alias("w"))
    return both.select("src", F.col("s.dst").alias("strong"), F.col("s.v").alias("strong_of"), F.col("w.dst").alias("weak"), F.col("w.v").alias("weak_of"))


def expand_greedily(edges: DataFrame, seeds: DataFrame, widths: tuple[int, ...] = (10, 7), least: float = 3.0, tasks: int | None = None) -> DataFrame:
    """Bounded greedy expansion: per depth, parents in order take their best references not yet
    taken by any earlier parent or depth; where none reaches `least`, those cited most.

    edges: src, dst, pos, score, cited; already dealt by src to so many tasks, if given. A depth is one job: the parents
    of all seeds meet their candidates, which are ranked, cut and kept once for all depths, and return to their seed, whose
    parents take their turns in a fold over what is taken: the choice of a parent depends on all before it.
    Returns seed, depth, parent, node, rank, score, path."""
    spark = edges.sparkSession
    if not tasks:
        tasks = max(spark.sparkContext.defaultParallelism, -(-edges.count() // 250_000))
        edges = edges.repartition(tasks, "src")
    steps, most = 1, 1
    for w in widths:
        steps *= w
        most += steps
    out = None
    with staying(spark):
        cands = bucketed(candidates(edges, most, least), "candidates", tasks, "src").withColumnRenamed("src", "parent")
        first = F.array(F.struct(F.col("seed").alias("node"), F.array("seed").alias("path")))
        state = seeds.where("seed IS NOT NULL").repartition(tasks, "seed").groupBy("seed").agg(F.count("*").cast("int").alias("copies")).select("seed", "copies", F.array("seed").alias("seen"), first.alias("picked"))
        for depth, width in enumerate(widths, 1):
            parents = state.select("seed", F.posexplode("picked").alias("i", "x")).select("seed", "i", F.col("x.node").alias("parent"), F.col("x.path").alias("path"))
            met = parents.repartition(tasks, "parent").join(cands, "parent").repartition(tasks, "seed")
            turns = met.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("i", "parent", "path", "strong", "strong_of", "weak", "weak_of"))).alias("turns"))
            taken = state.select("seed", "copies", "seen").join(turns, "seed").select("seed", "copies", F.expr(TURNS.replace("{width}", str(width))).alias("t"))
            state = bucketed(taken.select("seed", "copies", "t.seen", "t.picked"), "picked", tasks, "seed")
            own = state.select("seed", "copies", F.lit(depth).alias("depth"), F.posexplode("picked").alias("p", "x"))
            out = own if out is None else out.unionByName(own)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("seed", "x.parent", "x.node", "x.score", "x.path", (F.col("p") + 1).alias("rank"), "depth")


def sibling_pairs(targets: DataFrame, key: str | list[str] = "seed") -> DataFrame:
    """Pairs of a seed's (or of another key's, as a seed and its first step) different targets, in order
    of pos, and the contexts they share, most specific first; targets: key, pos, terminal, contexts."""
    keys = [key] if isinstance(key, str) else key
    a = targets.select(*keys, F.col("pos").alias("pos1"), F.col("terminal").alias("t1"), F.col("contexts").alias("c1"))
    b = targets.select(*keys, F.col("pos").alias("pos2"), F.col("terminal").alias("t2"), F.col("contexts").alias("c2"))
    pairs = a.join(b, keys).where("pos1 < pos2 AND t1 <> '' AND t2 <> '' AND t1 <> t2")
    return pairs.withColumn("shared", F.slice(F.array_sort(F.array_intersect("c1", "c2")), 1, 2)).drop("c1", "c2")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's neighbours in order, as one text of their titles."""
    named = edges.join(nodes.select(F.col("id").alias("dst"), "title"), "dst", "left")
    items = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("title", F.lit("?")).alias("t"))))
    return named.groupBy("src").agg(F.array_join(F.transform(items, lambda x: F.concat(x["pos"].cast("string"), F.lit(". "), x["t"])), "\n").alias("listing"), F.count("*").alias("n"))


def reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For (seed, target): whether the target is a neighbour of the seed or of a neighbour."""
    e = edges.select("src", "dst").distinct()
    direct = pairs.join(e.withColumnsRenamed({"src": "seed", "dst": "target"}), ["seed", "target"], "left_semi")
    via = pairs.join(e.withColumnsRenamed({"src": "seed", "dst": "mid"}), "seed").join(e.withColumnsRenamed({"src": "mid", "dst": "target"}), ["mid", "target"], "left_semi")
    hit = direct.select("seed", "target").unionByName(via.select("seed", "target")).distinct().withColumn("hit", F.lit(True))
    return pairs.join(hit, ["seed", "target"], "left").select("seed", "target", F.coalesce("hit", F.lit(False)).alias("reachable"))

