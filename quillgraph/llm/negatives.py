"""Hard negatives by norm-bucketed search.

Candidates are ordered by norm, longest first, in ranges of near equal size (groups) and cut into
buckets, each one row with its greatest norm; anchors are cut into blocks, each one row. By Cauchy
and Schwarz a bucket holds no score above |anchor| x norm. A block meets each group in a task of its own
that streams the buckets, longest first, and passes over those, and over the anchors of a block, whose bound
is below what a result needs: the least score that a window admits, or the running k-th score where k are
found. Which buckets travel to which blocks is settled before, by the same bound. Positives are
sought in the longest group first, so that all other groups have a k-th score to beat. A task holds one
block, one bucket and what it has found; the best of all groups are merged by anchor and window.

Scores are exact whole numbers: products run in double precision where all sums stay below 2**53, and
in Python's integers otherwise; a score beyond 64 bits is an error.

Defined results: rows without a label, a vector or one of its components take no part; rows are rows of
their own where ids repeat ("other rows" are other rows, of the same id too), each anchor row has its own
results, and rows without an id come last among ties; a shorter vector counts as filled up with zeros;
fewer than k are returned where there are fewer; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.packed import MEET, meet, pack

from .store import parts, small_batches, written

BUCKET, BLOCK = 1024, 512
GROUP = 1 << 22  # candidates of a group at most, about
NO_ID = 2**63 - 1
SLACK = 1 + 1e-9  # of bounds in double precision
PACKED = "g int, norm double, reach double, data binary"


def quantized(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    return F.expr(f"CASE WHEN NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) THEN transform({vector}, x -> floor({scale} * double(x))) END")


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of lists of longs in the narrowest integers, shorter ones filled up with zeros."""
    flat, edge = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    n = np.diff(edge)
    wide = int(n.max(initial=0))
    out = np.zeros((len(n), wide), np.int64)
    out[np.arange(wide) < n[:, None]] = flat
    least, most = int(out.min(initial=0)), int(out.max(initial=0))
    return out.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _packs(most: int, k: int):
    """Rows in the order of their norms to packed rows; scores and ids are those of an anchor's positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), most):
                b = whole.slice(a, most)
                col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
                x = {c: col[c].to_numpy(zero_copy_only=False) for c in ("r", "id", "label", "norm", "need")}
                reach = float((x["need"] / np.maximum(x["norm"], 1e-300)).min())
                if k:
                    score, pid = np.zeros((len(b), k), np.int64), np.full((len(b), k), NO_ID)
                    size = col["scores"].value_lengths().to_numpy(zero_copy_only=False)
                    at = np.arange(k) < size[:, None]
                    score[at], pid[at] = col["scores"].flatten().to_numpy(), col["pids"].flatten().to_numpy()
                    x |= {"score": score, "pid": pid, "has": at}
                data = pack(v=_matrix(col["vector"]), **x)
                yield pa.RecordBatch.from_arrays([col["g"].slice(0, 1), pa.array([float(x["norm"].max())]), pa.array([reach]), pa.array([data], pa.binary())], ["g", "norm", "reach", "data"])

    return run


def _packed(rows: DataFrame, groups: int, most: int, what: str, k: int = 0) -> DataFrame:
    """Packed rows of groups in descending order of norm, with a number of their own."""
    if "need" not in rows.columns:
        rows = rows.withColumn("need", F.lit(float("-inf")))
    names = ["r", "id", "label", "norm", "need", "vector", *(["scores", "pids"] if k else [])]
    dealt = rows.select(*names).repartitionByRange(groups, F.col("norm").desc(), "r").withColumn("g", F.spark_partition_id()).sortWithinPartitions(F.col("norm").desc(), "r")
    return written(dealt.mapInArrow(_packs(most, k), PACKED).withColumn("n", F.monotonically_increasing_id()), what)


class _Best:
    """The k best of each slot: the highest score, then the lowest id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.kth = k, np.full(slots, -np.inf)
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        slot, score, id_ = np.concatenate([self.slot, slot]), np.concatenate([self.score, score.astype(np.int64)]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else slot
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], id_[keep]
        full = rank == self.k - 1
        self.kth[slot[full]] = score[full]


def _products(a: np.ndarray, c: np.ndarray, times: int) -> np.ndarray:
    """All inner products, exactly, also `times` over."""
    d = min(a.shape[1], c.shape[1])
    a, c = a[:, :d], c[:, :d]
    most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, c)]
    kind = float if most[0] * most[1] * max(1, d) * times < 2**53 else object
    return a.astype(kind) @ c.astype(kind).T


def _likely(s: np.ndarray, ok: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that may be among the k best of their row."""
    f = np.where(ok, s, -np.inf).astype(float)
    least = np.partition(f, f.shape[1] - k, axis=1)[:, f.shape[1] - k] if f.shape[1] > k else np.full(len(f), -np.inf)
    # an exact score beyond 2**53 may be rounded up or down by a part in 2**53
    least = np.maximum(least, kth)
    return np.nonzero(ok & (f >= (least - np.abs(np.where(np.isfinite(least), least, 0)) * 1e-15)[:, None]))


def _tile(k: int, low: int, high: int):
    """The buckets of a group past a block: positives where the block has no windows."""

    def batch(x: dict, best: _Best) -> pa.RecordBatch:
        per = x["score"].shape[1] if "score" in x else 1
        return pa.RecordBatch.from_arrays([pa.array(x["r"][best.slot // per]), pa.array((best.slot % per).astype(np.int32)), pa.array(best.score), pa.array(best.id)], ["r", "j", "score", "id"])

    def positives(x: dict, c: dict, best: _Best, norm: float) -> None:
        need = np.maximum(x["need"], best.kth)
        on = np.flatnonzero(x["norm"] * norm * SLACK >= need)
        if len(on):
            s = _products(x["v"][on], c["v"], 1)
            ok = (x["label"][on][:, None] == c["label"]) & (x["r"][on][:, None] != c["r"])
            i, j = _likely(s, ok, need[on], k)
            best.add(on[i], s[i, j], c["id"][j])

    def negatives(x: dict, c: dict, best: _Best, norm: float) -> None:
        per = x["score"].shape[1]
        lower = np.where(x["has"], np.maximum(x["score"] * (low / 100), best.kth.reshape(-1, per)), np.inf)
        lower -= np.abs(np.where(np.isfinite(lower), lower, 0)) * 1e-12
        on = np.flatnonzero((x["norm"] * norm * SLACK)[:, None].__ge__(lower).any(axis=1))
        if not len(on):
            return
        s = _products(x["v"][on], c["v"], 100)
        other = x["label"][on][:, None] != c["label"]
        for w in range(per):
            has = np.flatnonzero(x["has"][on, w] & (x["norm"][on] * norm * SLACK >= lower[on, w]))
            if len(has):
                p = x["score"][on[has], w][:, None].astype(s.dtype)
                sw = s[has]
                ok = other[has] & (low * p <= 100 * sw) & (100 * sw <= high * p)
                i, j = _likely(sw, ok, lower[on[has], w], k)
                best.add(on[has[i]] * per + w, sw[i, j], c["id"][j])

    def run(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        here, x, best = None, {}, None
        for key, kind, _, c in rows:
            if key != here:
                if best is not None and len(best.slot):
                    yield batch(x, best)
                here, x, best = key, {}, None
            if kind == 0:
                x, best = c, _Best(c["score"].size if "score" in c else len(c["r"]), k)
            elif best is not None:
                (negatives if "score" in x else positives)(x, c, best, float(c["norm"].max()))
        if best is not None and len(best.slot):
            yield batch(x, best)

    return run


def _searched(blocks: DataFrame, buckets: DataFrame, groups: int, k: int, low: int, high: int, only: Column) -> DataFrame:
    """(r, j, score, id): of each group the k best for each anchor and window. A block is sent to each group
    and a bucket to each block that it can serve; `only` says which groups take part."""
    key = F.col("n") * groups + F.col("g")
    heads = blocks.select("n", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "data").where(only)
    asks = blocks.select("n", "reach")
    sent = buckets.where(only).drop("reach").withColumnRenamed("n", "place").join(asks, F.col("norm") * SLACK >= F.col("reach"))
    rows = heads.select(key.alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), "data")
    return meet(rows.unionByName(sent.select(key.alias("key"), F.lit(1).alias("kind"), "place", "data")).select("key", F.col("kind").cast("int").alias("kind"), "place", "data"), _tile(k, low, high), "r long, j int, score long, id long")


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """rows (vec_id, label, vector: whole numbers, anchor: boolean). For each anchor and each of its first
    `positives` other rows of its label, the first `negatives` rows of other labels whose score is
    between low % and high % of the positive's. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    spark = rows.sparkSession
    small_batches(spark)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    part = rows.where("label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    base = part.select(
        F.monotonically_increasing_id().alias("r"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<bigint>").alias("vector"), norm.alias("norm"), F.coalesce("anchor", F.lit(False)).alias("anchor"),
    )
    base = written(base, "vectors")
    n, asked = base.agg(F.count("*"), F.count_if("anchor")).first()
    anchors = base.where("anchor")
    blocks = max(1, -(-asked // BLOCK))
    groups = max(1, -(-n // GROUP), min(-(-n // BUCKET), -(-2 * parts(spark) // blocks)))
    buckets = _packed(base, groups, BUCKET, "buckets")
    found = written(_searched(_packed(anchors, blocks, BLOCK, "blocks"), buckets, groups, positives, low, high, F.col("g") == 0), "longest")
    if groups > 1:
        kth = _first(found, positives, "r").where(F.col("rank") == positives).select("r", F.col("score").cast("double").alias("k"))
        need = anchors.join(kth, "r", "left").withColumn("need", F.coalesce("k", F.lit(float("-inf")))).drop("k")
        rest = _searched(_packed(need, blocks, BLOCK, "blocks"), buckets, groups, positives, low, high, F.col("g") > 0)
        found = found.unionByName(rest)
    best = _first(found, positives, "r").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    own = anchors.join(best, "r").withColumns({"scores": F.col("p")["score"], "pids": F.col("p")["id"]})
    own = own.withColumn("need", F.least(F.array_min(F.transform("scores", lambda s: s * (low / 100))), F.array_min("scores").cast("double"))).drop("p")
    own = written(own, "windows")
    hits = _searched(_packed(own, blocks, BLOCK, "blocks", positives), buckets, groups, negatives, low, high, F.col("g") >= 0)
    out = _first(hits, negatives, "r", "j").withColumnRenamed("id", "nid").join(own.select("r", "id", "scores", "pids"), "r")
    id_ = lambda c: F.when(c != NO_ID, c)
    return out.select(
        id_(F.col("id")).alias("anchor_id"), id_(F.get("pids", "j")).alias("positive_id"), F.col("rank").cast("int").alias("rank"), id_(F.col("nid")).alias("negative_id"),
        F.get("scores", "j").alias("positive_score"), F.col("score").alias("negative_score"),
    )


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_inner_product(a.v, c.v)::BIGINT AS score FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE s.label <> s.own AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""
