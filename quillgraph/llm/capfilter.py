"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector belongs to it when their inner product reaches the
vector's own threshold, its LIST-th highest one. The directions form a random product code:
one unit codeword for each half of the dimensions, so that all directions a vector exceeds
follow from the heads of its two lists of inner products (list decoding), without visiting
every direction and without a sample. Vectors that share a filter are candidates and are
verified in double precision.

The number of directions grows with the table, so that a filter holds about PER_FILTER
vectors. Two random vectors at a cosine of exactly 0.9 share none at a rate that the tests
measure by the number of vectors (README has the figures); above it the rate falls fast.

Equal vectors are one class with a weight. Filters are dealt to shards by their first codeword,
of which a vector's list has few, and a vector travels once per shard; a codeword with more
places than a shard should hold is split by the second one. A filter with more than BLOCK
classes is split into pairs of blocks. No pair leaves a task: a shard returns, per class, the
weight it is linked with (a pair counts in its first common filter only) and the least class of
its part of the component.

Defined results: null, empty or zero vectors and those with null or non-finite components
link with nothing; vectors of different lengths never link; rows are vectors of their own,
whether they repeat an id, lack one or repeat a vector; a component's id is the least there is
in it, null where no row of it has one; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written

LIST, PER_FILTER, BLOCK = 48, 96, 2048
SHARD_BYTES = 32 << 20  # of vectors and their lists, with places in filters, that a task holds
ROWS = 512  # decoded at a time

# Places (i, j) of two descending lists that can be among the LIST highest sums.
_HEAD = np.array([(i, j) for i in range(LIST) for j in range(LIST) if (i + 1) * (j + 1) <= LIST]).T


class Code:
    """The product code for vectors of d dimensions with about `filters` directions."""

    def __init__(self, d: int, filters: int) -> None:
        self.size = max(4, int(np.ceil(np.sqrt(filters))))
        rng = np.random.default_rng([d, 77])
        self.half = d // 2
        self.words = []
        for n in (self.half, d - self.half):
            w = rng.standard_normal((self.size, n))
            self.words.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300))

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half] @ self.words[0].T, x[:, self.half :] @ self.words[1].T

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The LIST (or all) directions that each row of x exceeds, by its own threshold: first codeword
        << 20 | second codeword, in no order."""
        most = min(LIST, self.size**2)
        i, j = _HEAD[:, (_HEAD < self.size).all(axis=0)]
        out = np.zeros((len(x), most), np.int64)
        for s in range(0, len(x), ROWS):
            best = []
            for scores in self.scores(x[s : s + ROWS]):
                k = min(LIST, self.size)
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(scores, top, axis=1)
                order = np.argsort(-value, axis=1, kind="stable")
                best.append((np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)))
            (p, a), (q, b) = best
            at = np.argpartition(-(a[:, i] + b[:, j]), most - 1, axis=1)[:, :most]
            out[s : s + ROWS] = (np.take_along_axis(p[:, i], at, axis=1) << 20) | np.take_along_axis(q[:, j], at, axis=1)
        return out


def unit_rows(col: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where a row links with nothing."""
    out: list[np.ndarray | None] = []
    for v in col:
        x = v.values if v.is_valid else None
        if x is None or not len(x) or x.null_count:
            out.append(None)
            continue
        x = x.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0:
            out.append(None)
            continue
        x = x / top  # no overflow in the norm
        out.append(x / np.linalg.norm(x))
    return out


def _spread(pairs_a: np.ndarray, pairs_b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n nodes' component."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[pairs_a], lab[pairs_b])
        new = lab.copy()
        np.minimum.at(new, pairs_a, low)
        np.minimum.at(new, pairs_b, low)
        np.minimum.at(new, lab[pairs_a], low)
        np.minimum.at(new, lab[pairs_b], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _shard(cosine: float):
    def run(t: pa.Table) -> pa.Table:
        ids, weight = t.column("rep").to_numpy(), t.column("weight").to_numpy()
        vec = [np.frombuffer(v, np.float64) for v in t.column("unit").to_pylist()]
        lists = [np.frombuffer(v, np.int64) for v in t.column("filters").to_pylist()]
        places: dict[tuple, list[int]] = {}
        side: dict[tuple, list[int]] = {}
        for r, keys in enumerate(t.column("keys").to_pylist()):
            for k in keys:
                at = (k["f"], k["p"], k["q"])
                places.setdefault(at, []).append(r)
                side.setdefault(at, []).append(k["own"])
        count = np.zeros(len(ids), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for (f, p, q), rows in places.items():
            rows_, own = np.array(rows), np.array(side[(f, p, q)])
            left, right = (rows_, rows_) if p == q else (rows_[own == p], rows_[own == q])
            if not len(left) or not len(right):
                continue
            y = np.stack([vec[r] for r in right])
            for s in range(0, len(left), 512):
                some = left[s : s + 512]
                i, j = np.nonzero(np.stack([vec[r] for r in some]) @ y.T >= cosine)
                a, b = some[i], right[j]
                keep = ids[a] < ids[b] if p == q else a != b
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                a, b = _first_here(a, b, lists, f)
                np.add.at(count, a, weight[b])
                np.add.at(count, b, weight[a])
                ends.append((a, b))
        if ends:
            a, b = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        else:
            a = b = np.zeros(0, np.int64)
        order = np.argsort(ids)  # so that the least row of a component has its least id
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][_spread(place[a], place[b], len(ids))[place]]
        hit = count > 0
        return pa.table({"rep": ids[hit], "linked": count[hit], "root": root[hit]})

    return run


def _first_here(a: np.ndarray, b: np.ndarray, lists: list[np.ndarray], f: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without a common filter below f."""
    members = np.unique(np.concatenate([a, b]))
    low = [x[x < f] for x in (lists[r] for r in members)]
    known, back, many = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    use = np.cumsum(many > 1) - 1
    bits = np.zeros((len(members), int((many > 1).sum()) // 64 + 1), np.uint64)
    row = np.repeat(np.arange(len(members)), [len(x) for x in low])
    shared = many[back] > 1
    col = use[back[shared]]
    np.bitwise_or.at(bits, (row[shared], col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
    x, y = np.searchsorted(members, a), np.searchsorted(members, b)
    seen = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 16):
        seen[s : s + (1 << 16)] = (bits[x[s : s + (1 << 16)]] & bits[y[s : s + (1 << 16)]]).any(axis=1)
    return a[~seen], b[~seen]


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40  # rows are told apart by it, not by their ids
        for b in batches:
            u = unit_rows(b.column(b.schema.get_field_index("embedding")))
            ids = b.column(b.schema.get_field_index("vec_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(len(u))), ids, pa.array([None if x is None else len(x) for x in u], pa.int32()), pa.array([None if x is None else x.tobytes() for x in u], pa.binary())], ["rid", "vec_id", "d", "unit"])
            rid += len(u)

    rows = written(vectors.select("vec_id", "embedding").mapInArrow(units, "rid long, vec_id long, d int, unit binary").withColumn("key", F.md5("unit")), "units")
    classes = written(rows.where("unit IS NOT NULL").groupBy("key", "d").agg(F.min("vec_id").alias("least"), F.min("rid").alias("rep"), F.count("*").alias("weight"), F.min("unit").alias("unit")), "vectors")
    filters = {r.d: LIST * r["count"] // PER_FILTER for r in classes.groupBy("d").count().collect()}  # one row per length of vector

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Code] = {}
        for b in batches:
            d = b.column(b.schema.get_field_index("d")).to_pylist()
            unit = [np.frombuffer(v, np.float64) for v in b.column(b.schema.get_field_index("unit")).to_pylist()]
            found: list = [None] * len(d)
            for n in set(d):
                code = made.setdefault(n, Code(n, filters[n]))
                at = [i for i, k in enumerate(d) if k == n]
                for i, x in zip(at, code.decode(np.stack([unit[i] for i in at]))):
                    found[i] = np.sort(x * (1 << 16) + n)  # of this length only
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("rep")), b.column(b.schema.get_field_index("weight")), b.column(b.schema.get_field_index("unit")), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["rep", "weight", "unit", "filters", "list"])

    coded = written(classes.mapInArrow(decode, "rep long, weight long, unit binary, filters binary, list array<long>"), "filters")
    each = coded.select("rep", F.explode("list").alias("f"))
    sizes = each.groupBy("f").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    split = each.join(sizes, "f").withColumn("own", own).select("rep", "f", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    most = SHARD_BYTES // (8 * (max(filters, default=0) + LIST))  # places of a shard
    shards = max(1, -(-total // most))
    words = max(1, *(int(n**0.5) for n in filters.values())) if filters else 1
    parts = max(1, -(-total // (most * words)))  # of a first codeword
    key = F.struct("f", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "own")
    word, second = F.shiftright("f", 36), F.shiftright("f", 16).bitwiseAND(F.lit((1 << 20) - 1))
    place = F.when(F.col("blocks") > 1, F.xxhash64("f", F.least("own", "o"), F.greatest("own", "o"))).otherwise(F.xxhash64(word, F.pmod(second, F.lit(parts))))
    dealt = split.withColumn("shard", F.pmod(place, F.lit(shards)))
    dealt = dealt.groupBy("shard", "rep").agg(F.collect_list(key).alias("keys")).join(coded.drop("list"), "rep")
    found = written(dealt.groupBy("shard").applyInArrow(_shard(cosine), "rep long, linked long, root long"), "linked")
    links = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", "least", "rep", "weight").join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    named = named.select("key", "least", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.drop("least").join(least, "component")
    out = rows.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
