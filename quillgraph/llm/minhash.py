"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components.

A document is the set of its distinct word shingles (A-Z lower-cased; fewer words than a
shingle: the whole sequence as one; no words: the empty set, linked with nothing). Every
element visits the slots of the signature in an order of its own, its j-th visit bidding
j + r; a slot keeps its lowest bid. Once the highest slot of a document is below j + 1 no
later visit can win, so long documents stop after the first visits.

Rows with equal texts are one class from the start, which a row represents; texts that differ
are linked by their full sets only, equal sets included. Classes that share a band of their signatures are candidates. First every member of a bucket is
compared with the bucket's leader, the class that shares bands with most others; this links
all but the outer members of a group of copies. Where a bucket still holds several
components, the members outside its largest one are compared with all others: within a
task, in pairs of blocks, and only links that join components leave it. A member of the largest
one travels once per block of the others, which are few. So no link between
candidates is lost and none is written out that does not matter. Links are always decided
on the full sets of the whole texts.

Defined results: null text is no words; rows that repeat an id are documents of their own, with
whatever text; a row without an id takes part like any other, and a component's id is the least
there is in it, null where no row of it has one; an empty table gives an empty result; other
columns are not read by near_duplicates, and deduplicated returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written
from .words import hash_words, mix, slices, spans, text_column, windows

BANDS, ROWS = 20, 4  # a pair at 0.8 shares no band with a chance of 3e-5
BLOCK = 1024  # classes of a bucket that meet at a time
BLOCK_BYTES = 8 << 20  # of the sets of a block
SHARD_BYTES = 16 << 20  # of sets, with their places in buckets, that a task closes
KEPT = ("row", "doc_id", "text", "key")


def shingle_sets(data: np.ndarray, off: np.ndarray, i: int, j: int, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    b, start, end, first = spans(data, off, i, j)
    h = hash_words(b, start, end, lower=True)
    w = windows(h, k)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(w[a : z - k + 1]))
        elif z > a:
            out.append(windows(np.concatenate([h[a:z], np.full(1, z - a, np.uint64)]), z - a + 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _draw(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent uniform numbers of each element at a level."""
    with np.errstate(over="ignore"):
        x = mix(h + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return (x >> np.uint64(32)).astype(np.float64) / 2**32, (x & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (rows: documents, columns: slots); infinite for empty sets."""
    n = np.array([len(s) for s in sets])
    sig = np.full(len(sets) * m, np.inf)
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), n)
    order = None
    for level in range(m):
        if level:
            active = (sig.reshape(-1, m).max(axis=1) >= level) & (n > 0)
            keep = active[doc]
            h, doc = h[keep], doc[keep]
            order = order[keep] if order is not None else None
        if not len(h):
            break
        r, u = _draw(h, level)
        k = level + (u * (m - level)).astype(np.int64)
        if level == 0:
            slot, first = k, k
        else:
            at = np.arange(len(h))
            if order is None:  # the first swap, now that it matters
                order = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
                first = first[keep]
                order[at, 0], order[at, first] = first, 0
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, level]
            order[:, level] = slot
        np.minimum.at(sig, doc * m + slot, level + r)
    return sig.reshape(-1, m)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40  # rows are told apart by it, not by their ids
        for b in batches:
            data, off = text_column(b, "text")
            cols = [b.column(b.schema.get_field_index(c)) for c in KEPT]
            for i, j in slices(off):
                sets = shingle_sets(data, off, i, j, k)
                sig = super_minhash(sets, BANDS * ROWS).view(np.uint64).reshape(len(sets), BANDS, ROWS)
                keys = np.zeros((len(sets), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for c in range(ROWS):
                        keys = mix(keys * np.uint64(31) + sig[:, :, c])
                    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
                has = np.array([len(s) > 0 for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(keys[has].ravel().view(np.int64)))
                numbers = [pa.array(rid + np.arange(j - i)), pa.array([len(s) for s in sets], pa.int64()), lists]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in cols), *numbers], [*KEPT, "rid", "n_shingles", "bands"])
                rid += j - i

    return run


def _overlap(k: int):
    """Adds to each pair the sizes of intersection and union of the two texts' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for b in batches:
            sides = [text_column(b, c) for c in ("ta", "tb")]
            ids = [b.column(b.schema.get_field_index(c)) for c in ("a", "b")]
            both, every = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, a in enumerate(ids[0].to_pylist()):
                if known[0] != a:
                    known = (a, shingle_sets(*sides[0], i, i + 1, k)[0])
                s, t = known[1], shingle_sets(*sides[1], i, i + 1, k)[0]
                both[i] = len(np.intersect1d(s, t, assume_unique=True))
                every[i] = len(s) + len(t) - both[i]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(both), pa.array(every)], ["a", "b", "both", "every"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b) with ok: whether 100 * intersection >= percent * union of the whole texts' sets."""
    one = texts.select(F.col("rid").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rid").alias("b"), F.col("text").alias("tb"))
    full = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    return full.mapInArrow(_overlap(k), "a long, b long, both long, every long").select("a", "b", (F.col("both") * 100 >= F.col("every") * percent).alias("ok"))


def _low(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _own_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_column(b, "text")
            for i, j in slices(off):
                sets = [s.tobytes() for s in shingle_sets(data, off, i, j, k)]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("rid")).slice(i, j - i), pa.array(sets, pa.binary())], ["rep", "set"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of incidence
    matrices over a few thousand of the elements that both sides hold at a time."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for s in range(0, len(both), 4096):
        some = both[s : s + 4096]
        one, two = (np.zeros((len(side), len(some)), np.float32) for side in (left, right))
        for m, side in ((one, left), (two, right)):
            for r, x in enumerate(side):
                at = np.minimum(np.searchsorted(some, x), len(some) - 1)
                m[r, at[some[at] == x]] = 1
        out += one @ two.T
    return out


def _closing(percent: int):
    """In each pair of blocks of a bucket, links as far as they join components."""

    def run(t: pa.Table) -> pa.Table:
        rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        size = np.array([len(s) for s in sets], np.float32)
        places: dict[tuple, list[tuple]] = {}
        for r, keys in enumerate(t.column("keys").to_pylist()):
            for x in keys:
                places.setdefault((x["key"], x["p"], x["q"]), []).append((r, x["own"], x["rest"]))
        up: dict[int, int] = {}
        out: list[tuple[int, int]] = []

        def root(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for (_, p, q), rows in places.items():
            row, own, rest = (np.array(x) for x in zip(*rows))
            # a block of the rest with itself or another one, or (q below 0) with one of the main component
            for a, b in [(row[rest], row[~rest])] if q < 0 else [(row[own == p], row[own == q])]:
                if not len(a) or not len(b):
                    continue
                both = intersections([sets[r] for r in a], [sets[r] for r in b])
                i, j = np.nonzero((both * 100 >= (size[a][:, None] + size[b][None, :] - both) * percent) & (comp[a][:, None] != comp[b][None, :]))
                pair = np.unique(np.stack([comp[a[i]], comp[b[j]]], axis=1), axis=0, return_index=True)[1] if len(i) else []
                for n in pair:
                    x, y = a[i[n]], b[j[n]]
                    u, v = root(int(comp[x])), root(int(comp[y]))
                    if u != v:
                        up[max(u, v)] = min(u, v)
                        out.append((int(rep[x]), int(rep[y])))
        cols = list(zip(*out)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row of docs: row (its columns but the text), doc_id, text, n_shingles, component_id and
    first: whether the row is the one of its component that stays, by least id, rows without one last."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    plain = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("key"))
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in plain.schema["row"].dataType.fields)
    s = plain.mapInArrow(_signatures(k), f"row struct<{kinds}>, doc_id long, text string, key binary, rid long, n_shingles long, bands array<long>")
    s = written(s, "signatures", compression="zstd")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    classes = s.where("n_shingles > 0").groupBy("key").agg(F.min(place).alias("least"), F.min("rid").alias("rep"), F.min_by("bands", "rid").alias("bands"), (F.min("n_shingles") * 8).alias("bytes"))
    classes = written(classes, "classes")
    band = classes.select("rep", "bytes", F.explode("bands").alias("key"))
    sizes = band.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(band.join(sizes, "key"), "buckets")
    # the more classes share bands with a class, the nearer it is to the middle of its group
    middle = buckets.groupBy("rep").agg(F.sum("size").alias("reach"))
    texts = written(s.select("rid", "text").join(middle.select(F.col("rep").alias("rid")), "rid"), "candidates", compression="zstd")
    placed = buckets.join(middle, "rep").select("key", "rep", "size", F.struct("reach", F.xxhash64("rep").alias("h")).alias("place"))
    lead = written(placed.groupBy("key").agg(F.max_by("rep", "place").alias("lead")), "leads")  # so that the join below can be split
    star = written(buckets.join(lead, "key").where("rep <> lead").select(*_low(F.col("rep"), F.col("lead"))).distinct(), "pairs")
    edges = written(verified(star, texts, k, percent).where("ok").select("a", "b"), "links")

    comp = components(edges)
    member = buckets.where("size > 2").join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", "bytes", "size", F.coalesce("component", "rep").alias("comp"))
    member = written(member, "members")
    each = member.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    main = each.groupBy("key").agg(F.max_by(F.struct("comp", "n", "b"), F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n, b: F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES)).cast("int")
    main = main.select("key", F.col("main.comp").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("b") - F.col("main.b")).alias("of_rest"), blocks(F.col("main.n"), F.col("main.b")).alias("of_main"))
    left = member.join(written(main, "mains"), "key").withColumn("rest", F.col("comp") != F.col("main"))
    left = left.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("of_rest")).otherwise(F.col("of_main"))).cast("int"))
    meets = F.expr("""CASE WHEN rest THEN concat(transform(sequence(0, of_rest - 1), o -> struct(least(own, o) AS p, greatest(own, o) AS q)),
        transform(sequence(0, of_main - 1), o -> struct(own AS p, -1 - o AS q))) ELSE transform(sequence(0, of_rest - 1), o -> struct(o AS p, -1 - own AS q)) END""")
    left = left.withColumn("at", F.explode(meets))
    shards = 1 + (left.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES
    key = F.struct("key", "at.p", "at.q", "own", "rest")
    dealt = left.withColumn("shard", F.pmod(F.xxhash64("key", "at.p", "at.q"), F.lit(shards))).groupBy("shard", "rep", "comp").agg(F.collect_list(key).alias("keys"))
    sets = texts.mapInArrow(_own_sets(k), "rep long, set binary")
    more = written(dealt.join(sets, "rep").groupBy("shard").applyInArrow(_closing(percent), "a long, b long"), "more")

    c = components(edges.unionByName(more))
    named = classes.join(c, F.col("rep") == F.col("node"), "left").select("key", "least", F.coalesce("component", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    named = named.select("key", "component").join(least, "component").select("key", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("one"))
    out = s.join(named, "key", "left")
    return out.withColumns({"component_id": F.coalesce("component_id", "doc_id"), "first": F.coalesce(F.col("one") == F.col("rid"), F.lit(True))})


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    out = _grouped(docs.select("doc_id", "text"), k, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without near duplicates: of each component the row with
    the least id, and only that one where ids repeat or are missing."""
    out = _grouped(docs, k, percent).where("first")
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
