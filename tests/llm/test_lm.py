import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import lm, ppm

COLS = "doc_id long, text string, score string"


def brute(rows, order, share):
    """The same model from the definition: dictionaries of contexts, one symbol at a time."""
    norm = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
    stream = lambda t: " ".join(norm(t)).encode() + b"\n"
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    words, ends, size = Counter(), 0, 0
    for d, t, *_ in rows:
        if not held[d]:
            words.update(norm(t))
            ends += 1
            s = b"\n" * order + stream(t)
            for i in range(order, len(s)):
                size += 1
                for k in range(order + 1):
                    counts[k][s[i - k : i]][s[i]] += 1
    least = max(1.0, share * size)
    kept = [{c: Counter({x: n for x, n in v.items() if n >= least}) for c, v in level.items()} for level in counts]
    out = []
    for d, t, *_ in rows:
        s, score = b"\n" * order + stream(t), 0.0
        for i in range(order, len(s)):
            gone: set = set()
            p = 1.0
            for k in range(order, -1, -1):
                c = s[i - k : i]
                seen = kept[k].get(c, Counter())
                if not seen:
                    continue
                total = sum(counts[k][c].values()) - sum(seen[x] for x in gone)
                if total > 0:
                    if s[i] in seen and s[i] not in gone:
                        p *= (seen[s[i]] - 0.5) / total
                        break
                    pruned = sum(counts[k][c].values()) - sum(seen.values())
                    p *= (pruned + len(set(seen) - gone) / 2) / total
                gone |= set(seen)
            else:
                p /= 256 - len(gone)
            score += math.log10(p)
        w = norm(t)
        n, v = sum(words.values()) + ends, len(words) + (ends > 0)
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        out.append((d, held[d], len(w) + 1, sum(words[x] > 0 for x in w) + (ends > 0), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("order, share", [(2, 2e-3), (4, 1e-9)])
def test_equals_definition(spark, sf, order, share):
    rows = [(r.doc_id, r.text[:700], None) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(1000, None, "x"), (1001, "", None), (1002, " \n\t ", ""), (1003, "ABC abc é", ""), (1003, "ABC abc é", "")]
    got = sorted(map(tuple, lm.scores(spark.createDataFrame(rows, COLS), order=order, share=share).collect()))
    want = brute(rows, order, share)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want])


def test_probabilities_sum_to_one(spark, sf):
    rng = np.random.default_rng(1)
    g = rng.integers(97, 104, 3000)
    x = np.zeros(3000, np.int64)
    for k in range(ppm.ORDER + 1):
        x |= np.roll(g, k) << (8 * k)
    keys, n = np.unique(x, return_counts=True)
    model = ppm.Model(ppm.shares(keys, n, 3))
    for c in (keys[0] >> 8, keys[-1] >> 8, 0x6162):
        assert abs((10 ** model.log10((int(c) << 8) + np.arange(256))).sum() - 1) < 1e-9
    out = lm.scores(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").toPandas()
    assert len(out) and (out.score < 0).all()
    assert lm.scores(spark.createDataFrame([], COLS)).count() == 0


def test_keeps_rare_grams_of_a_large_corpus(spark, monkeypatch):
    """More than 5 MB, where a share of 2e-7 would prune what was seen once; many shards, few frequent grams."""
    rng = np.random.default_rng(3)
    common = " ".join(["the same old line"] * 6000)
    rows = [(d, common, None) for d in range(1, 70)] + [(1000 + i, "".join(map(chr, rng.integers(97, 117, 40))), None) for i in range(60)]
    monkeypatch.setattr(lm, "SHARD_GRAMS", 200, raising=False)
    small = [x for x in rows if x[0] >= 1000]
    got = sorted(map(tuple, lm.scores(spark.createDataFrame(rows, COLS)).where("doc_id >= 1000").select("doc_id", "held_out", "score").collect()))
    keys, n = Counter(), None
    for d, t, _ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            data = np.frombuffer(t.encode(), np.uint8)
            text = np.append(data, np.uint8(10))
            k, n = np.unique(ppm.grams(text, np.array([0, len(text)])), return_counts=True)
            keys.update(dict(zip(k.tolist(), n.tolist())))
    assert sum(keys.values()) > 5_000_000
    model = ppm.Model(ppm.shares(np.array(list(keys)), np.array(list(keys.values())), 1))
    want = []
    for d, t, _ in small:
        text = np.append(np.frombuffer(t.encode(), np.uint8), np.uint8(10))
        want.append((d, zlib.crc32(str(d).encode()) % 7 == 2, model.log10(ppm.grams(text, np.array([0, len(text)]))).sum()))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)])


def test_many_chunks_shards_and_messages(spark, sf, monkeypatch):
    """The same scores however the corpus is cut into chunks, shards, messages and batches."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120)
    docs = spark.createDataFrame([*map(tuple, docs.collect()), (None, "no id"), (None, "no id"), (7000, None)], "doc_id long, text string")
    key = lambda r: [(x is None, x or 0) for x in r]
    want = sorted(map(tuple, lm.scores(docs).collect()), key=key)
    monkeypatch.setattr(lm, "KEYS", 3000)
    monkeypatch.setattr(lm, "SHARD_BYTES", 5000)
    monkeypatch.setattr(lm, "MESSAGE", 40)
    monkeypatch.setattr(lm, "SPOOL", 100)
    got = sorted(map(tuple, lm.scores(docs.repartition(3)).collect()), key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want] and len(got) == 123
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want])


def test_packing_of_numbers():
    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(0, 2**56, 5000))
    assert (lm.unpacked_keys(lm.packed_keys(x), len(x)) == x).all()
    assert (lm.back(lm.turned(x, 6, 3), 6, 3) == x).all() and (lm.back(lm.turned(x % 2**24, 2, 2), 2, 2) == x % 2**24).all()
    t = lm.Tally()
    for a in (x[:3000], x[2000:], x[:10]):
        t.add(a)
    t.add(x[:5], counted=False)
    t.merge()
    assert (t.key == x).all() and t.n.sum() == 3000 + 3000 + 10 and t.n[0] == 2
