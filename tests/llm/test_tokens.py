import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import packing, tokenfile, tokens, wavelet

DOCS = "doc_id long, text string, part string"
ODD = [(3, None, "x"), (1, "", None), (2, "a  b\n c 's don't 12 34 é z  \n\n x", ""), (9, "<|endoftext|> hi", "k"), (11, "a <|endoftext|> b", "k"), (12, "x<|endoftext|>y\n<|endoftext|><|endoftext|> \n z <|endoftext", ""), (5, " lead trail ", "k"), (7, "tab\tb\x1cq \x1c z", ""), (7, "tab\tb\x1cq \x1c z", ""), (8, "x\0 y\n z", ""), (10, "word " * 5000, "")]


def truth(rows):
    tok = Tokenizer.from_file(tokens.default_path())
    out, at = [], 0
    for d, t in sorted(((r[0], r[1] or "") for r in rows)):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def rows(spark, sf):
    return ODD + [(100 + r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_wavelet():
    a = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32)
    for x in (a, a[:1], a[:0], a[:64]):
        m, _ = wavelet.WaveletMatrix.load(memoryview(wavelet.WaveletMatrix.of(x, 9).dump()))
        assert (m.symbols() == x).all() and (m.access(np.arange(len(x))) == x).all()
        for s in (0, 7, 299):
            assert m.count(np.array([s]))[0] == (x == s).sum()
            assert (m.locate(s, np.arange((x == s).sum())) == np.flatnonzero(x == s)).all()
            i = np.arange(0, len(x) + 1, 37)
            assert (m.rank(np.full(len(i), s), i) == [(x[:k] == s).sum() for k in i]).all()


def test_round_trip(spark, rows):
    got = sorted(map(tuple, tokenfile.round_trip(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [t[:4] for t in truth(rows)]
    assert tokenfile.round_trip(spark.createDataFrame([], DOCS)).count() == 0


def check(pieces: pd.DataFrame, rows, size=1024):
    want = {}
    for d, _, n, _, ids in truth(rows):
        want.setdefault(d, []).append(ids)
    pieces = pieces.sort_values(["sequence_id", "offset"])
    for s, g in pieces.groupby("sequence_id"):
        assert (g.offset.values == np.concatenate([[0], np.cumsum(g.length.values)[:-1]])).all() and g.length.sum() <= size
    for d, all_ids in want.items():
        p = pieces[pieces.doc_id == d].sort_values(["start", "sequence_id"])
        assert p.length.sum() == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for r in p.itertuples():
                assert r.start == at and r.doc_tokens == len(all_ids[0]) and list(r.ids) == all_ids[0][at : at + r.length]
                assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
                at += r.length
    full = pieces.groupby("sequence_id").length.sum().values
    pad = np.where((full & (full - 1)) == 0, 0, size - full)
    return pad.sum() / full.sum()


def test_packing(spark, rows):
    assert check(packing.pack(spark.createDataFrame(rows, DOCS)).toPandas(), rows) < 0.05
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(40):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))])
        cost = rng.integers(0, 5, len(at)).astype(float)
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        f = [0.0]
        for j in range(1, len(at)):
            f.append(cost[j] + min(f[i] + pad(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 16))
        cuts = packing.choose_cuts(at, cost, 16)
        price = dict(zip(at.tolist(), cost))
        assert cuts[0] == 0 and cuts[-1] == at[-1]
        assert sum(pad(int(y - x)) + price[int(y)] for x, y in zip(cuts, cuts[1:])) == f[-1]


def test_clashing_columns_and_null_ids(spark):
    kinds = "doc_id long, text string, part string, start string, n_tokens string, shard string, before string, data string, length string, offset string"
    rows = [(d, t, *"abcdefgh") for d, t in ((None, "no id"), (None, "no id"), (1, None), (2, "two"))]
    docs = spark.createDataFrame(rows, kinds)
    got = tokenfile.round_trip(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, 1, 1), (False, 2, 2), (True, 0, 3), (True, 0, 3)]
    assert sum(r.length for r in packing.pack(docs).collect()) == 9


def test_special_token_of_a_text(spark):
    ids, n = tokens.Encoder(tokens.default_path()).encode(np.frombuffer(b"a <|endoftext|> b", np.uint8), np.array([0, 17]))
    assert n.tolist() == [5] and 50256 in ids
