"""Many small values as one row: named arrays in bytes, and rows of a key that are read one after the other."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that meet: those of a key come one after the other, by kind, then by place.
MEET = "key long, kind int, place long, data binary"


def pack(**arrays: np.ndarray) -> bytes:
    head = json.dumps({k: [a.dtype.str, list(a.shape)] for k, a in arrays.items()}).encode()
    return b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(a).tobytes() for a in arrays.values())])


def unpack(data: bytes) -> dict[str, np.ndarray]:
    at = 4 + int.from_bytes(data[:4], "little")
    out = {}
    for k, (kind, shape) in json.loads(data[4:at]).items():
        n = int(np.prod(shape, dtype=np.int64))
        out[k] = np.frombuffer(data, kind, n, at).reshape(shape)
        at += out[k].nbytes
    return out


def packed_texts(col: pa.Array) -> dict[str, np.ndarray]:
    """Texts (none null) as arrays for `pack`."""
    data = [x.as_py().encode() for x in col]
    return {"size": np.array([len(x) for x in data], np.int32), "bytes": np.frombuffer(b"".join(data), np.uint8)}


def texts_of(x: dict[str, np.ndarray]) -> list[str]:
    whole, at, out = x["bytes"].tobytes(), 0, []
    for n in x["size"].tolist():
        out.append(whole[at : at + n].decode())
        at += n
    return out


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, dict[str, np.ndarray]]]:
    for b in batches:
        key, kind, place = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "kind", "place"))
        for i, data in enumerate(b.column(b.schema.get_field_index("data"))):
            yield key[i], kind[i], place[i], unpack(data.as_py())


def meet(rows: DataFrame, run: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over the rows (MEET) of many keys in order; it holds what it wants of one key, and streams the rest."""
    dealt = rows.repartition("key").sortWithinPartitions("key", "kind", "place")
    return dealt.mapInArrow(lambda batches: run(unpacked(batches)), schema)


def meet_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    key, kind, place, data = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(place, pa.int64()), pa.array(data, pa.binary())], ["key", "kind", "place", "data"])
