"""Integer arrays as compact bytes, and rows of such arrays sent between pieces of the input and ranges of hash values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

MESSAGE = "part long, piece long, keys binary, a binary, b binary, c binary"


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes, with its item size and length in front."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T.tobytes()
    return bytes([size]) + len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(raw: bytes) -> np.ndarray:
    """The array of ``pack``, unsigned."""
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    kind = np.dtype(f"<u{size}")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[9:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """An ascending array of unsigned 64-bit values by its steps."""
    return pack(np.diff(values, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def small(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest unsigned type that holds them."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where ascending 64-bit keys pass from one of ``parts`` equal ranges of values to the next: parts + 1 places."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def row_dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other, so that the arrays of one are held at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def messages(piece: int, keys: np.ndarray, parts: int, *columns: np.ndarray, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """Ascending keys of a piece and up to three columns, cut by ranges of the keys (in their highest bits after ``shift``)."""
    cut = edges(keys << np.uint64(shift), parts)
    rows = [(p, piece, pack_sorted(keys[x:y]), *(pack(small(c[x:y])) for c in columns)) for p, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
    rows = [r + (None,) * (6 - len(r)) for r in rows]
    if rows:
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "piece", "keys", "a", "b", "c"])


def gather(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(messages by piece, places of each in the distinct keys, distinct keys, first holder of each, ends of the messages)."""
    frame = frame.sort_values("piece")
    lists = [unpack_sorted(k) for k in frame["keys"]]
    keys, first, where = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    ends = np.cumsum([len(x) for x in lists])
    return frame, np.split(where, ends[:-1]), keys, first, ends


def added(frame: pd.DataFrame, column: str, where: list[np.ndarray], n: int) -> np.ndarray:
    """Sum of a column of the messages for each distinct key."""
    total = np.zeros(n, np.int64)
    for raw, at in zip(frame[column], where, strict=True):
        total[at] += unpack(raw).astype(np.int64)  # keys of one message are distinct
    return total
