"""Arrow helpers for operators that work on batches of texts inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # text worked on at once; a longer text forms a slice of its own
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold at most ``limit`` bytes; null texts become empty ones."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        filled = pc.fill_null(batch.column(at), b"" if pa.types.is_binary(batch.column(at).type) else "")
        batch = batch.set_column(at, text, filled)
        sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
        start, room = 0, limit
        for i, size in enumerate(sizes):
            if size > room and i > start:
                yield batch.slice(start, i - start)
                start, room = i, limit
            room -= size
        if start < len(sizes):
            yield batch.slice(start)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (separated by ASCII white space) of all texts as (first word of each text + end, code per word, words)."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # what leading and trailing white space leaves
        keep = codes != empty
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
        codes = codes[keep]
    return starts, codes, coded.dictionary


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring ``starts``, empty ranges included."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i] + 1, ... of each range, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
