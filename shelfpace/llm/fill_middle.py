"""Fill-in-the-middle: texts cut in three at code points and put in another order around marks.

Texts are UTF-8 bytes cut into content-defined chunks: a rolling hash of the last ``WINDOW`` bytes names the boundaries, so
equal passages make equal chunks wherever they stand. Each worker remembers chunks with a summary: the number of code points
that start inside, whether a mark stands inside, and the bytes at both ends. A chunk met again is recognised by its whole
content, not by a hash alone. Summaries combine: numbers of code points add up, also where a chunk ends inside a code
point, and a mark that crosses a boundary shows in the two ends. Running sums of the numbers tell which chunk holds a cut;
only that chunk is looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.arrowtext import slices

MARKS = (b"<P>", b"<S>", b"<M>")
WINDOW = 16  # bytes of the rolling hash, a power of two
BITS = 10  # a boundary about every 2 ** BITS bytes
FIRST = 64  # no boundary before; the window then lies inside the text
LARGEST = 1 << 16  # bytes of a chunk; longer stretches without a boundary are cut at this distance
KEPT = 32 << 20  # bytes of chunks in each of the two generations a worker remembers
REORDERED, SUFFIX_FIRST = 90, 20  # percent of texts that are reordered; of these, that start with the suffix


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places where a chunk may end, by the bytes before them; two are at least two bytes apart."""
    h = _byte_values()[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    found = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    return found[np.diff(found, prepend=-2) > 1]


def chunk_ends(found: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ends of the chunks of the text between two places; ``found``: boundaries of the whole buffer."""
    inner = found[np.searchsorted(found, start + FIRST) : np.searchsorted(found, end)]
    edges = np.concatenate(([start], inner, [end]))
    if (np.diff(edges) > LARGEST).any():
        edges = np.concatenate([np.arange(a, b, LARGEST) for a, b in zip(edges[:-1], edges[1:], strict=True)] + [[end]])
    return edges[1:]


def _starts(chunk: bytes) -> np.ndarray:
    """Whether a code point starts at each byte."""
    return np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80


class Summaries:
    """Summaries of chunks by content, two generations of them; the older one goes when the younger is full."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.young, self.old, self.held = kept, {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        """(code points that start inside, whether a mark stands inside, first two bytes, last two bytes)."""
        known = self.young.get(chunk)  # equal hash and equal bytes
        if known is None:
            known = self.old.get(chunk) or (int(np.count_nonzero(_starts(chunk))), any(m in chunk for m in MARKS), chunk[:2], chunk[-2:])
            self.young[chunk] = known
            self.held += len(chunk)
            if self.held > self.kept:
                self.old, self.young, self.held = self.young, {}, 0
        return known


@lru_cache(maxsize=1)
def _memory() -> Summaries:
    return Summaries()


def combined(parts: list[tuple[int, bool, bytes, bytes]]) -> tuple[np.ndarray, bool]:
    """(running sum of code points, whether a mark stands inside or across the chunks)."""
    total = np.cumsum([p[0] for p in parts])
    across = any(b"<" in a[3] and any(m in a[3] + b[2] for m in MARKS) for a, b in zip(parts, parts[1:], strict=False))
    return total, across or any(p[1] for p in parts)


def byte_place(chunks: list[bytes], total: np.ndarray, point: int) -> int:
    """Byte at which code point ``point`` starts, through the one chunk that holds it."""
    k = int(np.searchsorted(total, point, side="right"))
    before = sum(map(len, chunks[:k]))
    if k == len(chunks):
        return before
    return before + int(np.flatnonzero(_starts(chunks[k]))[point - (int(total[k - 1]) if k else 0)])


def _transform(batches: Iterator[pa.RecordBatch], reordered: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    memory = _memory()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_chunks", "output"]
    for batch in slices(batches):
        out: list[list] = [[] for _ in names[1:]]
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        sizes = [len(t) for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        found = boundaries(data)
        dice = [batch.column(f"h{k}").to_pylist() for k in range(1, 5)]
        raw, start = data.tobytes(), 0
        for i, size in enumerate(sizes):
            edges = [start, *chunk_ends(found, start, start + size).tolist()] if size else [start]
            chunks = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            text = raw[start : start + size]
            start += size
            total, marked = combined([memory.of(c) for c in chunks])
            n = int(total[-1]) if chunks else 0
            h1, h2, h3, h4 = (d[i] for d in dice)
            if not n or marked or h3 % 100 >= reordered:
                row = [n, "plain", None, None, len(chunks), text]
            else:
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = byte_place(chunks, total, low), byte_place(chunks, total, high)
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h4 % 100 < suffix_first:
                    row = [n, "spm", low, high - low, len(chunks), b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle]
                else:
                    row = [n, "psm", low, high - low, len(chunks), b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.array(column, kind) for column, kind in zip(out, types, strict=True)]
        arrays[-1] = arrays[-1].cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)


def fill_in_middle(docs: DataFrame, seed: str = "1", reordered: int = REORDERED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, n_chunks, output: one row per row of ``docs``.

    The dice are the first four groups of eight hexadecimal digits of the SHA-256 of ``seed``, a colon and the doc_id: the first two
    give the cuts, the third whether the text is reordered, the fourth which part comes first. Form is ``plain`` (output is the
    text, no cuts), ``psm`` or ``spm``; empty texts and texts that hold a mark stay plain.

    Null text: an empty one. Null doc_id: an empty id in the hash. Rows that repeat an id are cut by the same dice, each in its
    own text. Texts of any length are taken whole. Other columns are not read. An empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    dice = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *dice)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_chunks long, output string"
    return rows.mapInArrow(partial(_transform, reordered=reordered, suffix_first=suffix_first), schema)


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form alone; a reordered text holds no mark of its own."""
    parts = F.split(output, "<[PSM]>", -1)
    prefix_first, suffix_first = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", prefix_first).when(form == "spm", suffix_first).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    """Sizes and digests of each output and of the text rebuilt from it."""
    back = restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
