"""Token counts of whole texts, with overlapping chunks for huge ones."""

from __future__ import annotations

import collections
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.arrowtext import slices, sums
from shelfpace.llm.vocabulary import tokenizer, word_ids

CHUNK = 1 << 13  # code points of a long text encoded at once
OVERLAP = 256  # code points two neighbouring chunks share at first
MARGIN = 32  # code points next to the ends of a chunk where nothing is spliced, longer than any special string

# White space as the pre-tokenizer sees it, with the separators that only some libraries count as such.
SEPARATORS = "".join(map(chr, range(28, 32)))
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACES = WHITE + SEPARATORS
IRREGULAR = f"^ | $|[{SPACES}] | [{SPACES}]"


def stable_boundary(text: str, low: int, high: int, left: np.ndarray, right: np.ndarray) -> int | None:
    """A place in the range where the encodings of two overlapping chunks can be spliced, nearest to its middle.

    ``left`` and ``right``: (start, end) of their tokens, in code points of the text. Two kinds of place are proven:

    * white space after another character, where both chunks end a token: words never reach across it;
    * the end of a token that both chunks hold. A list of tokens is the encoding of its text exactly if each two
      neighbours are the encoding of theirs. Up to that token the left list has this property, and from it on the right
      one, so the spliced list has it too.
    """
    ours, theirs = (t[(t[:, 1] >= low) & (t[:, 1] < high)] for t in (left, right))
    ends = np.intersect1d(ours[:, 1], theirs[:, 1]).tolist()
    spaces = [p for p in ends if text[p] in WHITE and text[p - 1] not in SPACES]
    held = set(map(tuple, ours[ours[:, 1] > ours[:, 0]].tolist())) & set(map(tuple, theirs.tolist()))
    # A character of several tokens gives them all its own place, so only the last of them tells where it ends.
    once = collections.Counter(e for _, e in theirs.tolist())
    return min(spaces or [e for _, e in held if once[e] == 1], key=lambda p: abs(2 * p - low - high), default=None)


def count_huge(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of a text encoded in overlapping chunks; the count equals that of the text encoded whole.

    The right one of two neighbouring chunks starts where the left one ends a token, so that both stay in step on text
    that repeats itself. They are spliced at a ``stable_boundary`` of the overlap, which is doubled while it holds none.
    If it reaches back to the last splice, the left chunk is encoded anew at twice its length.
    """

    def tokens(a: int, b: int) -> np.ndarray:
        return np.array(tok.encode(text[a:b], add_special_tokens=False).offsets, np.int64).reshape(-1, 2) + a

    total, spliced, start, end = 0, 0, 0, min(chunk, len(text))
    left = tokens(start, end)
    while end < len(text):
        shared, splice = overlap, None
        right_end = min(len(text), end + chunk)
        while splice is None and end - shared > spliced:
            right_start = int(left[left[:, 1] <= end - shared, 1].max(initial=spliced))
            right = tokens(right_start, right_end)
            splice = stable_boundary(text, right_start + margin, end - margin, left, right)
            shared *= 2
        if splice is None:  # nothing to splice at since the last splice
            end = min(len(text), start + 2 * (end - start))
            left = tokens(start, end)
            continue
        total += int(((left[:, 1] > spliced) & (left[:, 1] <= splice)).sum())
        spliced, start, end, left = splice, right_start, right_end, right
    return total + int((left[:, 1] > spliced).sum())


def _counts(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    tok, ids = tokenizer(path), word_ids(path, " ")
    for batch in slices(batches):
        texts = batch.column("text")
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(sizes > chunk):
            counts[i] = count_huge(tok, texts[int(i)].as_py(), chunk, overlap)
        some = np.flatnonzero(odd & (sizes <= chunk))
        whole = tok.encode_batch_fast(texts.take(pa.array(some)).to_pylist(), add_special_tokens=False)
        counts[some] = [len(e.ids) for e in whole]
        rest = np.flatnonzero(~odd & (sizes <= chunk))
        # No space stands beside other white space: each one starts a piece that is encoded on its own.
        lists = pc.split_pattern(texts.take(pa.array(rest)), " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
        each = ids.of(coded.dictionary)[1][codes] if len(codes) else np.zeros(0, np.int64)
        first = starts[:-1]
        each[first] = [len(e.ids) for e in tok.encode_batch_fast(coded.dictionary.take(pa.array(codes[first])).to_pylist(), add_special_tokens=False)]
        counts[rest] = sums(each, starts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``).

    ``path`` names a byte-level tokenizer file whose words carry their leading space. Texts above ``chunk`` code points
    are encoded in overlapping chunks (``count_huge``). Shorter texts are cut at spaces that are stable boundaries, and
    each different piece is encoded once per worker; texts with irregular white space are encoded whole.

    Null text: 0 bytes and 0 tokens. Null ids, repeated rows and other columns of ``docs`` do no harm: one row per row of
    ``docs``, no other column is read. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = rows.mapInArrow(partial(_counts, path=path, chunk=chunk, overlap=overlap), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
