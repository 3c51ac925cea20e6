"""Repeated passages: every byte covered by a string of ``length`` bytes that also starts somewhere else.

A string of that length is assigned to one anchor, the smallest of the hashes of its ``K``-byte windows (the first, if
several), so equal strings have equal anchors. Anchors that occur once cannot belong to a repeat. For each other anchor
the stretch of text whose strings it stands for forms a context; equal contexts are kept once with their number.

Contexts are dealt by anchor into blocks of bounded size. A block is sorted by the first ``length`` bytes or more of its
suffixes, which gives the Burrows-Wheeler transform (as the place that each suffix's predecessor has in the order) up to
that depth. From the interval of the empty string, intervals are extended backwards breadth-first, by one byte per level;
an interval that ends at a boundary without a value gives the boundary the level as its common prefix and goes on to the
next level, others end. Values are found in increasing order, and the search stops at ``length``: boundaries still without
one have common prefixes of that length or more. Anchors with more context than a block may hold are settled by
comparing hashes of all their strings, so no group is too large.

``PASSAGE`` words can be shorter than ``length`` bytes, so a passage of words that another row holds too is found apart, by
the same anchors over hashes of words. Contexts that two rows share settle both rows; the windows of the others are
compared by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.arrowtext import ragged, slices
from shelfpace.llm.staging import stage

LENGTH = 400  # bytes
K = 50  # bytes of an anchor
PASSAGE = 51  # words, whatever white space stands between them
PASSAGE_K = 8  # words of an anchor
PASSAGE_BYTES = 1 << 19  # texts whose words are hashed at once
SEGMENT = 1 << 19  # bytes of a text whose anchors are found at once
BLOCK_BYTES = 1 << 20  # contexts sorted at once, on average
LARGEST = 2 << 20  # context of one anchor that still goes into a block
KEY_BITS = 64  # of a number that holds two ranks and a place
PLACE = np.uint64(20)  # bits for a place in a segment
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    if n <= SEGMENT:
        return _first_powers(int(base))[:n]
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(8)
def _first_powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _running(data: np.ndarray, base: np.uint64) -> np.ndarray:
    """The polynomial of all symbols before each place, and of all."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    total[1:] = data
    total[1:] += np.uint64(1)
    total[1:] *= _powers(base, n)
    return np.cumsum(total, dtype=np.uint64, out=total)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_hashes(data: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place: differences of a running polynomial, brought to a common power."""
    n = len(data)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    total = _running(data, base)
    return _mixed((total[size:] - total[: n - size + 1]) * _powers(inverse, n - size + 1))


def _span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """The same for spans of any length."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    total = _running(data, base)
    return _mixed((total[end] - total[first]) * _powers(inverse, len(data))[first])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def anchors(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start): consecutive starts of strings that have the same anchor."""
    found = []
    for low in range(0, len(data) - length + 1, SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        h = _window_hashes(part, k, _BASE)
        keys = (h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
        least = _sliding_min(keys, length - k + 1)
        cut = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        place = (least[cut] & np.uint64((1 << 20) - 1)).astype(np.int64)
        found.append((h[place].view(np.int64), cut + low, np.append(cut[1:], len(least)) - 1 + low))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        parts, keys = [], []
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
            parts.append(anchors(data, length))
            keys.append(len(parts[-1][0]))
        h, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = pa.array(np.repeat(np.arange(batch.num_rows), keys))
        yield pa.RecordBatch.from_arrays([batch.column("key").take(row), pa.array(h), pa.array(first), pa.array(last)], ["key", "h", "first", "last"])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text + end, hash per word) of binary texts; words are separated by ASCII white space."""
    texts = texts.cast(pa.binary())
    cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begins[inner] = ~space[inner]  # words end with their text
    ends[inner - 1] = ~space[inner - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(first, cuts), _span_hashes(data, first, end, _BASE)


def passage_anchors(starts: np.ndarray, words: np.ndarray, size: int = PASSAGE, k: int = PASSAGE_K) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, first start, last start) of all windows of ``size`` words that lie in one text."""
    h, first, last = anchors(words, size, k)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found = []
    # Windows in two texts have no meaning. A run of starts may hold such windows before or after those of one text.
    for own in (text[first], text[last]):
        a, b = np.maximum(first, starts[own]), np.minimum(last, starts[own + 1] - size)
        found.append(pd.DataFrame({"text": own, "h": h, "a": a, "b": b})[a <= b])
    both = pd.concat(found).drop_duplicates()
    return tuple(both[name].to_numpy() for name in ("text", "h", "a", "b"))


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of passages with a hash of their context, each once per row."""
    for batch in slices(batches, limit=PASSAGE_BYTES):
        starts, words = word_hashes(batch.column("text"))
        text, h, a, b = passage_anchors(starts, words)
        c = _span_hashes(words, a, b + PASSAGE, _BASE2).view(np.int64)
        once = pd.DataFrame({"text": text, "h": h, "c": c, "first": a - starts[text], "size": b - a + 1}).drop_duplicates(["text", "h", "c"])
        key = batch.column("key").take(pa.array(once["text"].to_numpy()))
        yield pa.RecordBatch.from_arrays([key, *(pa.array(once[name].to_numpy()) for name in ("h", "c", "first", "size"))], ["key", "h", "c", "first", "size"])


def _passage_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each window of words in the contexts ``unsure``, each once per row."""
    for batch in slices(batches, limit=PASSAGE_BYTES):
        starts, words = word_hashes(batch.column("text"))
        each, lengths = batch.column("unsure").flatten(), batch.column("unsure").value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), lengths)
        first, size = (each.field(name).to_numpy(zero_copy_only=False) for name in ("first", "size"))
        at = ragged(first + starts[row], size)
        h1, h2 = (_window_hashes(words, PASSAGE, base)[at].view(np.int64) for base in (_BASE, _BASE2))
        once = pd.DataFrame({"text": np.repeat(row, size), "h1": h1, "h2": h2}).drop_duplicates()
        key = batch.column("key").take(pa.array(once["text"].to_numpy()))
        yield pa.RecordBatch.from_arrays([key, pa.array(once["h1"].to_numpy()), pa.array(once["h2"].to_numpy())], ["key", "h1", "h2"])


def _passages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of rows that share a whole context of ``PASSAGE`` words or more with another row, and per key the contexts of
    anchors that some other row is still unsettled by (unsure: first word, number of windows)."""
    found = rows.select("key", "text").mapInArrow(_passage_rows, "key binary, h long, c long, first long, size long")
    repeated = stage(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated-passage-anchors")
    held = stage(found.join(repeated, "h"), "passage-anchors")
    kinds = held.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("key", "first", "size")).alias("one"))
    kinds = stage(kinds.select("h", "c", "times", "one.*"), "passage-contexts")
    sharing = stage(held.select("key", "h", "c").join(kinds.filter("times > 1").select("h", "c"), ["h", "c"]).select("key").distinct(), "sharing-a-context")
    open_anchors = kinds.filter("times = 1").join(sharing, "key", "left_anti").select("h").distinct()
    unsure = kinds.join(open_anchors, "h").groupBy("key").agg(F.collect_list(F.struct("first", "size")).alias("unsure"))
    return sharing, unsure


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors ``found``, by digest."""
    for batch in slices(batches):
        found = batch.column("found")
        each, text = found.flatten(), batch.column("text")
        row = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy(zero_copy_only=False))
        h, first, last = (each.field(name).to_numpy(zero_copy_only=False) for name in ("h", "first", "last"))
        cids, now, data = [], -1, b""
        for i, own, a, b in zip(row.tolist(), h.tolist(), first.tolist(), (last + length).tolist(), strict=True):
            if i != now:
                now, data = i, text[i].as_py()
            cids.append(hashlib.md5(b"%d:" % own + data[a:b]).digest())
        columns = [batch.column("key").take(pa.array(row)), pa.array(h), pa.array(first), pa.array(last - first + 1), pa.array(cids, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "h", "first", "size", "cid"])


def _context_bytes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        each, text = batch.column("mixed").flatten(), batch.column("text")
        lengths = batch.column("mixed").value_lengths().to_numpy(zero_copy_only=False)
        first, size = (each.field(name).to_numpy(zero_copy_only=False) for name in ("first", "size"))
        contexts, now, data = [], -1, b""
        for i, a, b in zip(np.repeat(np.arange(batch.num_rows), lengths).tolist(), first.tolist(), (first + size + length - 1).tolist(), strict=True):
            if i != now:
                now, data = i, text[i].as_py()
            contexts.append(data[a:b])
        yield pa.RecordBatch.from_arrays([each.field("cid"), each.field("h"), each.field("size"), pa.array(contexts, pa.binary())], ["cid", "h", "size", "context"])


def bounded_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, ordered by their first ``depth`` symbols or more, at most up to their first symbol 0; ties stand
    together.

    A suffix's rank is the place of the first of its equals. Each round takes only suffixes that still have equals and have
    not reached a symbol 0. Keys are sorted together with their places in one number, which is faster than an order of keys.
    """
    n = len(symbols)
    bits = np.uint64(max(1, (n + 1).bit_length()))
    low, packed = (np.uint64(1) << bits) - np.uint64(1), 3 * int(bits) <= KEY_BITS
    places = np.arange(n, dtype=np.int32)
    left = np.minimum.accumulate(np.where(symbols == 0, places, np.int32(n))[::-1])[::-1] - places  # symbols before the next 0
    reach = int((64 - int(bits)) / np.log2(257))
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(reach, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(reach):
        key = key * np.uint64(257) + np.where(left >= j, padded[j : j + n], np.uint64(0))
    key = np.sort((key << bits) | places.astype(np.uint64))
    at, order, ranked = places, (key & low).astype(np.int32), key >> bits
    moved = order
    rank = np.zeros(n + 1, np.int32)  # the last one stands for the end
    while True:
        head = np.concatenate((np.ones(min(1, len(at)), bool), ranked[1:] != ranked[:-1]))
        rank[moved] = np.repeat(at[head], np.diff(np.append(np.flatnonzero(head), len(at)))) + np.int32(1)
        going = np.flatnonzero(~(head & np.append(head[1:], True)) & (left[moved] >= reach))
        at, moved = at[going], moved[going]
        if reach >= depth or not len(at):
            return order
        ranked = (rank[moved].astype(np.uint64) << bits) | rank[moved + np.int32(reach)].astype(np.uint64)
        if packed:
            key = np.sort((ranked << bits) | moved.astype(np.uint64))
            ranked, moved = key >> bits, (key & low).astype(np.int32)
        else:
            by = np.argsort(ranked)
            ranked, moved = ranked[by], moved[by]
        order[at] = moved
        reach *= 2


def repeated_starts(symbols: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Per place, whether the ``length`` symbols from there also start elsewhere; symbol 0 separates texts.

    Only meant for places without a separator among these symbols.
    """
    n = len(symbols)
    order = bounded_order(symbols, length)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = np.roll(symbols, 1)[order]  # the transform: the symbol before each suffix
    back = place[order - 1]  # where the suffix with that symbol stands
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for level in range(length):
        size = high - low
        ends = np.cumsum(size)
        inside = np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        interval = np.repeat(np.arange(len(low)), size)
        if level:  # strings that start with a separator are of no use
            plain = before[inside] != 0
            inside, interval = inside[plain], interval[plain]
        # Predecessors keep the order of their suffixes, so counting by symbol puts the extended intervals in order.
        symbol = before[inside]
        by = np.argsort(symbol, kind="stable")
        to, symbol, interval = back[inside[by]], symbol[by], interval[by]
        first = np.flatnonzero(np.concatenate(([True], (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1]))))
        if not len(to):
            break
        new_low = np.minimum.reduceat(to, first)
        new_high = new_low + np.diff(np.append(first, len(to)))  # an interval holds all suffixes that start with its string
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True
        if not len(low):
            break
    out = np.empty(n, bool)
    out[order] = ~known[:-1] | ~known[1:]
    return out


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


RUNS = "cid binary, runs array<struct<a:long,b:long>>"


def _block(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    parts, at, starts = [], 0, []
    for c in frame["context"]:
        parts += [np.frombuffer(c, np.uint8).astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)]
        starts.append(at)
        at += len(c) + 1
    flags = repeated_starts(np.concatenate(parts), length)
    runs = [_runs(flags[s : s + size]) for s, size in zip(starts, frame["size"], strict=True)]
    out = pd.DataFrame({"cid": frame["cid"], "runs": runs})
    return out[out["runs"].map(len) > 0]


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column("context")[i].as_buffer(), np.uint8)
            h1, h2 = (_window_hashes(data, length, b) for b in (_BASE, _BASE2))
            n = len(h1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("cid")[i].as_py()] * n), pa.array(np.arange(n)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["cid", "at", "h1", "h2"]
            )


def _repeated_runs(contexts: DataFrame, held: DataFrame, length: int, block: int, largest: int) -> DataFrame:
    """cid, runs of starts (from the context's beginning) that repeat; ``contexts``: cid, h, size, times, and the key and
    first start of one that is like it; ``held``: key, text."""
    groups = contexts.groupBy("h").agg(F.count("*").alias("several"), F.sum(F.col("size") + (length - 1)).alias("bytes")).filter("several > 1")
    groups = stage(groups, "anchor-groups")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("size") - 1).alias("b")))
    found = contexts.filter("times > 1").select("cid", whole.alias("runs"))
    fits = F.col("bytes") <= largest
    total, n_large = groups.agg(F.sum(F.when(fits, F.col("bytes"))), F.count(F.when(~fits, 1))).first()

    def mixed(some: DataFrame) -> DataFrame:
        """cid, h, size, context of the anchors ``some``; bytes are cut from one text that holds them."""
        own = contexts.join(some.select("h"), "h").groupBy("key").agg(F.collect_list(F.struct("cid", "h", "first", "size")).alias("mixed"))
        return held.select("key", "text").join(own, "key").select("text", "mixed").mapInArrow(partial(_context_bytes, length=length), "cid binary, h long, size long, context binary")

    if total:
        small = mixed(groups.filter(fits)).select(F.pmod("h", F.lit(-(-total // block))).alias("block"), "cid", "size", "context")
        found = found.unionByName(small.groupBy("block").applyInPandas(lambda f: _block(f.drop(columns="block"), length), RUNS))
    if n_large:
        large = mixed(groups.filter(~fits)).select("cid", "context").mapInArrow(partial(_strings, length=length), "cid binary, at long, h1 long, h2 long")
        twice = large.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
        found = found.unionByName(large.join(twice, ["h1", "h2"]).select("cid", F.array(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("runs")))
    return found


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts without the covered bytes: what is left, and the spans taken out."""
    for batch in slices(batches):
        left, spans = [], []
        for i in range(batch.num_rows):
            text, runs = batch.column("text")[i].as_py(), batch.column("runs")[i].as_py() or []
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, [r["a"] for r in runs], 1)
            np.add.at(edge, [r["b"] + length for r in runs], -1)
            gone = np.cumsum(edge[:-1]) > 0
            left.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            spans.append([{"start": r["a"], "end": r["b"] + 1} for r in _runs(gone)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(left, pa.binary()), pa.array(spans, kind), batch.column("shares_passage")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "kept", "spans", "shares_passage"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK_BYTES, largest: int = LARGEST) -> DataFrame:
    """doc_id, n_bytes, kept (remaining bytes), spans (start, end of the maximal runs taken out), shares_passage (whether
    ``PASSAGE`` words in a row also stand in another row), one row per row of ``docs``.

    Texts are taken as UTF-8 bytes; what is left need not be whole characters. Overlapping repeats count, matches never
    reach across texts, and repeats are judged on the input. Null texts count as empty; texts shorter than ``length`` stay
    whole. Rows that repeat one another are copies, whose strings all occur twice. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), F.lit(":").cast("binary"), F.col("text")))))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    sharing, unsure = _passages(rows)
    all_anchors = stage(rows.select("key", "text").mapInArrow(partial(_anchor_rows, length=length), "key binary, h long, first long, last long"), "anchors")
    repeated = stage(all_anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated-anchors")
    flagged = all_anchors.join(repeated, "h").distinct()
    flagged = flagged.groupBy("key").agg(F.collect_list(F.struct("h", "first", "last")).alias("found"))
    flagged = stage(flagged.join(unsure, "key", "full").join(sharing.withColumn("shares", F.lit(True)), "key", "full"), "flagged")
    # Texts move once: those without open questions go from here to the result.
    texts = rows.join(flagged, "key", "left").withColumn("open", F.expr("int(found is not null or unsure is not null)"))
    texts = stage(texts, "texts", "open")
    held = texts.filter("open = 1")
    windows = stage(held.filter("unsure is not null").select("key", "text", "unsure").mapInArrow(_passage_windows, "key binary, h1 long, h2 long"), "passage-windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    late = windows.join(twice, ["h1", "h2"]).select("key").distinct().withColumn("late", F.lit(True))
    contexts = held.filter("found is not null").select("key", "text", "found").mapInArrow(partial(_contexts, length=length), "key binary, h long, first long, size long, cid binary")
    contexts = stage(contexts, "contexts")
    distinct = contexts.groupBy("cid").agg(F.first("h").alias("h"), F.first("size").alias("size"), F.min(F.struct("key", "first")).alias("one"), F.count("*").alias("times"))
    distinct = stage(distinct.select("cid", "h", "size", "times", "one.*"), "distinct-contexts")
    runs = stage(_repeated_runs(distinct, held, length, block, largest).select("cid", F.explode("runs").alias("r")), "runs")
    spans = contexts.select("cid", "key", "first").join(runs, "cid").select("key", (F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b")).distinct()
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    spans = stage(spans.join(late, "key", "full"), "document-runs")
    shares = F.coalesce("shares", "late", F.lit(False)).alias("shares_passage")
    cut = held.select("doc_id", "n_bytes", "key", "text", "shares").join(spans, "key", "left").select("doc_id", "n_bytes", "text", "runs", shares)
    cut = cut.mapInArrow(partial(_cut, length=length), "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>, shares_passage boolean")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")
    whole = texts.filter("open = 0").select("doc_id", "n_bytes", F.col("text").alias("kept"), none, F.coalesce("shares", F.lit(False)).alias("shares_passage"))
    return whole.unionByName(cut)


def digest(left: DataFrame) -> DataFrame:
    """Sizes and digest of what is left of each document, whether anything was taken out, and whether it shares a passage."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("has_repeat"), "shares_passage")
