"""Maximal periodic runs of words, from Lyndon roots under an order of the words and its reverse.

The grouping phase of Baier's suffix sorting puts suffixes into groups that share their longest Lyndon prefix: groups are
taken from the highest down, and each suffix of a group pushes the nearest lower one before it into a new group, whose
context grows by that of the group taken. When a group is taken, its context is the longest Lyndon word at its places. So one
pass per order gives the Lyndon array directly, without the order of the suffixes. Each maximal run has a Lyndon root under one
of the two orders; every candidate root (place, length) is extended to both sides by longest common extensions, read from
exact names of blocks of 1, 2, 4, ... words.

Only stretches of words covered by repeated windows can hold runs: a run of ``shortest`` words or more and at least two periods
repeats windows of half that size at its period everywhere. Other words are left out before the grouping, without loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.arrowtext import ragged, slices, word_codes
from shelfpace.llm.sqltext import indices, let, words

SHORTEST = 12  # words of a run
RUN = "struct<start:long,length:long,period:long>"


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place; symbol 0 separates texts and comes before all others.

    ``symbols`` starts with a separator. Separators are never pushed, so no Lyndon word reaches across one.
    """
    values, codes = np.unique(symbols, return_inverse=True)
    members = [part.tolist() for part in np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes))[:-1])]
    below, above = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))  # the groups in their order
    context = [1] * len(values)
    group = codes.tolist()
    left = list(range(len(symbols)))  # towards the nearest place before that is not taken yet
    out = [0] * len(symbols)
    now = len(values) - 1
    while now > 0:
        taken = [i for i in members[now] if group[i] == now]
        size = context[now]
        for i in taken:
            out[i] = size
            left[i] = i - 1
        pushed: dict[int, int] = {}
        for i in taken:
            p = i
            while left[p] != p:
                left[p] = left[left[p]]
                p = left[p]
            if group[p]:
                pushed[p] = pushed.get(p, 0) + 1
        kinds: dict[tuple[int, int], list[int]] = {}
        for p, times in pushed.items():
            kinds.setdefault((times, group[p]), []).append(p)
        # Most repetitions first: a new group stands directly above the old one, so those after it come below it.
        for times, old in sorted(kinds, reverse=True):
            places, fresh, over = kinds[times, old], len(members), above[old]
            members.append(places)
            context.append(context[old] + times * size)
            below.append(old)
            above.append(over)
            above[old] = below[over] = fresh
            for p in places:
                group[p] = fresh
        members[now] = None
        now = below[now]
    return np.array(out)


def _names(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... symbols from each place, equal for equal blocks; separators equal nothing."""
    first = symbols.astype(np.int64)
    apart = np.flatnonzero(symbols == 0)
    first[apart] = symbols.max(initial=0) + 1 + np.arange(len(apart))
    names = [first.astype(np.int32)]
    width = 1
    while 2 * width <= longest:
        last = names[-1].astype(np.int64)
        pairs = last[: len(last) - width] << 32 | last[width:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return names


def _common(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols agree from places a and b (a < b) on, or up to them."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width, table = 1 << k, names[k]
        x, y = (a + got, b + got) if forward else (a - got - width + 1, b - got - width + 1)
        inside = (x >= 0) & (y < len(table))
        same = inside & (table[np.where(inside, x, 0)] == table[np.where(inside, y, 0)])
        got += np.where(same, width, 0)
    return got


def runs_of(symbols: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, length, period) of all maximal runs of ``symbols`` (0 separates texts, also first), sorted."""
    cuts = np.flatnonzero(symbols == 0)
    longest = int(np.diff(cuts, append=len(symbols)).max())
    reverse = np.where(symbols > 0, symbols.max() + 1 - symbols, 0)
    places = np.flatnonzero(symbols)
    roots = [np.stack([places, lyndon_lengths(s)[places]], axis=1) for s in (symbols, reverse)]
    i, period = np.unique(np.concatenate(roots), axis=0).T
    names = _names(symbols, longest)
    right = _common(names, i, i + period, True)
    start = i - _common(names, i - 1, i + period - 1, False)
    length = i + period + right - start
    found = length >= np.maximum(shortest, 2 * period)
    return np.unique(np.stack([start, length, period], axis=1)[found], axis=0)


def _repeated(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Whether each word lies in a window of ``width`` words that stands in its text twice or more."""
    n = len(codes)
    if n < width:
        return np.zeros(n, bool)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64)
    value = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(31)
    whole = n - width + 1
    key = (doc[:whole] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + value[k : k + whole]
    at = np.flatnonzero(doc[:whole] == doc[width - 1 :])
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n + 1, np.int32)
    hits = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
    np.add.at(twice, hits, 1)
    np.add.at(twice, hits + width, -1)
    return np.cumsum(twice)[:-1] > 0


def _find(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        starts, codes, dictionary = word_codes(batch.column("text"))
        covered = _repeated(codes, starts, (shortest + 1) // 2)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        runs = np.zeros((0, 3), np.int64)
        if covered.any():
            # Each stretch of covered words of one text, with a separator before it.
            first = np.flatnonzero(covered & np.concatenate(([True], ~covered[:-1] | (doc[1:] != doc[:-1]))))
            edges = np.flatnonzero(covered & np.concatenate((~covered[1:] | (doc[1:] != doc[:-1]), [True])))
            size = edges - first + 1
            where = ragged(first - 1, size + 1)
            symbols = codes[np.maximum(where, 0)].astype(np.int64) + 1
            symbols[np.cumsum(size + 1) - size - 1] = 0
            runs = runs_of(symbols, shortest)
            runs[:, 0] = where[runs[:, 0]]
        owner = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
        gone = np.zeros(len(codes) + 1, np.int32)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(gone)[:-1] == 0
        ends = np.concatenate(([0], np.cumsum(kept)))[starts]
        left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), dictionary.take(pa.array(codes[kept])))
        offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        fields = [pa.array(runs[:, 0] - starts[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(starts)), lists, pc.binary_join(left, " ")], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; sorted), collapsed, one row per row of ``docs``.

    Words are separated by ASCII white space and numbered from 0. A run has at least ``shortest`` words and two smallest periods,
    and no neighbouring word continues it. ``collapsed`` holds the words, joined by single spaces, without those that some run
    contains after its first period.

    Null or empty text: no words, no runs, an empty rest. Texts of any length are taken whole, in the memory of one task (some 200 bytes
    a word where windows repeat). Null and repeated ids keep their rows. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_find, shortest=shortest), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which a tenth of the texts, by the CRC of the id, repeat a stretch of words up to their end."""

    def changed(text: Column, g: Column) -> Column:
        def repeated(ws: Column) -> Column:
            n = F.size(ws)
            a = g % n
            period = 1 + F.floor((n - a) / (3 + g % 8))
            return F.array_join(F.transform(indices(n), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int"))), " ")

        return let(words(text), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise(text))

    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.when(h % 10 == 0, changed(text, F.floor(h / 10))).otherwise(text).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the rest, per row."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    with_best = found.withColumn("best", best)
    length = -F.col("best.less")
    return with_best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
