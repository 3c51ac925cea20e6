"""Severity of toxic language: cumulative-link ordinal regression on hashed word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.arrowtext import slices, word_codes

BUCKETS = 1 << 17  # hashed features
SAMPLE = 12_000  # labelled rows the model is fitted on at most, chosen by a hash of their id
PREFIX = 5  # letters of the stem feature, which reaches inflected forms
GRADES = 3  # severity grades above 0
STEPS = 250
EDGE = ".,;:!?\"'()[]*_#$%&|<>"


def word_features(words: pa.Array) -> np.ndarray:
    """Two hashed features of each word: its letters, and its first letters."""
    bare = pc.utf8_trim(pc.utf8_lower(words), characters=EDGE)
    stem = pc.utf8_slice_codeunits(bare, 0, PREFIX)
    size = pc.utf8_length(bare).to_numpy(zero_copy_only=False)

    def hashed(values: pa.Array, key: str) -> np.ndarray:
        raw = pd.util.hash_array(values.to_numpy(zero_copy_only=False), hash_key=key, categorize=False)
        return (raw % np.uint64(BUCKETS)).astype(np.int64)

    found = np.stack([hashed(bare, "severity: words "), hashed(stem, "severity: stems ")], axis=1)
    found[size == 0] = -1
    found[size < PREFIX, 1] = -1
    return found


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each text."""
    for batch in slices(batches):
        starts, codes, words = word_codes(batch.column("text"))
        table = word_features(words)
        found = [np.unique(table[codes[a:b]].ravel()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        lists = pa.array([f[f >= 0].astype(np.int32) for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists], ["doc_id", "toxic", "features"])


@dataclass
class OrdinalModel:
    """P(grade >= k) = logistic(score - cut_k), one weight vector for all cuts, cuts in ascending order."""

    weights: np.ndarray
    cuts: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, buckets: int = BUCKETS, decay: float = 2e-4, steps: int = STEPS) -> OrdinalModel:
    """Proportional odds by full-batch Adam on the log-likelihood; feature values are 1.

    ``rows``, ``columns``: one entry for each feature of each row, rows ascending. The cuts are a first value and positive
    steps, so they stay in order. Only columns that occur at all are fitted.
    """
    used, at = np.unique(columns, return_inverse=True)
    n, top = len(grades), int(grades.max(initial=1))
    weights, first, gaps = np.zeros(len(used)), 1.0, np.full(top - 1, -0.7)
    m, v = np.zeros(len(used) + top), np.zeros(len(used) + top)
    for step in range(1, steps + 1):
        cuts = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        score = np.bincount(rows, weights[at], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -30, 30)))
        full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
        slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), axis=1)
        i = np.arange(n)
        share = np.maximum(full[i, grades] - full[i, grades + 1], 1e-9)
        by_score = -(slope[i, grades] - slope[i, grades + 1]) / share / n
        by_cut = np.zeros(top)
        np.add.at(by_cut, grades[grades > 0] - 1, (slope[i, grades] / share / n)[grades > 0])
        np.add.at(by_cut, grades[grades < top], -(slope[i, grades + 1] / share / n)[grades < top])
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate((np.bincount(at, by_score[rows], len(used)) + decay * weights, [by_cut.sum()], tail[1:] * np.exp(gaps)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        weights = weights - move[: len(used)]
        first -= move[len(used)]
        gaps = np.clip(gaps - move[len(used) + 1 :], -6, 3)
    dense = np.zeros(buckets, np.float32)
    dense[used] = weights
    return OrdinalModel(dense, first + np.concatenate(([0], np.cumsum(np.exp(gaps)))))


def severity_grades(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(features worth fitting, grade per row) from yes/no labels.

    A feature counts as telling when it is frequent enough and its log odds of a toxic row are high; toxic rows are graded
    by how many telling features they hold, in equal shares. Grade 0 is not toxic.
    """
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    with1 = np.bincount(columns, toxic[rows], BUCKETS)
    with0 = np.bincount(columns, 1 - toxic[rows], BUCKETS)
    odds = np.log((with1 + 0.5) / (n1 + 1)) - np.log((with0 + 0.5) / (n0 + 1))
    keep = (with1 + with0 >= 5) & (np.abs(odds) > 1.0)
    telling = keep & (odds > 2.0)
    count = np.bincount(rows, telling[columns], len(toxic))
    marked = np.sort(count[toxic == 1])
    edges = [marked[len(marked) * k // grades] for k in range(1, grades)] if len(marked) else []
    return keep, np.where(toxic == 1, 1 + np.searchsorted(np.array(edges), count, side="right") if edges else 1, 0).astype(int)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """The model from at most ``sample`` labelled documents (the ones with the smallest hash of their id).

    Only this bounded sample goes to the driver, as lists of feature numbers. Without toxic labels every score is low.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.join(marks, "doc_id").mapInArrow(_features, "doc_id long, toxic int, features array<int>")
    table = got.orderBy("doc_id").toArrow()
    lists = table.column("features").combine_chunks()
    toxic = table.column("toxic").to_numpy().astype(int)
    if not len(toxic) or not toxic.any():
        return OrdinalModel(np.zeros(BUCKETS, np.float32), np.arange(GRADES) + 10.0)
    rows = np.repeat(np.arange(len(toxic)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    columns = lists.flatten().to_numpy().astype(np.int64)
    keep, grades = severity_grades(rows, columns, toxic)
    chosen = keep[columns]
    return fit_ordinal(rows[chosen], columns[chosen], grades)


def _scores(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        starts, codes, words = word_codes(batch.column("text"))
        table = word_features(words)
        # Words without any weight drop out; the others' features count once per text.
        matters = ((model.weights[table] != 0) & (table >= 0)).any(axis=1)
        hit = np.flatnonzero(matters[codes])
        doc = np.searchsorted(starts, hit, side="right") - 1
        pairs = np.stack([np.repeat(doc, 2), table[codes[hit]].ravel()], axis=1)
        pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
        score = np.bincount(pairs[:, 0], model.weights[pairs[:, 1]], batch.num_rows)
        p = model.at_least(score)
        columns = [batch.column(c) for c in batch.schema.names if c != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0])], [*names, "expected_severity", "p_toxic"])


def toxicity(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, expected_severity (sum of P(grade >= k)), p_toxic (P(grade >= 1)), toxic (p_toxic >= threshold).

    One row per row of ``docs``. Null or empty texts have no features: their severity is that of the cuts alone. Null
    ids, repeated rows and other columns do no harm.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(partial(_scores, model=model), "doc_id long, expected_severity double, p_toxic double")
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)


def _clean(batches: Iterator[pa.RecordBatch], model: OrdinalModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        only = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
        keep = [x < threshold for part in _scores(iter([only]), model) for x in part.column("p_toxic").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def without_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not toxic; one pass, no join."""
    return docs.mapInArrow(partial(_clean, model=model, threshold=threshold), docs.schema)
