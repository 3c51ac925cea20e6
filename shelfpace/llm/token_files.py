"""Token files: the ids of all texts as one wavelet matrix per shard, and readers for them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfpace.llm.arrowtext import ragged, slices, sums, word_codes
from shelfpace.llm.vocabulary import word_ids

SLICE = 16 << 20  # text encoded at once
FILE_BYTES = 64 << 20  # text of a file
SHARD_TOKENS = 1 << 19  # ids after which a shard is closed; a document is never cut
BLOCK = 512  # bits between two stored ranks
END = 1  # id behind each document
SHARD = "part long, seq long, doc_ids array<long>, lengths array<long>, n long, planes array<binary>, ranks array<binary>, zeros array<long>"


class WaveletMatrix:
    """Bit-planes from the highest bit down; each plane is dealt stably by its bit, zeros first, to give the next.

    Each plane keeps the number of ones before every ``BLOCK`` bits, so that rank is one look-up and one short count, and
    select a search over these numbers.
    """

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()).bit_length() if len(ids) else 0
        now = ids.astype(np.uint16 if top <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for k in range(top - 1, -1, -1):
            bit = (now & now.dtype.type(1 << k)) != 0
            packed = np.packbits(bit)
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64)
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            planes.append(packed)
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype("<u4"))
            zeros.append(len(low))
            now = np.concatenate((now[low], now[high]))
        return cls(len(ids), planes, ranks, zeros)

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        block = i // BLOCK
        part = self.planes[k][block * BLOCK // 8 : (i + 7) // 8]
        if i % 8:
            part = part.copy()
            part[-1] &= 0xFF << (8 - i % 8) & 0xFF
        return int(self.ranks[k][block]) + int(np.bitwise_count(part).sum())

    def select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of that value in plane ``k``."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[block])])

    def _step(self, k: int, bit: int, i: int) -> int:
        ones = self.rank1(k, i)
        return self.zeros[k] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i // 8]) >> (7 - i % 8) & 1
            value, i = value << 1 | bit, self._step(k, bit, i)
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        if value < 0 or value >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            bit = value >> (len(self.planes) - 1 - k) & 1
            a, b = self._step(k, bit, a), self._step(k, bit, b)
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of an id between two places."""
        low, high = self._range(value, a, self.n if b is None else b)
        return high - low

    def occurrence(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of an id."""
        low, high = self._range(value, 0, self.n)
        if not 0 <= j < high - low:
            raise IndexError(f"{high - low} occurrences of {value}")
        at = low + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            at = self.select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, planes from the lowest bit up, each undoing one dealing."""
        top = len(self.planes)
        now = np.zeros(self.n, np.uint16 if top <= 16 else np.uint32)
        for k in range(top - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            back = np.empty_like(now)
            back[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            back[np.flatnonzero(bit)] = now[self.zeros[k] :]
            back |= bit.astype(now.dtype) << now.dtype.type(top - 1 - k)
            now = back
        return now.astype("<u4")


_FIELDS = [("part", pa.int64()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n", pa.int64()),
           ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64()))]


def _shard(seq: int, ids: list[np.ndarray], docs: list, lengths: list[np.ndarray]) -> pa.RecordBatch:
    m = WaveletMatrix.build(np.concatenate(ids))
    row = {
        "part": TaskContext.get().partitionId(), "seq": seq, "doc_ids": docs, "lengths": np.concatenate(lengths).tolist(), "n": m.n,
        "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks], "zeros": m.zeros,
    }
    return pa.RecordBatch.from_pylist([row], schema=pa.schema(_FIELDS))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, ends: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, number of ids per document) of each slice of texts, ends included."""
    words_of = word_ids(path, "", ends)
    for batch in slices(batches, limit=SLICE):
        starts, codes, words = word_codes(batch.column("text"))
        each, n = words_of.of(words)
        first = np.cumsum(n) - n
        # One more "word" per document: the end id, put behind the last one.
        each, first, n = np.append(each, np.uint32(END)), np.append(first, len(each)), np.append(n, 1)
        codes = np.insert(codes.astype(np.int64), starts[1:], len(words))
        starts = starts + np.arange(len(starts))
        yield batch.column("doc_id").to_pylist(), each[ragged(first[codes], n[codes])], sums(n[codes], starts)


def _to_shards(batches: Iterator[pa.RecordBatch], path: str, ends: str, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    seq, held = 0, 0
    ids, docs, lengths = [], [], []
    for doc_ids, got, size in _encoded(batches, path, ends):
        stop = np.concatenate(([0], np.cumsum(size)))
        at = 0
        while at < len(size):
            # Documents up to the one that fills the shard.
            to = min(len(size), int(np.searchsorted(stop, stop[at] + shard_tokens - held)))
            ids.append(got[stop[at] : stop[to]])
            docs += doc_ids[at:to]
            lengths.append(size[at:to])
            held += int(stop[to] - stop[at])
            at = to
            if held >= shard_tokens:
                yield _shard(seq, ids, docs, lengths)
                seq, held = seq + 1, 0
                ids, docs, lengths = [], [], []
    if docs:
        yield _shard(seq, ids, docs, lengths)


def write_token_files(docs: DataFrame, folder: str, path: str, ends: str = "</w>", shard_tokens: int = SHARD_TOKENS, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text and write the ids below ``folder``, documents in ascending order of doc_id.

    Rows are dealt into ranges of doc_id, so that file follows file in that order; a file holds one or more shards, each
    the wavelet matrix of some ``shard_tokens`` ids with the ids and lengths of its documents. ``path`` names a tokenizer file
    that drops white space, so that words are encoded on their own. Every document ends with id 1.

    Null text: an empty one, just the end id. Null doc_ids come first. Rows that repeat a doc_id stay, next to each other.
    Other columns are not read. An empty table gives a folder without shards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // file_bytes))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = ordered.mapInArrow(partial(_to_shards, path=path, ends=ends, shard_tokens=shard_tokens), SHARD)
    shards.write.option("compression", "zstd").parquet(folder)


def read_matrix(row) -> WaveletMatrix:
    """The wavelet matrix of a shard row."""
    planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
    return WaveletMatrix(int(row["n"]), planes, [np.frombuffer(r, "<u4") for r in row["ranks"]], [int(z) for z in row["zeros"]])


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each_shard(batches):
        raw = memoryview(read_matrix(row).decode().tobytes())
        lengths = np.asarray(row["lengths"], np.int64)
        ends = np.cumsum(lengths)
        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        columns = [np.full(len(lengths), row["part"]), np.full(len(lengths), row["seq"]), ends - lengths, lengths, crc]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(row["doc_ids"], pa.int64())], ["part", "seq", "local", "n_tokens", "ids_crc32", "doc_id"])


def _bases(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, n, base (ids before the shard): running sums inside files, inside blocks of files, and over the blocks."""

    def before(*by: str) -> Window:
        return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)

    shards = spark.read.schema(SHARD).parquet(folder).select("part", "seq", "n").withColumn("block", F.floor(F.col("part") / 1024))
    files = shards.groupBy("block", "part").agg(F.sum("n").alias("n"))
    blocks = files.groupBy("block").agg(F.sum("n").alias("n")).select(F.col("block").alias("of"), F.coalesce(F.sum("n").over(before("block")), F.lit(0)).alias("blocks_before"))
    files = files.select(F.col("part").alias("file"), "block", F.coalesce(F.sum("n").over(before("block", "part")), F.lit(0)).alias("files_before"))
    files = files.join(blocks, files["block"] == blocks["of"]).select("file", (F.col("files_before") + F.col("blocks_before")).alias("file_base"))
    inside = shards.withColumn("inside", F.coalesce(F.sum("n").over(before("part", "seq")), F.lit(0)))
    return inside.join(files, inside["part"] == files["file"]).select("part", "seq", "n", (F.col("file_base") + F.col("inside")).alias("base"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the token files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: those of the shards before and those before it in its own shard. A
    folder without shards gives no rows.
    """
    shards = spark.read.schema(SHARD).parquet(folder)
    docs = shards.mapInArrow(_read, "part long, seq long, local long, n_tokens long, ids_crc32 long, doc_id long")
    return docs.join(_bases(spark, folder), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _count(batches: Iterator[pa.RecordBatch], tokens: list[int]) -> Iterator[pa.RecordBatch]:
    for row in _each_shard(batches):
        m = read_matrix(row)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.count(t) for t in tokens], pa.int64())], ["token", "n"])


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of some ids stands in the whole folder, by rank in each shard, without decoding."""
    counted = spark.read.schema(SHARD).parquet(folder).mapInArrow(partial(_count, tokens=sorted(set(tokens))), "token long, n long")
    asked = spark.range(1).select(F.explode(F.array(*(F.lit(t).cast("long") for t in sorted(set(tokens))))).alias("token"))
    return asked.join(counted.groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _occur(batches: Iterator[pa.RecordBatch], token: int) -> Iterator[pa.RecordBatch]:
    for row in _each_shard(batches):
        m = read_matrix(row)
        places = np.array([m.occurrence(token, j) for j in range(m.count(token))], np.int64)
        ends = np.cumsum(np.asarray(row["lengths"], np.int64))
        doc = np.searchsorted(ends, places, side="right")
        inside = places - (ends - np.asarray(row["lengths"], np.int64))[doc]
        ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), row["part"])), pa.array(np.full(len(places), row["seq"])), ids, pa.array(inside), pa.array(places)], ["part", "seq", "doc_id", "inside", "local"])


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """doc_id, inside (place in the document), place (in the whole folder) of every occurrence of an id, by select."""
    found = spark.read.schema(SHARD).parquet(folder).mapInArrow(partial(_occur, token=token), "part long, seq long, doc_id long, inside long, local long")
    return found.join(_bases(spark, folder), ["part", "seq"]).select("doc_id", "inside", (F.col("base") + F.col("local")).alias("place"))


def _access(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each_shard(batches):
        m = read_matrix(row)
        yield pa.RecordBatch.from_arrays([pa.array([p + row["base"] for p in row["wanted"]], pa.int64()), pa.array([m.access(p) for p in row["wanted"]], pa.int64())], ["place", "token"])


def tokens_at(spark: SparkSession, folder: str, places: DataFrame, width: int = SHARD_TOKENS) -> DataFrame:
    """place, token for each distinct place of ``places`` (column ``place``: number of the id in the whole folder).

    Places meet their shard by bins of ``width`` ids, so a shard is compared with the places near it only. Places outside the
    folder and null places have no row.
    """
    wanted = places.select(F.col("place").cast("long").alias("place")).distinct().withColumn("bin", F.floor(F.col("place") / width))
    bases = _bases(spark, folder).filter("n > 0")
    bases = bases.withColumn("bin", F.explode(F.sequence(F.floor(F.col("base") / width), F.floor((F.col("base") + F.col("n") - 1) / width))))
    met = wanted.join(bases, "bin").filter((F.col("place") >= F.col("base")) & (F.col("place") < F.col("base") + F.col("n")))
    met = met.groupBy("part", "seq", "base").agg(F.collect_list(F.col("place") - F.col("base")).alias("wanted"))  # at most the ids of a shard
    return spark.read.schema(SHARD).parquet(folder).join(met, ["part", "seq"]).mapInArrow(_access, "place long, token long")
