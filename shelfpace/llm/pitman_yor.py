"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Each word is the context of a restaurant whose customers are the words behind it; all of them share one parent, the restaurant
without context, whose base is uniform over the training words and one unknown word. Every table of a child sends one
customer to the parent. A Gibbs sweep seats all customers of a word in a restaurant anew, one after the other by the
Chinese-restaurant rule, while tables of other words and the parent's chances stand as the last sweep left them; then the
parent is seated the same way. After a burn-in, the predictive probabilities of the following sweeps are averaged.

Texts are worked on in pieces of bounded size, each with its own sorted words and pairs. Counts and tables of the whole corpus
meet in ranges of hash values: every piece sends its part to each range, a range adds up what all pieces sent and answers
each of them, in the order of its request. Seats are drawn from a hash of pair, sweep and customer, so all pieces that hold
a pair draw the same, and one of them, its owner, reports the tables. No table of words or pairs passes through the driver or one
task; a frequent word is one entry per piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.arrowtext import slices, sums, word_codes
from shelfpace.llm.packing import MESSAGE, added, gather, messages, mix, pack, pack_sorted, row_dicts, small, unpack, unpack_sorted
from shelfpace.llm.staging import small_batches, stage

PIECE_BYTES = 6 << 20  # text of a piece
RANGE_KEYS = 1 << 20  # keys a range receives, on average
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0  # of every restaurant
SINGLY = 64  # customers seated one by one; later ones come in blocks of a sixteenth of those seated
END = np.uint64(0x5EED0F7E47E4D000)  # stands for the end of a text, and for what comes before its first word


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit key per pair of word hashes."""
    return mix(mix(context) * np.uint64(0x9E3779B97F4A7C15) + word)


def _chance(key: np.ndarray, sweep: int, customer: int) -> np.ndarray:
    salt = np.uint64((sweep * 0xD1B54A32D192ED03 + customer * 0xABC98388FB8FAC03) % (1 << 64))
    return (mix(key ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seats(key: np.ndarray, customers: np.ndarray, weight: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables that the customers of each word take.

    ``weight`` is (strength + discount * tables of the restaurant) * chance of the word in the parent. With t tables and j
    customers seated the next one opens a table with chance weight / (weight + j - discount * t). Beyond ``SINGLY``, blocks come
    at the chance of their first customer; their expected number of tables is rounded at random.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    at = at[np.argsort(-customers[at], kind="stable")]  # the most customers first: those with some left stay in front
    left, every = -customers[at], (key[at], weight[at], tables[at])
    seated, n = 1, len(at)
    while n:
        k, w, t = (x[:n] for x in every)
        block = max(1, seated // 16 if seated >= SINGLY else 1)
        fresh = w / (w + seated - discount * t)
        t += np.floor(np.minimum(block, -left[:n] - seated) * fresh + _chance(k, sweep, seated)).astype(np.int64) if seated >= SINGLY else _chance(k, sweep, seated) < fresh
        seated += block
        n = int(np.searchsorted(left[:n], -seated))
    tables[at] = every[2]
    return tables


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in slices(batches, limit=limit):
        starts, codes, words = word_codes(pc.ascii_lower(batch.column("text")))
        h = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
        vocabulary = np.unique(np.append(h, END))
        end = int(np.searchsorted(vocabulary, END))
        tokens = np.insert(np.searchsorted(vocabulary, h)[codes], starts[1:], end)
        lengths = np.diff(starts) + 1
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        learnt = np.repeat(train, lengths)
        before = np.concatenate(([end], tokens[:-1]))  # every text ends with the mark, so it also stands before the next
        pairs, which = np.unique(before << 32 | tokens, return_inverse=True)
        word_n = np.bincount(tokens[learnt], minlength=len(vocabulary))
        pair_n = np.bincount(which[learnt], minlength=len(pairs))
        row = {
            "piece": [part << 24 | seq], "n_words": [len(vocabulary)], "n_pairs": [len(pairs)],
            "vocabulary": [pack_sorted(vocabulary)], "word_n": [pack(small(word_n))],
            "context": [pack(small(np.diff(pairs >> 32, prepend=0)))], "word": [pack((pairs & 0xFFFFFFFF).astype(np.uint32))], "pair_n": [pack(small(pair_n))],
            "tokens": [pack(which.astype(np.uint32))], "lengths": [pack(small(lengths))],
            "doc_ids": [batch.column("doc_id").to_pylist()], "train": [train.tolist()],
        }
        yield pa.RecordBatch.from_pydict(row, schema=PIECE)
        seq += 1


_BLOBS = ("vocabulary", "word_n", "context", "word", "pair_n", "tokens", "lengths")
PIECE = pa.schema([("piece", pa.int64()), ("n_words", pa.int64()), ("n_pairs", pa.int64()), *((b, pa.binary()) for b in _BLOBS), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_()))])
PIECE_DDL = "piece long, n_words long, n_pairs long, " + ", ".join(f"{b} binary" for b in _BLOBS) + ", doc_ids array<long>, train array<boolean>"


class Pairs:
    """The pairs of a piece: places of both words in its vocabulary, and their keys in ascending order."""

    def __init__(self, row: dict):
        self.vocabulary = unpack_sorted(row["vocabulary"])
        self.context = np.cumsum(unpack(row["context"]), dtype=np.int64)
        self.word = unpack(row["word"]).astype(np.int64)
        self.keys = pair_keys(self.vocabulary[self.context], self.vocabulary[self.word])


def _ask_pairs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for row in row_dicts(batches):
        keys = Pairs(row).keys
        order = np.argsort(keys)
        yield from messages(row["piece"], keys[order], parts, unpack(row["pair_n"])[order])


PAIR_REPLY = "piece long, part long, total binary, owner binary, ones long, twos long"


def _answer_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    frame, where, keys, first, ends = gather(frame)
    total = added(frame, "a", where, len(keys))
    owner = np.zeros(ends[-1], bool)
    owner[first] = True
    out = pd.DataFrame({"piece": frame["piece"].to_numpy(), "part": frame["part"].to_numpy()})
    out["total"] = [pack(small(total[at])) for at in where]
    out["owner"] = [pack(np.packbits(o)) for o in np.split(owner, ends[:-1])]
    out["ones"], out["twos"] = 0, 0
    out.loc[0, ["ones", "twos"]] = [int((total == 1).sum()), int((total == 2).sum())]
    return out


class Restaurants:
    """What a sweep needs besides the answers: sizes, discounts and sums over the corpus."""

    def __init__(self, words: int, tokens: int, discount: float, root_discount: float, strength: float, sums_of: list[tuple[int, int]]):
        self.words, self.tokens, self.discount, self.root_discount, self.strength, self.sums_of = words, tokens, discount, root_discount, strength, sums_of

    def root(self, sweep: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Chance of each word in the parent after a sweep."""
        all_customers, all_tables = self.sums_of[sweep]
        base = (self.strength + self.root_discount * all_tables) / (self.words + 1)
        return (customers - self.root_discount * tables + base) / (self.strength + all_customers)


def _answers(got: list[dict], names: tuple[str, ...]) -> list[np.ndarray]:
    """The answers to a piece from all ranges, in the order of its sorted keys."""
    got = sorted(got, key=lambda r: r["part"])
    return [np.concatenate([unpack(r[n]).astype(np.int64) for r in got]) for n in names]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers for pairs in the piece's own order: customers in the whole corpus, and whether the piece reports them."""
    for row in row_dicts(batches):
        order = np.argsort(Pairs(row).keys)
        got = sorted(row["got"], key=lambda r: r["part"])
        totals = [unpack(r["total"]) for r in got]
        customers, owner = np.zeros(len(order), np.int64), np.zeros(len(order), np.uint8)
        customers[order] = np.concatenate(totals)
        owner[order] = np.concatenate([np.unpackbits(unpack(r["owner"]), count=len(t)) for r, t in zip(got, totals, strict=True)])
        yield pa.RecordBatch.from_pydict({"piece": [row["piece"]], "customers": [pack(small(customers))], "owner": [pack(owner)]}, schema=SETTLED)


SETTLED = pa.schema([("piece", pa.int64()), ("customers", pa.binary()), ("owner", pa.binary())])


def _reseat(pairs: Pairs, customers: np.ndarray, last: list[dict], world: Restaurants, sweep: int) -> np.ndarray:
    """Tables of each pair after ``sweep``, from what the sweep before left in ``last``."""
    below, root_customers, root_tables = _answers(last, ANSWER)
    chance = world.root(sweep - 1, root_customers, root_tables)
    weight = (world.strength + world.discount * below)[pairs.context]
    weight *= chance[pairs.word]
    return seats(pairs.keys, customers, weight, world.discount, sweep)


def _report(batches: Iterator[pa.RecordBatch], parts: int, sweep: int, world: Restaurants | None) -> Iterator[pa.RecordBatch]:
    """Tables by word and by context of the pairs each piece owns; the first time every pair has one table."""
    for row in row_dicts(batches):
        pairs, customers = Pairs(row), unpack(row["customers"]).astype(np.int64)
        tables = _reseat(pairs, customers, row["last"], world, sweep) if sweep else np.minimum(customers, 1)
        tables = tables * unpack(row["owner"])
        n = len(pairs.vocabulary)
        sent = np.bincount(pairs.word, tables, n).astype(np.int64)
        below = np.bincount(pairs.context, tables, n).astype(np.int64)
        first = [unpack(row["word_n"])] if not sweep else []
        yield from messages(row["piece"], pairs.vocabulary, parts, sent, below, *first)


ANSWER = ("below", "customers", "tables")
WORD_REPLY = "piece long, part long, below binary, customers binary, tables binary, n binary, all_customers long, all_tables long, words long, tokens long, ones long, twos long"


def _answer_words(frame: pd.DataFrame, sweep: int, world: Restaurants | None) -> pd.DataFrame:
    frame, where, keys, _, _ = gather(frame)
    customers, below = (added(frame, c, where, len(keys)) for c in "ab")
    n = added(frame, "c", where, len(keys)) if not sweep else np.zeros(0, np.int64)
    tables = np.minimum(customers, 1)
    if sweep:
        weight = np.full(len(keys), (world.strength + world.root_discount * world.sums_of[sweep - 1][1]) / (world.words + 1))
        tables = seats(mix(keys), customers, weight, world.root_discount, sweep)
    out = pd.DataFrame({"piece": frame["piece"].to_numpy(), "part": frame["part"].to_numpy()})
    for name, values in (("below", below), ("customers", customers), ("tables", tables), ("n", n)):
        out[name] = [pack(small(values[at])) if len(values) else None for at in where]
    totals = {"all_customers": customers.sum(), "all_tables": tables.sum(), "words": (n > 0).sum(), "tokens": n.sum(), "ones": (customers == 1).sum(), "twos": (customers == 2).sum()}
    for name, value in totals.items():
        out[name] = 0
        out.loc[0, name] = int(value)
    return out


def _word_answers(sweep: int, world: Restaurants | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        return _answer_words(frame, sweep, world)

    return answer


def _score(batches: Iterator[pa.RecordBatch], world: Restaurants, sweeps: int, burn_in: int) -> Iterator[pa.RecordBatch]:
    for row in row_dicts(batches):
        pairs, customers = Pairs(row), unpack(row["customers"]).astype(np.int64)
        got = {s: [r for r in row["got"] if r["sweep"] == s] for s in {0, *range(burn_in, sweeps + 1)}}
        (n,) = _answers(got[0], ("n",))
        base = np.log10((n + 0.5) / (world.tokens + 0.5 * (world.words + 1)))
        mean = np.zeros(len(customers))
        seated = (world.strength + n)[pairs.context]  # a word is followed by something each time it occurs
        for sweep in range(burn_in + 1, sweeps + 1):
            tables = _reseat(pairs, customers, got[sweep - 1], world, sweep)
            below, root_customers, root_tables = _answers(got[sweep], ANSWER)
            chance = (world.strength + world.discount * below)[pairs.context]
            chance *= world.root(sweep, root_customers, root_tables)[pairs.word]
            chance += customers - world.discount * tables
            chance /= seated
            mean += chance
            del tables, chance
        word = pairs.word
        del pairs, customers, seated  # the arrays of tokens come now
        mean /= sweeps - burn_in
        pair_score = np.log10(mean, out=mean)
        tokens, lengths = unpack(row["tokens"]), unpack(row["lengths"]).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        add = [sums(x[tokens], starts) for x in ((n > 0)[word], base[word], pair_score)]
        columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["train"], pa.bool_()), pa.array(lengths), pa.array(add[0]), pa.array(add[1]), pa.array(add[2])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])


def _last(pieces: DataFrame, settled: DataFrame, replies: list[DataFrame], burn_in: int) -> DataFrame:
    """Pieces with all that scoring needs. The answers of all sweeps meet in one exchange, and they and the counts join before the
    texts do: each join holds a page of memory per side and copies its rows, which are megabytes."""
    kept = [
        reply.select("piece", F.lit(sweep).alias("sweep"), "part", *(c if sweep >= burn_in else F.lit(None).cast("binary").alias(c) for c in ANSWER), "n")
        for sweep, reply in enumerate(replies)
        if sweep >= burn_in or not sweep
    ]
    got = reduce(DataFrame.unionByName, kept).groupBy("piece").agg(F.collect_list(F.struct("sweep", "part", *ANSWER, "n")).alias("got"))
    texts = pieces.select("piece", "vocabulary", "context", "word", "tokens", "lengths", "doc_ids", "train")
    return texts.join(settled.select("piece", "customers").join(got, "piece"), "piece")


def _discount(ones: int, twos: int) -> float:
    """From how many are seen once and twice."""
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def score_texts(docs: DataFrame, train: Column, sweeps: int = SWEEPS, burn_in: int = BURN_IN, strength: float = STRENGTH, piece_bytes: int = PIECE_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row per row of ``docs``.

    The model learns from the rows for which ``train`` (a condition on columns of ``docs``) holds; null counts as false. Tokens
    are the words (separated by ASCII white space, A-Z as a-z) and one end. ``base_score`` adds log10 of each token's smoothed share
    of the training tokens, ``score`` log10 of its averaged predictive probability behind the token before it; ``n_known`` counts
    tokens seen in training. Words are told apart by 64-bit hashes. Results do not depend on how rows are dealt.

    Null or empty text: just the end. Null and repeated ids: a row each, and each trains if ``train`` says so. Without training
    rows all tokens are unknown. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    table = f"shelfpace_pieces_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.mapInArrow(partial(_pieces, limit=piece_bytes), PIECE_DDL)
    with small_batches(spark, 10_000, piece_bytes * 7 // 8):  # a batch ends behind the row that fills it: mostly one piece
        # Bucketed by piece, so that only the answers move when they meet their piece.
        pieces.write.bucketBy(buckets, "piece").option("compression", "none").saveAsTable(table)
    pieces = spark.table(table)
    n_words, n_pairs = pieces.agg(F.sum("n_words"), F.sum("n_pairs")).first()
    if not n_words:
        spark.sql(f"DROP TABLE {table}")
        return rows.select("doc_id", "train", *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")), *(F.lit(0.0).alias(c) for c in ("base_score", "score", "perplexity"))).limit(0)
    word_parts, pair_parts = (max(1, -(-n // range_keys)) for n in (n_words, n_pairs))
    with small_batches(spark, 1):
        asked = pieces.select("piece", "vocabulary", "context", "word", "pair_n").mapInArrow(partial(_ask_pairs, parts=pair_parts), MESSAGE)
        totals = stage(asked.groupBy("part").applyInPandas(_answer_pairs, PAIR_REPLY), "pair-totals")
        ones, twos = totals.agg(F.sum("ones"), F.sum("twos")).first()
        told = totals.groupBy("piece").agg(F.collect_list(F.struct("part", "total", "owner")).alias("got"))
        settled = pieces.select("piece", "vocabulary", "context", "word").join(told, "piece").mapInArrow(_settle, "piece long, customers binary, owner binary")
        settled.write.bucketBy(buckets, "piece").option("compression", "none").saveAsTable(f"{table}_pairs")
        counted = pieces.select("piece", "vocabulary", "context", "word", "word_n").join(spark.table(f"{table}_pairs"), "piece")
        replies: list[DataFrame] = []
        world = None
        for sweep in range(sweeps + 1):
            now = counted.join(replies[-1].groupBy("piece").agg(F.collect_list(F.struct("part", *ANSWER)).alias("last")), "piece") if sweep else counted
            reported = now.mapInArrow(partial(_report, parts=word_parts, sweep=sweep, world=world), MESSAGE)
            replied = stage(reported.groupBy("part").applyInPandas(_word_answers(sweep, world), WORD_REPLY), f"sweep-{sweep}")
            t = replied.agg(*(F.sum(c).alias(c) for c in ("all_customers", "all_tables", "words", "tokens", "ones", "twos"))).first()
            if world is None:
                world = Restaurants(t["words"], t["tokens"], _discount(ones, twos), _discount(t["ones"], t["twos"]), strength, [])
            world.sums_of.append((t["all_customers"], t["all_tables"]))
            replies.append(replied)
        scored = _last(pieces, spark.table(f"{table}_pairs"), replies, burn_in).mapInArrow(partial(_score, world=world, sweeps=sweeps, burn_in=burn_in), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
        scored = stage(scored, "scores")
    for name in (table, f"{table}_pairs"):
        spark.sql(f"DROP TABLE {name}")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(world.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
