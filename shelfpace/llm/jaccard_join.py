"""Near-duplicate documents: Jaccard similarity of word shingles through a token-group matrix.

Texts with equal shingle sets are one node. Candidates come from the tokens (shingle hashes) in the nodes' prefixes: two
sets as similar as asked share a token among the rarest (1 - t) n + 1 of either, whatever fixed order of rarity is used. How many
sets hold a token is counted exactly for hashes cut to a length that follows the input: pieces of the input send their
sorted tokens to ranges of values and get classes of frequency back in the order of their request. Tokens of one set only
make no candidates and go no further.

Copies with many links are joined first: in each round every component sends one member as query to the one with which it
shares most prefix tokens; if the two members are linked, the components merge. The rest is settled exactly by the matrix:
nodes that share their most frequent open token form groups of bounded size, and the matrix holds the tokens of each
group. Every node queries the groups that hold one of its prefix tokens and a node of an earlier component; its overlap
with the stored token union of the group bounds that with each member; only groups that reach the bound are opened. Queries
meet a group many at a time. So no link between different components is missed, and no pairs are made: a token of k nodes
leads k queries to about k / MEMBERS groups.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpace.llm.arrowtext import slices, word_codes
from shelfpace.llm.components import contract
from shelfpace.llm.packing import MESSAGE, added, gather, messages, mix, pack, pack_sorted, row_dicts, small, unpack, unpack_sorted
from shelfpace.llm.staging import small_batches, stage

SHINGLE = 5  # words
PERCENT = 80  # similarity
PIECE_BYTES = 6 << 20  # text of a piece
RANGE_KEYS = 1 << 21  # tokens whose sets are counted in one range, on average
ROUNDS = 5
MEMBERS = 64  # about so many nodes in a group of the matrix, and queries that meet it at once
MEMBER_TOKENS = 1 << 16  # about so many tokens of their sets


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; of its whole word sequence, if it is shorter."""
    import pyarrow.compute as pc

    starts, codes, words = word_codes(pc.ascii_lower(texts))
    h = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)[codes]
    times = np.uint64(0x9E3779B97F4A7C15)
    whole = max(0, len(h) - size + 1)
    rolled = np.zeros(whole, np.uint64)
    for k in range(size):
        rolled = rolled * times + h[k : k + whole]
    rolled = mix(rolled)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        else:
            one = np.full(min(1, b - a), b - a, np.uint64)
            for x in h[a:b]:
                one = one * times + x
            yield mix(one)


def _pieces(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Texts in pieces: identity of each text's set, its tokens as places in the piece's sorted tokens, and how many sets hold each.

    Tokens are the first ``bits`` bits of the shingle hashes here.
    """
    part, seq = TaskContext.get().partitionId(), 0
    for batch in slices(batches, limit=PIECE_BYTES):
        n, low, high, sets, fresh, seen = [], [], [], [], [], set()
        for s in shingle_sets(batch.column("text"), size):
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            n.append(len(s))
            low.append(int.from_bytes(digest[:8], "little", signed=True) if len(s) else None)
            high.append(int.from_bytes(digest[8:], "little", signed=True) if len(s) else None)
            sets.append(np.unique(s >> np.uint64(64 - bits)))
            fresh.append(digest not in seen)
            seen.add(digest)
        held = [len(x) for x in sets]
        tokens, which = np.unique(np.concatenate(sets), return_inverse=True)
        counts = np.bincount(which[np.repeat(fresh, held)], minlength=len(tokens))
        steps = np.diff(which, prepend=0)
        starts = (np.cumsum(held) - held)[np.array(held) > 0]
        steps[starts] = which[starts]
        row = {"piece": [part << 24 | seq], "doc_ids": [batch.column("doc_id").to_pylist()], "n": [n], "low": [low], "high": [high], "held": [held],
               "n_tokens": [len(tokens)], "tokens": [pack_sorted(tokens)], "counts": [pack(small(counts))], "places": [pack(small(steps))]}
        yield pa.RecordBatch.from_pydict(row, schema=PIECE)
        seq += 1


_LISTS = ("doc_ids", "n", "low", "high", "held")
PIECE = pa.schema([("piece", pa.int64()), *((c, pa.list_(pa.int64())) for c in _LISTS), ("n_tokens", pa.int64()), *((c, pa.binary()) for c in ("tokens", "counts", "places"))])
PIECE_DDL = "piece long, " + ", ".join(f"{c} array<long>" for c in _LISTS) + ", n_tokens long, tokens binary, counts binary, places binary"


def _ask(batches: Iterator[pa.RecordBatch], parts: int, bits: int) -> Iterator[pa.RecordBatch]:
    for row in row_dicts(batches):
        yield from messages(row["piece"], unpack_sorted(row["tokens"]), parts, unpack(row["counts"]), shift=64 - bits)


def _classes(frame: pd.DataFrame) -> pd.DataFrame:
    """Class of frequency (eighths of the bits of the number of sets) of the tokens of each piece; 0 for those in one set."""
    frame, where, keys, _, _ = gather(frame)
    rank = np.ceil(8 * np.log2(np.maximum(added(frame, "a", where, len(keys)), 1))).astype(np.uint16)
    return pd.DataFrame({"piece": frame["piece"].to_numpy(), "part": frame["part"].to_numpy(), "rank": [pack(rank[at]) for at in where]})


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """token, n, low, high, at: the tokens in the prefix of each set that other sets may hold too."""
    for row in row_dicts(batches):
        rank = np.concatenate([unpack(r["rank"]) for r in sorted(row["got"], key=lambda r: r["part"])]) if row["got"] else np.zeros(0, np.uint16)
        tokens, steps = unpack_sorted(row["tokens"]), unpack(row["places"]).astype(np.int64)
        stop = np.cumsum(row["held"])
        parts: list[tuple] = []
        for i, (a, b) in enumerate(zip((stop - row["held"]).tolist(), stop.tolist(), strict=True)):
            places = np.cumsum(steps[a:b])
            ranks, n = rank[places], row["n"][i]
            if b == a or not ranks.any():
                continue
            order = np.argsort(ranks, kind="stable")[: n - -(-percent * n // 100) + 1]  # places are in the order of the tokens
            at = np.flatnonzero(ranks[order])
            parts.append((tokens[places[order[at]]], at, np.full(len(at), i)))
        if parts:
            token, at, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            columns = [token.view(np.int64), *(np.array([x or 0 for x in row[c]], np.int64)[doc] for c in ("n", "low", "high")), at]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "n", "low", "high", "at"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        tokens = pa.array([s.view(np.int64) for s in shingle_sets(batch.column("text"), size)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), tokens], ["node", "tokens"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct values reach the similarity, in whole numbers."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _check_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("left_tokens"), batch.column("right_tokens")
        ok = [similar(a[i].values.to_numpy(), b[i].values.to_numpy(), percent) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _open_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the components of queries and of earlier members of the group they meet."""
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for i in range(batch.num_rows):
            union = batch.column("all_tokens")[i].values.to_numpy()
            members, queries = batch.column("members")[i].values, batch.column("queries")[i].values
            sets = members.field("tokens")
            size, comp = np.diff(sets.offsets.to_numpy()), members.field("comp").to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            place = np.searchsorted(union, sets.flatten().to_numpy())
            comps, asked = queries.field("comp").to_pylist(), queries.field("tokens")
            for c, q in zip(comps, asked, strict=True):
                query = q.values.to_numpy()
                at = np.minimum(np.searchsorted(union, query), len(union) - 1)
                held = at[union[at] == query]
                if 100 * len(held) < percent * len(query):
                    continue  # no member can reach the similarity
                marked = np.zeros(len(union), bool)
                marked[held] = True
                shared = np.bincount(owner, marked[place], len(size))
                linked = (100 * shared >= percent * (size + len(query) - shared)) & (comp < c)
                found.update((c, int(o)) for o in np.unique(comp[linked]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _size_class(n: Column, percent: int) -> Column:
    """Linked sets lie in the same or in neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent)) + 1e-9)


def _can_reach(percent: int) -> Column:
    """Whether two sets of n and n2 tokens can reach the similarity.

    ``shared`` of their prefix tokens are equal, the last at places i and j. All prefix tokens before these places that are
    not shared are in one set only, because both prefixes follow one order.
    """
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / F.lit(100 + percent) - 1e-9)
    most = F.least(F.col("n") - (F.col("i") + 1 - F.col("shared")), F.col("n2") - (F.col("j") + 1 - F.col("shared")))
    return (most >= need) & (F.least("n", "n2") >= need)


def _merge_rounds(postings: DataFrame, sets: DataFrame, percent: int, rounds: int) -> DataFrame:
    """(node, comp) after the rounds in which each component sends one member to the one it shares most with."""
    labels = stage(postings.select("node").distinct().withColumn("comp", F.col("node")), "labels")
    for r in range(rounds):
        seen = postings.join(labels, "node").groupBy("token", "comp").agg(F.min_by(F.struct("node", "n", "at"), F.xxhash64("node", F.lit(r))).alias("m"))
        first = seen.groupBy("token").agg(F.min(F.struct("comp", "m")).alias("p"))
        pairs = seen.join(first, "token").filter("comp <> p.comp").select(
            "comp", F.col("p.comp").alias("other"), F.col("m.node").alias("l"), F.col("p.m.node").alias("r"), F.col("m.n").alias("n"), F.col("p.m.n").alias("n2"), F.col("m.at").alias("i"), F.col("p.m.at").alias("j")
        )
        counted = pairs.groupBy("comp", "other", "l", "r").agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("n").alias("n"), F.first("n2").alias("n2"))
        counted = counted.filter(_can_reach(percent))
        chosen = counted.groupBy("comp").agg(F.max(F.struct("shared", -F.col("other"), "other", "l", "r")).alias("best")).select(F.col("comp").alias("a"), F.col("best.other").alias("b"), "best.l", "best.r")
        # Two components may choose each other; a pair of members is compared once.
        chosen = chosen.select("a", "b", F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).dropDuplicates(["l", "r"])
        left = sets.select(F.col("node").alias("l"), F.col("tokens").alias("left_tokens"))
        right = sets.select(F.col("node").alias("r"), F.col("tokens").alias("right_tokens"))
        linked = chosen.join(left, "l").join(right, "r").select("a", "b", "left_tokens", "right_tokens").mapInArrow(partial(_check_pairs, percent=percent), "a long, b long")
        linked = stage(linked, "round-links")
        if linked.isEmpty():
            break
        roots = contract(linked).select(F.col("label").alias("comp"), "root")
        labels = stage(labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
    return labels


def _chunks(rows: DataFrame, key: list[str], members: int) -> DataFrame:
    """``rows`` (with node and n) of each key dealt into chunks of about ``members`` rows and ``MEMBER_TOKENS`` tokens."""
    parts = rows.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / MEMBER_TOKENS)).alias("chunks"))
    return rows.join(parts, key).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).drop("chunks")


def _group_links(postings: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, members: int) -> DataFrame:
    """Links (a, b) of components through the token-group matrix: all that the rounds left."""
    seen = postings.join(labels, "node").withColumn("size", _size_class(F.col("n"), percent))
    spread = seen.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("times")).filter("lo < hi")
    seen = stage(seen.join(spread.select("token", "times"), "token"), "open-postings")
    nodes = seen.groupBy("node", "comp", "size", "n").agg(F.max(F.struct("times", "token")).alias("leader"))
    nodes = nodes.select("node", "comp", "size", "n", F.col("leader.token").alias("leader"))
    dealt = _chunks(nodes, ["leader", "size"], members).withColumn("gid", F.xxhash64("leader", "size", "chunk")).select("node", "comp", "gid")
    dealt = stage(dealt, "groups")
    stored = dealt.join(sets, "node").groupBy("gid").agg(F.collect_list(F.struct("comp", "tokens")).alias("members"))
    stored = stored.withColumn("all_tokens", F.array_sort(F.array_distinct(F.flatten(F.col("members.tokens")))))
    matrix = seen.select("token", "node", "size").join(dealt, "node").groupBy("token", "size", "gid").agg(F.min("comp").alias("earliest"))
    asked = seen.select("token", "node", "n", "comp", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"))
    opened = asked.join(matrix, ["token", "size"]).filter("comp > earliest").select("gid", "node", "comp", "n").distinct()
    opened = _chunks(stage(opened, "opened"), ["gid"], members)
    queries = opened.join(sets, "node").groupBy("gid", "chunk").agg(F.collect_list(F.struct("comp", "tokens")).alias("queries"))
    full = queries.join(stored, "gid").select("queries", "members", "all_tokens")
    return full.mapInArrow(partial(_open_groups, percent=percent), "a long, b long").distinct()


def _bucketed(rows: DataFrame, name: str, key: str) -> DataFrame:
    """The rows as a table bucketed by their key, so that no join moves them again."""
    spark = rows.sparkSession
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS, members: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id per document; a component is what links of the similarity or more reach.

    Words are separated by ASCII white space, A-Z count as a-z. A text of fewer than ``size`` words has one shingle, its
    whole sequence; null texts and those without words have none and are linked with nothing. Rows with a null doc_id are
    linked with nothing and have no component. Rows that repeat a doc_id share a component if they have shingles. Other columns are
    not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(56, max(20, (8 * n_bytes).bit_length()))  # some fifty values for each shingle
    name = f"shelfpace_near_{uuid.uuid4().hex}"
    pieces = _bucketed(rows.mapInArrow(partial(_pieces, size=size, bits=bits), PIECE_DDL), f"{name}_pieces", "piece")
    with small_batches(spark, 1):
        parts = max(1, -(-(pieces.agg(F.sum("n_tokens")).first()[0] or 0) // RANGE_KEYS))
        asked = pieces.select("piece", "tokens", "counts").mapInArrow(partial(_ask, parts=parts, bits=bits), MESSAGE)
        ranks = stage(asked.groupBy("part").applyInPandas(_classes, "piece long, part long, rank binary"), "ranks")
        told = ranks.groupBy("piece").agg(F.collect_list(F.struct("part", "rank")).alias("got"))
        prefixes = pieces.join(told, "piece", "left").mapInArrow(partial(_prefixes, percent=percent), "token long, n long, low long, high long, at long")
        postings = prefixes.groupBy("token", "low", "high").agg(F.first("n").alias("n"), F.first("at").alias("at"))
        postings = stage(postings, "all-postings")
    known = stage(pieces.select(F.explode(F.arrays_zip("doc_ids", "n", "low", "high")).alias("d")).select(F.col("d.doc_ids").alias("doc_id"), "d.n", "d.low", "d.high"), "identities")
    spark.sql(f"DROP TABLE {name}_pieces")
    nodes = stage(known.filter("n > 0").groupBy("low", "high").agg(F.min("doc_id").alias("node")).filter("node is not null"), "nodes")
    several = postings.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    postings = stage(postings.join(several, "token").join(nodes, ["low", "high"]).select("token", "node", "n", "at"), "postings")
    wanted = stage(postings.select("node").distinct(), "wanted")
    texts = rows.join(wanted, rows["doc_id"] == wanted["node"]).select("node", "text")
    sets = texts.mapInArrow(partial(_sets, size=size), "node long, tokens array<long>")
    sets = _bucketed(sets, f"{name}_sets", "node")
    with small_batches(spark, 16):
        labels = _merge_rounds(postings, sets, percent, rounds)
        roots = contract(_group_links(postings, labels, sets, percent, members)).select(F.col("label").alias("comp"), "root")
    spark.sql(f"DROP TABLE {name}_sets")
    labels = labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    found = stage(nodes.join(labels, "node", "left").select("low", "high", F.coalesce("comp", "node").alias("component_id")), "node-components")
    whole = known.join(found, ["low", "high"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the document whose id names it.

    Of rows that repeat that id, the one with the smallest text stays. Rows with a null doc_id stay all. An empty table gives an
    empty result.
    """
    kept = near_duplicates(docs, size, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = stage(kept, "kept")
    ids = docs["doc_id"].cast("long")
    place = "k_of_id"
    while place in (c.lower() for c in docs.columns):
        place += "_"
    chosen = docs.join(kept, ids == kept["kept_id"], "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())))
    return chosen.filter(F.col(place) == 1).select(*docs.columns).unionByName(docs.filter(ids.isNull()))
