"""Fill-in-the-middle, periodic runs and the Pitman-Yor model against plain versions, and their edge cases."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfpace.llm import fill_middle, periodic_runs, pitman_yor, queries
from tests.llm.brute import WORD

FOLDER = "/root/testdata/sf0.001"
LONG = ("né " * 70 + "word " * 30 + "\n") * 4000  # above 1 MB
EDGE = [None, "", " \n\t ", "one", "ab<P>cd", "<", "<<S", "é", "日本 語" * 200, "x" * 200_000, "a b c d " * 40, LONG, LONG, "q " * 63 + "<M> " + "z" * 3000]
SCHEMA = "doc_id long, text string, n long, piece long, runs string, train string, h1 string"


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found += [(10_000 + k, t) for k, t in enumerate(EDGE)]
    rnd = random.Random(5)
    found += [(20_000 + k, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(90)))) for k in range(60)]
    return found + [(None, "no id here"), (None, None), (3, "an id that repeats"), (3, "an id that repeats")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z") for i, t in rows], SCHEMA).repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def middle(i, text):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", a, b - a, sha(out), sha(text)


def test_fill_in_middle(docs, rows):
    got = [tuple(r) for r in fill_middle.digest(fill_middle.fill_in_middle(docs)).collect()]
    want = [(i, *middle(i, t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_chunks_follow_content():
    rnd = np.random.default_rng(1)
    shared = rnd.integers(97, 123, 60_000).astype(np.uint8)
    cut = []
    for before in (b"", b"some other words in front. ", b"y" * 333):
        data = np.concatenate([np.frombuffer(before, np.uint8), shared])
        ends = fill_middle.chunk_ends(fill_middle.boundaries(data), 0, len(data))
        raw, edges = data.tobytes(), [0, *ends.tolist()]
        cut.append({raw[a:b] for a, b in zip(edges, edges[1:], strict=False)})
    assert len(set.intersection(*cut)) > 0.9 * len(cut[0]) > 30


def test_memory_is_bounded_and_right():
    memory = fill_middle.Summaries(kept=1000)
    for k in list(range(50)) * 3:
        chunk = f"{k}é<P" .encode() * (k + 1)
        assert memory.of(chunk) == (len(chunk.decode()), False, chunk[:2], chunk[-2:])
        assert sum(map(len, memory.young)) <= 1000
    total, marked = fill_middle.combined([memory.of(b"ab<"), memory.of(b"S>")])
    assert marked and total.tolist() == [3, 5]


def runs(w, shortest=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        k = 0
        while k + q < len(w):
            e = k
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e - k + q >= max(shortest, 2 * q) and e > k and not any((k, e - k + q) == (a, n) for a, n in found):
                found[k, e - k + q] = q
            k = e + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(i, text):
    w = WORD.findall(text or "")
    h = 1 if i is None else zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    found = runs(w)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    best = min(((-n, a, q) for a, n, q in found), default=None)
    one = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return len(found), *one, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_periodic_runs(docs, rows):
    got = [tuple(r) for r in periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 20_000)))).collect()]
    want = [(i, *collapsed(i, t)) for i, t in rows if len(t or "") < 20_000]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 30
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_runs_of_long_texts(docs):
    found = [r for r in periodic_runs.periodic_runs(docs).collect() if r.doc_id is not None and r.doc_id in (10_011, 10_012)]
    assert len(found) == 2
    for r in found:
        assert any((x.start, x.length, x.period) == (0, 400_000, 100) for x in r.runs)
        assert (0, 70, 1) in {(x.start, x.length, x.period) for x in r.runs} and r.collapsed == "né word"


def test_lyndon_words_and_runs():
    rnd = random.Random(2)
    for _ in range(300):
        w = [rnd.randint(1, rnd.choice([1, 2, 3])) for _ in range(rnd.randint(1, 40))]
        symbols = np.array([0, *w, 0, *w])
        lengths = periodic_runs.lyndon_lengths(symbols)
        want = [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]
        assert lengths[1 : len(w) + 1].tolist() == lengths[len(w) + 2 :].tolist() == want
        assert [(a - 1, n, q) for a, n, q in periodic_runs.runs_of(symbols, 4).tolist() if a <= len(w)] == runs(w, 4)


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def plain_scores(rows, train, sweeps=3, burn_in=1):
    """The model with plain dictionaries: one restaurant after the other, no pieces and no ranges."""
    ids = {w: pitman_yor.END if w is None else pd.util.hash_array(np.array([w], object), categorize=False)[0] for _, t in rows for w in tokens(t)}
    n, pairs = collections.Counter(), collections.Counter()
    for (_, text), learn in zip(rows, train, strict=True):
        if learn:
            w = tokens(text)
            n.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    every = sorted(pairs, key=str)
    keys = pitman_yor.pair_keys(np.array([ids[u] for u, _ in every], np.uint64), np.array([ids[w] for _, w in every], np.uint64))
    words = sorted(n, key=str)
    word_keys = pitman_yor.mix(np.array([ids[w] for w in words], np.uint64))
    counts = collections.Counter(pairs.values())
    d = pitman_yor._discount(counts[1], counts[2])
    tables = dict.fromkeys(every, 1)
    chances, below, root_d = [], [], None
    for sweep in range(sweeps + 1):
        if sweep:
            weight = np.array([(1 + d * below[-1][u]) * chances[-1](w) for u, w in every])
            tables = dict(zip(every, pitman_yor.seats(keys, np.array([pairs[p] for p in every]), weight, d, sweep).tolist(), strict=True))
        sent, here = collections.Counter(), collections.Counter()
        for (u, w), t in tables.items():
            sent[w] += t
            here[u] += t
        if root_d is None:
            counts = collections.Counter(sent.values())
            root_d = pitman_yor._discount(counts[1], counts[2])
            root = {w: 1 for w in words}
        else:
            weight = np.full(len(words), (1 + root_d * sum(root.values())) / (len(words) + 1))
            root = dict(zip(words, pitman_yor.seats(word_keys, np.array([sent[w] for w in words]), weight, root_d, sweep).tolist(), strict=True))
        below.append(here)

        def chance(w, sent=sent, root=root, at=sum(root.values())):
            return (sent[w] - root_d * root.get(w, 0) + (1 + root_d * at) / (len(words) + 1)) / (1 + sum(sent.values()))

        chances.append(chance)
        if sweep == burn_in + 1:
            mean = collections.defaultdict(float)
        if sweep > burn_in:
            kept = (tables, here, chance)
            mean[sweep] = kept

    def p(u, w):
        return sum((pairs[u, w] - d * t.get((u, w), 0) + (1 + d * h[u]) * c(w)) / (1 + n[u]) for t, h, c in mean.values()) / len(mean)

    total = sum(n.values())
    out = []
    for _, text in rows:
        w = tokens(text)
        base = sum(math.log10((n[x] + 0.5) / (total + 0.5 * (len(n) + 1))) for x in w)
        out.append((len(w), sum(n[x] > 0 for x in w), total, base, sum(math.log10(p(u, x)) for u, x in zip([None, *w], w, strict=False))))
    return out, p, words


@pytest.fixture(scope="module")
def small_rows(rows):
    return [r for r in rows if len(r[1] or "") < 3000]


def test_scores(spark, small_rows):
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(small_rows)], "doc_id long, text string, k long, piece string")
    train = [k % 4 != 1 for k in range(len(small_rows))]
    want, p, words = plain_scores(small_rows, train)
    for u in (words[0], "ab", "never seen", None):
        assert abs(sum(p(u, w) for w in words) + p(u, "another unknown") - 1) < 1e-9
    for parts, options in ((2, {}), (7, {"piece_bytes": 4000, "range_keys": 300})):
        got = pitman_yor.score_texts(df.repartition(parts), F.col("k") % 4 != 1, **options).collect()
        got = sorted(((r.doc_id is None, r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=str)
        expected = [(i is None, i, t, w[0], w[1], w[2], round(w[3], 6), round(w[4], 6)) for (i, _), t, w in zip(small_rows, train, want, strict=True)]
        assert [g[:6] for g in got] == [e[:6] for e in sorted(expected, key=str)]
        assert np.allclose([g[6:] for g in got], [e[6:] for e in sorted(expected, key=str)], atol=1e-5)


def test_scores_of_held_out_texts_beat_single_words(spark):
    got = queries.op13_pitman_yor(spark, "/root/testdata/sf0.01").filter("held_out")
    assert got.agg(F.sum("score") > F.sum("base_score")).first()[0]


def test_score_edges(spark, docs):
    nothing = pitman_yor.score_texts(docs.filter("doc_id < 5"), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)
    assert pitman_yor.score_texts(docs.limit(0), F.lit(True)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("shelfpace_pieces")]


def test_seats():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    customers = np.array([1, 2, 10, 500] * 1000)
    tables = pitman_yor.seats(keys, customers, np.full(4000, 3.0), 0.5, 1)
    assert (tables >= 1).all() and (tables <= customers).all() and (tables[customers == 1] == 1).all()
    for c in (2, 10, 500):  # expected tables by the recursion over their distribution
        chances = np.zeros(c + 2)
        chances[1] = 1
        t = np.arange(c + 2)
        for j in range(1, c):
            fresh = 3.0 / (3.0 + j - 0.5 * np.minimum(t, j))
            chances = chances * (1 - fresh) + np.concatenate(([0], (chances * fresh)[:-1]))
        assert abs(tables[customers == c].mean() / (chances * t).sum() - 1) < 0.03


def test_seats_one_word_at_a_time():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    customers, weights = np.minimum(rng.zipf(1.4, 300), 3000) - rng.integers(0, 2, 300), rng.random(300) * 4
    want = []
    for key, c, w in zip(keys, customers.tolist(), weights.tolist(), strict=True):
        tables, seated = min(1, c), 1
        while seated < c:
            block, chance = (1 if seated < 64 else seated // 16), float(pitman_yor._chance(np.array([key]), 2, seated)[0])
            fresh = w / (w + seated - 0.5 * tables)
            tables += int(chance < fresh) if seated < 64 else math.floor(min(block, c - seated) * fresh + chance)
            seated += block
        want.append(tables)
    assert pitman_yor.seats(keys, customers, weights, 0.5, 2).tolist() == want


def test_scoring_needs_two_joins(spark, small_rows, monkeypatch):
    plans, write = {}, pitman_yor.stage

    def noted(df, name, *apart):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, *apart)

    monkeypatch.setattr(pitman_yor, "stage", noted)
    df = spark.createDataFrame(small_rows[:40], "doc_id long, text string")
    assert pitman_yor.score_texts(df, F.lit(True)).count() == 40
    assert plans["scores"].count("Join Inner") == 2  # each held a page of memory per side, and a copy of its row


def test_pieces_come_in_batches_of_their_size(spark, monkeypatch, tmp_path):
    cut, folder = pitman_yor._pieces, str(tmp_path)

    def noted(batches, limit):
        def each():
            for k, batch in enumerate(batches):
                with open(f"{folder}/{batch.column('doc_id')[0]}-{k}", "w") as out:
                    out.write(str(batch.nbytes))
                yield batch

        yield from cut(each(), limit)

    monkeypatch.setattr(pitman_yor, "_pieces", noted)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 1000).alias("text"))
    assert pitman_yor.score_texts(df.coalesce(1), F.lit(True), piece_bytes=100_000).agg(F.sum("n_tokens")).first()[0] == 400 * 1001
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(sizes) > 1_500_000 and max(sizes) < 100_000


def test_memory_of_scoring_a_piece(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 1000) % 50_000) for _ in range(300)]
    monkeypatch.setattr(pitman_yor, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts, "train": [True] * 300})
    (piece,) = pitman_yor._pieces(iter([batch]), 1 << 30)
    row = piece.to_pylist()[0]
    pairs, customers = pitman_yor.Pairs(row), pitman_yor.unpack(row["pair_n"])
    words = len(pairs.vocabulary)
    sent, below = (np.bincount(x, minlength=words) for x in (pairs.word, pairs.context))
    answer = {"part": 0, "below": below, "customers": sent, "tables": np.minimum(sent, 1), "n": pitman_yor.unpack(row["word_n"])}
    answer = {k: v if k == "part" else pitman_yor.pack(pitman_yor.small(v)) for k, v in answer.items()}
    row |= {"customers": pitman_yor.pack(customers), "got": [answer | {"sweep": s} for s in range(4)]} | {f"answers_{s}": [answer] for s in range(4)}
    world = pitman_yor.Restaurants(words, 300_300, 0.7, 0.6, 1.0, [(int(sent.sum()), words)] * 4)
    monkeypatch.setattr(pitman_yor, "row_dicts", iter)
    tracemalloc.start()
    (scored,) = pitman_yor._score([row], world, 3, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored.num_rows == 300
    assert peak < 42 * (len(customers) + 300_300)  # 29 bytes a pair and token; it was 57
