"""The ten operators against plain versions, and their edge cases."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfpace.llm import chat_format, decontaminate, jaccard_join, mixing, pii, quality_rules, suffix_dedup, token_counts, token_files, toxicity, vocabulary
from shelfpace.llm.staging import new_folder
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
EDGE = [None, "", " \n\t ", "one", "Ab ab AB ab\x0bab ab ab ab", "wort " * 3000, "x" * 5000, "a b\nc\n\na b\nc  d\xa0e <|endoftext|> "]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, node string, h long"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table with edge cases, repeated rows and extra columns whose names the operators use inside."""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(10_000 + k, t, None if k % 2 else "en", None, 0) for k, t in enumerate(EDGE)]
    near = rows[1][1].split(" ")
    rows += [(20_000 + k, " ".join(near[: k + 1] + ["other"] + near[k + 2 :]), "en", "src0", 0) for k in range(30)]
    rows += [(30_000 + k, rows[3][1], "en", "src0", 0) for k in range(20)]
    return spark.createDataFrame([(*r, "t", "n", 1) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_quality(docs, texts, labels, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        n, *_, repeat = expected = brute.quality(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_decision_list_finds_a_planted_rule(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.random(), rnd.random(), 0.0, 0.0, float(rnd.randrange(100))) for i in range(3000)]
    df = spark.createDataFrame([(*r, int(r[1] > 0.7 and r[2] > 0.5)) for r in rows], ["doc_id", *quality_rules.FEATURES, "bad"])
    rules = quality_rules.learn_rules(df)
    wrong = df.filter(quality_rules.verdict(rules).isNotNull() != (df["bad"] == 1)).count()
    assert rules and wrong < 150
    assert quality_rules.learn_rules(df.filter("bad = 0")) == []


def test_near_duplicates(docs, texts, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute.components(texts)
    exact_only = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, rounds=0, members=2).collect()}
    assert exact_only == got
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_one_of_each(docs, texts):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute.components(texts).items() if i == c)


def test_chat_format(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("system", "be [INST] brief"), ("user", "a " * 300), ("assistant", "b " * 300), ("user", None), ("assistant", "<\\/s>")] * 3)]
    rows += [(2, 0, "system", "alone"), (3, None, None, "x"), (None, 1, "assistant", "</s>[INST] ok [/INST]"), (4, 0, "assistant", "big " * 2000), (4, 0, "assistant", "big " * 2000)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "conv_id long, turn long, role string, text string, window string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.chat_windows(df)).collect()}
    want = collections.defaultdict(list)
    for c, k, r, t in rows:
        want[c].append((-1 if k is None else k, r or "", t or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].n_windows > 1
    assert chat_format.chat_windows(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [5, 40])
def test_repeated_starts(length):
    rng = np.random.default_rng(length)
    s = np.concatenate([np.append(rng.integers(1, 4, 200), 0) for _ in range(6)]).astype(np.uint16)
    s[450:550] = s[50:150]
    seen = collections.Counter(tuple(s[i : i + length]) for i in range(len(s) - length + 1))
    flags = suffix_dedup.repeated_starts(s, length)
    assert all(flags[i] == (seen[tuple(s[i : i + length])] > 1) for i in range(len(s) - length + 1) if 0 not in s[i : i + length])


def test_the_order_leaves_out_suffixes_that_have_ended_or_stand_alone(monkeypatch):
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 200, 60), 0)
    s = np.concatenate([text] * 50 + [np.append(rng.integers(1, 200, 3000), 0)]).astype(np.uint16)
    upto = [tuple(s[i : i + 400][: np.argmax(np.append(s[i : i + 400], 0) == 0) + 1]) for i in range(len(s))]
    sizes = []
    for name in ("sort", "argsort"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda keys, *a, plain=plain, **b: sizes.append(len(keys)) or plain(keys, *a, **b))
    order = suffix_dedup.bounded_order(s, 400)
    monkeypatch.undo()
    assert [upto[i] for i in order] == sorted(upto)
    assert sum(sizes) < 3 * len(s)
    # Where places and ranks do not fit one number, the order is the same up to ties.
    monkeypatch.setattr(suffix_dedup, "KEY_BITS", 40)
    assert [upto[i] for i in suffix_dedup.bounded_order(s, 400)] == sorted(upto)


def test_remove_repeats(docs, texts, empty):
    want = brute.without_repeats(texts, 400)
    for largest in (suffix_dedup.LARGEST, 2000):
        left = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, block=1 << 16, largest=largest))
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in left.collect()} == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_mixing(docs, empty):
    rows = [r.asDict() for r in mixing.choose(docs, share=0.5).collect()]
    total = docs.select(mixing.n_tokens(docs["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    assert 0.3 * total < sum(r["n_tokens"] for r in rows) <= 0.5 * total
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert mixing.choose(empty).count() == 0
    assert mixing.mixed(docs, 0.5).columns == docs.columns


def test_shortages_go_to_siblings_first(spark):
    sizes = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s3", 1000)], "domain string, lang string, source string, supply long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(sizes, 0.4).collect()}
    assert got == {"s1": 10, "s2": 392, "s3": 402}


def test_decontamination(spark, empty):
    item = "In 2010 the company Orlando sold 45 kg of fresh apples to every market in town for 30 euros a day."
    other = item.replace("2010", "1999").replace("45", "77").replace("30", "12").replace("Orlando", "Miranda")
    unfit = "In 2010 the company Orlando sold 45 kg of fresh apples to every market near 45 towns, 45 villages and 45 farms"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "two words"), (4, unfit)], "item_id long, text string")
    rows = [(1, "Well. " + item), (2, "so " + other), (3, "nothing of the kind " * 20), (4, None), (None, item), (5, unfit.replace("45 towns", "46 towns")), (6, "word " * 300_000 + item)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item_id long, of long")
    got = {r.doc_id: r for r in decontaminate.decontaminate(df, bench).collect()}
    assert all(1 in got[i]["items"] for i in (1, 2, None, 6)) and got[3]["items"] == got[4]["items"] == []
    # Of the eleven windows only the four without the altered number fit.
    assert 4 in got[5]["items"]
    found = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.matches(df, bench).collect()}
    assert found[5, 4] == 4
    assert [r.doc_id for r in decontaminate.without_contaminated(df, bench).collect() if r.doc_id in (1, 3)] == [3]
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(df, bench.limit(0)).collect())


def test_decontamination_against_plain_windows(spark):
    """Whether each document holds the template windows of each item with fitting values, one by one."""
    rnd = random.Random(8)
    plain = "the market sold fresh apples and bread near town while people came by every day with more money".split()

    def text(n):
        return " ".join(rnd.choice(["12", "7", "Anna", "Bob", *plain, *plain]) for _ in range(n))

    items = [(k, text(rnd.choice([4, 7, 9, 14, 20]))) for k in range(12)]
    rows = []
    for k in range(60):
        words = items[k % 12][1].split()
        words = [{"12": "31", "Anna": "Cleo"}.get(w, w) if k % 3 == 0 else w for w in words]
        if k % 4 == 1:
            words[rnd.randrange(len(words))] = rnd.choice(["12", "99", "Bob", "apples"])
        rows.append((k, f"{text(6)} {' '.join(words)} {text(6)}"))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    t, v = decontaminate.template(F.col("text")).alias("t"), decontaminate.values(F.col("text")).alias("v")
    docs = {r.doc_id: (r.t, r.v) for r in df.select("doc_id", t, v).collect()}
    marks = (decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT)
    items = {r.item_id: (r.t, r.v) for r in bench.select("item_id", t, v).collect()}
    want = brute.template_hits(docs, items, marks, decontaminate.WINDOW, decontaminate.SHORTEST, decontaminate.LITERALS)
    assert {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.matches(df, bench).collect()} == want and len(want) > 30


def test_mixed_keeps_columns_with_its_own_names(spark):
    rows = [(k % 7 or None, "a b c" if k % 2 else None, "en", f"s{k % 3}", k, "x") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_id long, mix_k string")
    got = mixing.mixed(df, 1.0)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert mixing.mixed(df.limit(0)).count() == 0
    near = df.withColumnRenamed("mix_k", "k_of_id")
    assert {r.k_of_id for r in jaccard_join.one_of_each(near).collect()} == {"x"}


def test_personal_data(spark, docs, texts, empty):
    tricky = ["1.2.3.4.5 a@b.c.d_x@y.org +1 (555) 123-4567 4111 1111 1111 1111-2 300.1.1.1 0001.2.3.004", "4111-1111-1111-1111", "1 " * 9000, "7" * 9000]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50_000 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string"))
    want = dict(texts) | {50_000 + k: t for k, t in enumerate(tricky)}
    for r in pii.digest(pii.find_personal_data(df)).collect():
        spans = brute.personal(want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith(("term", "secret"))] == spans
        assert r.has_personal_data == bool(r.spans)
    assert pii.find_personal_data(empty).count() == 0


def test_terms_that_reveal_an_entity(spark):
    rows = [(k, f"{k} quiet harbour talk Zebulon writes as z{k}@mail.org today {k}") for k in range(6)]
    rows += [(50 + k, f"same words in copies Quillon sends y@copy.org {'and so on ' * 8}{'x' * k}") for k in range(6)]  # one surrounding only
    rows += [(100 + k, f"other talk about the quiet harbour {k} and today more writes as before, sends same words in copies") for k in range(400)]
    rows += [(600 + k, f"{'abcdefgh'[k]} passkey = 0123456789abcdef0123456789abcde{k} and {'hgfedcba'[k] * 9} follows") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.term: r for r in pii.disclosing_terms(df).collect()}
    assert set(found) == {"zebulon", "passkey", "follows"} and found["zebulon"].entity == "email in @mail.org" and found["passkey"].entity == "secret"
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.find_personal_data(df)).collect()}
    assert "talk [related term] writes as [email]" in clean[0] and clean[100] == rows[12][1]
    assert clean[600] == "a [related term] = [secret] and hhhhhhhhh [related term]"
    removed = {r.doc_id: r.text for r in pii.sanitise(pii.find_personal_data(df, removal=0.8)).collect()}
    assert removed[600] == "a  = [secret] and hhhhhhhhh "


def test_terms_of_the_small_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert "token" in [r.term for r in pii.disclosing_terms(docs).collect()]


@pytest.fixture(scope="module")
def held_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 4 <> 0"))
    assert (np.diff(model.cuts) > 0).all()
    return toxicity.toxicity(docs, model).join(labels.filter("doc_id % 4 = 0").withColumnRenamed("toxic", "truth"), "doc_id").collect()


def test_toxicity_leaves_clean_held_out_rows(held_out):
    assert sum(r.toxic and not r.truth for r in held_out) <= 0.01 * len(held_out)


@pytest.mark.xfail(reason="open: with some 3,100 labels it finds 97 of 119 held-out toxic rows, below this bar")
def test_toxicity_finds_held_out_rows(held_out):
    assert sum(r.toxic and r.truth for r in held_out) >= 0.85 * sum(r.truth for r in held_out)


def test_toxicity_edges(docs, labels, empty):
    model = toxicity.fit(docs, labels)
    assert toxicity.toxicity(docs, model).count() == docs.count()
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.fit(empty, labels).weights.any() == np.False_
    assert toxicity.toxicity(empty, model).count() == 0


def test_token_files(spark, docs, texts, empty):
    tok = path("word_bpe_49k.json")
    folder = new_folder(spark, "test")
    token_files.write_token_files(docs, folder, tok, shard_tokens=20_000)
    library, start, want = token_counts.tokenizer(tok), 0, []
    for i in sorted(texts):
        ids = np.array(library.encode(texts[i] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.read_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want
    flat = np.concatenate([library.encode(texts[i] or "", add_special_tokens=False).ids + [1] for i in sorted(texts)])
    asked = {int(flat[0]), int(flat[-2]), 1, 48_000, 60_000}
    assert {r.token: r.n for r in token_files.count_tokens(spark, folder, list(asked)).collect()} == {t: int((flat == t).sum()) for t in asked}
    token = int(flat[0])
    place = {i: start for i, start, *_ in want}
    got = [(r.place, r.doc_id, r.inside) for r in token_files.occurrences(spark, folder, token).collect()]
    assert sorted(p for p, _, _ in got) == np.flatnonzero(flat == token).tolist()
    assert all(place[i] + inside == p for p, i, inside in got)
    places = spark.range(-5, len(flat) + 5, 37).withColumnRenamed("id", "place")
    assert {r.place: r.token for r in token_files.tokens_at(spark, folder, places, width=7000).collect()} == {p: int(flat[p]) for p in range(-5, len(flat), 37) if p >= 0}
    token_files.write_token_files(empty, nothing := new_folder(spark, "test"), tok)
    assert token_files.read_documents(spark, nothing).count() == 0


def test_word_memory_forgets():
    ids = vocabulary.WordIds(path("word_bpe_49k.json"), ends="</w>", kept=50)
    rnd = random.Random(4)
    for _ in range(20):
        words = list({"".join(rnd.choice("abCé.1-") for _ in range(rnd.randint(1, 9))) for _ in range(30)})
        flat, n = ids.of(vocabulary.pa.array(words))
        assert [p.tolist() for p in np.split(flat, np.cumsum(n)[:-1])] == [ids.tok.encode(w, add_special_tokens=False).ids for w in words]
        assert len(ids.known) <= 60


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 700, 3000).astype(np.uint32)
    m = token_files.WaveletMatrix.build(ids)
    assert (m.decode() == ids).all()
    assert [m.access(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    for v in (0, 5, 699, 900):
        where = np.flatnonzero(ids == v)
        assert m.count(v) == len(where) and m.count(v, 100, 2000) == ((where >= 100) & (where < 2000)).sum()
        assert [m.occurrence(v, j) for j in range(len(where))] == where.tolist()


def test_token_counts(docs, texts, empty):
    tok = path("byte_bpe_50k.json")
    library = token_counts.tokenizer(tok)
    for chunk in (token_counts.CHUNK, 1500):
        for r in token_counts.token_counts(docs, tok, chunk=chunk, overlap=16).collect():
            text = texts[r.doc_id] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)
    assert token_counts.token_counts(empty, tok).count() == 0


def test_token_counts_of_long_texts_without_white_space():
    tok = token_counts.tokenizer(path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    odd = ["x" * 50_000, "q7Z" * 9000, "don't'll've's" * 2000, "<|endoftext|>" * 1500, "\x1c\x1d's\x85\xa0\n" * 4000, " " * 20_000, "日本語🎉" * 5000]
    odd += ["".join(rnd.choice("etaoinshrdlu") for _ in range(40_000)), "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(20_000))]
    for text in [*odd, "".join(odd), " ".join(odd)]:
        want = len(tok.encode(text, add_special_tokens=False).ids)
        assert token_counts.count_huge(tok, text) == token_counts.count_huge(tok, text, 700, 70) == want


@pytest.fixture(scope="module")
def odd_ids(spark):
    """Null and repeated doc_ids, with the same and with other texts, and a text above one million bytes."""
    mail = "write to somebody@mail.example.org about the seven grey ships in the harbour "
    long = " ".join(f"word{k * k % 100_003}" for k in range(120_000))
    rows = [(None, mail * 8), (None, None), (7, mail * 8), (7, mail * 8), (7, "other words under an id that is there already"), (8, long)]
    return spark.createDataFrame([(i, x, "en", "src1", 0, "t", "n", 1) for i, x in rows], SCHEMA), rows


def test_counts_of_odd_ids(odd_ids):
    df, rows = odd_ids
    library = token_counts.tokenizer(path("byte_bpe_50k.json"))
    want = [(i, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for i, x in rows]
    got = [tuple(r)[:3] for r in token_counts.token_counts(df, path("byte_bpe_50k.json")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_of_odd_ids(odd_ids, labels):
    df, rows = odd_ids
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(df, labels).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute.quality(x)) for i, x in rows], key=str)


def test_personal_data_of_odd_ids(odd_ids):
    df, rows = odd_ids
    got = [(r.doc_id, r.n_email, r.base_sha256) for r in pii.digest(pii.find_personal_data(df)).collect()]
    spans = [(i, brute.personal(x)) for i, x in rows]
    assert sorted(got, key=str) == sorted([(i, len(s), hashlib.sha256(",".join(s).encode()).hexdigest()) for i, s in spans], key=str)


def test_repeats_of_odd_ids(odd_ids):
    df, rows = odd_ids
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()]
    plain = brute.without_repeats(dict(enumerate(x for _, x in rows)), 400)
    assert sorted(got, key=str) == sorted([(i, *plain[k]) for k, (i, _) in enumerate(rows)], key=str)


def shared_passages(rows, size=51):
    """Per row, whether so many words in a row stand in another row too."""
    words = [(x or "").encode().split() for x in rows]
    windows = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in words]
    seen = collections.Counter(x for w in windows for x in w)
    return [any(seen[x] > 1 for x in w) for w in windows]


def test_passages_of_more_than_fifty_words(spark):
    """51 short words are fewer than 400 bytes, so they stay, but the row says that it shares them."""
    rng = np.random.default_rng(11)
    made = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    fifty, more, twice, wide = made(50), made(51), made(60), [f"{x:030d}" for x in rng.integers(0, 5000, 20)]
    texts = [" ".join(made(a) + p + made(b)) for p, a, b in ((fifty, 30, 40), (fifty, 0, 70), (more, 20, 0), (more, 90, 35), (twice, 0, 0), (wide, 50, 50), (wide, 9, 80))]
    texts += [" ".join(made(33)) + "\n" + "\t ".join(more) + " \n", " ".join(made(10) + twice + made(60) + twice + made(5)), " ".join(["again"] * 300), None, "", " ".join(more[:50])]
    inside, long = made(56), made(3000)
    texts += [" ".join(made(20) + inside + made(20) + inside + made(20))]  # twice in one row only
    texts += [" ".join(long), " ".join(long[:1500] + ["other"] + long[1500:])] + ["x" * 900] * 2
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()}
    assert [got[i].shares_passage for i in range(len(texts))] == shared_passages(texts)
    assert {2, 3, 4, 7, 8, 14, 15} == {i for i in got if got[i].shares_passage}
    assert [got[i].n_removed for i in (2, 3, 4, 7)] == [0, 0, 0, 0]
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute.without_repeats(dict(enumerate(texts)), 400)


def test_passages_of_all_documents(docs, texts, odd_ids):
    got = {r.doc_id: r.shares_passage for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(zip(texts, shared_passages(texts.values()), strict=True))
    df, rows = odd_ids
    got = sorted((str(r.doc_id), r.n_bytes, r.shares_passage) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted((str(i), len((x or "").encode()), s) for (i, x), s in zip(rows, shared_passages([x for _, x in rows]), strict=True))


def test_words_of_passages_across_texts():
    texts = [b"", b"a b  c", b" x\ty", b"", b"a", b"b c a", "é a".encode()]
    starts, words = suffix_dedup.word_hashes(pa.array(texts, pa.binary()))
    named = dict(zip(words.tolist(), [w for x in texts for w in x.split()], strict=True))
    assert len(named) == 6 and [[named[w] for w in words[a:b].tolist()] for a, b in itertools.pairwise(starts)] == [x.split() for x in texts]
    rng = np.random.default_rng(0)
    texts = [" ".join(map(str, rng.integers(0, 30, n))).encode() for n in rng.integers(0, 160, 60)]
    starts, words = suffix_dedup.word_hashes(pa.array([b"cut off", *texts], pa.binary()).slice(1))
    found = sorted((i, s) for i, _, a, b in zip(*suffix_dedup.passage_anchors(starts, words), strict=True) for s in range(a, b + 1))
    assert found == [(i, s) for i in range(60) for s in range(starts[i], starts[i + 1] - 50)]


def test_severity_and_links_of_odd_ids(spark, odd_ids, labels):
    df, rows = odd_ids
    model = toxicity.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    scored = collections.Counter(r.doc_id for r in toxicity.toxicity(df, model).collect())
    linked = collections.Counter(r.doc_id for r in jaccard_join.near_duplicates(df).collect())
    assert scored == linked == collections.Counter(i for i, _ in rows)


def plain_stages(spark, rows, docs, labels, bench):
    """Ids that the pipeline keeps after each filtering stage, by plain versions; ``rows``: doc_id to (text, lang, source)."""
    import corpus_pipeline

    model = toxicity.fit(docs, labels)

    def severity(text):
        words = brute.WORD.findall(text or "")
        found = set(toxicity.word_features(vocabulary.pa.array(words, vocabulary.pa.string())).ravel().tolist()) - {-1}
        return float(model.at_least(np.array([sum(float(model.weights[f]) for f in found)]))[0, 0])

    seen = {i for i, (text, *_) in rows.items() if severity(text) < 0.5}
    yield seen
    seen = {i for i, (_, c) in brute.components({i: rows[i][0] for i in seen}).items() if i == c}
    yield seen
    t, v = decontaminate.template(F.col("text")).alias("t"), decontaminate.values(F.col("text")).alias("v")
    ours = {r.doc_id: (r.t, r.v) for r in docs.select("doc_id", t, v).collect() if r.doc_id in seen}
    theirs = {r.item_id: (r.t, r.v) for r in bench.select("item_id", t, v).collect()}
    marks = (decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT)
    hits = brute.template_hits(ours, theirs, marks, decontaminate.WINDOW, decontaminate.SHORTEST, decontaminate.LITERALS)
    seen = seen - {i for i, _ in hits}
    yield seen
    yield brute.mixed([(i, *rows[i]) for i in seen], corpus_pipeline.MIX_SHARE, mixing.SEED, mixing.LANG_WEIGHTS, mixing.OTHER_WEIGHT)


def test_pipeline_against_plain_stages(spark, docs, labels):
    import corpus_pipeline

    folder = new_folder(spark, "test")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = {r.doc_id: (r.text, r.lang, r.source) for r in docs.collect()}
    seen, sizes = docs, [len(rows)]
    for (name, apply), want in zip(corpus_pipeline.STAGES[:-1], plain_stages(spark, rows, docs, labels, bench), strict=True):
        seen = apply(spark, seen, folder)
        got = [r.doc_id for r in seen.select("doc_id").collect()]
        assert seen.columns == docs.columns and sorted(got) == sorted(want), name
        sizes.append(len(got))
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)), sizes
    library, start, files = token_counts.tokenizer(path("word_bpe_49k.json")), 0, []
    for i in sorted(want):
        ids = np.array(library.encode(rows[i][0] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        files.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == files


def test_pipeline_on_tables_with_gaps(spark, docs):
    """Null and repeated doc_ids, null sources, columns with clashing names, and no documents at all."""
    import corpus_pipeline

    odd = docs.limit(0).unionByName(spark.createDataFrame([(i, t, None, s, 1, "t", "n", 1) for i, t, s in [(None, "a b c d e f", "src1"), (None, None, None), (7, "g h i j k l", "src2"), (7, "g h i j k l", "src2"), (7, "m n o p q r", None)]], SCHEMA))
    for table in (odd, odd.limit(0)):
        folder = new_folder(spark, "test")
        table.write.parquet(f"{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
        seen = spark.read.parquet(f"{folder}/documents.parquet")
        for name, apply in corpus_pipeline.STAGES[:-1]:
            seen = apply(spark, seen, folder)
            assert seen.columns == docs.columns, name
        assert corpus_pipeline.run(spark, folder).count() == seen.count() <= table.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(apply(spark, seen, FOLDER).collect(), docs.schema)
        assert after.columns == docs.columns and 0 < after.count() <= seen.count(), name
        seen = after
    assert corpus_pipeline.STAGES[-1][1](spark, seen, FOLDER).count() == seen.count()
    assert corpus_pipeline.run(spark, FOLDER).count() == seen.count()
