import json
import random

import pytest

from shelfpace.operators import metadata
from shelfpace.sources import lines, writers
from shelfpace.sources.readers import read_item_meta


@pytest.fixture(params=[1 << 27, 200])
def block_bytes(spark, request):
    """Files in one block each, and cut into many."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def test_positions_are_those_of_the_files(spark, tmp_path, block_bytes):
    rng = random.Random(5)
    want = []
    for name, size in (("a", 300), ("b", 1), ("c", 0), ("d", 77)):
        texts = ["".join(rng.choices("xyz ä", k=rng.randint(0, 60))) for _ in range(size)]
        (tmp_path / f"{name}.txt").write_text("".join(t + "\n" for t in texts))
        want += [(len(want) + n, n, text) for n, text in enumerate(texts)]
    read = lines.numbered_lines(spark, str(tmp_path))
    got = sorted(tuple(r) for r in read.collect())
    assert got == want
    if block_bytes == 200:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 7


def test_no_lines_at_all(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("sku,target_stock\n")
    assert lines.score_item_lines(spark, str(tmp_path)).count() == 0
    assert lines.item_meta_lines(spark, str(tmp_path / "empty.csv")).count() == 0


def _plain_score_items(path):
    """position -> (reason, sku, stock) by a plain reader."""
    found = {}
    with open(path, encoding="utf-8") as file:
        for n, raw in enumerate(file.read().split("\n")[:-1]):
            if n == 0 or not raw.strip(" "):
                continue
            n -= 1  # the header has no position
            fields = [f.strip(" ") for f in raw.split(",")]
            try:
                sku = int(fields[0])
            except ValueError:
                sku = None
            try:
                stock = float(fields[1]) if len(fields) > 1 and fields[1] else None
                bad = False
            except ValueError:
                stock, bad = None, True
            reason = "wrong number of fields" if len(fields) < 2 else "bad key" if sku is None else "bad number" if bad else None
            found[n] = (raw, reason, sku, stock)
    return found


def test_score_items_keep_order_and_bad_lines_keep_their_text(spark, tmp_path, block_bytes):
    rng = random.Random(11)
    kinds = [
        lambda n: f"{n},{n * 0.5}", lambda n: f"{n},", lambda n: f" {n} , 3 ", lambda n: f"x{n},4", lambda n: ",5",
        lambda n: f"{n},many", lambda n: f"{n}", lambda n: "", lambda n: f"{n},1,extra", lambda n: f"{10**20 + n},1" if n < 0 else f"{n},7",
    ]
    body = [rng.choice(kinds)(n) for n in range(400)]
    path = tmp_path / "items.csv"
    path.write_text("sku,target_stock\n" + "".join(b + "\n" for b in body))
    want = _plain_score_items(path)
    read = lines.score_item_lines(spark, str(path))
    got = {r["position"]: (r["raw"], r["reason"], r["sku"], r["target_stock"]) for r in read.collect()}
    assert got == want
    kept = lines.records(read)
    assert kept.columns == ["sku", "target_stock", "monid"]
    ordered = [r["sku"] for r in metadata.score_list(kept, spark.createDataFrame([], "sku long, item_domain_id string, site_id string")).collect()]
    assert ordered == [want[n][2] for n in sorted(want) if want[n][1] is None]
    out = lines.rejects(read, "items").collect()
    assert sorted((r["position"], r["reason"], r["raw"]) for r in out) == sorted((n, w[1], w[0]) for n, w in want.items() if w[1])


def test_a_key_beyond_64_bits_is_bad(spark, tmp_path):
    (tmp_path / "i.csv").write_text("sku,target_stock\n99999999999999999999,1\n1.5,2\n")
    got = lines.score_item_lines(spark, str(tmp_path / "i.csv")).collect()
    assert [r["reason"] for r in got] == ["bad key", "bad key"]


def test_metadata_rejects_broken_records_and_missing_keys(spark, tmp_path, block_bytes):
    good = [json.dumps({"sku": n, "item_domain_id": f"M-{n}", "site_id": None, "other": [1, {"a": "}"}]}) for n in range(40)]
    bad = ['{"sku": 1', "[1, 2]", "words", '{"site_id": "S"}', '{"sku": null}', '{"sku": "x"}', '"text"', "3"]
    texts = good + bad + ["", "  "]
    random.Random(2).shuffle(texts)
    (tmp_path / "meta.jl").write_text("".join(t + "\n" for t in texts))
    read = lines.item_meta_lines(spark, str(tmp_path / "meta.jl"))
    out = {r["raw"]: (r["position"], r["reason"]) for r in lines.rejects(read, "meta").collect()}
    missing = {'{"site_id": "S"}', '{"sku": null}'}
    assert out == {t: (texts.index(t), "bad key" if t in missing else "broken record") for t in bad}
    kept = sorted(tuple(r) for r in lines.records(read).collect())
    assert kept == [(n, f"M-{n}", None) for n in range(40)]
    plain = read_item_meta(spark, str(tmp_path / "meta.jl")).filter("item_domain_id IS NOT NULL")
    assert sorted(tuple(r) for r in plain.collect()) == kept


def test_positions_leave_out_the_header_of_each_file(spark, tmp_path):
    for name, size in (("a", 3), ("b", 0), ("c", 2)):
        (tmp_path / f"{name}.csv").write_text("sku,target_stock\n" + "".join(f"{n},1\n" for n in range(size)))
    got = sorted(tuple(r) for r in lines.numbered_lines(spark, str(tmp_path), header=True).collect())
    assert got == [(0, 1, "0,1"), (1, 2, "1,1"), (2, 3, "2,1"), (3, 1, "0,1"), (4, 2, "1,1")]


def test_predictions_are_read_only_if_complete(spark, tmp_path, block_bytes):
    n = 300
    rows = [(k, [(k + c) / 10_000 for c in range(30)]) for k in range(n)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "out.csv")
    predicted = spark.createDataFrame(rows, "monid long, probabilities array<double>").repartition(5)
    writers.write_predictions(predicted, path)
    got = {r["position"]: r["raw"] for r in lines.checked_lines(spark, path).collect()}
    assert got == {k: ",".join(f"{(k + c) / 10_000:.4f}" for c in range(30)) for k in range(n)}
    part = sorted((tmp_path / "out.csv").glob("part-*"))[-1]
    texts = part.read_text().splitlines(keepends=True)
    (tmp_path / "out.csv" / f".{part.name}.crc").unlink(missing_ok=True)
    for changed in (texts[1:], texts[::-1], [*texts, texts[0]]):
        part.write_text("".join(changed))
        with pytest.raises(ValueError):
            lines.checked_lines(spark, path)
    part.write_text("".join(texts))
    assert lines.checked_lines(spark, path).count() == n


def test_no_predictions_are_complete_too(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    writers.write_predictions(spark.createDataFrame([], "monid long, probabilities array<double>"), path)
    assert lines.checked_lines(spark, path).count() == 0
