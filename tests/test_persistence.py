"""The trigram index and versioned tables: equal to scans, readable after a writer died, one winner of two."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import search_index
from folioflow.sources import files, snapshots



def table(spark, n, seed=1):
    rng = random.Random(seed)
    parts = ["şirket", "IŞIK", "kâğıt", "güneş", "abc", "bca", "cab", "a", "🙂x", "the", "İstanbul"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    rows = [(k, rng.choice([None, "", word()]), rng.choice([None, "", " \t\n".join(word() for _ in range(rng.randint(1, 12)))]), k, 1, "x") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, title string, text string, row int, slot int, folded string")


@pytest.mark.parametrize("query", ["", "  ", "a", "ab", "abc", "abcab", "ŞİRKET isik", "sirketgun", "🙂xa", "x🙂", "zzz", "a abc", "kagitkagitkagit", "t i"])
def test_index_finds_what_a_scan_finds(spark, indexed, query):
    docs, index = indexed
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "text")]
    want = docs.where(text.matches(F.lit(query), *fields))
    got = index.search(query)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = table(spark, 300)
    index = search_index.SearchIndex(spark, f"{tmp_path_factory.mktemp('index')}/i")
    with pytest.raises(ValueError, match="nothing is indexed"):
        index.search("a")
    assert index.add(docs.where("doc_id < 200"), "title", "text") == 1
    assert index.add(docs.where("doc_id >= 200"), "title", "text") == 2
    return docs, index


def test_index_reads_posting_lists_alone(spark, indexed):
    docs, index = indexed
    plan = index.search("sirket")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    assert "Python" not in plan
    # the former version is still there, without the rows added later
    assert {r.doc_id for r in index.search("", version=1).collect()} == set(range(200))


@pytest.mark.parametrize("block", [7, 50, 8_000_000])
def test_posting_lists_hold_every_trigram_of_every_row(monkeypatch, block):
    monkeypatch.setattr(search_index, "BLOCK", block)
    rng = random.Random(3)
    wide = "".join(map(chr, rng.sample(range(0x4E00, 0x9FFF), 3000)))
    texts = ["", "ab", "abc", "abcabcabcd", "🙂x🙂x a", wide, *("".join(rng.choice("abı 🙂") for _ in range(rng.randint(0, 40))) for _ in range(60))]
    batch = lambda of: pa.RecordBatch.from_pylist([{"row": (k % 2 << 33) + k, "folded": texts[k].encode()} for k in of], schema=pa.schema([("row", pa.int64()), ("folded", pa.binary())]))
    found = [r for b in search_index.posting_lists(iter([batch(range(9)), batch(range(9, len(texts)))])) for r in b.to_pylist()]
    want = {(t[i : i + 3], (k % 2 << 33) + k) for k, t in enumerate(texts) for i in range(len(t) - 2)}
    assert {(r["gram"], row) for r in found for row in r["rows"]} == want
    assert all(r["n"] == len(set(r["rows"])) and [r["bucket"]] == search_index.buckets_of([r["gram"]]) for r in found)
    assert block < 8_000_000 or len(found) == len({g for g, _ in want})


def test_trigrams_in_many_rows_are_no_candidates_and_texts_may_be_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "FEW", 20)
    monkeypatch.setattr(search_index, "BLOCK", 5)
    docs = table(spark, 60, seed=4).coalesce(1)
    index = search_index.SearchIndex(spark, f"{tmp_path}/i")
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")
    try:
        index.add(docs, "title", "text")
    finally:
        spark.conf.unset(joined)
    (key,) = os.listdir(f"{tmp_path}/i/rows")
    assert len([n for n in os.listdir(f"{tmp_path}/i/rows/{key}") if n.startswith("slot=")]) > 1  # dealt out, though the source has one split
    plans = []
    for query in ("abc", "sirket", "cabcab the", "abcbcacab", "🙂xkag"):
        got = index.search(query)
        plans.append("rows#" in got._jdf.queryExecution().optimizedPlan().toString())
        want = docs.where(text.matches(F.lit(query), *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "text")]))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert set(plans) == {False, True}


def test_store_is_readable_when_a_writer_dies(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"{tmp_path}/s")
    assert store.read() is None and store.version() == 0
    one, two = (spark.createDataFrame([(k, "x")], "id int, json string") for k in (1, 2))
    assert files.write_store(one, f"{tmp_path}/s") == 1
    lost = store.stage(two)  # dies before it commits
    assert [r.id for r in files.read_store(spark, f"{tmp_path}/s").collect()] == [1]
    assert store.vacuum(older_than_s=3600) == 0
    assert store.vacuum(older_than_s=-60) == 1
    assert lost not in store._names("data")
    assert [r.id for r in store.read().collect()] == [1]


def test_one_of_two_writers_loses(spark, tmp_path):
    one, two = (spark.createDataFrame([(k, "x")], "id int, json string") for k in (1, 2))
    a, b = (snapshots.Snapshots(spark, f"{tmp_path}/s") for _ in range(2))
    a.write(one)
    seen = b.version()
    pinned = b.read()
    assert a.write(two, expected=1) == 2
    with pytest.raises(snapshots.Conflict):
        b.write(one, expected=seen)
    assert [r.id for r in pinned.collect()] == [1] and [r.id for r in b.read().collect()] == [2]
    assert b._names("staged") == {}
    assert b.write(one) == 3 and a.versions() == [1, 2, 3]


def test_appends_add_up(spark, tmp_path):
    frames = [spark.createDataFrame([(k, "x")], "id int, json string") for k in range(3)]
    a, b = (snapshots.Snapshots(spark, f"{tmp_path}/s") for _ in range(2))
    a.append(frames[0])
    real, first = b.version, [0]

    def late():  # b believes in an old version once, so its first commit meets a's
        found = real()
        if not first[0]:
            first[0] = 1
            a.append(frames[1])
        return found

    b.version = late
    assert b.append(frames[2]) == 3
    assert sorted(r.id for r in a.read().collect()) == [0, 1, 2]
    assert sorted(r.id for r in a.read(2).collect()) == [0, 1]
    with pytest.raises(ValueError, match="the table"):
        a.append(frames[0].withColumn("more", F.lit(1)))
