"""The sink of one file for each document: names, contents, failures."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from folioflow.sources import files, textfiles

ROWS = "doc_id bigint, title string, text string"


def test_each_document_is_its_own_file(spark, tmp_path):
    rows = [
        (1, "Report", "one\r\ntwo\n\n"), (2, "report", "three\rfour"), (3, "Report (1)", "  "), (4, None, None), (5, "", "é日🙂\x00"), (6, 'a/b\\c:*?"<>|', "﻿x"),
        (7, "x" * 300, "long"), (8, "x" * 301, "longer"), (9, "日" * 200, "wide"), (None, "n", "a"), (None, "n", "b"), (10, " .. ", "dots"),
    ]
    table = spark.createDataFrame(rows, ROWS).repartition(3)
    files.write_texts(table, f"{tmp_path}/out")
    back = {r.name: r.text for r in textfiles.read(spark, f"{tmp_path}/out").collect()}
    assert sorted(back.values()) == sorted(t or "" for *_, t in rows)
    assert len({n.lower() for n in back}) == len(rows)
    assert back["Report (1)"] == "one\r\ntwo\n\n" and back["report (2)"] == "three\rfour" and back["Report (1) (3)"] == "  "
    assert back["a_b_c_______"] == "﻿x" and {back["n (none)"], back["n (none-1)"]} == {"a", "b"}
    assert sorted(d for d in os.listdir(f"{tmp_path}/out") if not d.startswith("part-")) == ["_SUCCESS"]
    with pytest.raises(Exception, match="finished job"):
        files.write_texts(table, f"{tmp_path}/out")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    table = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("title"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="broken row"):
        files.write_texts(table, f"{tmp_path}/out")
    left = os.listdir(f"{tmp_path}/out") if os.path.isdir(f"{tmp_path}/out") else []
    assert left == []
    with pytest.raises(Exception, match="no job has finished"):
        textfiles.read(spark, f"{tmp_path}/out").count()
    files.write_texts(table.where("doc_id < 30"), f"{tmp_path}/out")
    assert textfiles.read(spark, f"{tmp_path}/out").count() == 30


def test_no_documents(spark, tmp_path):
    files.write_texts(spark.createDataFrame([], ROWS), f"{tmp_path}/out")
    assert os.listdir(f"{tmp_path}/out") == ["_SUCCESS"]


def test_the_same_name_twice_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="two documents are named"):
        textfiles.write(spark.createDataFrame([("a", "x"), ("a", "y")], "name string, text string").coalesce(1), f"{tmp_path}/out")


def test_a_task_holds_a_batch_and_not_its_files(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(textfiles, "BATCH_FILES", 10)
    monkeypatch.setattr(textfiles, "BATCH_BYTES", 5000)
    writer = textfiles.TextWriter(f"{tmp_path}/out")
    batches = [pa.RecordBatch.from_pydict({"name": [f"n{k:04}" for k in range(a, a + 50)], "text": ["é" * k if k % 7 else None for k in range(a, a + 50)]}) for a in range(0, 500, 50)]
    writer.commit([writer.write(iter(batches))])
    reader = textfiles.TextReader(f"{tmp_path}/out")
    (part,) = reader.partitions()
    back = list(reader.read(part))
    assert max(b.num_rows for b in back) <= 10 and max(b.nbytes for b in back) <= 5000 + 1000 + 20 * 10
    assert {n: t for b in back for n, t in zip(*b.to_pydict().values(), strict=True)} == {f"n{k:04}": "é" * k if k % 7 else "" for k in range(500)}
