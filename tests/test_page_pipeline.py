"""The page pipeline: one pass over pages, and the same results as its parts give one by one."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import layout, normalize, pipeline, stages, tables
from folioflow.plans import exports, words

SF = "/root/testdata/sf0.001"
LINES = "page bigint, block int, line int, text string, top double, bottom double, conf double"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")


@needs_tables
def test_pages_are_shuffled_once_and_nothing_is_written(spark):
    before = len(stages._TABLES)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = exports.page_pipeline(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(stages._TABLES) == before and plan.count("Exchange ") == 1 and "Join" not in plan


@needs_tables
def test_query_is_its_parts_one_by_one(spark):
    """Words as rows, lines as what they make, every part by itself: as the query is defined."""
    w = words.words(spark, SF).withColumn("text", F.when(F.col("word_no") == 201, "ME2AR").when(F.col("word_no") == 302, "5elam").otherwise(F.col("text")))
    dealt = w.withColumns({"line": F.floor(F.col("word_no") / 100).cast("int"), "conf": F.col("page") % 10 / 10.0})
    read = dealt.where("page % 13 <> 5").cache()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    lines = read.groupBy("page", "line").agg(text.alias("text"), F.first("conf").alias("conf")).select("page", F.floor(F.col("line") / 2).cast("int").alias("block"), "line", "text", (F.col("line") * 40.0).alias("top"), (F.col("line") * 40.0 + 20).alias("bottom"), "conf")
    raw = dealt.select("page", "conf").distinct().select("page", F.when(F.col("page") % 26 == 5, " ").otherwise("gü2el  raw5text ").alias("raw_text"), "conf")
    boxes = read.select("page", "word_no", "text", "l", "t", "r", "b", "conf")
    got = sorted(exports.page_pipeline(spark, SF).collect())
    assert got == sorted(pipeline.process(lines, boxes, raw).collect())
    # tables of repaired words, by the detector that other queries use
    fixed = boxes.withColumn("text", normalize.repair(F.col("text"), F.col("conf")))
    for grid in (None, words.grid(spark, SF)):
        want = {r.page: (r.near_miss, r.reason is None) for r in tables.Analysis(fixed, grid).decisions().collect()}
        some = got if grid is None else pipeline.process(lines, boxes, raw, grid).collect()
        assert {r.page: (r.near_miss, r.has_table) for r in some if r.page % 13 != 5} == want
    # changes and texts
    n = {r.page: r.n for r in lines.groupBy("page").agg(F.sum(F.size(normalize.changes(F.col("text"), F.col("conf")))).alias("n")).collect()}
    texts = {r.page: r.text for r in layout.format_blocks(lines.withColumn("text", normalize.repair(F.col("text"), F.col("conf")))).collect()}
    assert {r.page: (r.n_changes, r.text) for r in got if r.page % 13 != 5} == {p: (n[p], texts[p]) for p in n}


def test_odd_lines(spark):
    """Blank and missing texts, lines of one number, blocks and places unknown."""
    lines = [
        (1, 0, 0, " b5elam ", 0.0, 20.0, None), (1, 0, 0, "a", 0.0, 20.0, None), (1, None, 7, "first", None, None, None), (1, 1, 0, "far", 90.0, 110.0, 0.1), (1, 2, 0, None, 112.0, 132.0, None),
        (2, 0, 0, " \t", 0.0, 20.0, None), (3, 0, 0, None, 0.0, 20.0, None), (5, 0, 0, "se5lam", 0.0, 20.0, 0.2), (5, 1, 1, "ME2AR\r\nx ", 22.0, 42.0, 0.9),
    ]
    raw = [(1, "raw", None), (2, " raw2x ", None), (3, "gü2el", None), (4, " \n", None), (5, "", 0.9), (6, "gü2el", 0.1)]
    words = spark.createDataFrame([(1, 0, None, 0.0, 0.0, 9.0, 9.0, None)], "page bigint, word_no int, text string, l double, t double, r double, b double, conf double")
    got = {r.page: tuple(r)[1:] for r in pipeline.process(spark.createDataFrame(lines, LINES), words, spark.createDataFrame(raw, "page bigint, raw_text string, conf double")).collect()}
    none = (False, False)
    assert got == {1: ("firsta\nbselam\n\nfar", 1, *none), 2: (" raw2x ", 0, *none), 3: ("güzel", 1, *none), 4: ("", 0, *none), 5: ("se5lam\nMEZAR\nx", 1, *none), 6: ("gü2el", 0, *none)}


def test_tilts_against_counting():
    rng = np.random.default_rng(3)
    n = np.append(rng.integers(0, 70, 60), [1500, 6])
    first = n.cumsum() - n
    x, y = rng.integers(0, 900, n.sum()).astype(float), rng.integers(0, 90, n.sum()) * 6.0
    y[rng.integers(0, n.sum(), 5)] *= 1e7  # pages too high to count all their buckets
    h = rng.choice([10.0, 20.0], len(n))
    got = tables._tilts(x, y, first, n, h)
    for k in np.flatnonzero(n >= tables.MIN_SLOPE_WORDS):
        mine = slice(first[k], first[k] + n[k])
        v = (y[mine] - tables._TILTS[:, None] * x[mine]) / (h[k] * tables.ROW_TOLERANCE)
        whole = np.trunc(v)
        keys = whole + np.where(np.abs(v - whole) >= 0.5, np.sign(v), 0.0)
        assert got[k] == np.argmax([(np.unique(row, return_counts=True)[1] ** 2).sum() for row in keys]) - tables.SLOPE_STEPS


@needs_tables
def test_order_of_words_does_not_matter(spark):
    """Words may come in any order; of equal places the number decides."""
    w = words.words(spark, SF).withColumn("l", F.floor(F.col("l") / 150) * 150.0)  # many equal left edges
    frames = [w.orderBy(order).coalesce(1) for order in (F.asc("word_no"), F.desc("word_no"))]
    columns = ("n_rows", "n_cols", "confidence", "reason")
    first, second = ({r.page: tuple(round(v, 9) if isinstance(v := r[c], float) else v for c in columns) for r in tables.Analysis(f).decisions().collect()} for f in frames)
    assert first == second
    pages = frames[1].groupBy("page").agg(F.collect_list(F.struct("word_no", "text", "l", "t", "r", "b", "conf")).alias("words"))
    assert {r.page: r.has_table for r in tables.outcomes(pages).collect()} == {p: v[3] is None for p, v in first.items()}
