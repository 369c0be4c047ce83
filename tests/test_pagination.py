"""Pages in chunks against one line after the other."""

from __future__ import annotations

import numpy as np
import pytest

from folioflow.operators import pagination


def one_by_one(heights, used, room):
    out, page = [], 1
    for h in heights:
        h = min(h or 0, room)
        if used + h > room:
            page, used = page + 1, 0
        used += h
        out.append(page)
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, 1024])
def test_chunks_agree_with_lines(spark, chunk):
    rng = np.random.default_rng(chunk)
    docs = {k: [[6, 11, 11, 0, 200, 90, None][int(i)] for i in rng.integers(0, 7, n)] for k, n in [(1, 1), (2, 63), (3, 64), (4, 65), (5, 700), (6, 128), (None, 300)]}
    docs[7], docs[8] = [90] * 30, [0] * 20
    rows = [(k, n, None if h is None else float(h), None if k is None else ["", " ", "T"][k % 3]) for k, hs in docs.items() for n, h in enumerate(hs)]
    plan = spark.createDataFrame(rows, "id bigint, line int, height double, page_title string")
    got = pagination.paginate(plan, "id", plan["page_title"], room=90, chunk=chunk).collect()
    assert len(got) == len(rows)
    for k, hs in docs.items():
        mine = [r.page for r in sorted((r for r in got if r.id == k), key=lambda r: r.line)]
        assert mine == one_by_one(hs, pagination.HEADER if k is not None and k % 3 == 2 else 0, 90)


def test_empty_and_repeated(spark):
    plan = spark.createDataFrame([], "id bigint, line int, height double")
    assert pagination.paginate(plan, "id").count() == 0
    plan = spark.createDataFrame([(1, 0, 60.0), (1, 0, 60.0), (1, 1, 60.0)], plan.schema)
    assert sorted((r.line, r.page) for r in pagination.paginate(plan, "id", room=90).collect()) == [(0, 1), (0, 1), (1, 2)]


def test_counts(spark):
    paged = spark.createDataFrame([(1, 1), (1, 4), (2, 3)], "id bigint, page int")
    assert {tuple(r) for r in pagination.page_counts(paged, "id", 3).collect()} == {(1, 4, False), (2, 3, True)}
