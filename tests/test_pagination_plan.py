"""Chains of chunk tables are followed without Python, and tables are made a few at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import pagination


def test_tables_are_followed_in_the_engine(spark):
    rng = np.random.default_rng(5)
    heights = [rng.choice([6, 11], 64) for _ in range(5)]
    made = [pagination.chunk_table(h) for h in heights]
    found = pagination.followed(F.array(*[F.array(*[F.lit(int(x)) for x in t]) for t in made]), F.lit(28))
    got = [tuple(x) for x in spark.range(1).select(found.alias("ends")).first().ends]
    used, page, want = 28, 1, []
    for h in heights:
        for x in h:
            used, page = (used + x, page) if used + x <= pagination.ROOM else (x, page + 1)
        want.append((used, page))
    assert got == want
