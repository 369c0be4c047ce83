"""Values that lie at a rule's border to the last digit."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

from folioflow.operators import raster
from folioflow.plans import rasters


def test_levels_at_the_mean_border_fall_where_sql_has_them():
    rng = np.random.default_rng(3)
    made = []
    for _ in range(300):
        levels = rng.integers(200, 256, (8, 8)).astype(float)
        square = rng.permutation(np.repeat([240.0, 241.0], 24))
        levels[1:8, 0:7] = np.insert(square, 24, 216.0).reshape(7, 7)  # 216 is nine tenths of the mean 240
        made.append(levels / 255)
    px = pd.DataFrame([(k, x, y, v[y, x], 8, 8) for k, v in enumerate(made) for y in range(8) for x in range(8)], columns=["img_id", "x", "y", "v", "w", "h"])
    con = duckdb.connect()
    con.register("px", px)
    black = con.execute(f"select img_id, x, y from {rasters._box('select * from px', 3)} where v < m * 0.9::double").fetchall()
    assert black and set(black) == {(k, x, y) for k, v in enumerate(made) for y, x in zip(*np.nonzero(raster.threshold(v) == 0), strict=True)}
