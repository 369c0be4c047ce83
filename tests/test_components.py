"""The largest component by runs against a search that knows nothing of runs."""

from __future__ import annotations

import numpy as np
import pytest

from folioflow.operators import raster


def searched(mask):
    """All components by flooding, in the order of their first pixels; of equal corners the one whose place comes first in a walk
    written as recursion over a list of open places."""
    h, w = mask.shape
    left = {(x, y) for y in range(h) for x in range(w) if mask[y, x]}
    found = []
    for start in sorted(left, key=lambda p: (p[1], p[0])):
        if start not in left:
            continue
        order, todo = [], [start]
        left.discard(start)
        while todo:
            x, y = todo.pop()
            order.append((x, y))
            for p in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                if p in left:
                    left.discard(p)
                    todo.append(p)
        found.append(order)
    if not found:
        return 0, []
    most = max(found, key=len)
    return len(most), [min(most, key=lambda p: p[0] + p[1]), max(most, key=lambda p: p[0] - p[1]), max(most, key=lambda p: p[0] + p[1]), min(most, key=lambda p: p[0] - p[1])]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.6, 0.75, 1.0])
def test_random_masks(share):
    rng = np.random.default_rng(int(share * 100))
    for _ in range(60):
        mask = rng.random((rng.integers(1, 24), rng.integers(1, 24))) < share
        assert raster.largest_component(mask) == searched(mask)


def test_shapes_with_ties():
    y, x = np.mgrid[0:40, 0:40]
    diamond = abs(x - 20) + abs(y - 20) <= 12
    snake = (y % 4 == 0) | ((y % 4 == 2) & (x == 0)) | ((y % 8 == 1) & (x == 39)) | ((y % 8 == 5) & (x == 0))
    comb = (y == 39) | (x % 2 == 0)
    twins = ((x < 10) | (x > 25)) & (y > 4) & (y < 30)
    for mask in (diamond, snake, comb, comb[::-1], twins, twins[:, :36], diamond & ~twins):
        assert raster.largest_component(mask) == searched(mask)


def test_first_of_equal_components_stays():
    mask = np.zeros((9, 9), bool)
    mask[1:3, 5:7] = mask[5:7, 1:3] = True
    assert raster.largest_component(mask) == (4, [(5, 1), (6, 1), (6, 2), (5, 2)])
