"""Ranked searches next to plain versions."""

import numpy as np
import pandas as pd
import pytest

from cohortline.operators import moments

FITS = [(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, -1.0]), (4, [1.0, 3.0]), (5, [1.0, 3.0])]


@pytest.mark.parametrize("size", [(1_000_000, 20, 200_000), (40, 2, 0)])
def test_every_order_is_ranked_once_and_exactly(spark, monkeypatch, size):
    """Ties, nulls, a heavy value, constant fits; whole groups and slices of a few rows with label ranks joined by shuffle."""
    monkeypatch.setattr(moments, "SLICE_ROWS", size[0])
    monkeypatch.setattr(moments, "SLICE_SAMPLES", size[1])
    monkeypatch.setattr(moments, "MAX_RANKS", size[2])
    monkeypatch.setattr(moments, "HELD", 100)
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(size=900), 1), np.where(rng.random(900) < 0.4, 2.0, rng.normal(size=900))
    y = np.round(a + rng.normal(size=900))
    hole = rng.random(900) < 0.1
    rows = [(1 + i % 2, 1 + i % 3, i, float(y[i]), None if hole[i] else float(a[i]), float(b[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "outer int, inner int, __row long, __y double, __f0 double, __f1 double")
    fits = [(o, j, s, 1.5, slopes, [0.25, 0.0], 10.0, 0.0, 150.0) for o in (1, 2) for j in (0, 1, 2, 3) for s, slopes in FITS]
    got = {(r["outer"], r["inner"], r["set"]): r["score"] for r in moments.rank_scores(df, spark.createDataFrame(fits, moments._FITS), 2).collect()}
    assert len(got) == 2 * 3 * len(FITS)
    for (o, j, s), score in got.items():
        own = [r for r in rows if r[:2] == (o, j)]
        p = pd.Series([FITS[s][1][0] * (0.25 if r[4] is None else r[4]) + FITS[s][1][1] * r[5] for r in own])
        if s == 0:
            assert score is None
        else:
            assert score == pytest.approx(np.corrcoef(p.rank(), pd.Series([r[3] for r in own]).rank())[0, 1], abs=1e-12)


def test_fits_of_one_order_share_it():
    one = moments.direction(1, 2, [0.0, 0.3], [5.0, 6.0])
    assert one == moments.direction(1, 2, [0.0, 4.0], [5.0, 6.0])
    assert one != moments.direction(1, 2, [0.0, -4.0], [5.0, 6.0])
    assert moments.direction(1, 2, [0.0, 0.0], [5.0, 6.0]) is None
    assert moments.direction(1, 2, [1.0, 4.0], [5.0, 6.0]) != moments.direction(1, 2, [1.0, 4.1], [5.0, 6.0])
