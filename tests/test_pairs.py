"""Moments of all pairs of columns against a data frame library, over tiles, tasks, holes and constants."""

import numpy as np
import pandas as pd
import pytest

from feldspark.operators import pairs


def holed(n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 7)) @ rng.normal(size=(7, 7)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 0.1  # constant
    x[2:, 6] = np.nan  # hardly any rows
    return pd.DataFrame(x, columns=list("abcdefg"))


@pytest.mark.parametrize("tile", [2, 3, 512])
def test_correlations(spark, monkeypatch, tile):
    monkeypatch.setattr(pairs, "TILE", tile)
    frame = holed()
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame)).repartition(5)
    got = {(r["a"], r["b"]): r for r in pairs.pair_moments(df, list(frame.columns)).collect()}
    assert set(got) == {(a, b) for i, a in enumerate(frame) for b in list(frame)[i + 1 :]}
    for (a, b), r in got.items():
        both = frame[[a, b]].dropna()
        assert r["n"] == len(both)
        if len(both) > 1:
            spread = both - both.mean()
            assert r["cxy"] == pytest.approx((spread[a] * spread[b]).sum(), rel=1e-6, abs=1e-5)
    found = {(r["a"], r["b"]): r["r"] for r in pairs.correlations(df, list(frame.columns)).collect()}
    for (a, b), r in found.items():
        if "f" in (a, b) and got[a, b]["n"] > 1:
            assert np.isnan(r)
        elif got[a, b]["n"] > 2:
            assert r == pytest.approx(frame[a].corr(frame[b]), abs=1e-6)


def test_no_pairs_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert pairs.correlations(df, ["a"]).count() == 0
    assert [r["r"] for r in pairs.correlations(df, ["a", "b"]).collect()] == [None]
