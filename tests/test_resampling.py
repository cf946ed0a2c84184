"""Group bootstrap: exact numbers of draws, and metrics against plain computation with the same draws."""

import numpy as np
import pytest

from wickerwork.operators import resampling
from wickerwork.operators.learning import group_bootstrap, pu_metrics
from wickerwork.operators.resampling import bootstrap_weights, bucket_draws


def rows(spark):
    data = [(f"g{i % 37}" if i % 50 else None, int(i * 7 % 10 < 4), (i * 13 % 29) / 29) for i in range(600)]
    return data, spark.createDataFrame(data, "g string, y int, s double")


@pytest.mark.parametrize("bucket_groups", [4096, 5])
def test_every_replicate_draws_as_many_groups_as_there_are(spark, bucket_groups):
    data, df = rows(spark)
    got = {r.g: np.array(r.weights) for r in bootstrap_weights(df, "g", 200, 3, bucket_groups).collect()}
    again = {r.g: np.array(r.weights) for r in bootstrap_weights(df.repartition(7), "g", 200, 3, bucket_groups).collect()}
    assert set(got) == {d[0] for d in data} and all((got[k] == again[k]).all() for k in got)
    w = np.stack([got[k] for k in sorted(got, key=str)])
    assert (w.sum(0) == len(got)).all()
    # Mean 1 and variance 1 - 1/G, as drawing with replacement has.
    assert abs(w.var() - (1 - 1 / len(got))) < 0.1 and len({tuple(c) for c in w.T}) > 190


def test_splits_down_the_tree_add_up():
    counts = np.array([3, 0, 7, 1, 12, 5, 9])
    draws = np.stack([bucket_draws(counts, b, 50, 8) for b in range(len(counts))])
    assert (draws.sum(0) == counts.sum()).all() and (draws[1] == 0).all()
    assert abs(draws[4].mean() - 12) < 2


def test_metrics_equal_those_of_the_drawn_rows(spark, monkeypatch):
    data, df = rows(spark)
    weights = {r.g: r.weights for r in bootstrap_weights(df, "g", 20, 5).collect()}
    drawn = [(rep, y, s) for g, y, s in data for rep in range(20) for _ in range(weights[g][rep])]
    want = pu_metrics(spark.createDataFrame(drawn, "rep int, y int, s double"), "y", "s", 0.5, None, ["rep"]).toPandas().set_index("rep")
    monkeypatch.setattr(resampling, "SLICE_ROWS", 10)
    got = {r.metric: r for r in group_bootstrap(df, "g", "y", "s", 0.5, 20, 5).collect()}
    assert set(got) == set(want.columns) - {"n", "positives"}
    for name, r in got.items():
        assert abs(r["mean"] - want[name].mean()) < 1e-9 and abs(r.low - np.percentile(want[name], 2.5)) < 1e-9 and abs(r.high - np.percentile(want[name], 97.5)) < 1e-9
