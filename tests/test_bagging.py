"""Batched logistic regressions against single fits, and the registered learning queries that SQL cannot express."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wickerwork.operators import learning
from wickerwork.operators.batched_logit import fit_batched, mean_probability
from wickerwork.plans.registry import QUERIES


def test_all_members_equal_single_fits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)) * [1, 3, 0.1, 1, 0]
    y = (x[:, 0] - x[:, 1] / 2 + rng.normal(size=400) > 0.3).astype(float)
    w = (rng.random((400, 3)) < [1.0, 0.7, 0.4]).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b), c.tolist()) for a, b, c in zip(x, y, w, strict=True)], "x array<double>, y double, w array<double>").repartition(3)
    beta = fit_batched(rows, 3, 5)
    for m in range(3):
        own = rows.where(F.col("w")[m] == 1).select(array_to_vector("x").alias("f"), "y")
        fit = LogisticRegression(featuresCol="f", labelCol="y", regParam=0.01, maxIter=500, tol=1e-13).fit(own)
        assert np.abs(beta[m] - np.append(fit.coefficients.toArray(), fit.intercept)).max() < 1e-6
    got = [r[0] for r in rows.select(mean_probability(F.col("x"), beta).alias("p")).collect()]
    assert 0 < min(got) < max(got) < 1


def test_wide_features_are_fitted_one_by_one(spark, monkeypatch):
    df = spark.range(200).selectExpr("id", "cast(id % 10 < 3 as int) AS y", "array(cast(id % 10 as double), cast(id % 7 as double)) AS a").select("id", "y", array_to_vector("a").alias("x"))
    together = {r.id: r.score for r in learning.fit_pu_bagging(df, "id", "x", "y", members=3)(df).collect()}
    monkeypatch.setattr(learning, "BATCHED_WIDTH", 1)
    alone = {r.id: r.score for r in learning.fit_pu_bagging(df, "id", "x", "y", members=3, iterations=200)(df).collect()}
    assert max(abs(together[i] - alone[i]) for i in together) < 1e-3


def auc(rows):
    ranked = sorted(rows)
    pos = [i for i, (_, y) in enumerate(ranked) if y]
    return (sum(pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (len(ranked) - len(pos)))


def test_bagging_query(spark, sf):
    got = QUERIES["i5_pu_bagging"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and auc([(r.score, r.y) for r in got]) > 0.8


def test_baseline_query(spark, sf):
    got = QUERIES["i2_i3_i4_baseline_scores"](spark, sf).collect()
    assert len({r.doc_id for r in got}) == len(got) > 0 and all(0 <= r.score <= 1 for r in got)
    assert auc([(r.score, r.quality) for r in got if r.split == "train"]) > 0.8


def test_heads_query(spark, sf):
    got = QUERIES["i14_fit_heads"](spark, sf).collect()
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert len(got) == len(labels) and sum(int(r.class_pred) == labels[r.vec_id] for r in got) > 0.6 * len(got)


def test_ensemble_query(spark, sf):
    got = QUERIES["j1_ensemble"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    for r in got:
        assert abs(sum(r["mean"]) - 1) < 1e-9 and min(r["std"]) >= 0 and r.bald >= -1e-9 and 0 <= r.entropy <= np.log(2) + 1e-6
