"""Ensembles, uncertainty and selection of candidates to try next."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from wickerwork.operators.learning import apply_heads, fit_heads
from wickerwork.operators.ranking import top_k_per_group


def fit_ensemble(df: DataFrame, id_col: str, embedding: str, label: str, kind: str, members: int = 5) -> DataFrame:
    """(id, member, prob array) of heads fitted to hash bootstraps: a row weighs Poisson(1) for each member."""
    out = None
    for m in range(members):
        u = F.pmod(F.xxhash64(F.lit(m), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
        weight = F.when(u < 0.3679, 0.0).when(u < 0.7358, 1.0).when(u < 0.9197, 2.0).when(u < 0.981, 3.0).otherwise(4.0)
        rows = df.withColumn("_w", weight).where("_w > 0")
        model = fit_heads(rows, id_col, embedding, {"task": (label, kind)}, validation=0, weight="_w")
        value = F.col("task_prob") if kind != "regression" else F.array("task_pred")
        one = apply_heads(df, embedding, model).select(id_col, F.lit(m).alias("member"), value.alias("prob"))
        out = one if out is None else out.unionByName(one)
    return out


def _entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log(x + 1e-10))


def ensemble_stats(preds: DataFrame, item: str) -> DataFrame:
    """preds(item, member, prob array): item, mean (array), std (array), entropy of the mean, bald = entropy of mean - mean entropy."""
    cells = preds.select(item, _entropy(F.col("prob")).alias("h"), F.posexplode("prob").alias("k", "p"))
    per = cells.groupBy(item, "k").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s"), F.avg("h").alias("h"))
    out = per.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("k", "m", "s"))).alias("c"), F.first("h").alias("h"))
    mean, std = F.transform("c", lambda x: x["m"]), F.transform("c", lambda x: x["s"])
    return out.select(item, mean.alias("mean"), std.alias("std"), _entropy(mean).alias("entropy"), (_entropy(mean) - F.col("h")).alias("bald"))


def error_function(x: np.ndarray) -> np.ndarray:
    """erf of a whole array: 2 / sqrt(pi) exp(-x^2) sum of 2^n x^(2n+1) / (2n+1)!!, whose terms have one sign; 1 to double precision beyond 6."""
    at = np.clip(np.abs(x), 0.0, 6.0)
    term, total = at.copy(), at.copy()
    for n in range(1, 160):
        term = term * (2 * at * at / (2 * n + 1))
        total = total + term
    return np.copysign(np.minimum(2 / math.sqrt(math.pi) * np.exp(-at * at) * total, 1.0), x)


@pandas_udf(DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * (1.0 + error_function(z.to_numpy(float) / math.sqrt(2.0))))


def expected_improvement(mu: Column, sd: Column, best: float, xi: float = 0.01) -> Column:
    """0 where sd < 1e-10. Only the normal distribution function, which SQL lacks, is an Arrow function."""
    gain = mu - best - xi
    z = gain / F.greatest(sd, F.lit(1e-10))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(sd < 1e-10, 0.0).otherwise(gain * _normal_cdf(z) + F.greatest(sd, F.lit(1e-10)) * density)


def select_candidates(stats: DataFrame, item: str, score: str, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """The k best items by score, ties to the smaller id, without those of exclude(item): item, score (6 digits), rank."""
    left = stats.join(exclude.select(item), item, "left_anti") if exclude is not None else stats
    best = left.orderBy(F.desc(score), item).limit(k)
    ranked = top_k_per_group(best.withColumn("_g", F.lit(1)), "_g", [F.desc(score), item], k)
    return ranked.select(item, F.round(score, 6).alias("score"), "rank")


def round_summary(selected: Sequence[DataFrame], score: str = "score") -> DataFrame:
    """round, selected, mean_score, best_score of the rounds' selections."""
    out = None
    for i, s in enumerate(selected, 1):
        one = s.agg(F.count("*").alias("selected"), F.avg(score).alias("mean_score"), F.max(score).alias("best_score")).select(F.lit(i).alias("round"), "*")
        out = one if out is None else out.unionByName(one)
    return out
