"""Bootstrap over groups: multinomial draws made where the groups are, and metrics of all replicates in one pass over the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.operators.graph import written
from wickerwork.operators.ranking import _numbered

#: Groups whose draws one task makes at a time.
BUCKET_GROUPS = 4096
#: Rows whose weights are numbers at a time.
SLICE_ROWS = 4096
_SUMS = ("n", "positives", "negatives", "tp", "fp", "score_positive", "score_negative", "ap", "auc", "b", "ll")


def bucket_draws(counts: np.ndarray, bucket: int, replicates: int, seed: int) -> np.ndarray:
    """How many of all draws fall into a bucket of groups, for each replicate. The draws (as many as groups) are split by binomials down a binary
    tree over the buckets; a node's random numbers hang on the seed and the node alone, so every task finds the same splits."""
    lo, hi = 0, len(counts)
    n = np.full(replicates, counts.sum(), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, whole = counts[lo:mid].sum(), counts[lo:hi].sum()
        in_left = np.random.default_rng([seed, 1, lo, hi]).binomial(n, left / whole if whole else 0.0)
        n, lo, hi = (in_left, lo, mid) if bucket < mid else (n - in_left, mid, hi)
    return n


def bootstrap_weights(df: DataFrame, group: str, replicates: int = 500, seed: int = 0, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(group, weights): for every distinct group how often each replicate draws it. A replicate draws, with replacement and equal chances,
    exactly as many groups as there are (null is a group). Groups are dealt to buckets by hash; counts by bucket, one number for about
    bucket_groups groups, are all that the tasks are told."""
    groups = written(df.select(group).distinct())
    total = groups.count()
    buckets = max(1, -(-total // bucket_groups))
    dealt = groups.withColumn("_bucket", F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(buckets)).cast("int"))
    counts = np.zeros(buckets, np.int64)
    for row in dealt.groupBy("_bucket").count().collect():
        counts[row["_bucket"]] = row["count"]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["_bucket"].iloc[0])
        pdf = pdf.iloc[np.argsort(pdf[group].astype(str).to_numpy(), kind="stable")]
        n = bucket_draws(counts, bucket, replicates, seed)
        w = np.random.default_rng([seed, 2, bucket]).multinomial(n, np.full(len(pdf), 1 / len(pdf)))
        return pd.DataFrame({group: pdf[group], "weights": list(w.T.astype(np.int32))})

    return written(dealt.groupBy("_bucket").applyInPandas(draw, f"`{group}` {dict(df.dtypes)[group]}, weights array<int>"))


def _weighted(pdf: pd.DataFrame):
    """Slices of a partition from the highest score down: scores, labels and weights by row, and where each distinct score begins."""
    pdf = pdf.iloc[np.argsort(-pdf["score"].to_numpy(float), kind="stable")]
    score, label, c = (pdf[x].to_numpy(float) for x in ("score", "label", "c"))
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    at = 0
    while at < len(score):
        later = first[first >= at + SLICE_ROWS]
        stop = int(later[0]) if len(later) else len(score)
        yield score[at:stop], label[at:stop], np.stack(pdf["weights"].iloc[at:stop].to_list()) * c[at:stop, None], first[(first >= at) & (first < stop)] - at
        at = stop


def replicate_sums(rows: DataFrame, threshold: float, replicates: int) -> DataFrame:
    """One row per replicate with the _SUMS that the metrics need, of rows (score, label, c, weights): sums by score run down range partitions;
    first each partition's totals, one vector of the replicates, then the sums from what lies before it."""
    numbered = _numbered(rows, [F.desc("score")])

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((2, replicates))
        for _, label, w, _ in _weighted(pdf):
            sums += np.stack([label @ w, (1 - label) @ w])
        return pd.DataFrame({"_part": pdf["_part"].iloc[:1], "pos": [sums[0]], "neg": [sums[1]]})

    before, pos, neg = {}, np.zeros(replicates), np.zeros(replicates)
    for row in numbered.groupBy("_part").applyInPandas(totals, "_part long, pos array<double>, neg array<double>").orderBy("_part").collect():
        before[row["_part"]] = (pos.copy(), neg.copy())
        pos, neg = pos + np.array(row["pos"]), neg + np.array(row["neg"])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        tp, fp = (x.copy() for x in before[int(pdf["_part"].iloc[0])])
        out = dict.fromkeys(_SUMS, 0.0)
        for score, label, w, first in _weighted(pdf):
            p = np.clip(score, 1e-7, 1 - 1e-7)
            kept = (score >= threshold).astype(float)
            by_score = lambda x: np.add.reduceat(x[:, None] * w, first, axis=0)  # noqa: B023, E731
            at_pos, at_neg = by_score(label), by_score(1 - label)
            upto_tp, upto_fp = tp + np.cumsum(at_pos, axis=0), fp + np.cumsum(at_neg, axis=0)
            each = {
                "n": w.sum(0), "positives": label @ w, "negatives": (1 - label) @ w, "tp": (kept * label) @ w, "fp": (kept * (1 - label)) @ w,
                "score_positive": (score * label) @ w, "score_negative": (score * (1 - label)) @ w, "b": (score - label) ** 2 @ w,
                "ll": -(label * np.log(p) + (1 - label) * np.log(1 - p)) @ w,
                "ap": (at_pos * upto_tp / np.maximum(upto_tp + upto_fp, 1e-300)).sum(0), "auc": (at_neg * (upto_tp - at_pos / 2)).sum(0),
            }
            out = {k: out[k] + each[k] for k in _SUMS}
            tp, fp = upto_tp[-1], upto_fp[-1]
        return pd.DataFrame({"rep": np.arange(replicates), **out})

    per_part = numbered.groupBy("_part").applyInPandas(sums, "rep int, " + ", ".join(f"{k} double" for k in _SUMS))
    return per_part.groupBy("rep").agg(*(F.sum(k).alias(k) for k in _SUMS))


def group_bootstrap(df: DataFrame, group: str, label: str, score: str, threshold: float, replicates: int = 500, seed: int = 0) -> DataFrame:
    """metric, mean, low, high (2.5 and 97.5 %) of pu_metrics over replicates that each draw exactly as many groups as there are, with
    replacement. Rows are first summed by group and score; every row carries the weights of all replicates as one vector."""
    weights = bootstrap_weights(df, group, replicates, seed).withColumnRenamed(group, "_g")
    rows = df.groupBy(F.col(group).alias("g"), F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score")).agg(F.count("*").cast("double").alias("c"))
    weighted = rows.join(weights, F.col("g").eqNullSafe(F.col("_g"))).where("label IS NOT NULL AND score IS NOT NULL").select("score", "label", "c", "weights")
    s = replicate_sums(weighted, threshold, replicates)
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    metrics = {
        "recall": over("tp", "positives"), "unlabeled_positive_rate": over("fp", "negatives"), "mean_score_positive": over("score_positive", "positives"),
        "mean_score_unlabeled": over("score_negative", "negatives"), "average_precision": over("ap", "positives"),
        "roc_auc": F.col("auc") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0.0)), "brier": over("b", "n"), "log_loss": over("ll", "n"),
    }
    long = s.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in metrics.items()))).alias("r")).select("r.*")
    return long.where("v IS NOT NULL").groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
