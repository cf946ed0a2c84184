"""What the operators move must not grow faster than their input."""

import itertools
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wickerwork.operators import learning, omics, similarity, splits


def test_group_graph_is_over_ids(spark, monkeypatch):
    seen, real = [], splits.connected_components
    monkeypatch.setattr(splits, "connected_components", lambda edges: seen.append(edges.collect()) or real(edges))
    rows = spark.createDataFrame([(i,) for i in range(8)], "id long")
    tokens = [(i, f"only {i} {j}") for i in range(6) for j in range(20)] + [(0, "x"), (3, "x"), (3, "y"), (5, "y"), (4, "x"), (7, None)]
    got = {r.id: r.group_key for r in splits.unified_group_split(rows, "id", spark.createDataFrame(tokens, "id long, token string")).collect()}
    # Tokens of one id make no edges, those of several link ids to the smallest one.
    assert {(r.a, r.b) for r in seen[0]} == {(3, 0), (4, 0), (5, 3)}
    assert len(got) == 8 and None not in got.values() and len({got[i] for i in (0, 3, 4, 5)}) == 1 and len(set(got.values())) == 5


def test_group_graph_with_a_token_of_most_ids(spark, monkeypatch):
    monkeypatch.setattr(splits, "LEAST", 50)
    rows = spark.createDataFrame([(i,) for i in range(300)], "id long")
    tokens = [(i, "common") for i in range(0, 300, 2)] + [(i, f"t{i // 10}") for i in range(1, 300, 2)]
    got = {r.id: r.group_key for r in splits.unified_group_split(rows, "id", spark.createDataFrame(tokens, "id long, token string")).collect()}
    assert len(got) == 300 and len({got[i] for i in range(0, 300, 2)}) == 1 and len(set(got.values())) == 31


def test_mean_group_correlation_makes_no_pairs(spark, tmp_path):
    """Equal to the mean over gene_correlation's pairs, with genes of other conditions, flat ones and ones with too few in common."""
    draw = random.Random(5)
    values = [(g, f"c{c}", 1.0 if g % 7 == 0 else draw.random()) for g in range(40) for c in range(6) if g % 5 or c != g % 6] + [(40, "c1", 0.5), (41, "c9", 0.5)]
    members = [(k, g) for k in range(3) for g in range(42) if g % (k + 1) == 0]
    expr, groups = spark.createDataFrame(values, "gene_id long, condition string, value double"), spark.createDataFrame(members, "group_id long, gene_id long")
    pairs = groups.withColumnRenamed("gene_id", "gene_a").join(groups.withColumnRenamed("gene_id", "gene_b"), "group_id").where("gene_a <> gene_b")
    means = pairs.join(omics.gene_correlation(expr, pairs), ["gene_a", "gene_b"]).groupBy("group_id", F.col("gene_a").alias("gene_id")).agg(F.avg("correlation").alias("m")).where("m IS NOT NULL")
    want = {(r.group_id, r.gene_id): r.m for r in means.collect()}
    got = {(r.group_id, r.gene_id): r.mean_correlation for r in omics.mean_group_correlation(expr, groups).collect()}
    assert got.keys() == want.keys() and len(got) > 60 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_pseudo_gpr_does_not_pair_candidates(spark, monkeypatch):
    def pairs(*_):
        raise AssertionError("candidates were paired")

    monkeypatch.setattr(omics, "gene_correlation", pairs)
    expr = spark.createDataFrame([(g, f"c{c}", float((g * 3 + 1) * c % 7)) for g in range(20) for c in range(5)], "gene_id long, condition string, value double")
    stoich = spark.createDataFrame([(0, 1), (1, 1)], "reaction_id long, met_id long")
    rules = spark.createDataFrame([(0, g) for g in range(20)], "reaction_id long, gene_id long")
    assert omics.infer_pseudo_gpr(expr, stoich, rules, -1.0).count() == 5


@pytest.mark.parametrize("fit", [learning.holdout_regression, learning.kfold_regression])
def test_forests_deal_their_rows(spark, monkeypatch, fit):
    """The rows of one small file are dealt to several tasks, and the files' layout decides nothing."""
    monkeypatch.setattr(learning, "FOREST_ROWS", 100)
    parts, real = [], learning.RandomForestRegressor.fit
    monkeypatch.setattr(learning.RandomForestRegressor, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or real(self, df))
    df = spark.range(400).select("id", array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double"))).alias("x"), (F.col("id") % 7 + F.col("id") % 3).cast("double").alias("y"))
    one, many = (sorted(map(tuple, fit(df.repartition(n), "id", "x", "y", 2, trees=3).collect())) if fit is learning.kfold_regression else sorted(map(tuple, fit(df.repartition(n), "id", "x", "y", 2, 20, 3).collect())) for n in (1, 5))
    assert set(parts) == {4} and [(k, n) for k, n, *_ in one] == [(k, n) for k, n, *_ in many]
    assert all(abs(a - b) < 1e-9 for x, y in zip(one, many, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("whole", [True, False])
def test_similarity_keeps_no_sets(spark, monkeypatch, whole):
    """Sets are neither written nor posted in full, and links are all found with several classes, small chunks and an order of a sample."""
    for name, value in {"CLASS_POSTS": 500, "CHUNK": 700, "PAIRS": 50, "SMALL": 60, "ORDER_SHINGLES": 10**6 if whole else 300}.items():
        monkeypatch.setattr(similarity, name, value)
    tables, real = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df: tables.append(real(df)) or tables[-1])
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(draw.randrange(1, 40))) for _ in range(60)]
    texts += [t[: len(t) * draw.randrange(5, 10) // 10] + " " + word() for t in texts] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    found = {(r.a, r.b): r.jaccard for r in similarity.similarity_links(df, "i", "t", 5, 0.5, 0.5, 0.9).collect()}
    sets = [{t[j : j + 5] for j in range(max(1, len(t) - 4))} for t in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(len(texts)), 2)}

    def groups(links, least):
        label = list(range(len(texts)))
        for (a, b), j in links.items():
            if j >= least and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
        return label

    assert all(abs(want[p] - j) < 1e-12 for p, j in found.items()) and len(found) > 30
    assert groups(found, 0.5) == groups(want, 0.5) and groups(found, 0.9) == groups(want, 0.9)
    arrays = [(df, c) for df in tables for c, kind in df.dtypes if kind.startswith("array")]
    assert sum(df.agg(F.sum(F.size(c))).first()[0] or 0 for df, c in arrays) < sum(map(len, sets)) / 4


def test_threshold_sweep_keeps_no_sets(spark, monkeypatch):
    """The sweep's clusters are those of all pairs, with several classes, and no table it writes holds the sets."""
    monkeypatch.setattr(similarity, "CLASS_POSTS", 500)
    tables, real = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df: tables.append(real(df)) or tables[-1])
    draw = random.Random(7)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(60, 90))).strip() for _ in range(12)]
    texts += [t[: len(t) * part // 100] + "zyxwv" for t in texts[:8] for part in (95, 80, 65)]
    sets = [{t[j : j + 5] for j in range(max(1, len(t) - 4))} for t in texts]
    alike = lambda x, y, t: len(x & y) >= t * len(x | y) and 2 * len(x & y) >= max(len(x), len(y))
    want = {}
    for t in (0.5, 0.7, 0.9):
        label = list(range(len(texts)))
        for a, b in itertools.combinations(range(len(texts)), 2):
            if alike(sets[a], sets[b], t) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
        want[t] = len(set(label))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.threshold: r.clusters for r in splits.threshold_sweep(df, "i", "t", [0.5, 0.7, 0.9]).collect()}
    assert got == want and len(set(want.values())) > 1
    arrays = [(df, c) for df in tables for c, kind in df.dtypes if kind.startswith("array")]
    assert sum(df.agg(F.sum(F.size(c))).first()[0] or 0 for df, c in arrays) < sum(map(len, sets)) / 4
