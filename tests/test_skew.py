"""Joins with heavy keys, components with hubs, exact similarity, spanning forests and metabolite hubs against brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wickerwork.operators.graph import connected_components
from wickerwork.operators.joins import build_pairs
from wickerwork.operators.omics import hub_metabolites, metabolite_neighbours
from wickerwork.operators.similarity import cut_forest, similarity_links, spanning_forest, text_shingles
from wickerwork.operators.skew import heavy_light_join, heavy_keys, lookup_join


def joined_groups(nodes, edges):
    low = {n: n for n in nodes}

    def find(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return {n: find(n) for n in nodes}


def test_heavy_joins_equal_plain_ones(spark):
    left = spark.createDataFrame([(1 if i % 2 else i % 9, i) for i in range(900)], "k int, x int")
    right = spark.createDataFrame([(1 if i % 3 else i % 12, i) for i in range(150)] + [(None, 5)], "k int, y int")
    assert {r.k for r in heavy_keys(left, "k", 100).collect()} == {1}
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, heavy_light_join(left, right, "k", 20).collect())) == want
    assert sorted(map(tuple, heavy_light_join(left, right, "k").collect())) == want
    table = right.where("k IS NOT NULL").groupBy("k").agg(F.max("y").alias("y")).where("k <> 3")
    for how in ("inner", "left"):
        want = Counter(map(tuple, left.join(table, "k", how).collect()))
        assert Counter(map(tuple, lookup_join(left, table, "k", how, 100).collect())) == want


def test_a_class_of_half_the_rows_is_dealt_evenly(spark):
    n = 6000
    left = spark.range(n).selectExpr("if(id % 2 = 0, 7, id) AS k", "id AS x")
    right = spark.range(300).selectExpr("if(id % 2 = 0, 7, id) AS k", "id AS y")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = heavy_light_join(left, right, "k", 100).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = [r["count"] for r in out]
    assert sum(rows) == 3001 * 151 + 149  # the odd 7 is in the class too
    assert max(rows) <= 2 * sum(rows) / len(rows) and len(rows) > 1


def test_build_pairs_by_classes(spark):
    enz = spark.createDataFrame([(i, i % 2, f"YAL{i % 50:03d}W") for i in range(100)], "enzyme_id int, relevance_class int, orf_text string")
    rxn = spark.createDataFrame([(i, 0, i % 3) for i in range(30)], "reaction_id int, relevance_class int, substrate_id int")
    sub = spark.createDataFrame([(0, "C"), (1, "O")], "substrate_id int, smiles string")
    fasta = spark.createDataFrame([(f"YAL{i:03d}W", "M") for i in range(40)], "seq_id string, sequence string")
    got = build_pairs(enz, rxn, sub, fasta)
    assert got.count() == sum(i % 2 == 0 and i % 50 < 40 for i in range(100)) * 20


@pytest.mark.parametrize("least", [10_000, 20])
def test_components_with_hubs(spark, least):
    rng = random.Random(least)
    edges = [(0, i) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(1300 + i, 1301 + i) for i in range(40)] + [(5, 5), (None, 3), (7, None), (299, 1000)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(2, 1)] * 3
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), least).collect()}
    whole = [e for e in edges if None not in e]
    assert got == joined_groups({n for e in whole for n in e}, whole)


def words_text(rng, n):
    return "".join(rng.choice(["ab", "cd ", "efg", "hé", "\U0001f600 ", "xyz "]) for _ in range(n))


def texts_with_links():
    rng = random.Random(4)
    texts = [words_text(rng, rng.randrange(1, 120)) for _ in range(60)]
    for t in texts[:20]:
        for cut in (2, 10, 40):
            texts.append(t + words_text(rng, cut))
    base = words_text(rng, 100)
    texts += [base[:i] + "Q" + base[i + 1 :] for i in range(0, 90, 3)]
    return [*texts, "", "  ", None, "ab", "ab", texts[3], texts[3], "abcdefgh", "abcdefghi"]


def all_links(texts, k, identity, coverage):
    sets = {i: {t[j : j + k] for j in range(max(1, len(t) - k + 1))} for i, t in enumerate(texts) if t and t.strip()}
    out = {}
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        j = common / len(sets[a] | sets[b])
        if j >= identity and common / max(len(sets[a]), len(sets[b])) >= coverage:
            out[a, b] = j
    return out


@pytest.mark.parametrize(("identity", "coverage", "tight"), [(0.5, 0.5, None), (0.3, 0.5, 0.9), (0.3, 0.0, 0.7), (0.9, 0.2, None), (1.0, 0.0, None)])
def test_similarity_finds_every_link(spark, identity, coverage, tight):
    texts = texts_with_links()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    links = {(r.a, r.b): r.jaccard for r in similarity_links(df, "i", "t", 5, identity, coverage, tight).collect()}
    want = all_links(texts, 5, identity, coverage)
    assert all(abs(want[p] - j) < 1e-12 for p, j in links.items())
    for t in {identity, tight or identity, (identity + (tight or identity)) / 2}:
        level = lambda found: joined_groups(range(len(texts)), [p for p, j in found.items() if j >= t])  # noqa: B023, E731
        assert level(links) == level(want)
    if tight is None:
        assert len(links) < len(want) or len(want) < 40


def test_shingles_count_characters():
    assert len(text_shingles("a\U0001f600b", 2)) == 2 and len(text_shingles("ab", 5)) == 1 and len(text_shingles("aaaaaaa", 3)) == 1


def test_forest_is_maximal_and_cuts_like_all_links(spark):
    rng = random.Random(9)
    links = {tuple(sorted(rng.sample(range(40), 2))): rng.randrange(1, 8) / 8 for _ in range(150)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a int, b int, jaccard double")
    forest = {(r.a, r.b): r.jaccard for r in spanning_forest(df).collect()}
    groups = joined_groups(range(40), links)
    assert len(forest) == 40 - len(set(groups.values())) and all(links[e] == w for e, w in forest.items())
    levels = [0.25, 0.5, 0.8]
    cut = cut_forest(spark.createDataFrame([(a, b, w) for (a, b), w in forest.items()], "a int, b int, jaccard double"), levels).collect()
    for t in levels:
        want = joined_groups(range(40), [e for e, w in links.items() if w >= t])
        got = {r.node: r.component for r in cut if r.threshold == t}
        assert {n: got.get(n, n) for n in range(40)} == want
    assert spanning_forest(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs_up_to", [1000, 8, 2])
def test_hub_metabolites_are_counted_exactly(spark, pairs_up_to):
    rng = random.Random(2)
    rows = {(r, m) for r in range(60) for m in rng.sample(range(25), 3)} | {(r, 99) for r in range(60)} | {(r, 98) for r in range(0, 60, 2)} | {(70, 99)}
    mets = {}
    for r, m in rows:
        mets.setdefault(r, set()).add(m)
    want = set()
    for r in mets:
        shared = sorted(((-len(mets[r] & mets[o]), o) for o in mets if o != r and mets[r] & mets[o]))[:6]
        want |= {(r, o, -n) for n, o in shared}
    df = spark.createDataFrame(sorted(rows), "reaction_id int, met_id int")
    got = metabolite_neighbours(df, 6, pairs_up_to=pairs_up_to)
    assert {(r.reaction_id, r.neighbour, r.shared) for r in got.collect()} == want
    assert {r.met_id for r in hub_metabolites(df, 20).collect()} == {98, 99}
