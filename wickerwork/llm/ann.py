"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.llm.shared import durable


class KMeansTree:
    """children[i]: (centroids, child numbers) of an inner node; leaf[i]: the leaf number of a leaf node."""

    def __init__(self, points: np.ndarray, branch: int, leaf_points: int, seed: int = 7):
        self.children: dict[int, tuple[np.ndarray, list[int]]] = {}
        self.leaf: dict[int, int] = {}
        rng = np.random.default_rng(seed)
        todo, nodes = [(0, points)], 1
        while todo:
            node, own = todo.pop()
            centres, label = self._split(own, branch, rng) if len(own) > leaf_points else (None, None)
            if centres is None:
                self.leaf[node] = len(self.leaf)
                continue
            self.children[node] = (centres, [*range(nodes, nodes + len(centres))])
            todo += [(nodes + i, own[label == i]) for i in range(len(centres))]
            nodes += len(centres)

    @staticmethod
    def _split(own: np.ndarray, branch: int, rng: np.random.Generator):
        distinct = np.unique(own[rng.permutation(len(own))[:2000]], axis=0)
        if len(distinct) < 2:
            return None, None
        centres = distinct[rng.choice(len(distinct), min(branch, len(distinct)), replace=False)]
        for _ in range(10):
            label = np.argmin((centres**2).sum(1) - 2 * own @ centres.T, axis=1)
            centres = np.stack([own[label == i].mean(0) if (label == i).any() else c for i, c in enumerate(centres)])
        label = np.argmin((centres**2).sum(1) - 2 * own @ centres.T, axis=1)
        used = np.unique(label)
        return (None, None) if len(used) < 2 else (centres[used], np.searchsorted(used, label))

    def assign(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
                continue
            centres, below = self.children[node]
            label = np.argmin((centres**2).sum(1) - 2 * points[rows] @ centres.T, axis=1)
            todo += [(child, rows[label == i]) for i, child in enumerate(below) if (label == i).any()]
        return out

    def visit(self, point: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: the queue always continues at the node whose centroid is nearest."""
        waiting = [(0.0, 0)]
        while waiting:
            _, node = heapq.heappop(waiting)
            if node in self.leaf:
                yield self.leaf[node]
                continue
            centres, below = self.children[node]
            for d, child in zip(((centres - point) ** 2).sum(1).tolist(), below, strict=True):
                heapq.heappush(waiting, (d, child))


def calibrated_visits(tree: KMeansTree, sample: np.ndarray, k: int, recall: float, probes: int) -> int:
    """The fewest leaves to visit so that, within the sample, `probes` of its vectors find that part of their true k nearest."""
    step = max(1, len(sample) // probes)
    leaf_of = tree.assign(sample)
    needed = []
    for i in range(0, len(sample), step):
        score = sample @ sample[i]
        score[i] = -np.inf
        true = np.argpartition(-score, min(k, len(score) - 1))[:k]
        place = {leaf: n for n, leaf in enumerate(tree.visit(sample[i]), 1)}
        needed += [place[x] for x in leaf_of[true]]
    needed.sort()
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if needed else 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_size: int = 16_384,
    branch: int = 8,
    leaf_points: int = 48,
    target_recall: float = 0.98,
    probes: int = 256,
    block_rows: int = 2048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries its k nearest rows of vectors by cosine, its own id
    excepted; nearest first, ties to the smaller id. queries has the same two columns as vectors.

    The tree is fitted on a hash sample of about sample_size vectors, twice that at most (documented bound: what the driver holds; the
    tree then has fewer leaves), but every vector is indexed by its leaf. How many leaves a query visits is
    calibrated: the fewest with which probes of the sample reach target_recall against brute force over the sample;
    a query also goes on until the leaves it has visited hold 4 k rows. Queries and vectors meet by leaf in a
    shuffle; leaves above block_rows vectors, or visited by as many queries, are cut into blocks by hashes of the
    ids, so a dense leaf is many tasks' work. Scores are recomputed on the original vectors in double precision.

    Vectors that are null, all zero, hold nulls or non-finite numbers, or whose length is not the commonest, take no
    part, as queries or candidates; nor do null ids. Rows with equal ids are one another's own row. With fewer than k
    candidates all are returned. Extra columns are ignored; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        df = df.select(F.col(id_col).alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        return df.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")

    base, asked = clean(vectors), clean(queries)
    commonest = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if commonest is None:
        return spark.createDataFrame([], result)
    dims = commonest["d"]
    base, asked = base.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    rows = commonest["count"]
    drawn = base.where(F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, sample_size / rows) * (1 << 30)))
    fitted = drawn.select("id", "v").limit(2 * sample_size).toPandas().sort_values("id")  # the limit counts only where rows repeat
    if fitted.empty:
        fitted = base.orderBy("id").limit(1).select("id", "v").toPandas()
    sample = _unit(np.stack(fitted["v"].to_numpy()).astype(np.float64))
    tree = KMeansTree(sample, branch, leaf_points)
    visits = calibrated_visits(tree, sample, k, target_recall, probes)

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=tree.assign(_unit(np.stack(batch["v"].to_numpy()))))

    indexed = durable(base.mapInPandas(to_leaf, f"id {kind}, v array<double>, leaf long"))
    sizes = indexed.groupBy("leaf").agg(F.count("*").alias("rows")).toPandas()  # at most one row a leaf of the tree
    held = dict(zip(sizes["leaf"].tolist(), sizes["rows"].tolist(), strict=True))

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaves = []
            for point in _unit(np.stack(batch["v"].to_numpy())) if len(batch) else []:
                own, seen = [], 0
                for leaf in tree.visit(point):
                    own.append(leaf)
                    seen += held.get(leaf, 0)
                    if len(own) >= visits and seen >= 4 * k:
                        break
                leaves.append([x for x in own if x in held])
            if leaves:
                yield batch.assign(leaves=leaves)

    seeking = asked.mapInPandas(to_visits, f"id {kind}, v array<double>, leaves array<long>")
    seeking = durable(seeking.select("id", "v", F.explode("leaves").alias("leaf")))
    blocks = (
        indexed.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("vb"))
        .join(seeking.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("qb")), "leaf")
    )
    block_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    stored = indexed.join(F.broadcast(blocks), "leaf").select("leaf", block_of("vb").alias("x"), each("qb").alias("y"), "id", "v")
    wanted = seeking.join(F.broadcast(blocks), "leaf").select("leaf", each("vb").alias("x"), block_of("qb").alias("y"), "id", "v")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own, found = left["id"].to_numpy(), []
        v = np.stack(left["v"].to_numpy())
        length = np.sqrt((v * v).sum(1))
        unit = v / length[:, None]
        for query, q in zip(right["id"], right["v"], strict=True):
            rough = unit @ (q / np.sqrt((q * q).sum()))
            rough[own == query] = -np.inf
            cut = np.partition(rough, max(0, len(rough) - k))[max(0, len(rough) - k)]
            near = np.flatnonzero((rough >= cut - 1e-9) & (own != query))
            exact = (v[near] * q).sum(1) / (length[near] * np.sqrt((q * q).sum()))
            for i in np.lexsort((own[near], -exact))[:k]:
                found.append((query, own[near[i]], exact[i]))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["leaf", "x", "y"]
    scored = stored.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(score, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
