"""Connected components as a DataFrame loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.operators.skew import LEAST, heavy_keys, lookup_join


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names (on a local master without it, in an own folder): the lineage
    ends there and a lost executor costs nothing that was done before. The shuffle files of the write go as it ends, as nothing reads them
    again; otherwise they would stay until the driver collects its garbage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    path, cleanup = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, least: int = LEAST) -> DataFrame:
    """(node, component) of edges(a, b): the smallest node of the component. Labels move to neighbours, then jump to their
    label's label; a round is two joins, the state is written each round, and the loop ends when nothing changes.

    A node of very many edges, and a label that very many nodes have, are heavy keys of those joins: what is looked up for them is
    broadcast (see lookup_join), so that their rows stay where they are and no task gets a hub. Minima are combined before the shuffle."""
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = written(edges.union(edges.select("b", "a")).toDF("node", "other").distinct())
    label = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")))
    hubs = _heavy(both, "other", least)
    while True:
        named = label.select(F.col("node").alias("other"), F.col("component").alias("c"))
        seen = _joined(both, named, "other", hubs)
        low = seen.groupBy("node").agg(F.min("c").alias("m"))
        step = written(label.join(low, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("c2"))
        new = _joined(step, jump, "component", _heavy(step, "component", least))
        new = written(new.select("node", "old", F.least("component", "c2").alias("component")))
        if not new.where("component <> old").limit(1).count():
            return new.select("node", "component")
        label = new.select("node", "component")


def _heavy(rows: DataFrame, key: str, least: int) -> DataFrame | None:
    """The heavy keys, or None where there are none; a table of fewer rows than a heavy key has is not counted by key."""
    if rows.count() <= least:
        return None
    heavy = heavy_keys(rows, key, least).select(key)
    return heavy if heavy.limit(1).count() else None


def _joined(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """lookup_join where there are heavy keys, else a plain join; every key is in the table."""
    return rows.join(table, key) if heavy is None else lookup_join(rows, table, key, heavy=heavy)
