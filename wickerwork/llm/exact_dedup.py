"""Exact deduplication by content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.llm.shared import ascii_lower, durable, partitions_of

#: Characters of a text that sampled splitters carry; bounds what range partitioning sends to the driver.
SPLITTER_CHARS = 32


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z. repartitionByRange samples splitters and
    range-partitions the normalised texts; the sort inside each partition (external, it spills) puts equal
    texts side by side, and the window's group boundary is a full comparison of neighbours. One row of each
    group is kept, that with the smallest id (keep="largest": the largest). Splitters are made of a text's first
    SPLITTER_CHARS characters and its hash, since the driver gathers them; the sort then compares whole texts.

    Skew: a text with more than 1/(4 n) of all rows (n partitions) is cut into pieces by a hash of the id before
    the sort; there are fewer than 4 n such texts, so the list of their hashes may be broadcast. The pieces'
    first rows, fewer than 8 n, are content-sorted once more and joined back.

    Null text counts as empty. A null id sorts last and is kept only where the group has no other id; among
    rows with equal text and id one is kept. Other columns are ignored; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    n = partitions or partitions_of(docs.sparkSession)
    order = F.asc_nulls_last if keep == "smallest" else F.desc_nulls_last
    best = F.min if keep == "smallest" else F.max

    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    total = docs.count()
    hot = (
        rows.groupBy("h")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") * (4 * n) > total)
        .select("h", F.ceil(F.col("c") * (4 * n) / total).alias("pieces"))
    )
    placed = (
        rows.join(F.broadcast(hot), "h", "left")
        .select("doc_id", "norm", "h", "pieces", F.coalesce(F.pmod(F.xxhash64("doc_id"), "pieces"), F.lit(0)).alias("piece"))
        .withColumn("start", F.substring("norm", 1, SPLITTER_CHARS))
        .repartitionByRange(n, "start", "h", "piece")
    )
    run = Window.partitionBy("start", "h", "piece", "norm")
    first = F.row_number().over(run.orderBy(order("doc_id"))) == 1
    runs = placed.select(
        "doc_id",
        "piece",
        "norm",
        F.col("pieces").isNotNull().alias("cut"),
        first.alias("first"),
        best("doc_id").over(run).alias("run_keep"),
        F.count("*").over(run).alias("run_size"),
    ).select(
        "doc_id",
        "piece",
        "first",
        "run_keep",
        "run_size",
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("cut") & F.col("first"), F.col("norm")).alias("head"),
    )
    runs = durable(runs)

    group = Window.partitionBy("start", "text_sha256", "head")
    merged = (
        runs.where(F.col("head").isNotNull())
        .withColumn("start", F.substring("head", 1, SPLITTER_CHARS))
        .repartitionByRange(n, "start", "text_sha256")
        .select(
            "text_sha256",
            "piece",
            best("run_keep").over(group).alias("group_keep"),
            F.sum("run_size").over(group).alias("group_rows"),
            (F.row_number().over(group.orderBy(order("run_keep"), "piece")) == 1).alias("winner"),
        )
    )
    return runs.join(F.broadcast(merged), ["text_sha256", "piece"], "left").select(
        "doc_id",
        F.coalesce("group_keep", "run_keep").alias("keep_id"),
        F.coalesce("group_rows", "run_size").alias("group_size"),
        (F.col("first") & F.coalesce("winner", F.lit(True))).alias("kept"),
        "text_sha256",
    )
