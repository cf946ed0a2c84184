"""Size-balanced sharding with sampled splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.llm.shared import durable

_LAST = 2**63 - 1


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at or below key, by binary search in a constant array."""
    width = 1
    while width <= len(bounds):
        width *= 2
    table = F.split(F.lit(",".join(map(str, bounds + [_LAST] * (width - len(bounds))))), ",").cast("array<bigint>")
    steps, step = [], width // 2
    while step:
        steps.append(step)
        step //= 2
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.element_at(table, at + s) <= key, at + s).otherwise(at)
    )


def _deal(groups: list, n_shards: int, share: float) -> tuple[dict, list[float]]:
    """Shards for the given (key, bytes) groups, the largest first, each to the shard with most room of its share left; the rooms then left."""
    left, shard_of = [share] * n_shards, {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = max(range(n_shards), key=lambda i: (left[i], -i))
        shard_of[key] = at
        left[at] -= size
    return shard_of, left


def shard_by_size(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int | None = None,
    samples_per_range: int = 32,
    keep_rows: bool = False,
) -> DataFrame:
    """Shards of near-equal bytes; equal texts stay together. One row per input row:
    doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless in the shard), grown_shard (null); with keep_rows also row, the input row.

    The key is a 64-bit hash of the text, so equal texts are neighbours. A row's load is its size plus the mean size, so that many small
    rows count too. A sample drawn with probability proportional to load (ranges * samples_per_range keys expected) gives the boundaries
    of `ranges` key ranges: 128 a shard, or one for 500,000 rows where that is more. Keys with more load than an even range (fewer than
    `ranges` of them, hence the broadcasts) make a range overfull and are subdivided by a hash of the id. Of these, a group of equal
    texts above 1/32 of a shard (fewer than 32 a shard) that fits a shard is dealt whole to the shard with most room; one that fits none
    is cut row by row. All other groups lie on the line of all bytes, whole, and fill what room the dealt ones leave: running
    sums inside the ranges, plus the ranges' offsets, place each by its midpoint. So a shard misses its room by at most 1/64 of a shard at
    either end; dealt groups too large to be packed evenly are the one other cause of a difference.

    Size is the text's UTF-8 bytes plus 1 (null: 1); the crc32 of a null is that of no bytes, 0. Null ids and
    repeated rows are placed like any other. Extra columns are ignored. An empty table gives an empty result.
    """
    text = F.col(text_col)
    base = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
            F.xxhash64(id_col).alias("id_hash"),
            *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_rows else []),
        )
    )
    sums = base.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = sums["bytes"] or 0
    ranges = ranges or max(128 * n_shards, sums["rows"] // 500_000)
    even, share = max(1.0, 2 * total / ranges), total / n_shards
    load = F.col("size") + F.lit(total / max(1, sums["rows"]))

    draws = ranges * samples_per_range / max(2 * total, 1)
    chance = F.pmod(F.xxhash64("id_hash", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    expected = load * draws
    weight = F.floor(expected) + F.when(chance < expected - F.floor(expected), 1).otherwise(0)
    quantiles = [i / ranges for i in range(1, ranges)]
    bounds = (
        base.withColumn("w", weight).where("w > 0").agg(F.percentile("key", quantiles, F.col("w")).alias("b")).first()["b"]
    )
    bounds = sorted({int(x) for x in bounds or []})

    ranged = base.withColumn("range", _range_of(F.col("key"), bounds))
    overfull = ranged.groupBy("range").agg(F.sum(load).alias("load")).where(F.col("load") > 2 * even).select("range")
    heavy = durable(
        ranged.join(F.broadcast(overfull), "range", "left_semi")
        .groupBy("key")
        .agg(F.sum("size").alias("bytes"), F.sum(load).alias("load"))
        .where(F.col("load") > even)
        .select("key", "bytes", F.col("key").alias("hot_key"), F.ceil(F.col("load") / even).alias("parts"))
    )
    large = heavy.where((F.col("bytes") > share / 32) & (F.col("bytes") <= share)).select("key", "bytes").collect()  # fewer than 32 a shard
    dealt, room = _deal([(r["key"], r["bytes"]) for r in large], n_shards, share)
    dealt_to = base.sparkSession.createDataFrame([(-1, 0), *((s, k) for k, s in dealt.items())], "dealt int, hot_key long").where("dealt >= 0")
    heavy = heavy.join(F.broadcast(dealt_to), "hot_key", "left").select("key", "hot_key", "parts", "dealt", (F.col("bytes") > share).alias("cut"))
    spread = ranged.join(F.broadcast(heavy), "key", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("id_hash", F.lit(5)), "parts"), F.lit(-1))
    )
    # What is dealt takes no place on the line.
    spread = spread.withColumn("lies", F.when(F.col("dealt").isNull(), F.col("size")).otherwise(0))
    unit = ["range", "hot_key", "part"]
    whole = ["range", "hot_key"]
    offsets = Window.orderBy(F.col("range"), F.asc_nulls_first("hot_key"), "part").rowsBetween(Window.unboundedPreceding, -1)
    units = (
        spread.groupBy(*unit)
        .agg(F.sum("lies").alias("bytes"), F.count("*").alias("rows"))
        .select(
            F.col("range").alias("u_range"),
            F.col("hot_key").alias("u_hot"),
            F.col("part").alias("u_part"),
            F.coalesce(F.sum("bytes").over(offsets), F.lit(0)).alias("bytes_before"),
            F.sum("bytes").over(Window.partitionBy(*whole)).alias("whole_bytes"),
            F.coalesce(F.sum("bytes").over(Window.partitionBy(*whole).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("whole_before"),
            F.coalesce(F.sum("rows").over(offsets), F.lit(0)).alias("rows_before"),
        )
    )
    here = Window.partitionBy(*unit).orderBy("key", "doc_id", "id_hash")
    same_text = Window.partitionBy(*unit, "key")
    placed = (
        spread.withColumn("before", F.sum("lies").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("lies"))
        .withColumn("nth", F.row_number().over(here) - 1)
        .withColumn("group_start", F.min("before").over(same_text))
        .withColumn("group_bytes", F.sum("lies").over(same_text))
        .join(
            F.broadcast(units),
            (F.col("range") == F.col("u_range")) & F.col("hot_key").eqNullSafe(F.col("u_hot")) & (F.col("part") == F.col("u_part")),
        )
    )
    alone, in_parts = F.coalesce(F.col("cut"), F.lit(False)), F.col("hot_key").isNotNull()
    start = F.col("bytes_before") + F.when(alone, F.col("before")).when(in_parts, -F.col("whole_before")).otherwise(F.col("group_start"))
    width = F.when(alone, F.col("size")).when(in_parts, F.col("whole_bytes")).otherwise(F.col("group_bytes"))
    # On the line a shard has the room that dealt groups leave, and all rooms together are scaled to the line.
    free = [max(x, 0.0) for x in room]
    line = max(1, total - sum(r["bytes"] for r in large))
    ends, at = [], 0.0
    for x in free[:-1]:
        at += x * line / max(sum(free), 1)
        ends.append(at)
    middle = start + width / 2
    on_line = F.lit(0)
    for end in ends:
        on_line = on_line + (middle >= F.lit(end)).cast("int")
    placed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.col("nth")).alias("at"),
        F.coalesce("dealt", on_line).cast("int").alias("shard"),
        *(["row"] if keep_rows else []),
    )
    placed = durable(placed)
    # Rows of a shard are numbered in the order of `at`, in as many blocks of it as there are ranges, so that no task numbers a whole shard.
    block = F.floor(F.col("at") / F.lit(-(-sums["rows"] // ranges) or 1))
    counts = placed.groupBy("shard", block.alias("block")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_slot"))
    nth = F.row_number().over(Window.partitionBy("shard", "block").orderBy("at")) - 1
    return placed.withColumn("block", block).withColumn("nth", nth).join(starts, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("nth")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if keep_rows else []),
    )


def write_shards(docs: DataFrame, n_shards: int, path: str, **options) -> None:
    """Write whole documents, all columns, as one folder per shard below path; the files of a folder, read in order, hold its documents in
    slot order. Takes the options of shard_by_size. The rows are range-partitioned by shard and slot. A column shard is replaced."""
    placed = shard_by_size(docs.drop("shard"), n_shards, keep_rows=True, **options).select("shard", "slot", "row")
    rows = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select("shard", "row.*").write.partitionBy("shard").parquet(path)
