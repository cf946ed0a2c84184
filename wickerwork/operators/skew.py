"""Joins on keys of which a few hold most rows. Heavy keys are found by counting, and their number has a bound whatever the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are heavy: a key is heavy when it holds more than LEAST rows and more than one in so many of all rows.
HEAVY_KEYS = 50_000
LEAST = 10_000


def heavy_keys(rows: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """(key, rows, parts) of the heavy keys of a table that is written or cheap to read: fewer than HEAVY_KEYS, a proven bound for a
    broadcast. parts: how many parts of the limit a key makes."""
    limit = max(least, rows.count() // HEAVY_KEYS)
    heavy = rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    return heavy.withColumn("parts", F.ceil(F.col("rows") / limit).cast("int"))


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", least: int = LEAST, heavy: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has one row a key at most ('inner' or 'left'). What the table has for heavy keys is broadcast, all other
    keys are shuffled: no task gets more than about `least` rows of a key, or one in HEAVY_KEYS of all. heavy(key): those keys, if known."""
    heavy = heavy_keys(rows, key, least).select(key) if heavy is None else heavy
    few = F.broadcast(table.join(F.broadcast(heavy), key, "left_semi"))
    out = rows.join(F.broadcast(heavy), key, "left_anti").join(table, key, how)
    return out.unionByName(rows.join(F.broadcast(heavy), key, "left_semi").join(few, key, how))


def heavy_light_join(left: DataFrame, right: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """left and right joined on key, many to many. A heavy key of l and r rows is dealt over a grid of ceil(l / limit) by ceil(r / limit)
    cells: a left row goes to one line of cells, a right row to one column, each pair of rows meets in one cell, and no cell gets more than
    about `limit` rows of a side. Other keys are one cell. The grid's size comes from both sides' counts."""
    sizes = [heavy_keys(side, key, least).select(key, F.col("parts").alias(name)) for side, name in ((left, "_lines"), (right, "_columns"))]
    grid = F.broadcast(sizes[0].join(sizes[1], key, "full"))
    one = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(n), F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    lines = left.join(grid, key, "left").select(*left.columns, one(left, "_lines").alias("_line"), each("_columns").alias("_column"))
    columns = right.join(grid, key, "left").select(*right.columns, each("_lines").alias("_line"), one(right, "_columns").alias("_column"))
    return lines.join(columns, [key, "_line", "_column"]).drop("_line", "_column")
