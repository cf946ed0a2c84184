"""Surrogate ids, top-k, curves and first-of-key rules without windows over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.operators.graph import written


def _numbered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df as a table of range-partitioned rows with _part and _nth (from 1), their place in the partition. It is written once: bounds
    are sampled and partitions merged at run time, so two readings of the plan could place a row differently."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    place = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    return written(placed).withColumns({"_part": F.shiftright("_place", 33), "_nth": F.col("_place").bitwiseAND((1 << 33) - 1) + 1}).drop("_place")


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """1, 2, 3, ... in the given order. Rows are range-partitioned and numbered inside the partitions; the partitions' offsets
    come from their counts, so no task holds the table. The order should be total."""
    numbered = _numbered(df, order)
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with sums (name -> column) over the rows of the same `by` up to and with each row in a total order. Sums run inside range
    partitions; what a `by` has in earlier partitions is added from a table of one row a partition and `by`."""
    by = list(by)
    numbered = _numbered(df, [*by, *order])
    upto = Window.partitionBy("_part", *by).orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = numbered.withColumns({name: F.sum(c).over(upto) for name, c in sums.items()})
    per = numbered.groupBy("_part", *by).agg(*(F.sum(c).alias(f"_t_{name}") for name, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_part", *(F.col(b).alias(f"_by_{b}") for b in by), *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums)).withColumnRenamed("_part", "_p")
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return here.join(before, same).withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).select(*df.columns, *sums)


def assign_uids(df: DataFrame, order: Sequence[Column | str], prefix: str, out: str = "uid") -> DataFrame:
    """PREFIX:0000001 and so on in the given order."""
    return global_rank(df, order, "_r").withColumn(out, F.concat(F.lit(prefix + ":"), F.lpad(F.col("_r").cast("string"), 7, "0"))).drop("_r")


def top_k_per_group(df: DataFrame, group: Sequence[str] | str, order: Sequence[Column | str], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group. The limit runs before and after the shuffle."""
    group = [group] if isinstance(group, str) else list(group)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def design_pairs(matrix: DataFrame, routes: DataFrame, score: str, entry: str, a: int = 3, b: int = 3) -> DataFrame:
    """matrix(reaction_id, entry, score, ...), routes(route, step1_reaction, step2_reaction): for each route the a best entries of
    step 1 with the b best of step 2, their mean score and a risk note; at most a * b rows a route."""
    best = top_k_per_group(matrix, "reaction_id", [F.desc(score), entry], max(a, b))
    one = best.where(F.col("rank") <= a).select(F.col("reaction_id").alias("step1_reaction"), F.col(entry).alias("step1_entry"), F.col(score).alias("_s1"))
    two = best.where(F.col("rank") <= b).select(F.col("reaction_id").alias("step2_reaction"), F.col(entry).alias("step2_entry"), F.col(score).alias("_s2"))
    pairs = routes.join(one, "step1_reaction").join(two, "step2_reaction")
    return pairs.withColumns(
        {
            "mean_score": (F.col("_s1") + F.col("_s2")) / 2,
            "risk_note": F.when(F.least("_s1", "_s2") < 0, "weak_step").when(F.col("step1_entry") == F.col("step2_entry"), "same_entry").otherwise("none"),
        }
    ).drop("_s1", "_s2")


def cap_per_source(df: DataFrame, source: str, order: Sequence[Column | str], n: int = 500, text: str | None = None, chars: int = 2000) -> DataFrame:
    """A report's first n rows of each source, with the text shortened to be shown."""
    out = top_k_per_group(df, source, order, n, "_n").drop("_n")
    return out.withColumn(text, F.substring(text, 1, chars)) if text else out


def selection_curve(ranked: DataFrame, label: str, rank: str, k: int, rounds: int) -> DataFrame:
    """round, selected, hits, precision, recall when k rows are taken a round in the order of rank (1, 2, ...). Only round sums
    are accumulated, so the window sees `rounds` rows."""
    totals = ranked.agg(F.sum(label).alias("_all"))
    per = ranked.withColumn("round", F.ceil(F.col(rank) / k).cast("int")).where(F.col("round") <= rounds)
    per = per.groupBy("round").agg(F.count("*").alias("n"), F.sum(label).alias("h"))
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = per.select("round", F.sum("n").over(w).alias("selected"), F.sum("h").over(w).alias("hits")).join(F.broadcast(totals))
    return cum.select("round", "selected", "hits", (F.col("hits") / F.col("selected")).alias("precision"), (F.col("hits") / F.nullif(F.col("_all"), F.lit(0))).alias("recall"))


def random_order(df: DataFrame, id_col: str, seed: int = 0, out: str = "random_rank") -> DataFrame:
    """A reproducible random order: by the SHA-256 of seed and id."""
    return global_rank(df.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)), ["_h", id_col], out).drop("_h")


def unique_labels(df: DataFrame, col: str, order: Sequence[Column | str], out: str = "label") -> DataFrame:
    """Labels of [A-Za-z0-9_], with _2, _3, ... from the second of a name on."""
    clean = df.withColumn(out, F.regexp_replace(col, r"[^A-Za-z0-9_]+", "_"))
    n = F.row_number().over(Window.partitionBy(out).orderBy(*order))
    return clean.withColumn("_n", n).withColumn(out, F.when(F.col("_n") > 1, F.concat_ws("_", out, F.col("_n").cast("string"))).otherwise(F.col(out))).drop("_n")


def pick_column(df: DataFrame, cols: Sequence[str], pattern: str | None = None) -> DataFrame:
    """(column, score) of the column with most distinct values, or most values that fit pattern; ties to the earlier one."""
    score = lambda c: F.count_if(F.col(c).cast("string").rlike(pattern)) if pattern else F.count_distinct(c)
    row = df.agg(*(score(c).alias(c) for c in cols))
    cells = F.array(*(F.struct(F.col(c).alias("score"), F.lit(-i).alias("i"), F.lit(c).alias("column")) for i, c in enumerate(cols)))
    return row.select(F.array_max(cells).alias("b")).select("b.column", "b.score")


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """The first row of each key; `out` is its place in the whole order, so numbers of dropped rows are gaps."""
    ranked = global_rank(df, order, out)
    return top_k_per_group(ranked, list(key), [out], 1, "_n").drop("_n")
