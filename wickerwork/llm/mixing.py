"""Mixing sources to target weights by Pfair scheduling: by exact weights, or by shares of a period in SQL functions only."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.llm.shared import durable

# Slot by slot: of the blocks released by now, that with the earliest deadline runs. Block j (from 0) of a source with e of
# `period` slots is released at floor(j * period / e) and due by ceil((j + 1) * period / e).
_EARLIEST_DEADLINE_FIRST = """
aggregate(
  sequence(0, {period} - 1),
  named_struct('done', array_repeat(0, size(shares)), 'picks', cast(array() as array<int>)),
  (state, slot) -> transform(
    array(array_min(filter(
      transform(shares, (e, i) -> named_struct(
        'due', (state.done[i] + 1) * {period} div e + if((state.done[i] + 1) * {period} % e > 0, 1, 0),
        'i', i,
        'ready', state.done[i] < e and state.done[i] * {period} div e <= slot)),
      x -> x.ready)).i),
    pick -> named_struct(
      'done', transform(state.done, (d, i) -> if(i = pick, d + 1, d)),
      'picks', concat(state.picks, array(pick))))[0],
  state -> state.picks)
"""


def _weighted(docs: DataFrame, weights: dict[str, float] | None, source_col: str, alpha: float) -> DataFrame:
    """mix_source, rows and target weight of every source."""
    sources = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source")).agg(F.count("*").alias("rows"))
    if not weights:
        return sources.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(alpha)) if weights is None else F.lit(0.0))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (str(kv[0]), float(kv[1]))])
    return sources.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("mix_source")), F.lit(0.0)))


def schedule(sources: list[tuple[str, int, float]], block_rows: int) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, slot, release, deadline, position of its first row) of all blocks in the order of the mixture, for sources
    (name, rows, weight). Earliest deadline first in exact integers: block j of a source of weight w of all is released at floor(j / w) and
    due by ceil((j + 1) / w). Sources of weight 0, or with a deadline beyond 2**62, follow at the end and take turns."""
    sources = sorted(sources)
    exact = [max(Fraction(repr(float(w))), Fraction(0)) for _, _, w in sources]
    total = sum(exact)
    blocks = [-(-n // block_rows) for _, n, _ in sources]
    some = {i for i, w in enumerate(exact) if w and blocks[i] * total / w <= 1 << 62}
    slot, position = 0, 0
    for part in (sorted(some), [i for i in range(len(sources)) if i not in some]):
        base = slot
        # Slots from one block to the next, as numerator and denominator.
        step = {i: (total / exact[i]).as_integer_ratio() if i in some else (len(part), 1) for i in part}
        waiting, ready = [(0, i, 0) for i in part], []
        while waiting or ready:
            if not ready:
                slot = max(slot, base + waiting[0][0])
            while waiting and base + waiting[0][0] <= slot:
                release, i, j = heapq.heappop(waiting)
                a, b = step[i]
                heapq.heappush(ready, (-(-(j + 1) * a // b), i, j, release))
            deadline, i, j, release = heapq.heappop(ready)
            yield sources[i][0], j, slot, base + release, base + deadline, position
            slot += 1
            position += min(block_rows, sources[i][1] - j * block_rows)
            if j + 1 < blocks[i]:
                a, b = step[i]
                heapq.heappush(waiting, ((j + 1) * a // b, i, j + 1))


def exact_plan(sources: DataFrame, block_rows: int) -> DataFrame:
    """The schedule as a table, one row per block: one task with the sources and a heap in memory, which streams the rows."""
    names = ["mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "_mix_first"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for row in schedule([x for b in batches for x in zip(b["mix_source"], b["rows"].tolist(), b["weight"].tolist(), strict=True)], block_rows):
            found.append(row)
            if len(found) == 50_000:
                yield pd.DataFrame(found, columns=names)
                found = []
        if found:
            yield pd.DataFrame(found, columns=names)

    return sources.repartition(1).mapInPandas(run, "mix_source string, " + ", ".join(f"{c} long" for c in names[1:]))


def _shares(sources: DataFrame, period: int) -> DataFrame:
    """mix_source, rows and share: each source's whole slots of a period, by largest remainders, at least one; an error where there are more
    sources than slots."""
    everything = Window.partitionBy()
    free = F.lit(period) - F.count("*").over(everything)
    exact = free * F.coalesce(F.col("weight") / F.nullif(F.sum("weight").over(everything), F.lit(0.0)), 1 / F.count("*").over(everything))
    dealt = sources.withColumn("k", F.count("*").over(everything)).withColumn("exact", F.round(exact, 9))
    dealt = dealt.withColumn("whole", F.floor("exact"))
    left = F.lit(period) - F.col("k") - F.sum("whole").over(everything)
    by_remainder = F.row_number().over(Window.orderBy((F.col("exact") - F.col("whole")).desc(), "mix_source"))
    dealt = dealt.withColumn("share", (1 + F.col("whole") + F.when(by_remainder <= left, 1).otherwise(0)).cast("int"))
    checked = F.when(F.col("k") > period, F.raise_error(F.lit(f"more sources than the {period} slots of a period"))).otherwise(F.col("share"))
    return dealt.select("mix_source", "rows", checked.cast("int").alias("share"))


def period_plan(sources: DataFrame, block_rows: int, period: int) -> DataFrame:
    """The schedule by shares of a period as a table, one row per block (see exact_plan), in SQL functions only. The slots of one period, `period`
    rows at most, are dealt once; a period's blocks take their places from it, and their first positions from a sum over the blocks of the
    period and a closed sum over the sources for the periods before. Work grows with the blocks and with period x sources."""
    listed = _shares(sources, period).agg(F.array_sort(F.collect_list(F.struct("mix_source", "rows", "share"))).alias("s"))
    whole = durable(listed.where(F.size("s") > 0).selectExpr("s.mix_source as names", "s.rows as sizes", "s.share as shares").withColumn("picks", F.expr(_EARLIEST_DEADLINE_FIRST.format(period=period))))
    slots = whole.select("names", "shares", "sizes", F.posexplode("picks").alias("slot", "i"))
    nth = F.row_number().over(Window.partitionBy("mix_source").orderBy("slot")) - 1
    slots = slots.selectExpr("names[i] as mix_source", "shares[i] as share", "sizes[i] as rows", "slot").withColumn("nth", nth)
    # A slot of the period serves block nth of each of the source's turns, as far as the source has blocks.
    last = F.expr(f"(rows + {block_rows - 1}) div {block_rows} - 1")
    turns = slots.where(F.col("nth") <= last).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(((rows + {block_rows - 1}) div {block_rows}) - 1 - nth) div share"))))
    blocks = turns.withColumn("mix_block", F.expr("turn * share + nth")).withColumn("n", F.expr(f"least({block_rows}, rows - mix_block * {block_rows})"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("turn").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = f"aggregate(zip_with(sizes, shares, (n, e) -> least(n, {block_rows}L * turn * e)), 0L, (a, b) -> a + b)"
    starts = blocks.select("turn").distinct().join(F.broadcast(whole.select("sizes", "shares"))).select("turn", F.expr(earlier).alias("start"))
    return blocks.withColumn("before", before).join(starts, "turn").selectExpr(
        "mix_source", "mix_block", f"turn * {period} + slot as mix_slot", f"mix_block * {period} div share as mix_release",
        f"((mix_block + 1) * {period} + share - 1) div share as mix_deadline", "start + before as _mix_first",
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_rows: int = 16,
    period: int | None = None,
    alpha: float = 0.5,
    buckets: int = 1024,
) -> DataFrame:
    """All rows of docs with the columns mix_block, mix_slot, mix_release, mix_deadline and mix_position (0, 1, 2, ... in
    the order of the mixture). Ordering by mix_position interleaves the sources by their weights.

    weights gives target weights by source; None means rows ** alpha. At any slot a source that still has blocks has had less than
    one block more or less than its weight's part of the slots, however long the mixture and however many the sources. Sources
    with weight 0 or none come after all others. A source that runs out leaves its slots empty; the others keep their proportions.

    With a period, weights become whole slots of it by largest remainders, at least one a source, so that the schedule of one period
    (`period` rows at most, a proven bound for the broadcast) repeats for ever and block j of a source is placed by arithmetic, in
    SQL functions only. The bound then holds for these shares and not for the weights, and there may be no more sources than slots.

    Inside a source the rows are put in the order of md5(id), then id. The rank in a source is the row's rank in its
    bucket of that hash plus the earlier buckets' counts, so no task holds a source. The position needs no sort: it
    is the number of rows of all blocks before the row's slot, plus its place in the block.

    A null source is one source of its own, named ''. Null ids hash like ''. Repeated rows get neighbouring places.
    Columns of docs named like the results are replaced; none may start with _mix. An empty table gives an empty result.
    """
    mine = ["mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"]
    payload = [c for c in docs.columns if c not in mine]
    rows = docs.select(
        *payload,
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_mix_hash"),
    ).withColumn("_mix_bucket", F.pmod(F.conv(F.substring("_mix_hash", 1, 6), 16, 10).cast("int"), F.lit(buckets)))
    counted = rows.groupBy("mix_source", "_mix_bucket").agg(F.count("*").alias("_mix_rows"))
    earlier = Window.partitionBy("mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("_mix_start", F.coalesce(F.sum("_mix_rows").over(earlier), F.lit(0))).drop("_mix_rows")
    in_bucket = Window.partitionBy("mix_source", "_mix_bucket").orderBy("_mix_hash", F.col(id_col))
    numbered = rows.withColumn("_mix_nth", F.row_number().over(in_bucket) - 1)
    sources = _weighted(docs, weights, source_col, alpha)
    # Every bucket gets the list of its blocks' places, so the rows are not dealt a second time.
    plan = exact_plan(sources, block_rows) if period is None else period_plan(sources, block_rows, period)
    bounds = counted.join(starts, ["mix_source", "_mix_bucket"])
    held = bounds.select("*", F.explode(F.expr(f"sequence(_mix_start div {block_rows}, (_mix_start + _mix_rows - 1) div {block_rows})")).alias("mix_block"))
    placed = held.join(plan, ["mix_source", "mix_block"]).groupBy("mix_source", "_mix_bucket", "_mix_start")
    placed = placed.agg(F.array_sort(F.collect_list(F.struct("mix_block", "mix_slot", "mix_release", "mix_deadline", "_mix_first"))).alias("_mix_places"))
    ranked = numbered.join(placed, ["mix_source", "_mix_bucket"]).withColumn("_mix_rank", F.col("_mix_start") + F.col("_mix_nth"))
    ranked = ranked.withColumn("_mix_place", F.expr(f"_mix_places[cast(_mix_rank div {block_rows} - _mix_start div {block_rows} as int)]"))
    return ranked.select(
        *payload,
        "mix_source",
        *(F.col(f"_mix_place.{c}").alias(c) for c in mine[1:5]),
        F.expr(f"_mix_place._mix_first + _mix_rank % {block_rows}").alias("mix_position"),
    )


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, all rows and columns, range-partitioned and sorted by mix_position: files written from it are the mixture."""
    mixed = mix_sources(docs, **options)
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)
