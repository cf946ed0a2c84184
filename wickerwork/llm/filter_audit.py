"""Filter interaction audit: what every order of a set of filters removes, and each filter's exact Shapley share."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is counted of every cell: rows, and rows of the two label flags.
COUNTS = ("rows", "good", "toxic")
#: Rows with a null id are spread over so many join keys.
NULL_SALT = 1024


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: A under 100 words, B under 80 % distinct words, C over 10 % capitals A-Z, D any of #$%&*|.
    Words are maximal runs of other than space and \\x09-\\x0D, case-sensitive."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def coalition_cells(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, rows, good, toxic): rows by the exact set of filters that they fail, bit i for the i-th letter; the last filter, E, is a
    text identical to that of any smaller id, whatever its part. Equal texts meet by SHA-256, after equal rows were counted together, so
    that a text with many copies is a few rows by then."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    fails = text_filters(text)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        sum((F.shiftleft(fail.cast("int"), i) for i, fail in enumerate(fails.values())), F.lit(0)).alias("mask"),
        digest.alias("digest"),
        F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text, F.spark_partition_id()), F.lit(NULL_SALT)).cast("int")).otherwise(0).alias("salt"),
    )
    flags = labels.select(F.col(id_col).alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id", F.lit(0).alias("salt"))
    flags = flags.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    labelled = rows.join(flags, ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_good", "is_toxic")})
    alike = ["digest", "part", "mask", "is_good", "is_toxic"]
    per_id = labelled.groupBy("id", "salt", *alike).agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    groups = per_id.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.sum(F.when(known, F.lit(0)).otherwise(F.col("n"))).alias("n_null"), F.min(F.when(known, F.struct("id", "n"))).alias("low")
    )
    first = groups.groupBy("digest").agg(F.min("low.id").alias("first"))
    passing = F.col("n_null") + F.when(F.col("low.id") == F.col("first"), F.col("low.n")).otherwise(0)
    bit = 1 << len(fails)
    split = groups.join(first, "digest").select(
        "part", "is_good", "is_toxic", F.explode(F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - passing).alias("n")))).alias("c")
    )
    return split.groupBy("part", "c.mask").agg(
        F.sum("c.n").alias("rows"), F.sum(F.when(F.col("is_good"), F.col("c.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), F.col("c.n")).otherwise(0)).alias("toxic")
    )


def removals(cells: Mapping[int, int], k: int) -> list[int]:
    """For each coalition of k filters (a bit mask) how many rows it removes: those failing any of its filters."""
    return [sum(n for mask, n in cells.items() if mask & s) for s in range(1 << k)]


def shapley_by_least_squares(v: list[int], k: int) -> list[Fraction]:
    """Exact Shapley values of the game v (by bit mask, v[0] = 0): the weighted least squares fit of an additive game to all coalitions with
    kernel weight (k - 1) / (C(k, s) s (k - s)), the values constrained to sum to v of all. Its normal equations with the multiplier of
    the constraint are solved in rationals by elimination."""
    full = (1 << k) - 1
    if k == 1:
        return [Fraction(v[1])]
    a = [[Fraction(0)] * (k + 2) for _ in range(k + 1)]
    for s in range(1, full):
        size = s.bit_count()
        w = Fraction(k - 1, comb(k, size) * size * (k - size))
        inside = [i for i in range(k) if s >> i & 1]
        for i in inside:
            for j in inside:
                a[i][j] += w
            a[i][k + 1] += w * v[s]
    for i in range(k):
        a[i][k] = a[k][i] = Fraction(1)
    a[k][k + 1] = Fraction(v[full])
    for c in range(k + 1):
        pivot = next(r for r in range(c, k + 1) if a[r][c])
        a[c], a[pivot] = a[pivot], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(k + 1):
            if r != c and a[r][c]:
                factor = a[r][c]
                a[r] = [x - factor * y for x, y in zip(a[r], a[c], strict=True)]
    return [a[i][k + 1] for i in range(k)]


def order_rows(part: str, cells: Mapping[str, Mapping[int, int]], letters: str) -> list[tuple]:
    """All steps of all orders of one part, from its cells by kind of count."""
    k = len(letters)
    full = (1 << k) - 1
    rows, good, toxic = (removals(cells[c], k) for c in COUNTS)
    total = sum(cells["rows"].values())
    shares = [x * factorial(k) for x in shapley_by_least_squares(rows, k)]
    assert all(x.denominator == 1 for x in shares)
    out = []
    for order in permutations(range(k)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            out.append((
                part, name, step, total - rows[after], rows[after] - rows[before], rows[1 << i] + rows[before] - rows[after],
                rows[full] - rows[full ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], int(shares[i]),
            ))
            before = after
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for the filters A to D of
    text_filters and E (text identical to a smaller id's) in all 120 orders; one row per part, order and step.

    The corpus is read once, into at most 32 counts a part: the rows by the exact set of filters they fail. From them come the removals
    of all 32 coalitions; differences of two coalitions are a step's counts, and the Shapley values (removals of the step's filter summed
    over all orders) solve kernel-weighted least squares in rationals. A part's counts are one small row by then, whatever its size.

    Null text counts as empty, a null part is the part ''. labels(id, quality, toxic): a row is good or toxic if any label row of its id
    says so; without label it is neither, and label rows without id label nothing. Rows with the same id and text count each, none of them as a copy of the other. Rows with a null
    id never fail E and make no other fail. Other columns are ignored; an empty table gives an empty result.
    """
    letters = "ABCDE"
    cells = coalition_cells(docs, labels, id_col, text_col, part_col)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[2:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, found in zip(batch["part"], batch["cells"], strict=True):
                own = {c: {x["mask"]: x[c] for x in found} for c in COUNTS}
                yield pd.DataFrame(order_rows(part, own, letters), columns=["part", *names])

    return by_part.mapInPandas(run, schema)


#: The same rows by definition: every order's steps counted over the documents' failures.
AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS low FROM t),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS m FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT l1.l || l2.l || l3.l || l4.l || l5.l AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bs FROM l l1, l l2, l l3, l l4, l l5
  WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31 AND list_unique([l1.b, l2.b, l3.b, l4.b, l5.b]) = 5),
s AS (SELECT filter_order, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN m & (earlier | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN m & own > 0 AND m & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN m & own > 0 AND m & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN m = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN m & own > 0 AND m & earlier = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN m & own > 0 AND m & earlier = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
