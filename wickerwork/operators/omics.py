"""Expression tables: long and wide forms, penalties, classes, correlations and inferred gene rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.operators.graph import written
from wickerwork.operators.ranking import top_k_per_group
from wickerwork.operators.skew import lookup_join

#: Metabolites of more reactions make no pairs of reactions (see metabolite_neighbours).
HUB_DEGREE = 1000


def expression_long(wide: DataFrame, gene: str, conditions: Sequence[str]) -> DataFrame:
    """gene_id, condition, value of a wide table of text; blanks and what is no number become 0."""
    cells = F.array(*(F.struct(F.lit(c).alias("condition"), F.coalesce(F.trim(F.col(c).cast("string")).try_cast("double"), F.lit(0.0)).alias("value")) for c in conditions))
    return wide.select(F.col(gene).alias("gene_id"), F.explode(cells).alias("r")).select("gene_id", "r.condition", "r.value")


def expression_wide(long: DataFrame, conditions: Sequence[str]) -> DataFrame:
    return long.groupBy("gene_id").pivot("condition", list(conditions)).agg(F.first("value")).fillna(0.0)


def condition_percentiles(expr: DataFrame, **points: float) -> DataFrame:
    """condition and the exact, interpolated percentiles (name=share)."""
    return expr.groupBy("condition").agg(*(F.percentile("value", p).alias(n) for n, p in points.items()))


def low_expression_penalty(expr: DataFrame, gpr: DataFrame, share: float = 0.25) -> DataFrame:
    """expr(gene_id, condition, value), gpr(reaction_id, gene_id): condition, reaction_id, penalty for reactions all of whose genes are
    below the condition's percentile; a gene without a value is not low. penalty = (t - max) / max(t, 1e-10)."""
    cut = condition_percentiles(expr, t=share)
    per = gpr.join(expr, "gene_id").join(cut, "condition").groupBy("condition", "reaction_id").agg(
        F.count_distinct("gene_id").alias("seen"), F.max("value").alias("top"), F.first("t").alias("t"), F.bool_and(F.col("value") < F.col("t")).alias("low")
    )
    sizes = gpr.groupBy("reaction_id").agg(F.count_distinct("gene_id").alias("genes"))
    low = per.join(sizes, "reaction_id").where("low AND seen = genes")
    return low.select("condition", "reaction_id", ((F.col("t") - F.col("top")) / F.greatest(F.col("t"), F.lit(1e-10))).alias("penalty"))


def expression_classes(expr: DataFrame, gpr: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """condition, reaction_id, class: high if any gene reaches the upper percentile, low if all are below the lower one."""
    cuts = condition_percentiles(expr, lo=low, hi=high)
    sizes = gpr.groupBy("reaction_id").agg(F.count_distinct("gene_id").alias("genes"))
    per = gpr.join(expr, "gene_id").join(cuts, "condition").groupBy("condition", "reaction_id").agg(
        F.bool_or(F.col("value") >= F.col("hi")).alias("any_high"), F.bool_and(F.col("value") < F.col("lo")).alias("all_low"), F.count_distinct("gene_id").alias("seen")
    )
    label = F.when(F.col("any_high"), "high").when(F.col("all_low") & (F.col("seen") == F.col("genes")), "low")
    return per.join(sizes, "reaction_id").select("condition", "reaction_id", label.alias("class")).where(F.col("class").isNotNull())


def gene_correlation(expr: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """pairs(gene_a, gene_b) with correlation over the conditions both have; 0 without variance, null below `least` conditions. A gene's values
    are packed into one row first, so that a pair is one row with two vectors and not a row for each condition. Of repeated (gene, condition)
    rows the mean counts."""
    values = expr.where("value IS NOT NULL").groupBy("gene_id", "condition").agg(F.avg("value").alias("value"))
    packed = values.groupBy("gene_id").agg(F.map_from_entries(F.collect_list(F.struct("condition", "value"))).alias("v"))
    side = lambda gene, v: packed.select(F.col("gene_id").alias(gene), F.col("v").alias(v))
    both = pairs.select("gene_a", "gene_b").distinct().join(side("gene_a", "va"), "gene_a").join(side("gene_b", "vb"), "gene_b")
    both = both.withColumn("c", F.array_sort(F.array_intersect(F.map_keys("va"), F.map_keys("vb")))).where(F.size("c") > 0)
    of = lambda v: F.transform("c", lambda c: F.try_element_at(v, c))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    both = both.withColumns({"x": of("va"), "y": of("vb")}).withColumns({"tx": total(F.col("x")) / F.size("c"), "ty": total(F.col("y")) / F.size("c")})
    both = both.withColumns({"x": F.transform("x", lambda v: v - F.col("tx")), "y": F.transform("y", lambda v: v - F.col("ty"))})
    sums = both.select("gene_a", "gene_b", F.size("c").alias("n"), product("x", "y").alias("xy"), product("x", "x").alias("xx"), product("y", "y").alias("yy"))
    deviation = lambda s: F.sqrt(F.col(s) / F.col("n"))
    flat = (deviation("xx") < 1e-12) | (deviation("yy") < 1e-12)
    r = F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    return sums.select("gene_a", "gene_b", F.when(F.col("n") >= least, F.when(flat, 0.0).otherwise(r)).alias("correlation"))


def hub_metabolites(stoich: DataFrame, degree: int = HUB_DEGREE) -> DataFrame:
    """met_id, reactions: metabolites of more than `degree` reactions, which metabolite_neighbours counts without making their pairs."""
    return stoich.select("reaction_id", "met_id").distinct().groupBy("met_id").agg(F.count("*").alias("reactions")).where(F.col("reactions") > degree)


def metabolite_neighbours(stoich: DataFrame, cap: int = 20, hub_degree: int | None = None, pairs_up_to: int = HUB_DEGREE) -> DataFrame:
    """reaction_id, neighbour, shared: reactions that share a metabolite, at most `cap` for each (a display limit of the operator),
    by number of shared metabolites, then id. hub_degree leaves out metabolites of more reactions, water and the like.

    Metabolites of at most pairs_up_to reactions are counted by pairs. The others, hubs, make no pairs: a reaction has a signature, the sorted
    list of its hubs, and two signatures share as many hubs as their lists do. What counts for a pair is pairs + shared hubs. A
    neighbour by hubs alone can only be among the first cap + 1 reactions, by shared hubs and id, of all for that signature: every other one
    has at least `cap` before it. So a metabolite of all reactions adds cap + 1 rows a reaction, and the result is exact."""
    rows = stoich.select("reaction_id", "met_id").distinct()
    if hub_degree is not None:
        rows = rows.join(hub_metabolites(rows, hub_degree).select("met_id"), "met_id", "left_anti")
    rows = written(rows)
    hubs = written(hub_metabolites(rows, pairs_up_to).select("met_id", F.lit(True).alias("hub")))
    if hubs.limit(1).count():
        flagged = written(lookup_join(rows, hubs, "met_id", "left"))
        light, heavy = flagged.where("hub IS NULL").drop("hub"), flagged.where("hub").drop("hub")
    else:
        light, heavy = rows, None
    other = light.select(F.col("reaction_id").alias("neighbour"), "met_id")
    pairs = light.join(other, "met_id").where("reaction_id <> neighbour").groupBy("reaction_id", "neighbour").agg(F.count("*").alias("pairs"))
    if heavy is None:
        return top_k_per_group(pairs.withColumnRenamed("pairs", "shared"), "reaction_id", [F.desc("shared"), "neighbour"], cap, "n").drop("n")

    signed = written(heavy.groupBy("reaction_id").agg(F.array_sort(F.collect_set("met_id")).alias("s")))
    kinds = written(top_k_per_group(signed, "s", ["reaction_id"], cap + 1, "nth"))
    lists = kinds.where("nth = 1").select("s", F.explode("s").alias("met_id"))
    common = lists.join(lists.withColumnsRenamed({"s": "s2"}), "met_id").groupBy("s", "s2").agg(F.count("*").alias("hubs"))
    first = common.join(kinds.select(F.col("s").alias("s2"), F.col("reaction_id").alias("neighbour")), "s2")
    first = top_k_per_group(first, "s", [F.desc("hubs"), "neighbour"], cap + 1, "nth").select("s", "neighbour")
    listed = first.groupBy("s").agg(F.collect_list("neighbour").alias("first"))
    by_hubs = lookup_join(signed, listed, "s").select("reaction_id", F.explode("first").alias("neighbour")).where("reaction_id <> neighbour")
    candidates = pairs.unionByName(by_hubs.withColumn("pairs", F.lit(0).cast("long"))).groupBy("reaction_id", "neighbour").agg(F.sum("pairs").alias("pairs"))
    mine, theirs = signed.withColumnRenamed("s", "s1"), signed.select(F.col("reaction_id").alias("neighbour"), F.col("s").alias("s2"))
    both = lookup_join(written(candidates), theirs, "neighbour", "left").join(mine, "reaction_id", "left")
    shared = both.select("reaction_id", "neighbour", (F.col("pairs") + F.coalesce(F.size(F.array_intersect("s1", "s2")), F.lit(0))).alias("shared"))
    return top_k_per_group(shared, "reaction_id", [F.desc("shared"), "neighbour"], cap, "n").drop("n")


def mean_group_correlation(expr: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """group_id, gene_id, mean_correlation: the mean of a gene's gene_correlation with the other genes of its group, over those with `least`
    common conditions; no row without one. members(group_id, gene_id).

    No pairs are made: a correlation is the product of two unit vectors, so a gene's sum over all genes with one set of conditions is its
    product with their sum over the common conditions, less its own. The work is members times the sets of conditions in their group."""
    values = expr.where("value IS NOT NULL").groupBy("gene_id", "condition").agg(F.avg("value").alias("value"))
    packed = values.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("condition", "value"))).alias("v"))
    packed = written(packed.withColumn("mine", F.transform("v", lambda x: x["condition"])))
    rows = written(members.select("group_id", "gene_id").distinct().join(packed.select("gene_id", "mine"), "gene_id"))
    kinds = written(rows.groupBy("group_id", F.col("mine").alias("theirs")).agg(F.count("*").alias("n")))
    meeting = kinds.select("group_id", "theirs").join(kinds.select("group_id", F.col("theirs").alias("mine")), "group_id").select("mine", "theirs").distinct()
    meeting = meeting.where(F.size(F.array_intersect("mine", "theirs")) >= least)

    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  f(x) with x computed once
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    centred = lambda x: once(total(x) / F.size(x), lambda t: F.transform(x, lambda v: v - t))
    unit = lambda x: once(F.sqrt(product(x, x)), lambda d: F.transform(x, lambda v: F.when(d / F.sqrt(F.size(x)) < 1e-12, 0.0).otherwise(v / d)))
    x = F.transform(F.filter("v", lambda x: F.array_contains("theirs", x["condition"])), lambda x: x["value"])
    units = written(packed.join(meeting, "mine").select("gene_id", "mine", "theirs", once(once(x, centred), unit).alias("u")))

    places = rows.join(units.drop("mine"), "gene_id").join(kinds.drop("n"), ["group_id", "theirs"]).select("group_id", "mine", "theirs", F.posexplode("u").alias("at", "u"))
    sums = places.groupBy("group_id", "mine", "theirs", "at").agg(F.sum("u").alias("u")).groupBy("group_id", "mine", "theirs").agg(F.array_sort(F.collect_list(F.struct("at", "u"))).alias("s"))
    sums = sums.select("group_id", F.col("mine").alias("theirs"), F.col("theirs").alias("mine"), F.transform("s", lambda x: x["u"]).alias("s"))
    own = F.col("mine") == F.col("theirs")
    met = rows.join(units.drop("mine"), "gene_id").join(written(sums.join(kinds, ["group_id", "theirs"])), ["group_id", "mine", "theirs"])
    part = product("u", "s") - F.when(own, product("u", "u")).otherwise(0.0)
    per = met.groupBy("group_id", "gene_id").agg(F.sum(part).alias("r"), F.sum(F.col("n") - own.cast("int")).alias("n"))
    return per.where("n > 0").select("group_id", "gene_id", (F.col("r") / F.col("n")).alias("mean_correlation"))


def infer_pseudo_gpr(expr: DataFrame, stoich: DataFrame, gpr: DataFrame, least: float = 0.5, cap: int = 20, genes: int = 5, hub_degree: int | None = None) -> DataFrame:
    """reaction_id, gene_id, mean_correlation, rank for reactions without rule: neighbours' genes whose mean correlation with the other
    candidates is at least `least`; the best `genes`. Means are rounded to nine places, so that the order of their sums decides no tie."""
    bare = stoich.select("reaction_id").distinct().join(gpr.select("reaction_id"), "reaction_id", "left_anti")
    near = metabolite_neighbours(stoich, cap, hub_degree).join(bare, "reaction_id", "left_semi")
    cand = near.join(gpr.select(F.col("reaction_id").alias("neighbour"), "gene_id"), "neighbour").select(F.col("reaction_id").alias("group_id"), "gene_id")
    # The candidates are read three times.
    mean = mean_group_correlation(expr, written(cand.distinct())).select(F.col("group_id").alias("reaction_id"), "gene_id", F.round("mean_correlation", 9).alias("mean_correlation"))
    return top_k_per_group(mean.where(F.col("mean_correlation") >= least), "reaction_id", [F.desc("mean_correlation"), "gene_id"], genes)


def apply_pseudo_gpr(reactions: DataFrame, inferred: DataFrame) -> DataFrame:
    """reactions(reaction_id, rule) with the inferred rule 'a or b' where there is none, and rule_inferred."""
    rules = inferred.groupBy("reaction_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene_id"))), lambda x: x["gene_id"].cast("string")), " or ").alias("_r"))
    out = reactions.join(rules, "reaction_id", "left")
    bare = F.col("rule").isNull() | (F.trim("rule") == "")
    return out.withColumns({"rule_inferred": bare & F.col("_r").isNotNull(), "rule": F.when(bare, F.col("_r")).otherwise(F.col("rule"))}).drop("_r")


def gene_coverage(mapped: DataFrame, genes: DataFrame) -> DataFrame:
    """genes, covered, percent of the model's genes that a platform measures."""
    joined = genes.select("gene_id").distinct().join(mapped.select("gene_id", F.lit(True).alias("m")).distinct(), "gene_id", "left")
    out = joined.agg(F.count("*").alias("genes"), F.count_if("m").alias("covered"))
    return out.withColumn("percent", F.col("covered") * 100.0 / F.nullif(F.col("genes"), F.lit(0)))
