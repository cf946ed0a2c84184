"""Coverage, balance and evidence aggregates; all combine before their shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.functions.text import compact_join, has_text, json_map, parse_formula


def aggregate_evidence(enz: DataFrame, key: str, sets: Sequence[str]) -> DataFrame:
    """key, evidence_rows, and each of sets as its sorted distinct values joined by '|'."""
    return enz.groupBy(key).agg(F.count("*").alias("evidence_rows"), *(F.collect_set(c).alias(c) for c in sets)).withColumns({c: compact_join(c) for c in sets})


def coverage_by_group(df: DataFrame, group: str, cols: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """group, field, filled, total, percent. Text counts as filled when it has content, numbers when above 0."""
    cells = [F.struct(F.lit(c).alias("field"), has_text(F.col(c).cast("string")).alias("ok")) for c in cols]
    cells += [F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c) > 0, F.lit(False)).alias("ok")) for c in numeric]
    counted = df.select(group, F.explode(F.array(*cells)).alias("r")).groupBy(group, F.col("r.field").alias("field"))
    out = counted.agg(F.count_if("r.ok").alias("filled"), F.count("*").alias("total"))
    return out.withColumn("percent", F.col("filled") * 100.0 / F.col("total"))


def all_members_coverage(stoich: DataFrame, members: DataFrame, rxn: str, member: str, group: str, attrs: Sequence[str]) -> DataFrame:
    """group, attribute, complete, total, percent: groups' share of reactions all of whose members have the attribute."""
    joined = stoich.join(members.select(member, *attrs), member, "left")
    full = joined.groupBy(group, rxn).agg(*(F.bool_and(has_text(F.col(a).cast("string"))).alias(a) for a in attrs))
    cells = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("ok")) for a in attrs))
    out = full.select(group, F.explode(cells).alias("r")).groupBy(group, F.col("r.attribute").alias("attribute"))
    out = out.agg(F.count_if("r.ok").alias("complete"), F.count("*").alias("total"))
    return out.withColumn("percent", F.col("complete") * 100.0 / F.col("total"))


def duplicate_report(df: DataFrame, key: str, group: str) -> DataFrame:
    """key, copies and the groups it spans, for keys that occur more than once."""
    out = df.where(has_text(F.col(key).cast("string"))).groupBy(key).agg(F.count("*").alias("copies"), F.collect_set(group).alias("groups"))
    return out.where("copies > 1").withColumn("groups", compact_join(F.col("groups").cast("array<string>")))


def balance_audit(stoich: DataFrame, compounds: DataFrame, tol: float = 1e-6) -> DataFrame:
    """stoich(reaction_id, met_id, coeff), compounds(met_id, formula, charge) -> per reaction formula_balanced,
    charge_balanced, the lists of metabolites without formula, with one that cannot be parsed, without charge, the map
    of unbalanced elements and the charge sum. A reaction with missing or unparsable formulas is not formula-balanced."""
    # Dealt out before the parsing: a small file of many compounds is one task. explode_outer, as the filter that explode implies is pushed
    # below that exchange and parses there once more.
    known = compounds.select("met_id", "formula", "charge").repartition("met_id").select("met_id", "formula", "charge", parse_formula("formula").alias("atoms"))
    rows = stoich.join(known, "met_id", "left")
    flaws = {"missing_formula": ~has_text("formula"), "unparsable_formula": has_text("formula") & F.col("atoms").isNull(), "missing_charge": F.col("charge").isNull()}
    flawed = F.col("met_id").isNotNull() & (F.col("f.missing_formula") | F.col("f.unparsable_formula") | F.col("f.missing_charge"))
    per = rows.withColumn("f", F.struct(*(v.alias(k) for k, v in flaws.items()))).groupBy("reaction_id").agg(
        F.collect_set(F.when(flawed, F.struct("met_id", "f"))).alias("flawed"), F.coalesce(F.sum(F.col("coeff") * F.col("charge")), F.lit(0.0)).alias("charge_imbalance")
    )
    with_flaw = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter("flawed", lambda r: r["f"][c]), lambda r: r["met_id"]))).alias(c)
    per = per.select("reaction_id", *map(with_flaw, flaws), "charge_imbalance")
    atoms = rows.select("reaction_id", "coeff", F.explode_outer("atoms").alias("element", "count")).where("element IS NOT NULL")
    sums = atoms.groupBy("reaction_id", "element").agg(F.sum(F.col("coeff") * F.col("count")).alias("x")).where(F.abs("x") > tol)
    uneven = sums.groupBy("reaction_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element", "x")))).alias("element_imbalance"))
    out = per.join(uneven, "reaction_id", "left")
    complete = (F.size("missing_formula") == 0) & (F.size("unparsable_formula") == 0)
    return out.withColumns(
        {
            "formula_balanced": complete & F.col("element_imbalance").isNull(),
            "charge_balanced": (F.size("missing_charge") == 0) & (F.abs("charge_imbalance") <= tol),
        }
    )


def balance_summary(audit: DataFrame, group: str) -> DataFrame:
    return audit.groupBy(group).agg(
        F.count("*").alias("reactions"),
        F.count_if("formula_balanced").alias("formula_balanced"),
        F.count_if("charge_balanced").alias("charge_balanced"),
        F.count_if(F.col("formula_balanced") & F.col("charge_balanced")).alias("both_balanced"),
    )


def issue_occurrences(audit: DataFrame) -> DataFrame:
    """(met_id, category, occurrences) over the lists of a balance audit."""
    named = lambda c: F.transform(c, lambda m: F.struct(m.alias("met_id"), F.lit(c).alias("category")))
    cells = F.concat(named("missing_formula"), named("unparsable_formula"), named("missing_charge"))
    return audit.select(F.explode(cells).alias("r")).groupBy("r.met_id", "r.category").agg(F.count("*").alias("occurrences"))


def issue_summary(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("category").agg(F.count("*").alias("unique_metabolites"), F.sum("occurrences").alias("occurrences"))


def mapping_coverage(mapping: DataFrame, namespaces: Sequence[str]) -> DataFrame:
    """namespace, mapped, total, fraction: one pass for all namespaces."""
    row = mapping.agg(F.count("*").alias("_n"), *(F.count_if(has_text(F.col(c).cast("string"))).alias(c) for c in namespaces))
    cells = F.array(*(F.struct(F.lit(c).alias("namespace"), F.col(c).alias("mapped"), F.col("_n").alias("total")) for c in namespaces))
    out = row.select(F.explode(cells).alias("r")).select("r.*")
    return out.withColumn("fraction", F.col("mapped") / F.nullif(F.col("total"), F.lit(0)))


def split_summary(df: DataFrame, split: str, key: str, role: str) -> DataFrame:
    """(metric, role, split, value): rows a split, a role and split, distinct keys a split, and keys that cross splits."""
    rows = df.groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))
    cells = F.array(F.struct(F.lit("rows").alias("metric"), F.col("rows").alias("value")), F.struct(F.lit("distinct_keys").alias("metric"), F.col("keys").alias("value")))
    out = rows.select(F.lit("").alias("role"), F.col(split).alias("split"), F.explode(cells).alias("r")).select("r.metric", "role", "split", "r.value")
    by_role = df.groupBy(role, split).agg(F.count("*").alias("value")).select(F.lit("role_rows").alias("metric"), F.col(role).cast("string").alias("role"), F.col(split).alias("split"), "value")
    crossing = df.groupBy(key).agg(F.count_distinct(split).alias("s")).agg(F.count_if(F.col("s") > 1).alias("value"))
    return out.unionByName(by_role).unionByName(crossing.select(F.lit("crossing_keys").alias("metric"), F.lit("").alias("role"), F.lit("").alias("split"), "value"))


def max_over_map(df: DataFrame, key: str, col: str) -> DataFrame:
    """key and the largest value of its JSON map column."""
    return df.groupBy(key).agg(F.max(F.array_max(F.map_values(json_map(col)))).alias("max_value"))


def id_coverage(df: DataFrame, list_col: str, ref: DataFrame, ref_col: str) -> tuple[DataFrame, DataFrame]:
    """(one row: rows_with_ids, unique_ids, matched_ids; the ids that ref lacks). list_col: array of ids."""
    ids = df.select(F.explode(list_col).alias("id")).distinct()
    marked = ids.join(ref.select(F.col(ref_col).alias("id"), F.lit(True).alias("there")).distinct(), "id", "left")
    counts = marked.agg(F.count("*").alias("unique_ids"), F.count_if("there").alias("matched_ids"))
    with_ids = df.agg(F.count_if(F.size(list_col) > 0).alias("rows_with_ids"))
    return with_ids.join(counts, how="cross"), marked.where("there IS NULL").select("id")


ACTIONS = {"A": "promote_after_curation", "B": "prioritise", "C": "prioritise", "D": "class_support", "E": "class_support"}


def best_tier(candidates: DataFrame, records: DataFrame, key: str, tiers: Sequence[str] = "ABCDE") -> DataFrame:
    """candidates with record_count, best_tier (the earliest in `tiers`) and the action it calls for."""
    rank = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    best = records.withColumn("_r", F.when(rank > 0, rank)).groupBy(key).agg(F.count("*").alias("record_count"), F.min("_r").alias("_r"))
    out = candidates.join(best, key, "left")
    tier = F.element_at(F.array(*map(F.lit, tiers)), F.coalesce("_r", F.lit(1)).cast("int"))
    tier = F.when(F.col("_r").isNotNull(), tier)
    action = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    return out.withColumns(
        {"record_count": F.coalesce("record_count", F.lit(0)), "best_tier": tier, "action": F.coalesce(F.try_element_at(action, tier), F.lit("none"))}
    ).drop("_r")


def collapse_probes(values: DataFrame, probe_map: DataFrame, genes: DataFrame) -> DataFrame:
    """values(probe_id, condition, value), probe_map(probe_id, gene_id), genes(gene_id): gene_id, condition, value, the mean over
    probes without missing values; genes without any value go, a missing condition of the others is 0."""
    rows = values.join(probe_map, "probe_id").join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    rows = rows.withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))
    means = rows.groupBy("gene_id", "condition").agg(F.avg("value").alias("value"))
    kept = rows.groupBy("gene_id").agg(F.count("value").alias("c")).where("c > 0").select("gene_id")
    return means.join(kept, "gene_id", "left_semi").withColumn("value", F.coalesce("value", F.lit(0.0)))


def probe_statistics(values: DataFrame, probe_map: DataFrame, genes: DataFrame) -> DataFrame:
    """probes, mapped_probes, and genes they reach, in one row."""
    mapped = values.select("probe_id").distinct().join(probe_map, "probe_id", "left").join(genes.select("gene_id", F.lit(True).alias("known")).distinct(), "gene_id", "left")
    return mapped.agg(
        F.count_distinct("probe_id").alias("probes"),
        F.count_distinct(F.when(F.col("known"), F.col("probe_id"))).alias("mapped_probes"),
        F.count_distinct(F.when(F.col("known"), F.col("gene_id"))).alias("genes"),
    )
