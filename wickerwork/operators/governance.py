"""Identity resolution, confidence and quality gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.functions.text import classify_first_match, has_text, parse_formula, structure_status
from wickerwork.operators.graph import written


def waterfall_resolve(rows: DataFrame, candidates: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """rows(row_id, formula, structure), candidates(row_id, tier, structure, formula, parseable, source): one row for each row_id
    without a structure: decision (mapped, manual_review, unresolved), reason, tier, structure, source, candidate_count.

    Tiers are tried in the given order. A tier with parseable candidates is decisive: no compatible formula ->
    formula_conflict, several structures -> multiple_structures_for_key, one -> mapped. All tiers are evaluated at once
    and the first decisive one is taken, so the walk is one aggregate and not a loop.
    """
    todo = rows.where(~has_text("structure")).select("row_id", F.col("formula").alias("target"))
    number = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    long = todo.join(candidates, "row_id").withColumn("no", number).where("no > 0")
    fits = ~has_text("target") | ~has_text("formula") | (F.col("target") == F.col("formula"))
    ok = F.coalesce(F.col("parseable"), F.lit(False)) & has_text("structure")
    per = long.groupBy("row_id", "no").agg(
        F.first("tier").alias("tier"),
        F.count_if(ok).alias("readable"),
        F.count_distinct(F.when(ok & fits, F.col("structure"))).alias("structures"),
        F.min(F.when(ok & fits, F.struct("structure", "source"))).alias("best"),
    )
    reason = (
        F.when(F.col("readable") == 0, "no_parseable_local_structure")
        .when(F.col("structures") == 0, "formula_conflict")
        .when(F.col("structures") > 1, "multiple_structures_for_key")
        .otherwise("mapped")
    )
    per = per.withColumn("reason", reason).withColumn("r", F.struct("no", "tier", "reason", "structures", "best"))
    picked = per.groupBy("row_id").agg(F.min(F.when(F.col("readable") > 0, F.col("r"))).alias("d"), F.max("r").alias("l"))
    out = todo.select("row_id").join(picked, "row_id", "left")
    decided = F.col("d").isNotNull()
    mapped = decided & (F.col("d.reason") == "mapped")
    return out.select(
        "row_id",
        F.when(mapped, "mapped").when(decided, "manual_review").otherwise("unresolved").alias("decision"),
        F.coalesce("d.reason", "l.reason", F.lit("local_key_space_exhausted")).alias("reason"),
        F.coalesce("d.tier", "l.tier").alias("tier"),
        F.when(mapped, F.col("d.best.structure")).alias("structure"),
        F.when(mapped, F.col("d.best.source")).alias("source"),
        F.coalesce("d.structures", F.lit(0)).alias("candidate_count"),
    )


def key_space_audit(keys: DataFrame, candidates: DataFrame) -> DataFrame:
    """keys(row_id, tier), candidates as above: per tier rows with the key, with a candidate, with a parseable one."""
    have = candidates.groupBy("row_id", "tier").agg(F.bool_or(F.coalesce(F.col("parseable"), F.lit(False))).alias("ok"))
    joined = keys.select("row_id", "tier").distinct().join(have, ["row_id", "tier"], "left")
    return joined.groupBy("tier").agg(
        F.count("*").alias("rows_with_key"), F.count("ok").alias("rows_with_candidate"), F.count_if("ok").alias("rows_with_parseable")
    )


def canonical_id(spaces: Sequence[tuple[str, str, bool]]) -> Column:
    """Struct(id, is_structure): the first filled column of (column, prefix, is_structure), prefixed."""
    out = None
    for column, prefix, structure in spaces:
        value = F.struct(F.concat(F.lit(prefix + ":"), F.trim(column)).alias("id"), F.lit(structure).alias("is_structure"))
        out = (F if out is None else out).when(has_text(column), value)
    return out


def reaction_signature(stoich: DataFrame, ids: DataFrame, equations: DataFrame | None = None) -> DataFrame:
    """stoich(reaction_id, met_id, coeff), ids(met_id, id, is_structure): reaction_id, signature, substrates.

    Coefficients are summed over canonical ids, so compartments do not count; zero sums go; the smaller of the two
    directions is hashed, so direction does not count. substrates hashes the consumed side, if a structure is among it.
    equations(reaction_id, equation) serves reactions of which nothing is left."""
    named = stoich.join(ids, "met_id", "left").select(
        "reaction_id", F.coalesce("id", F.concat(F.lit("met:"), F.col("met_id").cast("string"))).alias("id"), F.coalesce("is_structure", F.lit(False)).alias("s"), "coeff"
    )
    net = named.groupBy("reaction_id", "id").agg(F.sum("coeff").alias("x"), F.bool_or("s").alias("s")).withColumn("x", F.round("x", 6)).where("x <> 0")
    text = lambda sign: F.concat_ws(":", "id", F.format_number(F.col("x") * sign, 6))
    per = net.groupBy("reaction_id").agg(
        F.array_join(F.array_sort(F.collect_list(text(1))), "|").alias("f"),
        F.array_join(F.array_sort(F.collect_list(text(-1))), "|").alias("r"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("x") < 0, F.col("id")))), "|").alias("sub"),
        F.bool_or((F.col("x") < 0) & F.col("s")).alias("sub_ok"),
    )
    out = per.select("reaction_id", F.sha2(F.least("f", "r"), 256).alias("signature"), F.when(F.col("sub_ok"), F.sha2("sub", 256)).alias("substrates"))
    if equations is None:
        return out
    fallback = F.concat(F.lit("equation:"), F.sha2(F.trim("equation"), 256))
    return equations.join(out, "reaction_id", "left").select("reaction_id", F.coalesce("signature", F.when(has_text("equation"), fallback)).alias("signature"), "substrates")


def confidence_flags(rows: DataFrame, prefixed: Column, matched: Column, has_ec: Column, has_xref: Column) -> DataFrame:
    """rows with status, tier, role, usable, by four conditions."""
    case = lambda a, b, c, d, e: F.when(prefixed & matched & has_ec, a).when(prefixed & matched, b).when(prefixed, c).when(has_xref, d).otherwise(e)
    return rows.withColumns(
        {
            "status": case("underground_rxndb_provenance", "underground_rxndb_provenance", "underground_no_selected_rxndb_match", "curated_or_database_crossreferenced", "model_reaction_without_external_crossref"),
            "tier": case("prediction_provenance", "prediction_provenance", "review_required", "external_crossref", "model_only"),
            "role": case("candidate_label_with_ec_and_review", "candidate_label_with_review", "exclude_until_provenance_resolved", "preferred_reference_label", "supporting_model_context"),
            "usable": ~prefixed & has_xref,
        }
    )


def metabolite_quality(compounds: DataFrame, validator=None, parser_available: bool = True) -> DataFrame:
    """compounds(smiles, formula, mapping_source, source_database, source_record_id, ...) with structure_status, reason_code,
    availability, review and source."""
    rows = structure_status(compounds, "smiles", validator)
    missing = F.col("structure_status") == "missing"
    parsed = F.col("structure_status") == "parseable"
    reason = F.when(
        missing,
        F.when(~has_text("formula"), "missing_formula_and_structure")
        .when(parse_formula("formula").isNull(), "generic_or_unparsable_formula_no_structure")
        .when(~has_text("mapping_source"), "external_mapping_not_found")
        .otherwise("mapped_source_has_no_structure"),
    )
    pair = F.when(has_text("source_database") & has_text("source_record_id"), F.concat_ws(":", "source_database", "source_record_id"))
    source = F.when(has_text("mapping_source"), F.col("mapping_source")).otherwise(F.coalesce(pair, F.lit("unrecorded")))
    if parser_available:
        status, availability = F.col("structure_status"), F.when(parsed, "available").otherwise("unresolved")
        review = F.when(missing, "not_reviewed").when(parsed, "not_required").otherwise("review_required")
    else:
        status = F.when(missing, "missing").otherwise("parser_unavailable")
        availability = F.when(missing, "unresolved").otherwise("blocked")
        review = F.when(missing, "not_reviewed").otherwise("review_required")
    return rows.withColumns({"structure_status": status, "reason_code": reason, "availability": availability, "review": review, "source": source})


def reaction_quality(audit: DataFrame) -> DataFrame:
    """audit(formula_balanced, charge_balanced booleans; missing_formula, unparsable_formula arrays) with mass_status,
    charge_status, formula_status, parse_status, mapping_status, review."""
    status = lambda c: F.when(F.col(c), "balanced").when(~F.col(c), "unbalanced").otherwise("unknown")
    gaps, unread = F.size("missing_formula") > 0, F.size("unparsable_formula") > 0
    bad = unread | (status("formula_balanced") != "balanced") | (status("charge_balanced") != "balanced")
    return audit.withColumns(
        {
            "mass_status": status("formula_balanced"),
            "charge_status": status("charge_balanced"),
            "formula_status": F.when(gaps, "present").otherwise("none"),
            "parse_status": F.when(unread, "failed").otherwise("parsed"),
            "mapping_status": F.when(gaps, "pending").otherwise("complete"),
            "review": F.when(bad, "required").otherwise("not_required"),
        }
    )


def require_fields(df: DataFrame, key: str, fields: Sequence[str], label: str) -> DataFrame:
    """(key, message) of rows that miss some of the fields."""
    gaps = F.array_compact(F.array(*(F.when(~has_text(F.col(f).cast("string")), f) for f in fields)))
    rows = df.select(key, gaps.alias("g")).where(F.size("g") > 0)
    return rows.select(key, F.concat(F.lit(f"{label} "), F.coalesce(F.col(key).cast("string"), F.lit("?")), F.lit(" missing: "), F.array_join("g", ", ")).alias("message"))


def strict_subset_gate(subsets: DataFrame, metabolites: DataFrame, reactions: DataFrame) -> DataFrame:
    """subsets(subset, metabolite_ids, reaction_ids arrays, min_parse_fraction, require_balance); metabolites(met_id, formula, charge,
    source, parseable, consistent); reactions(reaction_id, evidence_scope, has_balance, formula_balanced,
    charge_balanced): rows (subset, item, check, passed). subset_status gives the verdicts."""
    # A formula is parsed once for its metabolite and not for every subset that names it.
    known = metabolites.withColumns({"_in": F.lit(True), "_parses": parse_formula("formula").isNotNull()}).drop("formula")
    mets = subsets.select("subset", "min_parse_fraction", F.explode("metabolite_ids").alias("met_id")).join(known, "met_id", "left")
    flags = {
        "id_known": F.col("_in").isNotNull(),
        "formula_parses": F.col("_parses"),
        "charge_numeric": F.col("charge").isNotNull(),
        "source_recorded": has_text("source") & (F.col("source") != "unrecorded"),
        "tables_agree": F.coalesce("consistent", F.lit(True)),
    }
    out = mets.select("subset", F.col("met_id").cast("string").alias("item"), _stack(flags)).select("subset", "item", "r.*")
    share = mets.groupBy("subset").agg(F.avg(F.coalesce(F.col("parseable"), F.lit(False)).cast("double")).alias("x"), F.max("min_parse_fraction").alias("m"))
    out = out.unionByName(share.select("subset", F.lit("").alias("item"), F.lit("parse_fraction").alias("check"), (F.col("x") >= F.col("m")).alias("passed")))
    rx = subsets.select("subset", "require_balance", F.explode("reaction_ids").alias("reaction_id")).join(reactions.withColumn("_in", F.lit(True)), "reaction_id", "left")
    free = ~F.col("require_balance")
    flags = {
        "reaction_defined": F.col("_in").isNotNull(),
        "evidence_scope": has_text("evidence_scope"),
        "balance_row": F.coalesce("has_balance", F.lit(False)),
        "mass_balanced": free | F.coalesce("formula_balanced", F.lit(False)),
        "charge_balanced": free | F.coalesce("charge_balanced", F.lit(False)),
    }
    return out.unionByName(rx.select("subset", F.col("reaction_id").cast("string").alias("item"), _stack(flags)).select("subset", "item", "r.*"))


def _stack(flags: Mapping[str, Column]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in flags.items()))).alias("r")


def subset_status(checks: DataFrame) -> DataFrame:
    out = checks.groupBy("subset").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "passed").otherwise("failed"))


def gate_summary(metabolites: DataFrame, reactions: DataFrame, failures: DataFrame) -> DataFrame:
    """(section, key, value): counts by status and reason, number of failures, overall status."""

    def counts(df: DataFrame, section: str, col: str) -> DataFrame:
        return df.groupBy(F.coalesce(F.col(col), F.lit("none")).alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit(section).alias("section"), "key", "value")

    out = counts(metabolites, "structure_status", "structure_status").union(counts(metabolites, "reason_code", "reason_code"))
    out = out.union(counts(reactions, "mass_status", "mass_status")).union(counts(reactions, "charge_status", "charge_status"))
    n = failures.agg(F.count("*").alias("n"))
    out = out.union(n.select(F.lit("gate"), F.lit("failures"), F.col("n").cast("string")))
    return out.union(n.select(F.lit("gate"), F.lit("status"), F.when(F.col("n") == 0, "passed").otherwise("failed")))


# Classes of a metabolite's issue in order of precedence, with their terms, and the actions that follow.
ISSUE_RULES = [
    {"when": "startswith(met_id, 'sn_')", "out": {"class": "underground_template_metabolite_missing_formula"}},
    {"when": "formula RLIKE '[RX]'", "out": {"class": "generic_r_group_or_polymer_formula"}},
    {"any_of": ["cytochrome", "thioredoxin", "ferredoxin", "protein", "trna", "enzyme"], "out": {"class": "macromolecule_or_redox_carrier_formula"}},
    {"when": "coalesce(lower(trim(formula)), '') IN ('', 'nan', 'none', 'null')", "out": {"class": "missing_formula_no_local_mapping"}},
]
OTHER_ISSUE = "other_formula_issue"
EXCLUDED_ISSUES = ("underground_template_metabolite_missing_formula", "generic_r_group_or_polymer_formula", "macromolecule_or_redox_carrier_formula")
ACTIONS = {
    "balanced": "training_ready_mass_charge_balanced",
    "excluded": "exclude_from_structure_sensitive_training_or_apply_curated_carrier_rules",
    "mapping": "requires_external_structure_mapping",
    "review": "requires_manual_balance_review",
}


def remediation_action(
    audit: DataFrame,
    compounds: DataFrame,
    rules: Sequence[dict] = ISSUE_RULES,
    other: str = OTHER_ISSUE,
    excluded: Sequence[str] = EXCLUDED_ISSUES,
    actions: Mapping[str, str] = ACTIONS,
    lists: Sequence[str] = ("missing_formula", "unparsable_formula"),
) -> DataFrame:
    """reaction_id, issue_classes, action. The metabolites in the audit's `lists` are classed by `rules` (as classify_first_match takes
    them, over met_id, name and formula of compounds(met_id, name, formula); a metabolite that is not there has neither name nor
    formula), then a balanced reaction, one with classes of `excluded` only and one without some formula get their action."""
    flags = {"balanced": F.col("formula_balanced") & F.col("charge_balanced"), "unmapped": F.size("missing_formula") > 0, "ids": F.array_distinct(F.concat(*lists))}
    # Read twice below, so written once: else all reactions are audited twice.
    flagged = written(audit.select("reaction_id", *(v.alias(k) for k, v in flags.items())))
    issues = flagged.select("reaction_id", F.explode("ids").alias("met_id")).join(compounds.select("met_id", "name", "formula"), "met_id", "left")
    classed = classify_first_match(issues, ["name"], rules, {"class": other})
    per = classed.groupBy("reaction_id").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    out = flagged.drop("ids").join(per, "reaction_id", "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
    only = (F.size("classes") > 0) & F.forall("classes", lambda c: c.isin(*excluded))
    action = F.when(F.col("balanced"), actions["balanced"]).when(only, actions["excluded"]).when(F.col("unmapped"), actions["mapping"]).otherwise(actions["review"])
    return out.select("reaction_id", F.array_join("classes", "|").alias("issue_classes"), action.alias("action"))


def gate_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two (metric, value) tables."""
    b, a = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    out = b.join(a, "metric", "full").fillna(0, ["before", "after"])
    return out.withColumn("delta", F.col("after") - F.col("before"))
