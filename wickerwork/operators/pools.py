"""Set operations that build label pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.functions.text import has_text


def export_group(role: str = "role"):
    """Column: the export group of a confidence role."""
    r = F.col(role)
    return (
        F.when(r == "preferred_reference_label", "first_pass_reference_label")
        .when(r.startswith("candidate_label"), "candidate_extension_evidence")
        .when(r.startswith("exclude"), "excluded_review_required")
        .otherwise("model_context_only")
    )


def label_exports(conf: DataFrame, seed: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """conf (with role) joined with the seed table and the aggregated evidence, with export_group and label_source."""
    out = conf.join(seed, key, "left").join(evidence, key, "left").withColumn("export_group", export_group())
    source = F.when(F.col("export_group") == "first_pass_reference_label", "external_crossref").when(
        F.col("export_group") == "candidate_extension_evidence", "database_provenance"
    )
    return out.withColumns({"label_source": source.otherwise("none"), "evidence_rows": F.coalesce("evidence_rows", F.lit(0))})


def cross_pool_overlap(df: DataFrame, keys: dict[str, str], group: str) -> DataFrame:
    """(key_type, key, rows, groups) of keys in more than one group. keys: name -> SQL expression, an array or a value."""
    streams = None
    for name, expr in keys.items():
        rows = df.select(F.col(group).alias("g"), F.expr(expr).alias("k"))
        rows = rows.select("g", F.explode("k").alias("k")) if dict(rows.dtypes)["k"].startswith("array") else rows
        one = rows.select(F.lit(name).alias("key_type"), F.col("k").cast("string").alias("key"), "g").where(has_text("key"))
        streams = one if streams is None else streams.unionByName(one)
    out = streams.groupBy("key_type", "key").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("g")).alias("gs"))
    return out.where(F.size("gs") > 1).select("key_type", "key", "rows", F.array_join("gs", "|").alias("groups"))


def build_pools(rows: DataFrame, group: str, key: str, overlap: DataFrame) -> DataFrame:
    """rows with pool: reference rows and candidates that overlap(key) does not have -> training; overlapping candidates ->
    overlap_review; context and excluded rows keep to themselves."""
    marked = rows.join(overlap.select(key, F.lit(True).alias("_o")).distinct(), key, "left")
    pool = (
        F.when(F.col(group) == "first_pass_reference_label", "training")
        .when((F.col(group) == "candidate_extension_evidence") & F.col("_o").isNull(), "training")
        .when(F.col(group) == "candidate_extension_evidence", "overlap_review")
        .when(F.col(group) == "model_context_only", "context")
        .otherwise("excluded")
    )
    return marked.withColumn("pool", pool).drop("_o")


def negative_pool(labels: DataFrame, audit: DataFrame, key: str, group: str, provenance: Sequence[str]) -> DataFrame:
    """Context rows without provenance that are mass and charge balanced."""
    none = F.lit(True)
    for c in provenance:
        none = none & ~has_text(F.col(c).cast("string"))
    balanced = audit.where("formula_balanced AND charge_balanced").select(key)
    return labels.where((F.col(group) == "model_context_only") & none).join(balanced, key, "left_semi")


def merge_registry(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.join(new, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def validation_matrix(labels: DataFrame, audit: DataFrame, key: str, group: str, items: dict[str, str], extra: DataFrame | None = None) -> DataFrame:
    """key, group, evidence_items (names of items, name -> SQL condition, that hold) and action; extra rows are appended."""
    joined = labels.join(audit.select(key, "formula_balanced", "charge_balanced"), key, "left")
    found = F.array_compact(F.array(*(F.when(F.expr(cond), name) for name, cond in items.items())))
    balanced = F.coalesce(F.col("formula_balanced") & F.col("charge_balanced"), F.lit(False))
    action = (
        F.when((F.col(group) == "first_pass_reference_label") & balanced, "usable_for_training")
        .when(F.col(group) == "candidate_extension_evidence", "review_provenance")
        .when(F.col(group) == "excluded_review_required", "exclude")
        .otherwise("review")
    )
    out = joined.select(key, F.col(group).alias("export_group"), F.array_join(found, "|").alias("evidence_items"), action.alias("action"))
    return out if extra is None else out.unionByName(extra)
