"""Enrichment, cross-reference and resolver joins. Sides are left to the optimizer: it broadcasts what it knows to be small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.functions.text import has_text, null_text
from wickerwork.operators.skew import heavy_light_join


def _last(df: DataFrame, key: str, order: Column | str, first: bool = False) -> DataFrame:
    """One row per key: the last (or first) in order. The window's limit is applied before the shuffle."""
    order = F.col(order) if isinstance(order, str) else order
    n = F.row_number().over(Window.partitionBy(key).orderBy(order.asc() if first else order.desc()))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def enrich_lookup(seed: DataFrame, ref: DataFrame, key: str, field_map: Mapping[str, str], source: str, order: str) -> DataFrame:
    """seed with fields filled from ref by key where seed has none; mapping_source names `source` where ref matched. Of repeated
    keys in ref the last in `order` counts."""
    ref = _last(ref, key, order).select(F.col(key).alias("_key"), *(F.col(v).alias(f"_ref_{k}") for k, v in field_map.items()))
    joined = seed.join(ref, seed[key] == F.col("_key"), "left")
    filled = {k: F.coalesce(null_text(k) if k in seed.columns else F.lit(None), null_text(f"_ref_{k}")) for k in field_map}
    filled["mapping_source"] = F.when(F.col("_key").isNotNull(), source)
    return joined.withColumns(filled).drop("_key", *(f"_ref_{k}" for k in field_map))


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(field, filled, total) of columns."""
    row = df.agg(F.count("*").alias("n"), *(F.count_if(has_text(F.col(c).cast("string"))).alias(c) for c in cols))
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.col("n").alias("total")) for c in cols))
    return row.select(F.explode(cells).alias("r")).select("r.*")


def enrich_by_token(enz: DataFrame, proteins: DataFrame, token_col: str, list_col: str, payload: Sequence[str], order: str, pattern: str = r"^Y.{6,}$") -> DataFrame:
    """enz joined by its token to proteins, whose list_col is free text of tokens; of several proteins with a token the first in
    order counts. pattern says what a token is."""
    tokens = proteins.select(F.explode(F.array_distinct(F.split(list_col, r"[\s;,|]+"))).alias("_token"), order, *payload)
    best = _last(tokens.where(F.col("_token").rlike(pattern)), "_token", order, first=True).select("_token", *payload)
    return enz.join(best, enz[token_col] == F.col("_token"), "left").drop("_token")


def build_crossrefs(rxn: DataFrame, xref: DataFrame, id_list: str, xref_key: str, external: Sequence[str], prefixed: str) -> DataFrame:
    """rxn with the properties of its primary id (the first of the list) and crossref_status. prefixed: SQL condition for rows
    that are not expected to have one."""
    primary = F.element_at(F.split(null_text(id_list), r"[|;]"), 1)
    joined = rxn.withColumn("primary_id", F.trim(primary)).join(xref.withColumnRenamed(xref_key, "primary_id"), "primary_id", "left")
    any_external = F.lit(False)
    for c in external:
        any_external = any_external | has_text(c)
    status = F.when(any_external, "has_external_crossref").when(F.expr(prefixed), "no_external_crossref").otherwise("model_only_no_external_crossref")
    return joined.withColumn("crossref_status", status)


def _least(cols: Sequence[str]) -> Column:
    """One row's values of these columns, the same on every run and for every type: the least by its JSON."""
    return F.min_by(F.struct(*cols), F.to_json(F.struct(*cols)))


def attach_provenance(rxn: DataFrame, db: DataFrame, key: str, db_key: str, prefix: str, payload: Sequence[str]) -> DataFrame:
    """Rows whose key begins with prefix, joined to the database by the rest of the key; match_status matched or unmatched. Of rows that
    repeat a database key the one with the least payload counts."""
    ours = rxn.where(F.col(key).startswith(prefix)).withColumn("_k", F.expr(f"substring({key}, {len(prefix) + 1})"))
    db = db.groupBy(F.col(db_key).alias("_db")).agg(_least(payload).alias("_p")).select("_db", "_p.*")
    joined = ours.join(db, F.col("_k") == F.col("_db"), "left")
    return joined.withColumn("match_status", F.when(F.col("_db").isNotNull(), "matched").otherwise("unmatched")).drop("_k", "_db")


def resolve_with_redirect(ids: DataFrame, current: DataFrame, deprecated: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """ids joined to current directly, and through deprecated(old_id, new_id); path tells which. Both tables are first reduced to
    the ids asked for."""
    wanted = ids.select(key).distinct()
    moved = deprecated.join(wanted.withColumnRenamed(key, "old_id"), "old_id", "left_semi")
    direct = wanted.join(current, key).select(key, F.lit("direct").alias("path"), *payload)
    through = moved.join(current.withColumnRenamed(key, "new_id"), "new_id").select(F.col("old_id").alias(key), F.lit("redirect").alias("path"), *payload)
    return direct.unionByName(through)


def resolve_ids(df: DataFrame, mapping: DataFrame, id_col: str, src: str, dst: str, hub: str, order: str) -> DataFrame:
    """df with resolved: its id of namespace column src of mapping, in namespace dst. The same namespace is the identity; of
    several hub rows with an id the first in order counts; no match gives null."""
    if src == dst:
        return df.withColumn("resolved", F.col(id_col))
    hubs = mapping.select(F.col(src).alias("_id"), F.col(hub).alias("_hub"), F.col(order).alias("_o")).where(has_text("_id"))
    there = mapping.select(F.col(hub).alias("_hub"), F.col(dst).alias("resolved"), F.col(order).alias("_o")).where(has_text("_hub"))
    one = hubs.groupBy("_id").agg(F.min_by("_hub", "_o").alias("_hub"))
    two = there.groupBy("_hub").agg(F.min_by("resolved", "_o").alias("resolved"))
    lookup = one.join(two, "_hub", "left").select("_id", null_text("resolved").alias("resolved"))
    return df.join(lookup, df[id_col] == F.col("_id"), "left").drop("_id")


def reverse_index(mapping: DataFrame, namespace: str, hub: str, order: str) -> DataFrame:
    """(namespace id, hub): the last hub row of an id counts."""
    return mapping.where(has_text(namespace)).groupBy(F.col(namespace).alias("id")).agg(F.max_by(hub, order).alias("hub"))


def build_pairs(enz: DataFrame, rxn_sub: DataFrame, substrates: DataFrame, fasta: DataFrame, orf_pattern: str = r"Y[A-P][LR][0-9]{3}[WC](?:-[A-Z])?") -> DataFrame:
    """enz(enzyme_id, relevance_class, orf_text), rxn_sub(reaction_id, relevance_class, substrate_id), substrates(substrate_id,
    smiles), fasta(seq_id, sequence): prediction inputs of rows that have a sequence. A class that holds a large part of either side is
    dealt over a grid (see heavy_light_join); of its pairs every task gets a part."""
    candidates = enz.select("enzyme_id", "relevance_class", F.explode(F.array_distinct(F.regexp_extract_all("orf_text", F.lit(f"({orf_pattern})"), 1))).alias("seq_id"))
    with_sequence = candidates.join(fasta.select("seq_id", "sequence"), "seq_id")
    reactions = rxn_sub.select("reaction_id", "relevance_class", "substrate_id").join(substrates.select("substrate_id", "smiles"), "substrate_id")
    return heavy_light_join(with_sequence, reactions, "relevance_class").select(
        "enzyme_id", "seq_id", "reaction_id", "substrate_id", "relevance_class", "smiles", "sequence"
    )


def evidence_matrix(pred: DataFrame, sides: Mapping[str, tuple[DataFrame, Sequence[str]]], defaults: Mapping[str, float] | None = None) -> DataFrame:
    """pred left-joined with side tables, each unique on its keys (name -> (table, keys)); defaults fills nulls."""
    for table, keys in sides.values():
        pred = pred.join(table, list(keys), "left")
    return pred.fillna(dict(defaults)) if defaults else pred


def split_cached(seqs: DataFrame, cache: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose (id, hash of the text) the cache(id, seq_hash, ...) has, joined to it; rows still to be computed).
    Of cache rows that repeat a key the one with the least other columns counts."""
    hashed = seqs.withColumn("seq_hash", F.sha2(text_col, 256))
    keys = [id_col, "seq_hash"]
    rest = [c for c in cache.columns if c not in keys]
    once = cache.groupBy(*keys).agg(_least(rest).alias("_r")).select(*keys, "_r.*") if rest else cache.distinct()
    return hashed.join(once, keys), hashed.join(cache, keys, "left_anti")


def assemble_labels(base: DataFrame, labels: Mapping[str, tuple[DataFrame, str]], id_col: str, order: str) -> DataFrame:
    """base with one column a task (name -> (table, column)); null where a task has no label. Of repeated ids the last counts."""
    for name, (table, column) in labels.items():
        one = table.groupBy(id_col).agg(F.max_by(column, order).alias(name))
        base = base.join(one, id_col, "left")
    return base


def class_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Number of a class in the sorted vocabulary of classes; the vocabulary, not the rows, is ranked."""
    classes = df.select(col).where(F.col(col).isNotNull()).distinct()
    numbered = classes.withColumn(out, F.row_number().over(Window.orderBy(col)) - 1)
    return df.join(numbered, col, "left")


def check_references(reactions: DataFrame, compounds: DataFrame, routes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(section, id, message): repeated ids, and references that lead nowhere. reactions(id), compounds(id),
    routes(id, reactions array), pairs(id, reaction, compound)."""

    def repeated(df: DataFrame, name: str) -> DataFrame:
        bad = df.groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
        return bad.select(F.lit(name).alias("section"), "id", F.concat(F.lit(f"duplicate {name} id "), F.col("id").cast("string")).alias("message"))

    def dangling(df: DataFrame, col: str, target: DataFrame, name: str, what: str) -> DataFrame:
        bad = df.select("id", F.col(col).alias("_ref")).join(target.select(F.col("id").alias("_ref")), "_ref", "left_anti")
        message = F.concat(F.lit(f"{name} "), F.col("id").cast("string"), F.lit(f" references unknown {what} "), F.col("_ref").cast("string"))
        return bad.where("_ref IS NOT NULL").select(F.lit(name).alias("section"), "id", message.alias("message")).distinct()

    out = repeated(reactions, "reaction")
    for df, name in ((compounds, "compound"), (routes, "route"), (pairs, "pair")):
        out = out.unionByName(repeated(df, name))
    steps = routes.select("id", F.explode("reactions").alias("reaction"))
    out = out.unionByName(dangling(steps, "reaction", reactions, "route", "reaction"))
    out = out.unionByName(dangling(pairs, "reaction", reactions, "pair", "reaction"))
    return out.unionByName(dangling(pairs, "compound", compounds, "pair", "compound"))
