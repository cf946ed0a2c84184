"""Queries of governance (G) and of splits and graphs (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.operators import governance as G
from wickerwork.operators import splits as H
from wickerwork.operators.aggregates import balance_audit
from wickerwork.operators.graph import connected_components
from wickerwork.plans.registry import Tables, query
from wickerwork.plans.table_queries import _BALANCE, balance_tables

_TIERS = ["name", "brand", "type"]


def _candidates(t: Tables) -> DataFrame:
    """A supplier's candidate structures: parts that agree with it in one of three keys, as tiers."""
    parts = t.part.select("p_partkey", "p_brand", F.expr("if(p_partkey % 5 = 0, null, 'C' || (p_partkey % 3 + 1))").alias("formula"), (F.col("p_partkey") % 4 > 0).alias("parseable"))
    keys = t.supplier.select(F.col("s_suppkey").alias("row_id"), F.explode(F.expr("array(named_struct('tier', 'name', 'k', s_suppkey * 7), named_struct('tier', 'brand', 'k', s_suppkey * 11), named_struct('tier', 'brand', 'k', s_suppkey * 13), named_struct('tier', 'type', 'k', s_suppkey))")).alias("x"))
    keys = keys.select("row_id", "x.tier", F.col("x.k").alias("p_partkey"))
    return keys.join(parts, "p_partkey").select("row_id", "tier", F.col("p_brand").alias("structure"), "formula", "parseable", F.col("p_partkey").cast("string").alias("source"))


_WATERFALL = """
WITH c AS (SELECT s_suppkey AS row_id, x.no AS no, x.tier AS tier, p_brand AS structure, CASE WHEN p_partkey % 5 > 0 THEN 'C' || (p_partkey % 3 + 1) END AS formula, p_partkey % 4 > 0 AS ok, p_partkey::VARCHAR AS source,
    'C' || (s_suppkey % 3 + 1) AS target FROM supplier,
    LATERAL (SELECT unnest([{'no': 1, 'tier': 'name', 'k': s_suppkey * 7}, {'no': 2, 'tier': 'brand', 'k': s_suppkey * 11}, {'no': 2, 'tier': 'brand', 'k': s_suppkey * 13}, {'no': 3, 'tier': 'type', 'k': s_suppkey}]) AS x) JOIN part ON p_partkey = x.k)
"""


@query(_WATERFALL + """
, per AS (SELECT row_id, no, any_value(tier) AS tier, count(*) FILTER (ok) AS readable, count(DISTINCT structure) FILTER (ok AND (formula IS NULL OR formula = target)) AS n, min(structure) FILTER (ok AND (formula IS NULL OR formula = target)) AS best FROM c GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN readable = 0 THEN 'no_parseable_local_structure' WHEN n = 0 THEN 'formula_conflict' WHEN n > 1 THEN 'multiple_structures_for_key' ELSE 'mapped' END AS reason FROM per),
d AS (SELECT row_id, arg_min(reason, no) AS reason, arg_min(tier, no) AS tier, arg_min(n, no) AS n, arg_min(best, no) AS best FROM r WHERE readable > 0 GROUP BY 1),
l AS (SELECT row_id, arg_max(reason, no) AS reason, arg_max(tier, no) AS tier FROM r GROUP BY 1)
SELECT s_suppkey AS row_id, CASE WHEN d.reason = 'mapped' THEN 'mapped' WHEN d.reason IS NOT NULL THEN 'manual_review' ELSE 'unresolved' END AS decision,
  coalesce(d.reason, l.reason, 'local_key_space_exhausted') AS reason, coalesce(d.tier, l.tier) AS tier, CASE WHEN d.reason = 'mapped' THEN d.best END AS structure, coalesce(d.n, 0) AS candidate_count
FROM supplier LEFT JOIN d ON d.row_id = s_suppkey LEFT JOIN l ON l.row_id = s_suppkey WHERE s_suppkey % 9 > 0
""")
def g1_waterfall_resolve(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_suppkey").alias("row_id"), F.expr("'C' || (s_suppkey % 3 + 1)").alias("formula"), F.expr("if(s_suppkey % 9 > 0, '', 'CCO')").alias("structure"))
    return G.waterfall_resolve(rows, _candidates(t), _TIERS).drop("source")


@query(_WATERFALL + """
SELECT k.tier AS tier, count(*) AS rows_with_key, count(x.ok) AS rows_with_candidate, count(*) FILTER (x.ok) AS rows_with_parseable
FROM (SELECT s_suppkey AS row_id, unnest(['name', 'brand', 'type']) AS tier FROM supplier) k LEFT JOIN (SELECT row_id, tier, bool_or(ok) AS ok FROM c GROUP BY 1, 2) x USING (row_id, tier) GROUP BY 1
""")
def g2_key_space_audit(t: Tables) -> DataFrame:
    keys = t.supplier.select(F.col("s_suppkey").alias("row_id"), F.explode(F.array(*map(F.lit, _TIERS))).alias("tier"))
    return G.key_space_audit(keys, _candidates(t))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'inchikey:' || c_name WHEN c_custkey % 3 = 0 THEN 'metanetx:' || c_mktsegment ELSE 'uid:' || c_custkey END AS id, c_custkey % 4 = 0 AS is_structure FROM customer
""")
def g3_canonical_id(t: Tables) -> DataFrame:
    df = t.customer.withColumns({"inchikey": F.expr("if(c_custkey % 4 = 0, c_name, '')"), "mnx": F.expr("if(c_custkey % 3 = 0, c_mktsegment, 'none')"), "uid": F.expr("cast(c_custkey as string)")})
    spaces = [("inchikey", "inchikey", True), ("mnx", "metanetx", False), ("uid", "uid", False)]
    return df.select("c_custkey", G.canonical_id(spaces).alias("c")).select("c_custkey", "c.id", "c.is_structure")


@query("""
WITH n AS (SELECT l_orderkey, 'p:' || (l_partkey % 40) AS id, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END), 6) AS x FROM lineitem GROUP BY 1, 2 HAVING x <> 0),
s AS (SELECT l_orderkey, list_sort(list(id || ':' || x::INTEGER)) AS f, list_sort(list(id || ':' || (-x)::INTEGER)) AS r FROM n GROUP BY 1),
k AS (SELECT least(array_to_string(f, '|'), array_to_string(r, '|')) AS k, count(*) AS n FROM s GROUP BY 1)
SELECT n AS reactions_sharing, count(*) AS signatures FROM k GROUP BY 1
""")
def g4_reaction_signature(t: Tables) -> DataFrame:
    stoich, _ = balance_tables(t)
    ids = t.part.select(F.col("p_partkey").alias("met_id"), F.concat(F.lit("p:"), (F.col("p_partkey") % 40).cast("string")).alias("id"), F.lit(True).alias("is_structure"))
    per = G.reaction_signature(stoich, ids).groupBy("signature").agg(F.count("*").alias("reactions_sharing"))
    return per.groupBy("reactions_sharing").agg(F.count("*").alias("signatures"))


@query("""
SELECT o_orderkey, CASE WHEN u AND m THEN 'underground_rxndb_provenance' WHEN u THEN 'underground_no_selected_rxndb_match' WHEN x THEN 'curated_or_database_crossreferenced' ELSE 'model_reaction_without_external_crossref' END AS status,
  CASE WHEN u AND m AND e THEN 'candidate_label_with_ec_and_review' WHEN u AND m THEN 'candidate_label_with_review' WHEN u THEN 'exclude_until_provenance_resolved' WHEN x THEN 'preferred_reference_label' ELSE 'supporting_model_context' END AS role,
  NOT u AND x AS usable
FROM (SELECT o_orderkey, o_orderstatus = 'P' AS u, o_totalprice > 100000 AS m, o_orderpriority LIKE '1%' AS e, o_orderkey % 2 = 0 AS x FROM orders)
""")
def g5_confidence_flags(t: Tables) -> DataFrame:
    c = F.col
    return G.confidence_flags(t.orders, c("o_orderstatus") == "P", c("o_totalprice") > 100000, c("o_orderpriority").startswith("1"), c("o_orderkey") % 2 == 0).select("o_orderkey", "status", "role", "usable")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'parseable' ELSE 'parse_failed' END AS structure_status,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'missing_formula_and_structure' WHEN p_partkey % 5 = 0 THEN 'generic_or_unparsable_formula_no_structure'
    WHEN p_size > 25 THEN 'external_mapping_not_found' ELSE 'mapped_source_has_no_structure' END END AS reason_code,
  CASE p_partkey % 3 WHEN 0 THEN 'not_reviewed' WHEN 1 THEN 'not_required' ELSE 'review_required' END AS review,
  CASE WHEN p_size > 25 THEN CASE WHEN p_partkey % 7 = 0 THEN 'unrecorded' ELSE 'db:' || p_partkey END ELSE p_brand END AS source
FROM part
""")
def g6_metabolite_quality(t: Tables) -> DataFrame:
    df = t.part.select(
        "p_partkey",
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'nan' WHEN 1 THEN 'C1CC1(O)' ELSE 'C1CC(' END").alias("smiles"),
        F.expr("if(p_partkey % 2 = 0, '', if(p_partkey % 5 = 0, 'C6R', 'C6H12O6'))").alias("formula"),
        F.expr("if(p_size > 25, null, p_brand)").alias("mapping_source"),
        F.lit("db").alias("source_database"),
        F.expr("if(p_partkey % 7 = 0, '', cast(p_partkey as string))").alias("source_record_id"),
    )
    return G.metabolite_quality(df).select("p_partkey", "structure_status", "reason_code", "review", "source")


@query(_BALANCE + """
SELECT reaction_id, CASE WHEN formula_balanced THEN 'balanced' ELSE 'unbalanced' END AS mass_status, CASE WHEN charge_balanced THEN 'balanced' ELSE 'unbalanced' END AS charge_status,
  CASE WHEN missing_formulas > 0 THEN 'pending' ELSE 'complete' END AS mapping_status, CASE WHEN formula_balanced AND charge_balanced THEN 'not_required' ELSE 'required' END AS review FROM b
""")
def g7_reaction_quality(t: Tables) -> DataFrame:
    return G.reaction_quality(balance_audit(*balance_tables(t))).select("reaction_id", "mass_status", "charge_status", "mapping_status", "review")


@query("""
SELECT c_custkey, 'customer ' || c_custkey || ' missing: ' || concat_ws(', ', CASE WHEN c_custkey % 3 = 0 THEN 'name' END, CASE WHEN c_custkey % 5 = 0 THEN 'segment' END) AS message FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0
""")
def g8_require_fields(t: Tables) -> DataFrame:
    df = t.customer.withColumns({"name": F.expr("if(c_custkey % 3 = 0, ' ', c_name)"), "segment": F.expr("if(c_custkey % 5 = 0, null, c_mktsegment)")})
    return G.require_fields(df, "c_custkey", ["name", "segment"], "customer")


@query(_BALANCE + """
, o AS (SELECT o_custkey AS subset, l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
x AS (
  SELECT DISTINCT subset, l_partkey::VARCHAR AS item, unnest([{'c': 'id_known', 'p': m.p_partkey IS NOT NULL}, {'c': 'formula_parses', 'p': m.c IS NOT NULL}, {'c': 'charge_numeric', 'p': m.q IS NOT NULL}, {'c': 'source_recorded', 'p': m.p_partkey IS NOT NULL}, {'c': 'tables_agree', 'p': true}], recursive := true) FROM o LEFT JOIN m ON p_partkey = l_partkey
  UNION ALL SELECT subset, '', 'parse_fraction', avg(CASE WHEN l_partkey % 4 > 0 THEN 1.0 ELSE 0 END) >= 0.5 FROM (SELECT DISTINCT subset, l_partkey FROM o) GROUP BY 1
  UNION ALL SELECT DISTINCT subset, l_orderkey::VARCHAR, unnest([{'c': 'reaction_defined', 'p': true}, {'c': 'evidence_scope', 'p': true}, {'c': 'balance_row', 'p': true}, {'c': 'mass_balanced', 'p': subset % 2 > 0 OR b.formula_balanced}, {'c': 'charge_balanced', 'p': subset % 2 > 0 OR b.charge_balanced}], recursive := true) FROM o JOIN b ON reaction_id = l_orderkey)
SELECT subset, count(*) AS checks, count(*) FILTER (NOT p) AS failed, CASE WHEN count(*) FILTER (NOT p) = 0 THEN 'passed' ELSE 'failed' END AS status FROM x GROUP BY 1
""")
def g9_strict_subset_gate(t: Tables) -> DataFrame:
    stoich, compounds = balance_tables(t)
    audit = balance_audit(stoich, compounds)
    owned = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    subsets = owned.groupBy(F.col("o_custkey").alias("subset")).agg(F.collect_set("l_partkey").alias("metabolite_ids"), F.collect_set("l_orderkey").alias("reaction_ids"))
    subsets = subsets.withColumns({"min_parse_fraction": F.lit(0.5), "require_balance": F.col("subset") % 2 == 0})
    mets = compounds.select("met_id", "formula", "charge", F.lit("db").alias("source"), (F.col("met_id") % 4 > 0).alias("parseable"), F.lit(True).alias("consistent"))
    rxns = audit.select("reaction_id", F.lit("scope").alias("evidence_scope"), F.lit(True).alias("has_balance"), "formula_balanced", "charge_balanced")
    return G.subset_status(G.strict_subset_gate(subsets, mets, rxns))


@query("""
SELECT section, key, value FROM (
  SELECT 'structure_status' AS section, CASE p_partkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'parseable' ELSE 'parse_failed' END AS key, count(*)::VARCHAR AS value FROM part GROUP BY 2
  UNION ALL SELECT 'reason_code', CASE WHEN p_partkey % 3 = 0 THEN 'missing_formula_and_structure' ELSE 'none' END, count(*)::VARCHAR FROM part GROUP BY 2
  UNION ALL SELECT 'mass_status', CASE WHEN o_orderstatus = 'F' THEN 'balanced' ELSE 'unbalanced' END, count(*)::VARCHAR FROM orders GROUP BY 2
  UNION ALL SELECT 'charge_status', 'balanced', count(*)::VARCHAR FROM orders
  UNION ALL SELECT 'gate', 'failures', count(*)::VARCHAR FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'gate', 'status', CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END FROM customer WHERE c_acctbal < 0)
""")
def g10_gate_summary(t: Tables) -> DataFrame:
    mets = t.part.select(
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'parseable' ELSE 'parse_failed' END").alias("structure_status"),
        F.expr("if(p_partkey % 3 = 0, 'missing_formula_and_structure', null)").alias("reason_code"),
    )
    rxns = t.orders.select(F.expr("if(o_orderstatus = 'F', 'balanced', 'unbalanced')").alias("mass_status"), F.lit("balanced").alias("charge_status"))
    return G.gate_summary(mets, rxns, t.customer.where("c_acctbal < 0"))


@query(_BALANCE + """
, cls AS (SELECT p_partkey, CASE WHEN p_name LIKE '%gear%' THEN 'macromolecule' WHEN p_partkey % 10 = 0 THEN 'no_mapping' ELSE 'other' END AS k FROM part),
i AS (SELECT l_orderkey, list_sort(list(DISTINCT coalesce(k, 'other'))) AS ks FROM r LEFT JOIN cls ON p_partkey = l_partkey WHERE c IS NULL OR q IS NULL GROUP BY 1)
SELECT reaction_id, coalesce(array_to_string(ks, '|'), '') AS issue_classes, CASE WHEN formula_balanced AND charge_balanced THEN 'training_ready' WHEN ks = ['macromolecule'] THEN 'exclude_or_carrier_rules'
  WHEN missing_formulas > 0 THEN 'external_mapping' ELSE 'manual_review' END AS action FROM b LEFT JOIN i ON l_orderkey = reaction_id
""")
def g11_remediation_action(t: Tables) -> DataFrame:
    stoich, compounds = balance_tables(t)
    rules = [{"any_of": ["gear"], "out": {"class": "macromolecule"}}, {"when": "formula = 'nan'", "out": {"class": "no_mapping"}}]
    actions = {"balanced": "training_ready", "excluded": "exclude_or_carrier_rules", "mapping": "external_mapping", "review": "manual_review"}
    lists = ("missing_formula", "unparsable_formula", "missing_charge")
    audit = balance_audit(stoich, compounds).withColumns({c: F.col(c).cast("array<string>") for c in lists})
    named = compounds.withColumn("met_id", F.col("met_id").cast("string"))
    return G.remediation_action(audit, named, rules, "other", ["macromolecule"], actions, lists)


@query("""
SELECT metric, before, after, after - before AS delta FROM (
  SELECT coalesce(a.m, b.m) AS metric, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after
  FROM (SELECT o_orderpriority AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS m, count(*) AS n FROM orders GROUP BY 1) b USING (m))
""")
def g12_gate_delta(t: Tables) -> DataFrame:
    count = lambda df: df.groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    return G.gate_delta(count(t.orders.where("o_orderstatus = 'F'")), count(t.orders))


_SPLIT = "CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END"


@query(f"""
SELECT o_orderkey, split_key, fallback, {_SPLIT} AS split FROM (SELECT *, ('0x' || substr(sha256(split_key), 1, 12))::BIGINT % 100 AS b FROM (
  SELECT o_orderkey, s IS NULL AS fallback, CASE WHEN s IS NOT NULL THEN 'seqset:' || sha256(array_to_string(s, '|')) ELSE 'equation:' || o_orderpriority END AS split_key
  FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT sha256(p_name))) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON l_orderkey = o_orderkey))
""")
def h2_exact_sequence_split(t: Tables) -> DataFrame:
    ids = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("seq_id"))
    seqs = t.part.select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("sequence"))
    return H.exact_sequence_split(t.orders, "o_orderkey", ids, seqs, "o_orderpriority").select("o_orderkey", "split_key", "fallback", "split")


@query(f"""
SELECT o_orderkey, split_key, {_SPLIT} AS split FROM (SELECT *, ('0x' || substr(sha256(split_key), 1, 12))::BIGINT % 100 AS b FROM (
  SELECT o_orderkey, CASE WHEN s IS NOT NULL THEN 'cluster_set:' || sha256(array_to_string(s, '|')) ELSE 'reaction_id:' || o_orderkey END AS split_key
  FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON l_orderkey = o_orderkey))
""")
def h3_cluster_split(t: Tables) -> DataFrame:
    ids = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("member"))
    reps = t.part.select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("representative"))
    return H.cluster_split(t.orders, "o_orderkey", ids, reps).select("o_orderkey", "split_key", "split")


#: All pairs of documents with a common shingle compared in full, and (t, node, r): node and r are linked at threshold t, directly or
#: through others.
_ALIKE = """
WITH RECURSIVE s AS (SELECT DISTINCT id, substr(text, i, 12) AS x FROM (
  SELECT doc_id AS id, text, unnest(range(1, greatest(length(text) - 11, 1) + 1)) AS i FROM documents WHERE trim(text) <> '')),
m AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM s x JOIN s y ON x.x = y.x AND x.id < y.id GROUP BY 1, 2),
c AS (SELECT a, b, o.n, p.n AS na, q.n AS nb FROM o JOIN m p ON p.id = a JOIN m q ON q.id = b),
v AS (SELECT t, a, b FROM c, (SELECT unnest({}) AS t) WHERE n / (na + nb - n) >= t AND n / greatest(na, nb) >= 0.5),
u AS (SELECT t, a, b FROM v UNION ALL SELECT t, b, a FROM v),
w AS (SELECT t, a AS node, a AS r FROM u UNION SELECT u.t, u.b, w.r FROM w JOIN u ON u.t = w.t AND u.a = w.node)
"""


@query(_ALIKE.format("[0.5]") + "SELECT doc_id AS member, coalesce(min(r), doc_id) AS representative FROM documents LEFT JOIN w ON node = doc_id GROUP BY doc_id")
def h4_similarity_clusters(t: Tables) -> DataFrame:
    return H.similarity_clusters(t.documents, "doc_id", "text", 12, 0.5, 0.5)


@query(_ALIKE.format("[0.3, 0.5, 0.7, 0.9]") + f"""
, k AS (SELECT o.t, 'cluster_set:' || sha256(coalesce(min(r), doc_id)::VARCHAR) AS k FROM (SELECT doc_id, unnest([0.3, 0.5, 0.7, 0.9]) AS t FROM documents) o LEFT JOIN w ON node = doc_id AND w.t = o.t GROUP BY o.t, doc_id),
d AS (SELECT *, {_SPLIT} AS split FROM (SELECT *, ('0x' || substr(sha256(k), 1, 12))::BIGINT % 100 AS b FROM k))
SELECT t::DOUBLE AS threshold, count(DISTINCT k) AS clusters, count(*) AS rows, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev,
  count(*) FILTER (split = 'test') AS test, 0::BIGINT AS crossing_keys FROM d GROUP BY t
""")
def h5_threshold_sweep(t: Tables) -> DataFrame:
    return H.threshold_sweep(t.documents, "doc_id", "text", [0.3, 0.5, 0.7, 0.9], k=12)


_EDGES = """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000 + l_suppkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT a AS node, a AS r FROM u UNION SELECT u.b, w.r FROM w JOIN u ON u.a = w.node)
"""


@query(_EDGES + "SELECT node, min(r) AS component FROM w GROUP BY 1")
def h6_connected_components(t: Tables) -> DataFrame:
    edges = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return connected_components(edges.select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")))


@query("""
WITH RECURSIVE tok AS (
  SELECT doc_id, 'text:' || sha256(text) AS token FROM documents
  UNION SELECT doc_id, 'first:' || sha256(string_split(text, chr(10))[1]) FROM documents WHERE length(string_split(text, chr(10))[1]) >= 20
  UNION SELECT doc_id, 'last:' || sha256(string_split(text, chr(10))[-1]) FROM documents WHERE length(string_split(text, chr(10))[-1]) >= 20),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY token) AS b FROM tok),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT a AS node, a AS r FROM u UNION SELECT u.b, w.r FROM w JOIN u ON u.a = w.node),
m AS (SELECT node, min(r) AS r FROM w GROUP BY 1),
k AS (SELECT r, 'unified:' || sha256(min(token)) AS group_key FROM m JOIN tok ON doc_id = node GROUP BY 1)
SELECT node AS doc_id, group_key FROM m JOIN k USING (r)
""")
def h7_unified_group_split(t: Tables) -> DataFrame:
    """Documents with the same text, first line or last line (of 20 characters and more), directly or through others."""
    lines = F.split("text", "\n")
    token = lambda name, x: F.when(F.length(x) >= 20, F.concat(F.lit(f"{name}:"), F.sha2(x, 256)))
    own = F.array_compact(F.array(F.concat(F.lit("text:"), F.sha2("text", 256)), token("first", F.get(lines, F.lit(0))), token("last", F.element_at(lines, -1))))
    tokens = t.documents.select("doc_id", F.explode(own).alias("token"))
    return H.unified_group_split(t.documents.select("doc_id"), "doc_id", tokens).select("doc_id", "group_key")


@query(f"""
WITH RECURSIVE l AS (SELECT DISTINCT doc_id, sha256(x) AS token FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(x) >= 40),
tok AS (SELECT * FROM l UNION ALL SELECT doc_id, 'reaction_id:' || doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY token) AS b FROM tok),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT a AS node, a AS r FROM u UNION SELECT u.b, w.r FROM w JOIN u ON u.a = w.node),
m AS (SELECT node, min(r) AS r FROM w GROUP BY 1),
k AS (SELECT r, 'unified:' || sha256(min(token)) AS group_key FROM m JOIN tok ON doc_id = node GROUP BY 1),
d AS (SELECT node AS doc_id, group_key, ('0x' || substr(sha256(group_key), 1, 12))::BIGINT % 100 AS b FROM m JOIN k USING (r))
SELECT doc_id, group_key, {_SPLIT} AS split FROM d
""")
def h7_paragraph_groups(t: Tables) -> DataFrame:
    """Documents that share a line of 40 characters and more, directly or through others, in one split."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 40)
    tokens = t.documents.select("doc_id", F.explode(F.transform(F.array_distinct(lines), lambda x: F.sha2(x, 256))).alias("token"))
    return H.unified_group_split(t.documents.select("doc_id"), "doc_id", tokens).select("doc_id", "group_key", "split")


@query(f"""
WITH d AS (SELECT *, {_SPLIT} AS split FROM (SELECT doc_id, text, source, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT % 100 AS b FROM documents)),
v AS (SELECT 'text' AS dimension, sha256(text) AS v, split FROM d UNION ALL SELECT 'source', source, split FROM d),
p AS (SELECT dimension, v, count(DISTINCT split) AS s FROM v GROUP BY 1, 2)
SELECT dimension, count(*) AS values, count(*) FILTER (s > 1) AS crossing, coalesce(array_to_string(list_sort(list(v) FILTER (s > 1))[1:10], '|'), '') AS examples,
  CASE WHEN count(*) FILTER (s > 1) > 0 THEN 'fail' ELSE 'pass' END AS status FROM p GROUP BY 1
UNION ALL SELECT 'absent', 0, 0, '', 'missing'
""")
def h8_leakage_audit(t: Tables) -> DataFrame:
    from wickerwork.functions.text import assign_split

    df = t.documents.withColumn("split", assign_split(F.col("doc_id").cast("string")))
    return H.leakage_audit(df, {"text": "sha2(text, 256)", "source": "source", "absent": "array(cast(null as string))"})
