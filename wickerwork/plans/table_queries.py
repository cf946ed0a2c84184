"""Queries of the joins (C), aggregates (D), ranking (E) and pools (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.operators import aggregates as D
from wickerwork.operators import joins as C
from wickerwork.operators import pools as P
from wickerwork.operators import ranking as E
from wickerwork.plans.registry import Tables, query


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'own label' ELSE n_name END AS label, 'nation' AS mapping_source
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def c1_enrich_lookup(t: Tables) -> DataFrame:
    seed = t.supplier.withColumn("label", F.expr("if(s_suppkey % 4 = 0, 'own label', 'nan')"))
    ref = t.nation.withColumnRenamed("n_nationkey", "s_nationkey").select("s_nationkey", "n_name", F.lit(2).alias("no"))
    ref = ref.union(ref.select("s_nationkey", F.lit("earlier row"), F.lit(1)))
    return C.enrich_lookup(seed, ref, "s_nationkey", {"label": "n_name"}, "nation", "no").select("s_suppkey", "label", "mapping_source")


@query("SELECT 'label' AS field, (SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0) AS filled, (SELECT count(*) FROM customer) AS total")
def c1_coverage(t: Tables) -> DataFrame:
    return C.coverage(t.customer.withColumn("label", F.expr("if(c_custkey % 4 = 0, ' ', c_name)")), ["label"])


@query("""
SELECT p.p_partkey, m.s_name FROM part p LEFT JOIN (
  SELECT s_suppkey % 40 AS k, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) m ON m.k = p.p_partkey % 50
""")
def c2_enrich_by_token(t: Tables) -> DataFrame:
    token = lambda n: F.concat(F.lit("YAB"), F.lpad(n.cast("string"), 4, "0"))
    proteins = t.supplier.withColumn("genes", F.concat_ws("; ", token(F.col("s_suppkey") % 40), F.lit("short"), F.lit("YX")))
    parts = t.part.withColumn("orf", token(F.col("p_partkey") % 50))
    return C.enrich_by_token(parts, proteins, "orf", "genes", ["s_name"], "s_suppkey").select("p_partkey", "s_name")


@query("""
SELECT o_orderkey, c_mktsegment, CASE WHEN c_mktsegment IS NOT NULL THEN 'has_external_crossref' WHEN o_orderkey % 10 = 1 THEN 'no_external_crossref'
  ELSE 'model_only_no_external_crossref' END AS crossref_status
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 3 > 0
""")
def c3_crossrefs(t: Tables) -> DataFrame:
    rxn = t.orders.withColumn("ids", F.expr("if(o_orderkey % 3 > 0, o_custkey || '|other', 'none')"))
    xref = t.customer.select(F.col("c_custkey").cast("string").alias("id"), "c_mktsegment")
    return C.build_crossrefs(rxn, xref, "ids", "id", ["c_mktsegment"], "o_orderkey % 10 = 1").select("o_orderkey", "c_mktsegment", "crossref_status")


@query("""
SELECT l.doc_id, d.lang, 'matched' AS match_status FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1
UNION ALL SELECT doc_id, NULL, 'unmatched' FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents)
""")
def c4_provenance(t: Tables) -> DataFrame:
    rxn = t.labels.withColumn("key", F.expr("if(quality = 1, 'u_', 'm_') || doc_id"))
    db = t.documents.select(F.col("doc_id").cast("string").alias("db_id"), "lang")
    return C.attach_provenance(rxn, db, "key", "db_id", "u_", ["lang"]).select("doc_id", "lang", "match_status")


@query("""
SELECT p_partkey AS id, 'direct' AS path, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT l.k, 'redirect', p_name FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) l JOIN part ON p_partkey = l.k + 1
""")
def c5_redirect(t: Tables) -> DataFrame:
    moved = t.part.select((F.col("p_partkey") - 1).alias("old_id"), F.col("p_partkey").alias("new_id"))
    current = t.part.select(F.col("p_partkey").alias("id"), "p_name")
    return C.resolve_with_redirect(t.lineitem.select(F.col("l_partkey").alias("id")), current, moved, "id", ["p_name"])


@query("""
SELECT n_nationkey, r.r_name AS resolved FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
""")
def c6_resolve_ids(t: Tables) -> DataFrame:
    m = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("a"), F.col("r_name").alias("b"), F.col("r_regionkey").alias("hub"), F.lit(1).alias("o"))
    m = m.union(m.select("a", F.lit("later"), "hub", F.lit(2)))
    df = t.nation.withColumn("a_id", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    return C.resolve_ids(df, m, "a_id", "a", "b", "hub", "o").select("n_nationkey", "resolved")


@query("SELECT c_mktsegment AS id, max(c_custkey) AS hub FROM customer GROUP BY 1")
def c7_reverse_index(t: Tables) -> DataFrame:
    return C.reverse_index(t.customer, "c_mktsegment", "c_custkey", "c_custkey")


@query("""
SELECT p.p_partkey AS enzyme_id, r.r_regionkey AS reaction_id, length(s.s_name) AS sequence_length
FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey % 1000 JOIN region r ON r.r_regionkey = p.p_size % 5
""")
def c8_build_pairs(t: Tables) -> DataFrame:
    orf = lambda n: F.concat(F.lit("YAL"), F.lpad(n.cast("string"), 3, "0"), F.lit("W"))
    enz = t.part.select(F.col("p_partkey").alias("enzyme_id"), (F.col("p_size") % 5).alias("relevance_class"), F.concat(F.lit("gene "), orf(F.col("p_partkey") % 1000), F.lit(" x")).alias("orf_text"))
    rxn = t.region.select(F.col("r_regionkey").alias("reaction_id"), F.col("r_regionkey").alias("relevance_class"), F.col("r_name").alias("substrate_id"))
    sub = t.region.select(F.col("r_name").alias("substrate_id"), F.lit("CCO").alias("smiles"))
    fasta = t.supplier.where("s_suppkey < 1000").select(orf(F.col("s_suppkey")).alias("seq_id"), F.col("s_name").alias("sequence"))
    return C.build_pairs(enz, rxn, sub, fasta).select("enzyme_id", "reaction_id", F.length("sequence").cast("long").alias("sequence_length"))


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(b.n, 0) AS pages FROM documents d LEFT JOIN labels l USING (doc_id)
LEFT JOIN (SELECT page_id AS doc_id, count(*) AS n FROM pages GROUP BY 1) b USING (doc_id)
""")
def c9_evidence_matrix(t: Tables) -> DataFrame:
    pages = t.pages.groupBy(F.col("page_id").alias("doc_id")).agg(F.count("*").alias("pages"))
    sides = {"labels": (t.labels.select("doc_id", "quality"), ["doc_id"]), "pages": (pages, ["doc_id"])}
    return C.evidence_matrix(t.documents.select("doc_id"), sides, {"quality": -1, "pages": 0})


@query("""
SELECT status, count(*) AS rows FROM (
  SELECT CASE WHEN c.k IS NULL THEN 'todo' ELSE 'cached' END AS status FROM part p LEFT JOIN (
    SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') c ON c.k = p_partkey) GROUP BY 1
""")
def c10_cache_split(t: Tables) -> DataFrame:
    used = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    cache = t.part.join(used, "p_partkey").select("p_partkey", F.sha2("p_name", 256).alias("seq_hash"), F.lit(1).alias("vector"))
    hit, todo = C.split_cached(t.part.select("p_partkey", "p_name"), cache, "p_partkey", "p_name")
    both = hit.select(F.lit("cached").alias("status")).union(todo.select(F.lit("todo")))
    return both.groupBy("status").agg(F.count("*").alias("rows"))


@query("""
SELECT vec_id, label, quality, toxic, dense_rank() OVER (ORDER BY label) - 1 AS label_no
FROM embeddings LEFT JOIN labels ON doc_id = vec_id
""")
def c11_assemble_labels(t: Tables) -> DataFrame:
    labels = t.labels.withColumnRenamed("doc_id", "vec_id").withColumn("o", F.lit(1))
    base = C.assemble_labels(t.embeddings.select("vec_id", "label"), {"quality": (labels, "quality"), "toxic": (labels, "toxic")}, "vec_id", "o")
    return C.class_index(base, "label", "label_no").select("vec_id", "label", "quality", "toxic", F.col("label_no").cast("long").alias("label_no"))


@query("""
SELECT 'reaction' AS section, l_partkey AS id, 'duplicate reaction id ' || l_partkey AS message FROM lineitem GROUP BY l_partkey HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'pair', o_orderkey, 'pair ' || o_orderkey || ' references unknown compound ' || (o_custkey + 5) FROM orders
  WHERE o_custkey + 5 NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT DISTINCT 'pair', o_orderkey, 'pair ' || o_orderkey || ' references unknown reaction ' || o_custkey FROM orders
  WHERE o_custkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT DISTINCT 'route', s_suppkey, 'route ' || s_suppkey || ' references unknown reaction ' || -s_suppkey FROM supplier
  WHERE -s_suppkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT DISTINCT 'route', s_suppkey, 'route ' || s_suppkey || ' references unknown reaction ' || s_suppkey FROM supplier
  WHERE s_suppkey NOT IN (SELECT l_partkey FROM lineitem)
""")
def c12_check_references(t: Tables) -> DataFrame:
    routes = t.supplier.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_suppkey"), -F.col("s_suppkey")).alias("reactions"))
    pairs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("reaction"), (F.col("o_custkey") + 5).alias("compound"))
    return C.check_references(t.lineitem.select(F.col("l_partkey").alias("id")), t.customer.select(F.col("c_custkey").alias("id")), routes, pairs)


@query("""
SELECT l_orderkey, count(*) AS evidence_rows, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS l_returnflag,
  array_to_string(list_sort(list(DISTINCT l_linestatus)), '|') AS l_linestatus FROM lineitem GROUP BY 1
""")
def d1_aggregate_evidence(t: Tables) -> DataFrame:
    return D.aggregate_evidence(t.lineitem, "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("""
SELECT lang, 'source' AS field, count(*) FILTER (source <> 'src0') AS filled, count(*) AS total, round(count(*) FILTER (source <> 'src0') * 100.0 / count(*), 6) AS percent FROM documents GROUP BY lang
UNION ALL SELECT lang, 'n_chars', count(*) FILTER (n_chars > 500), count(*), round(count(*) FILTER (n_chars > 500) * 100.0 / count(*), 6) FROM documents GROUP BY lang
""")
def d2_coverage_by_group(t: Tables) -> DataFrame:
    df = t.documents.withColumns({"source": F.expr("if(source = 'src0', 'none', source)"), "n_chars": F.expr("n_chars - 500")})
    return D.coverage_by_group(df, "lang", ["source"], ["n_chars"]).withColumn("percent", F.round("percent", 6))


@query("""
SELECT o_orderpriority, 'brand' AS attribute, count(*) FILTER (ok) AS complete, count(*) AS total, round(count(*) FILTER (ok) * 100.0 / count(*), 6) AS percent
FROM (SELECT o_orderpriority, l_orderkey, bool_and(coalesce(p_size > 2, false)) AS ok FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY 1
""")
def d3_all_members_coverage(t: Tables) -> DataFrame:
    stoich = t.lineitem.join(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select("l_orderkey", "o_orderpriority", "l_partkey")
    members = t.part.select(F.col("p_partkey").alias("l_partkey"), F.expr("if(p_size > 2, p_brand, 'null')").alias("brand"))
    out = D.all_members_coverage(stoich, members, "l_orderkey", "l_partkey", "o_orderpriority", ["brand"])
    return out.withColumn("percent", F.round("percent", 6))


@query("""
SELECT text, count(*) AS copies, array_to_string(list_sort(list(DISTINCT source)), '|') AS groups FROM documents WHERE trim(text) <> '' GROUP BY text HAVING count(*) > 1
""")
def d4_duplicate_report(t: Tables) -> DataFrame:
    return D.duplicate_report(t.documents, "text", "source")


_BALANCE = """
WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 3 + 1 END AS c, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 2 + 1 END AS h,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 3 - 1 END AS q FROM part),
r AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS x, c, h, q FROM lineitem LEFT JOIN m ON p_partkey = l_partkey),
b AS (SELECT l_orderkey AS reaction_id, bool_and(c IS NOT NULL) AND coalesce(sum(x * c), 0) = 0 AND coalesce(sum(x * h), 0) = 0 AS formula_balanced,
  bool_and(q IS NOT NULL) AND coalesce(sum(x * q), 0) = 0 AS charge_balanced, coalesce(sum(x * q), 0)::DOUBLE AS charge_imbalance,
  count(DISTINCT CASE WHEN c IS NULL THEN l_partkey END) AS missing_formulas FROM r GROUP BY 1)
"""


def balance_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """lineitem as stoichiometry: order = reaction, part = metabolite, the line's parity = side."""
    stoich = t.lineitem.select(F.col("l_orderkey").alias("reaction_id"), F.col("l_partkey").alias("met_id"), F.expr("if(l_linenumber % 2 = 0, 1.0D, -1.0D)").alias("coeff"))
    compounds = t.part.select(
        F.col("p_partkey").alias("met_id"),
        F.expr("if(p_partkey % 10 = 0, 'nan', 'C' || (p_partkey % 3 + 1) || 'H' || (p_partkey % 2 + 1))").alias("formula"),
        F.expr("if(p_partkey % 13 = 0, null, p_partkey % 3 - 1)").alias("charge"),
        F.col("p_name").alias("name"),
    )
    return stoich, compounds


@query(_BALANCE + "SELECT * FROM b")
def d5_balance_audit(t: Tables) -> DataFrame:
    out = D.balance_audit(*balance_tables(t))
    return out.select("reaction_id", "formula_balanced", "charge_balanced", "charge_imbalance", F.size("missing_formula").cast("long").alias("missing_formulas"))


@query(_BALANCE + """
SELECT o_orderstatus AS o_orderstatus, count(*) AS reactions, count(*) FILTER (formula_balanced) AS formula_balanced, count(*) FILTER (charge_balanced) AS charge_balanced,
  count(*) FILTER (formula_balanced AND charge_balanced) AS both_balanced FROM b JOIN orders ON o_orderkey = reaction_id GROUP BY 1
""")
def d6_balance_summary(t: Tables) -> DataFrame:
    audit = D.balance_audit(*balance_tables(t)).join(t.orders.withColumnRenamed("o_orderkey", "reaction_id"), "reaction_id")
    return D.balance_summary(audit, "o_orderstatus")


@query(_BALANCE + """
SELECT category, count(*) AS unique_metabolites, sum(n)::BIGINT AS occurrences FROM (
  SELECT 'missing_formula' AS category, l_partkey, count(DISTINCT l_orderkey) AS n FROM r WHERE c IS NULL GROUP BY 2
  UNION ALL SELECT 'missing_charge', l_partkey, count(DISTINCT l_orderkey) FROM r WHERE q IS NULL GROUP BY 2) GROUP BY 1
""")
def d7_issue_summary(t: Tables) -> DataFrame:
    return D.issue_summary(D.issue_occurrences(D.balance_audit(*balance_tables(t))))


@query("""
SELECT 'c_name' AS namespace, count(*) AS mapped, count(*) AS total, 1.0::DOUBLE AS fraction FROM customer
UNION ALL SELECT 'code', count(*) FILTER (c_custkey % 4 > 0), count(*), round(count(*) FILTER (c_custkey % 4 > 0) / count(*), 6) FROM customer
""")
def d8_mapping_coverage(t: Tables) -> DataFrame:
    df = t.customer.withColumn("code", F.expr("if(c_custkey % 4 > 0, c_mktsegment, '')"))
    return D.mapping_coverage(df, ["c_name", "code"]).withColumn("fraction", F.round("fraction", 6))


@query("""SELECT user_id, max((props::JSON ->> '$.k')::DOUBLE) AS max_value FROM events GROUP BY 1""")
def d10_max_over_map(t: Tables) -> DataFrame:
    return D.max_over_map(t.events, "user_id", "props")


@query("""
SELECT count(DISTINCT o_orderkey) AS rows_with_ids, (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS unique_ids,
  (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey AND p_size > 10) AS matched_ids
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def d11_id_coverage(t: Tables) -> DataFrame:
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids"))
    rows = t.orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    return D.id_coverage(rows, "ids", t.part.where("p_size > 10"), "p_partkey")[0]


@query("""
SELECT c_custkey, coalesce(n, 0) AS record_count, best AS best_tier, CASE best WHEN 'A' THEN 'promote_after_curation' WHEN 'B' THEN 'prioritise' WHEN 'C' THEN 'prioritise'
  WHEN 'D' THEN 'class_support' WHEN 'E' THEN 'class_support' ELSE 'none' END AS action
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(chr(64 + substr(o_orderpriority, 1, 1)::INTEGER)) AS best FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def d12_best_tier(t: Tables) -> DataFrame:
    records = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.expr("char(64 + cast(substr(o_orderpriority, 1, 1) as int))").alias("tier"))
    return D.best_tier(t.customer.select("c_custkey"), records, "c_custkey")


@query("""
WITH v AS (SELECT user_id AS probe, user_id % 50 AS gene, event_type AS condition, CASE WHEN event_id % 9 = 0 OR user_id % 50 = 3 THEN NULL ELSE value END AS value FROM events)
SELECT gene AS gene_id, condition, round(coalesce(avg(value), 0), 10) AS value FROM v WHERE gene IN (SELECT gene FROM v GROUP BY gene HAVING count(value) > 0) GROUP BY 1, 2
""")
def d13_collapse_probes(t: Tables) -> DataFrame:
    values = t.events.select(F.col("user_id").alias("probe_id"), F.col("event_type").alias("condition"), F.expr("if(event_id % 9 = 0 or user_id % 50 = 3, double('nan'), value)").alias("value"))
    probes = t.events.select(F.col("user_id").alias("probe_id"), (F.col("user_id") % 50).alias("gene_id")).distinct()
    return D.collapse_probes(values, probes, probes).withColumn("value", F.round("value", 10))


@query("""SELECT 'CUST:' || lpad(row_number() OVER (ORDER BY c_name, c_custkey)::VARCHAR, 7, '0') AS uid, c_custkey FROM customer""")
def e1_assign_uids(t: Tables) -> DataFrame:
    return E.assign_uids(t.customer, ["c_name", "c_custkey"], "CUST").select("uid", "c_custkey")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3
""")
def e2_top_k_per_group(t: Tables) -> DataFrame:
    return E.top_k_per_group(t.orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query("""
WITH b AS (SELECT p_brand, p_name, p_partkey, p_retailprice AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
routes AS (SELECT DISTINCT p_brand AS a, (SELECT min(p_brand) FROM part) AS z FROM part)
SELECT a AS route, x.p_partkey AS step1_entry, y.p_partkey AS step2_entry, round((x.s + y.s) / 2, 4) AS mean_score, CASE WHEN x.p_partkey = y.p_partkey THEN 'same_entry' ELSE 'none' END AS risk_note
FROM routes JOIN b x ON x.p_brand = a AND x.r <= 3 JOIN b y ON y.p_brand = z AND y.r <= 2
""")
def e3_design_pairs(t: Tables) -> DataFrame:
    matrix = t.part.select(F.col("p_brand").alias("reaction_id"), F.col("p_partkey").alias("entry"), F.col("p_retailprice").alias("score"))
    first = t.part.agg(F.min("p_brand").alias("step2_reaction"))
    routes = t.part.select(F.col("p_brand").alias("route"), F.col("p_brand").alias("step1_reaction")).distinct().join(F.broadcast(first))
    return E.design_pairs(matrix, routes, "score", "entry", 3, 2).select("route", "step1_entry", "step2_entry", F.round("mean_score", 4).alias("mean_score"), "risk_note")


@query("""
SELECT source, doc_id, substr(text, 1, 2000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 500
""")
def e4_cap_per_source(t: Tables) -> DataFrame:
    return E.cap_per_source(t.documents, "source", ["doc_id"], 500, "text", 2000).select("source", "doc_id", "text")


@query("""
WITH r AS (SELECT quality, ceil(row_number() OVER (ORDER BY sha256('0:' || doc_id), doc_id) / 10)::INTEGER AS round FROM labels),
p AS (SELECT round, count(*) AS n, sum(quality) AS h FROM r WHERE round <= 20 GROUP BY 1)
SELECT round, sum(n) OVER w::BIGINT AS selected, sum(h) OVER w::BIGINT AS hits, round(sum(h) OVER w / sum(n) OVER w, 6) AS precision, round(sum(h) OVER w / (SELECT sum(quality) FROM labels), 6) AS recall
FROM p WINDOW w AS (ORDER BY round)
""".replace("OVER w::BIGINT", "OVER w"))
def e5_selection_curve(t: Tables) -> DataFrame:
    ranked = E.random_order(t.labels, "doc_id", 0, "rank")
    out = E.selection_curve(ranked, "quality", "rank", 10, 20)
    return out.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("""
SELECT p_partkey, CASE WHEN n > 1 THEN l || '_' || n ELSE l END AS label FROM (
  SELECT p_partkey, l, row_number() OVER (PARTITION BY l ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9_]+', '_', 'g') AS l FROM part))
""")
def e6_unique_labels(t: Tables) -> DataFrame:
    return E.unique_labels(t.part, "p_type", ["p_partkey"]).select("p_partkey", "label")


@query("""SELECT 'source' AS column, count(DISTINCT source) AS score FROM documents""")
def e7_pick_column(t: Tables) -> DataFrame:
    return E.pick_column(t.documents, ["lang", "source"])


@query("""
SELECT o_custkey, o_orderkey, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY position) AS n FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders)) WHERE n = 1
""")
def e8_dedupe_first(t: Tables) -> DataFrame:
    return E.dedupe_first(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("position").cast("long").alias("position"))


_GROUPS = """
WITH e AS (SELECT doc_id, source, lang, text, CASE lang WHEN 'en' THEN 'first_pass_reference_label' WHEN 'fr' THEN 'candidate_extension_evidence' WHEN 'de' THEN 'excluded_review_required'
  ELSE 'model_context_only' END AS g FROM documents)
"""


def _conf(t: Tables) -> DataFrame:
    role = F.expr("CASE lang WHEN 'en' THEN 'preferred_reference_label' WHEN 'fr' THEN 'candidate_label_with_review' WHEN 'de' THEN 'exclude_until_provenance_resolved' ELSE 'context' END")
    return t.documents.select("doc_id", role.alias("role"))


@query(_GROUPS + """
SELECT e.doc_id, g AS export_group, CASE g WHEN 'first_pass_reference_label' THEN 'external_crossref' WHEN 'candidate_extension_evidence' THEN 'database_provenance' ELSE 'none' END AS label_source,
  source, coalesce(n, 0) AS evidence_rows FROM e LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) USING (doc_id)
""")
def f1_label_exports(t: Tables) -> DataFrame:
    evidence = D.aggregate_evidence(t.labels, "doc_id", [])
    return P.label_exports(_conf(t), t.documents.select("doc_id", "source"), evidence, "doc_id").select("doc_id", "export_group", "label_source", "source", "evidence_rows")


@query("""
SELECT 'text' AS key_type, text AS key, count(*) AS rows, array_to_string(list_sort(list(DISTINCT source)), '|') AS groups FROM documents WHERE trim(text) <> '' GROUP BY text HAVING count(DISTINCT source) > 1
UNION ALL SELECT 'first_word', w, count(*), array_to_string(list_sort(list(DISTINCT source)), '|') FROM (SELECT source, unnest([string_split(text, ' ')[1]]) AS w FROM documents)
  WHERE lower(trim(w)) NOT IN ('', 'nan', 'none', 'null') GROUP BY w HAVING count(DISTINCT source) > 1
""")
def f2_cross_pool_overlap(t: Tables) -> DataFrame:
    return P.cross_pool_overlap(t.documents, {"text": "text", "first_word": "array(split(text, ' ')[0])"}, "source")


@query(_GROUPS + """
, o AS (SELECT text FROM e GROUP BY text HAVING count(DISTINCT g) > 1)
SELECT doc_id, CASE WHEN g = 'first_pass_reference_label' THEN 'training' WHEN g = 'candidate_extension_evidence' AND text NOT IN (SELECT text FROM o) THEN 'training'
  WHEN g = 'candidate_extension_evidence' THEN 'overlap_review' WHEN g = 'model_context_only' THEN 'context' ELSE 'excluded' END AS pool FROM e
""")
def f3_build_pools(t: Tables) -> DataFrame:
    rows = _conf(t).withColumn("export_group", P.export_group()).join(t.documents.select("doc_id", "text"), "doc_id")
    overlap = P.cross_pool_overlap(rows, {"text": "text"}, "export_group").select(F.col("key").alias("text"))
    return P.build_pools(rows, "export_group", "text", overlap).select("doc_id", "pool")


@query(_BALANCE + """
SELECT o_orderkey AS reaction_id FROM orders JOIN b ON reaction_id = o_orderkey WHERE o_orderstatus = 'O' AND o_orderpriority NOT LIKE '1%' AND formula_balanced AND charge_balanced
""")
def f4_negative_pool(t: Tables) -> DataFrame:
    labels = t.orders.select(
        F.col("o_orderkey").alias("reaction_id"),
        F.expr("if(o_orderstatus = 'O', 'model_context_only', 'first_pass_reference_label')").alias("g"),
        F.expr("if(o_orderpriority like '1%', 'db', 'none')").alias("prov"),
    )
    return P.negative_pool(labels, D.balance_audit(*balance_tables(t)), "reaction_id", "g", ["prov"]).select("reaction_id")


@query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'ACTIVE' FROM (SELECT DISTINCT o_custkey FROM orders)
""")
def f5_merge_registry(t: Tables) -> DataFrame:
    new = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("ACTIVE").alias("c_mktsegment")).distinct()
    return P.merge_registry(t.customer.select("c_custkey", "c_mktsegment"), new, ["c_custkey"])


@query(_BALANCE + """
SELECT o_orderkey AS reaction_id, CASE o_orderstatus WHEN 'F' THEN 'first_pass_reference_label' WHEN 'O' THEN 'candidate_extension_evidence' ELSE 'excluded_review_required' END AS export_group,
  concat_ws('|', CASE WHEN o_totalprice > 100000 THEN 'large' END, CASE WHEN b.formula_balanced AND b.charge_balanced THEN 'balanced' END) AS evidence_items,
  CASE WHEN o_orderstatus = 'F' AND coalesce(b.formula_balanced AND b.charge_balanced, false) THEN 'usable_for_training' WHEN o_orderstatus = 'O' THEN 'review_provenance'
    WHEN o_orderstatus = 'F' THEN 'review' ELSE 'exclude' END AS action FROM orders LEFT JOIN b ON reaction_id = o_orderkey
""")
def f6_validation_matrix(t: Tables) -> DataFrame:
    labels = t.orders.select(
        F.col("o_orderkey").alias("reaction_id"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'first_pass_reference_label' WHEN 'O' THEN 'candidate_extension_evidence' ELSE 'excluded_review_required' END").alias("g"),
        "o_totalprice",
    )
    items = {"large": "o_totalprice > 100000", "balanced": "formula_balanced AND charge_balanced"}
    return P.validation_matrix(labels, D.balance_audit(*balance_tables(t)), "reaction_id", "g", items)
