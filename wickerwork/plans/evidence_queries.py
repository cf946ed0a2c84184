"""Queries of evidence search, contracts and prioritisation (K)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.operators import evidence as K
from wickerwork.plans.registry import Tables, query


@query("""
WITH x AS (SELECT 'customer' AS source, c_custkey::VARCHAR AS id, lower(concat_ws(' ', c_custkey, c_name, c_nationkey, c_mktsegment)) AS t FROM customer
  UNION ALL SELECT 'part', p_partkey::VARCHAR, lower(concat_ws(' ', p_name, p_brand, p_type)) FROM part)
SELECT source, id, concat_ws('|', CASE WHEN t LIKE '%machinery%' THEN 'machinery' END, CASE WHEN t LIKE '%brass%' THEN 'brass' END, CASE WHEN t LIKE '%brand#13%' THEN 'brand#13' END) AS hits FROM x
WHERE t LIKE '%machinery%' OR t LIKE '%brass%' OR t LIKE '%brand#13%'
""")
def k1_term_search(t: Tables) -> DataFrame:
    tables = {"customer": t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "part": t.part.select("p_partkey", "p_name", "p_brand", "p_type")}
    return K.term_search(tables, ["Machinery", "brass", "brand#13"], {"customer": "c_custkey", "part": "p_partkey"})


@query("""
SELECT doc_id, array_to_string(list_sort(list(w)), '|') AS hits FROM (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^0-9a-z_]+'))) AS w FROM documents)
WHERE w IN ('license', 'licensed', 'copyright', 'token') GROUP BY 1
""")
def k1_term_table_search(t: Tables) -> DataFrame:
    terms = t.documents.sparkSession.createDataFrame([(x,) for x in ("license", "licensed", "copyright", "token")], "term string")
    return K.term_search_by_table(t.documents, "doc_id", "text", terms)


@query("""
WITH w AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark),
t AS (SELECT DISTINCT array_to_string(w[1:2], ' ') AS t FROM w UNION SELECT DISTINCT array_to_string(w[3:5], ' ') FROM w UNION SELECT DISTINCT w[6] FROM w)
SELECT doc_id, array_to_string(list_sort(list(t)), '|') AS hits FROM (SELECT doc_id, lower(text) AS x FROM documents) JOIN t ON contains(x, t) WHERE trim(t) <> '' GROUP BY 1
""")
def k1_phrase_search(t: Tables) -> DataFrame:
    """Two words, three words and one word of every benchmark text, sought in all documents."""
    w = F.split(F.lower("text"), " ")
    phrases = F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 3, 3), " "), F.get(w, F.lit(5)))
    return K.term_search_contained(t.documents, "doc_id", "text", t.benchmark.select(F.explode(phrases).alias("term")))


@query("""
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'Z' WHEN e AND r AND a THEN 'A' WHEN e THEN 'B' WHEN n AND f THEN 'C' WHEN n OR f THEN 'D' ELSE 'E' END AS tier FROM (
  SELECT doc_id, x LIKE '%licensed%' AS e, x LIKE '%license%' AS n, x LIKE '%work%' AS f, x LIKE '%under%' AS r, x LIKE '%reaction%' OR x LIKE '%catalytic%' OR x LIKE '%activity%' OR x LIKE '%enzyme%' AS a FROM (SELECT doc_id, lower(text) AS x FROM documents))
""")
def k2_evidence_tier(t: Tables) -> DataFrame:
    tier = K.evidence_tier(F.col("text"), ["licensed"], ["license"], ["work"], ["under"], F.col("doc_id") % 17 == 0)
    return t.documents.select("doc_id", tier.alias("tier"))


@query("""
SELECT p_partkey, CASE WHEN x LIKE '%plated%' THEN 'plated' WHEN x LIKE '%steel%' THEN 'metal' ELSE 'other' END AS relevance_class FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS x FROM part) WHERE x LIKE '%steel%' OR x LIKE '%gear%'
""")
def k3_enzyme_candidates(t: Tables) -> DataFrame:
    rules = [{"any_of": ["plated"], "out": {"relevance_class": "plated"}}, {"any_of": ["steel"], "out": {"relevance_class": "metal"}}]
    return K.enzyme_candidates(t.part, ["p_name", "p_type"], ["steel", "gear"], rules).select("p_partkey", "relevance_class")


@query("""
SELECT c_custkey, coalesce(o.n, 0) AS direct_hits, coalesce(s.n, 0) AS class_hits, CASE WHEN o.n > 0 THEN 'direct_local_support' WHEN s.n > 0 THEN 'class_support_only' ELSE 'no_local_support' END AS verdict
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey
""")
def k4_local_verdicts(t: Tables) -> DataFrame:
    matches = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    enzymes = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"))
    return K.local_verdicts(t.customer, matches, enzymes, "c_custkey", "c_nationkey").select("c_custkey", "direct_hits", "class_hits", "verdict")


@query("""
SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 5 = 0 THEN 'bad_pmid' END, CASE WHEN o_orderkey % 7 = 0 THEN 'bad_digest' END, CASE WHEN a AND g IN ('A', 'B') THEN 'automated_grade_too_high' END,
  CASE WHEN g IN ('A', 'B') AND NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0) THEN 'grade_needs_approved_review' END) AS violations
FROM (SELECT *, chr(64 + substr(o_orderpriority, 1, 1)::INTEGER) AS g, o_orderkey % 2 = 0 AS a FROM orders)
WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR (a AND g IN ('A', 'B')) OR (g IN ('A', 'B') AND NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0))
""")
def k5_validate_evidence(t: Tables) -> DataFrame:
    df = t.orders.select(
        "o_orderkey",
        F.lit("P12345").alias("uniprot"),
        F.expr("if(o_orderkey % 5 = 0, 'PM1', '12345678')").alias("pmid"),
        F.lit("RHEA:12345").alias("rhea"),
        F.expr("if(o_orderkey % 7 = 0, 'xyz', sha2('a', 256))").alias("record_sha256"),
        F.expr("char(64 + cast(substr(o_orderpriority, 1, 1) as int))").alias("grade"),
        F.expr("o_orderkey % 2 = 0").alias("automated"),
        F.expr("if(o_orderstatus = 'F', 'approved', 'pending')").alias("review_status"),
        F.expr("if(o_custkey % 2 = 0, 'ann', '')").alias("reviewer"),
    )
    return K.validate_evidence(df, "o_orderkey")


@query("""
SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown_status' END, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'ready_without_predictions' END,
  CASE WHEN o_orderstatus <> 'F' AND o_custkey % 2 > 0 THEN 'predictions_without_ready' END, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 = 0 THEN 'not_ready_without_message' END) AS violations
FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR (o_orderstatus = 'F' AND o_custkey % 2 = 0) OR (o_orderstatus <> 'F' AND (o_custkey % 2 > 0 OR o_orderkey % 3 = 0))
""")
def k6_validate_results(t: Tables) -> DataFrame:
    df = t.orders.select(
        "o_orderkey",
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'blocked' ELSE 'odd' END").alias("status"),
        (F.col("o_custkey") % 2).cast("int").alias("n_predictions"),
        F.expr("if(o_orderkey % 3 = 0, '', 'why')").alias("message"),
        F.lit("").alias("metrics"),
        F.lit(False).alias("public_reference"),
        F.lit("").alias("dataset_name"),
        F.lit("").alias("dataset_version"),
        F.lit("").alias("snapshot_sha256"),
    )
    return K.validate_results(df, "o_orderkey")


def _vowel_share(batch: pd.DataFrame) -> list[float]:
    return [sum(map(text.count, "aeiou")) / len(text) for text in batch["text"]]


@query("""
SELECT item_id, CASE WHEN item_id % 4 = 0 OR item_id % 3 > 0 THEN 'unsupported' ELSE 'ready' END AS status, CASE WHEN item_id % 4 = 0 THEN 'missing_inputs' WHEN item_id % 3 = 1 THEN 'not_in_registry' WHEN item_id % 3 = 2 THEN 'plugin_not_ready' END AS reason,
  CASE WHEN item_id % 4 > 0 AND item_id % 3 = 0 THEN round(length(regexp_replace(text, '[^aeiou]', '', 'g')) / length(text), 6) END AS value FROM benchmark
""")
def k7_score_pairs(t: Tables) -> DataFrame:
    pairs = t.benchmark.select(
        "item_id",
        F.expr("CASE item_id % 3 WHEN 0 THEN 'vowels' WHEN 1 THEN 'absent' ELSE 'broken' END").alias("plugin"),
        F.lit("score").alias("capability"),
        F.expr("if(item_id % 4 = 0, ' ', text)").alias("text"),
    )
    registry = t.benchmark.sparkSession.createDataFrame([("vowels", "score", "ready"), ("broken", "score", "blocked")], "plugin string, capability string, status string")
    return K.score_pairs(pairs, registry, "item_id", _vowel_share, ["text"]).withColumn("value", F.round("value", 6))


@query("""
SELECT o_orderpriority AS plugin, o_orderstatus AS capability, count(*) AS requests, CASE WHEN o_orderstatus = 'P' THEN 'not_registered' WHEN o_orderpriority LIKE '1%' THEN 'ready' ELSE 'not_ready' END AS readiness FROM orders GROUP BY 1, 2, 4
""")
def k8_requested_readiness(t: Tables) -> DataFrame:
    asked = t.orders.select(F.col("o_orderpriority").alias("plugin"), F.col("o_orderstatus").alias("capability"))
    registry = asked.where("capability <> 'P'").distinct().withColumn("status", F.expr("if(plugin like '1%', 'ready', 'blocked')"))
    return K.requested_readiness(asked, registry)


@query("""
SELECT p_partkey, 'P' || p_partkey AS accession, p_brand AS organism, CASE WHEN p_partkey % 2 = 0 THEN 'gA' ELSE 'gA|gB' END AS genes, p_name AS name, '1.1.1.' || p_size AS ec_numbers FROM part
""")
def k9_flatten_uniprot(t: Tables) -> DataFrame:
    record = F.to_json(
        F.struct(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("primaryAccession"),
            F.struct(F.col("p_brand").alias("scientificName")).alias("organism"),
            F.expr("array(named_struct('geneName', named_struct('value', 'gA')), named_struct('geneName', named_struct('value', if(p_partkey % 2 = 0, 'gA', 'gB'))))").alias("genes"),
            F.struct(
                F.struct(F.struct(F.col("p_name").alias("value")).alias("fullName"), F.expr("array(named_struct('value', '1.1.1.' || p_size))").alias("ecNumbers")).alias("recommendedName")
            ).alias("proteinDescription"),
        )
    )
    flat = K.flatten_uniprot(t.part.select("p_partkey", record.alias("record")), "record")
    return flat.select("p_partkey", "accession", "organism", F.array_join("genes", "|").alias("genes"), "name", F.array_join("ec_numbers", "|").alias("ec_numbers"))


@query("""
WITH r AS (SELECT l_suppkey AS reaction_id, l_partkey AS entry, min(l_linenumber) AS priority FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reaction_id ORDER BY priority, entry) AS n FROM r) WHERE n <= 3)
SELECT reaction_id, entry, 'external' AS origin FROM c UNION ALL SELECT s_suppkey, s_suppkey, 'panel' FROM supplier WHERE (s_suppkey, s_suppkey) NOT IN (SELECT reaction_id, entry FROM c)
""")
def k10_collect_external(t: Tables) -> DataFrame:
    records = t.lineitem.select(F.col("l_suppkey").alias("reaction_id"), F.col("l_partkey").alias("entry"), F.col("l_linenumber").alias("priority"), F.concat(F.lit("flag_"), "l_returnflag").alias("note"))
    panel = t.supplier.select(F.col("s_suppkey").alias("reaction_id"), F.col("s_suppkey").alias("entry"))
    return K.collect_external(records, panel, ["note"], ["flag_R"], 3).select("reaction_id", "entry", "origin")


_SANITY = [
    {"any_of": ["brass"], "out": {"class": "fit", "reason": "soft", "score": 3.0}},
    {"any_of": ["steel"], "when": "p_size < 10", "out": {"class": "doubtful", "reason": "small", "score": 1.0}},
]


@query("""
SELECT p_partkey, CASE WHEN x LIKE '%brass%' THEN 'fit' WHEN x LIKE '%steel%' AND p_size < 10 THEN 'doubtful' ELSE 'unclassified' END AS sanity_class,
  round(2 * CASE WHEN x LIKE '%brass%' THEN 3 WHEN x LIKE '%steel%' AND p_size < 10 THEN 1 ELSE 0 END + log10(p_retailprice) + p_size / 100.0 + least(p_partkey % 7 / 10.0, 0.4) + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END
    + CASE p_partkey % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.4 ELSE 0.2 END, 6) AS score FROM (SELECT *, lower(p_type) AS x FROM part)
""")
def k11_k12_engineering_score(t: Tables) -> DataFrame:
    df = K.family_sanity(t.part, ["p_type"], _SANITY)
    c = F.col
    score = K.engineering_score(
        c("sanity_score"), F.log10("p_retailprice"), c("p_size") / 100.0, (c("p_partkey") % 7) / 10.0, c("p_partkey") % 2 == 0, F.expr("CASE p_partkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE 'D' END")
    )
    return df.select("p_partkey", "sanity_class", F.round(score, 6).alias("score"))


@query("""
WITH s AS (SELECT p_partkey, p_size % 8 AS sanity, CASE WHEN x LIKE '%brass%' THEN 'self_sufficient' WHEN x LIKE '%steel%' THEN 'mammalian' ELSE 'fungal_cyp52' END AS system_class, CASE WHEN x LIKE '%brass%' THEN 4 ELSE 2 END AS redox,
  CASE WHEN p_size > 25 THEN 4.0 ELSE 1.0 END AS sub, CASE WHEN p_name LIKE '%widget%' THEN 2.0 ELSE 1.0 END AS host FROM (SELECT *, lower(p_type) AS x FROM part))
SELECT p_partkey, system_class, (sanity + redox + 1 + sub + host)::DOUBLE AS feasibility, CASE WHEN system_class = 'self_sufficient' AND sanity + redox + 1 + sub + host >= 13 THEN 'test_first' WHEN system_class = 'fungal_cyp52' AND sanity + redox + 1 + sub + host >= 13 THEN 'test_with_cpr'
  WHEN system_class = 'mammalian' AND sub >= 4 THEN 'engineer_n_terminus' WHEN sanity + redox + 1 + sub + host >= 10 THEN 'second_round' ELSE 'deprioritise' END AS action FROM s
""")
def k13_p450_feasibility(t: Tables) -> DataFrame:
    packs = {
        "system": (["p_type"], [{"any_of": ["brass"], "out": {"system_class": "self_sufficient", "redox_score": 4.0}}, {"any_of": ["steel"], "out": {"system_class": "mammalian"}}], {"system_class": "fungal_cyp52", "redox_score": 2.0, "expression_score": 1.0}),
        "substrate": (["p_name"], [{"when": "p_size > 25", "out": {"substrate_score": 4.0}}], {"substrate_score": 1.0}),
        "host": (["p_name"], [{"any_of": ["widget"], "out": {"host_score": 2.0}}], {"host_score": 1.0}),
    }
    df = t.part.withColumns({"sanity_score": (F.col("p_size") % 8).cast("double"), "log_kcat_km": F.lit(0.0)})
    return K.p450_feasibility(df, packs).select("p_partkey", "system_class", "feasibility", "action")


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS pos FROM part), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY pos) AS n FROM o) WHERE n = 1)
SELECT 'DESIGN:' || lpad(pos::VARCHAR, greatest(4, 4), '0') AS design_id, p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'strong promoter' ELSE 'weak promoter' END AS promoter,
  CASE WHEN p_size >= 24 AND p_partkey % 2 = 0 THEN 1 WHEN p_size >= 22 THEN 2 WHEN p_size >= 20 THEN 3 ELSE 4 END AS priority_tier FROM k
""")
def k14_construct_matrix(t: Tables) -> DataFrame:
    designs = t.part.withColumns({"score": F.col("p_size"), "risk": F.expr("if(p_partkey % 2 = 0, 'medium', 'medium_high_activity')")})
    modules = {"promoter": ([{"any_of": ["steel"], "out": {"text": "strong promoter"}}], "weak promoter")}
    out = K.construct_matrix(designs, ["p_type"], modules, ["p_brand", "p_size"], [F.desc("p_size"), "p_partkey"])
    return out.select("design_id", "p_partkey", "promoter", "priority_tier")


@query("""
SELECT p_partkey AS rule_id, n IS NOT NULL AND CASE WHEN p_partkey % 2 = 0 THEN n = p_size ELSE n >= p_size END AS matched, CASE WHEN n IS NOT NULL AND CASE WHEN p_partkey % 2 = 0 THEN n = p_size ELSE n >= p_size END THEN p_brand END AS outcome
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
""")
def k15_apply_rules(t: Tables) -> DataFrame:
    observed = t.lineitem.groupBy(F.col("l_partkey").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_partkey").alias("metric"), F.expr("if(p_partkey % 2 = 0, 'equals', 'greater_than_or_equal')").alias("operator"), F.col("p_size").cast("double").alias("expected"), F.col("p_brand").alias("result"))
    return K.apply_rules(rules, observed).select("rule_id", "matched", "outcome")


@query("""
SELECT l_orderkey AS route, count(*) AS steps, coalesce(array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR) FILTER (p_size IS NULL)), '|'), '') AS missing, CASE WHEN count(*) FILTER (p_size IS NULL) = 0 THEN 'draft' ELSE 'incomplete' END AS status
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON p_partkey = l_partkey GROUP BY 1
""")
def k16_complete_routes(t: Tables) -> DataFrame:
    routes = t.lineitem.groupBy(F.col("l_orderkey").alias("route")).agg(F.collect_set("l_partkey").alias("reactions"))
    return K.complete_routes(routes, t.part.where("p_size > 5").select(F.col("p_partkey").alias("reaction_id"), F.col("p_name").alias("enzyme")))


@query("SELECT DISTINCT (o_custkey + 10000)::VARCHAR AS pmid, 'pending' AS review_status FROM orders WHERE o_orderstatus = 'F'")
def k17_structured_evidence(t: Tables) -> DataFrame:
    text = F.expr("if(o_orderstatus = 'F', 'see PMID: ' || (o_custkey + 10000), 'nothing here')")
    return K.structured_evidence(t.orders.select(text.alias("x")), "x").select("pmid", "review_status")


@query("SELECT l_orderkey, l_returnflag AS scenario, 'line' || l_linenumber AS check, l_quantity AS value FROM lineitem")
def k18_flatten_scenarios(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct(F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_quantity").alias("value"))).alias("checks"))
    nested = per.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), "checks")).alias("s"))
    return K.flatten_scenarios(nested, "s").select("l_orderkey", "scenario", "check", "value")


@query("""
SELECT o_orderpriority AS route, o_orderstatus AS metric, max(o_totalprice) FILTER (o_custkey % 2 = 0) AS even, max(o_totalprice) FILTER (o_custkey % 2 = 1) AS odd FROM orders GROUP BY 1, 2
""")
def k18_compare_routes(t: Tables) -> DataFrame:
    df = t.orders.select(F.col("o_orderpriority").alias("route"), F.col("o_orderstatus").alias("metric"), F.expr("if(o_custkey % 2 = 0, 'even', 'odd')").alias("system"), "o_totalprice")
    return K.compare_routes(df, "route", "metric", "system", "o_totalprice", ["even", "odd"])


@query("""
SELECT page_id, concat_ws('|', CASE WHEN h LIKE '%<nav>%' THEN '<nav>' END, CASE WHEN h LIKE '%<table>%' THEN '<table>' END) AS found_keywords,
  CASE WHEN h LIKE '%<nav>%' AND h LIKE '%<table>%' THEN 'all_keywords' WHEN h LIKE '%<nav>%' OR h LIKE '%<table>%' THEN 'some_keywords' ELSE 'no_keywords' END AS page_status FROM (SELECT page_id, lower(html) AS h FROM pages)
""")
def k19_page_status(t: Tables) -> DataFrame:
    return K.page_status(t.pages, "html", ["<nav>", "<TABLE>"]).select("page_id", "found_keywords", "page_status")


@query("""
SELECT p_partkey, o AS observed, p_size::DOUBLE AS expected, abs(o - p_size) AS abs_error, coalesce(abs(o - p_size) <= 5, false) AS within FROM part LEFT JOIN (SELECT l_partkey, round(avg(l_quantity), 4) AS o FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
""")
def k20_benchmark_check(t: Tables) -> DataFrame:
    observed = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))
    return K.benchmark_check(observed, t.part.select("p_partkey", F.col("p_size").cast("double").alias("value")), "p_partkey", 5.0)


@query("""
SELECT source, count(*) AS rows, count(*) FILTER (text IN (SELECT text FROM documents WHERE source = 'src0')) AS overlapping, count(*) FILTER (text IN (SELECT text FROM documents WHERE source = 'src0')) = 0 AS eligible FROM documents GROUP BY 1
""")
def k20_overlap_eligibility(t: Tables) -> DataFrame:
    return K.overlap_eligibility(t.documents, t.documents.where("source = 'src0'"), "source", "text")
