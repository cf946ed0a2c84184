"""Queries of the scalar functions (B) and of profiles (A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.functions import text as X
from wickerwork.operators.aggregates import split_summary
from wickerwork.operators.splits import structural_split
from wickerwork.plans.registry import Tables, query
from wickerwork.sources.assets import profile, profile_index


@query("""
SELECT 'rows' AS metric, '' AS key, count(*)::VARCHAR AS value FROM orders
UNION ALL SELECT 'columns', '', '6'
UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*)::VARCHAR FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*)::VARCHAR FROM orders GROUP BY 2
""")
def a8_profile(t: Tables) -> DataFrame:
    return profile(t.orders, ["o_orderstatus", "o_orderpriority"]).where("metric <> 'digest'")


@query()
def a8_profile_index(t: Tables) -> DataFrame:
    return profile_index({"orders": t.orders, "part": t.part, "documents": t.documents}, ["lang", "p_brand"])


@query("""
SELECT c_custkey, c_mktsegment,
  CASE WHEN lower(trim(v)) NOT IN ('', 'nan', 'none', 'null') THEN v END AS cleaned,
  coalesce(lower(trim(v)) NOT IN ('', 'nan', 'none', 'null'), false) AS filled
FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN ' none ' WHEN 2 THEN '' ELSE c_name END AS v FROM customer)
""")
def b1_missing_text(t: Tables) -> DataFrame:
    v = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN ' none ' WHEN 2 THEN '' ELSE c_name END")
    df = t.customer.withColumn("v", v).withColumn("filled", X.has_text("v"))
    return X.nullify(df, ["v"]).select("c_custkey", "c_mktsegment", F.col("v").alias("cleaned"), "filled")


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(
    string_split_regex(p_name || ' |nogene; ' || p_brand || '|nan|' || p_name, '[|;]'), lambda x: trim(x)),
  lambda x: lower(x) NOT IN ('', 'nan', 'none', 'null', 'nogene')))), '|') AS parts FROM part
""")
def b2_split_multi(t: Tables) -> DataFrame:
    cell = F.expr("p_name || ' |nogene; ' || p_brand || '|nan|' || p_name")
    return t.part.select("p_partkey", F.array_join(X.split_multi(cell, drop=["nogene"], distinct=True), "|").alias("parts"))


@query("""
SELECT source, array_to_string(list_sort(list(DISTINCT trim(lang))), '|') AS langs FROM documents GROUP BY source
""")
def b3_compact_join(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(X.compact_join(F.collect_set("lang")).alias("langs"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN NULL ELSE c_name END, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END, 'none given') AS label
FROM customer
""")
def b4_first_text(t: Tables) -> DataFrame:
    df = t.customer.withColumns({"a": F.expr("if(c_custkey % 3 > 0, 'null', c_name)"), "b": F.expr("if(c_custkey % 2 = 0, ' ', c_mktsegment)")})
    return df.select("c_custkey", F.coalesce(X.first_text("a", "b"), F.lit("none given")).alias("label"))


@query("""
SELECT doc_id, b AS bucket, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT doc_id, (('0x' || substr(sha256(text), 1, 12))::BIGINT % 100)::INTEGER AS b FROM documents)
""")
def b5_stable_bucket(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.stable_bucket("text").alias("bucket"), X.assign_split("text").alias("split"))


MATERIAL_RULES = [
    {"any_of": ["brass", "copper"], "out": {"class": "soft_metal", "score": 2.0}},
    {"any_of": ["steel"], "when": "p_size > 20", "out": {"class": "large_steel", "score": 3.0}},
    {"any_of": ["steel", "nickel"], "out": {"class": "hard_metal", "score": 1.5}},
]


@query("""
SELECT p_partkey,
  CASE WHEN x LIKE '%brass%' OR x LIKE '%copper%' THEN 'soft_metal' WHEN x LIKE '%steel%' AND p_size > 20 THEN 'large_steel'
    WHEN x LIKE '%steel%' OR x LIKE '%nickel%' THEN 'hard_metal' ELSE 'other' END AS class,
  CASE WHEN x LIKE '%brass%' OR x LIKE '%copper%' THEN 2.0::DOUBLE WHEN x LIKE '%steel%' AND p_size > 20 THEN 3.0
    WHEN x LIKE '%steel%' OR x LIKE '%nickel%' THEN 1.5 ELSE 0 END AS score
FROM (SELECT *, lower(p_name || ' ' || p_type) AS x FROM part)
""")
def b6_classify_first_match(t: Tables) -> DataFrame:
    out = X.classify_first_match(t.part, ["p_name", "p_type"], MATERIAL_RULES, {"class": "other", "score": 0.0})
    return out.select("p_partkey", "class", "score")


@query("""
SELECT d.doc_id, r.c AS class, r.n AS rule_no FROM documents d LEFT JOIN (
  SELECT doc_id, min(n) AS n, arg_min(c, n) AS c FROM (
    SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^0-9a-z_]+'))) AS w FROM documents) x
  JOIN (VALUES (1, 'licensed', 'licence'), (2, 'the', 'english'), (3, 'der', 'german'), (4, 'les', 'french')) AS rules(n, w, c) USING (w) GROUP BY doc_id) r
USING (doc_id)
""")
def b6_classify_by_table(t: Tables) -> DataFrame:
    rules = t.documents.sparkSession.createDataFrame(
        [(1, "licensed", "licence"), (2, "the", "english"), (3, "der", "german"), (4, "les", "french")], "rule_no int, term string, class string"
    )
    return X.classify_by_table(t.documents.select("doc_id", "text"), ["doc_id"], F.col("text"), rules).select("doc_id", "class", "rule_no")


def _formula():
    return F.expr("'C' || (p_partkey % 30 + 1) || 'H' || (p_size + 1) || if(p_partkey % 3 = 0, 'Cl', 'O2') || if(p_partkey % 7 = 0, 'R', '') || if(p_partkey % 11 = 0, 'C2', '')")


@query("""
SELECT p_partkey, p_partkey % 7 <> 0 AS parsed,
  CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 30 + 1 + CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 0 END)::DOUBLE END AS carbon,
  CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END END AS chlorine
FROM part
""")
def b7_b8_formula(t: Tables) -> DataFrame:
    f = _formula()
    return t.part.select("p_partkey", X.parse_formula(f).isNotNull().alias("parsed"), X.element_count(f, "C").alias("carbon"), X.element_count(f, "Cl").alias("chlorine"))


@query("""
SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE value::INTEGER::VARCHAR END AS DOUBLE), 0) AS number,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE len(json_keys(props)) END::INTEGER AS keys
FROM events
""")
def b9_numbers(t: Tables) -> DataFrame:
    number = F.expr("if(event_id % 4 = 0, 'n/a', cast(cast(rint(value) as int) as string))")
    props = F.expr("if(event_id % 5 = 0, '{broken', props)")
    return t.events.select("event_id", X.to_num0(number).alias("number"), X.json_size(props).alias("keys"))


@query("""
SELECT p_partkey, p_partkey::VARCHAR AS chebi, lower(trim(p_name || ' x')) AS name, upper(replace(p_brand, ' ', '')) AS inchikey FROM part
""")
def b10_normalise_ids(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        X.norm_chebi(F.concat(F.lit(" chebi:"), F.col("p_partkey").cast("string"))).alias("chebi"),
        X.norm_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t X "))).alias("name"),
        X.norm_inchikey(F.concat(F.lit(" "), F.lower("p_brand"))).alias("inchikey"),
    )


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'P' || lpad((page_id % 10)::VARCHAR, 1, '0') || 'ABC1' END AS uniprot, (10000 + page_id)::VARCHAR AS pmid,
  CASE WHEN page_id % 3 = 0 THEN '12345' END AS rhea FROM pages
""")
def b11_extract_ids(t: Tables) -> DataFrame:
    raw = F.expr("url || ' PMID: ' || (10000 + page_id) || if(page_id % 2 = 0, ' see P' || (page_id % 10) || 'ABC1.', '') || if(page_id % 3 = 0, ' RHEA:12345', ' RHEA:1')")
    return t.pages.select("page_id", X.extract_ids(raw).alias("i")).select("page_id", "i.uniprot", "i.pmid", "i.rhea")


@query("""
SELECT p_partkey, len(x)::INTEGER AS tokens, array_to_string(x, ' ') AS text FROM (
  SELECT p_partkey, regexp_extract_all('CC(Cl)N%12Br' || repeat('C', p_size) || '[Na]', '%..|Cl|Br|Si|Se|se|As|Na|Li|Ca|Mg|Zn|Fe|Al|@@|.') AS x FROM part)
""")
def b12_smiles_tokens(t: Tables) -> DataFrame:
    smiles = F.expr("'CC(Cl)N%12Br' || repeat('C', p_size) || '[Na]'")
    return t.part.select("p_partkey", F.size(X.tokenize_smiles(smiles)).alias("tokens"), F.array_join(X.tokenize_smiles(smiles), " ").alias("text"))


@query("""
SELECT item_id, CASE WHEN len(w) > 20 THEN array_to_string(list_concat(w[1:10], w[-10:]), ' ') ELSE array_to_string(w, ' ') END AS kept,
  len(w)::INTEGER AS original_length, least(len(w), 20)::INTEGER AS effective_length, len(w) > 20 AS truncated
FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
""")
def b13_head_tail(t: Tables) -> DataFrame:
    cut = t.benchmark.select("item_id", X.head_tail(F.split("text", " "), 20).alias("h"))
    return cut.select("item_id", F.array_join("h.value", " ").alias("kept"), "h.original_length", "h.effective_length", "h.truncated")


@query("""
SELECT item_id, array_to_string(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)), ' ') AS grams
FROM (SELECT item_id, '-' || text || '=' AS p FROM benchmark)
""")
def b14_ngram_words(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(X.ngram_words("text", 3), " ").alias("grams"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'missing_sequence' WHEN p_partkey % 4 = 1 THEN 'invalid_residue'
  WHEN p_partkey % 4 = 2 THEN 'multi_component_smiles' END AS problem FROM part
""")
def b15_validate_pair(t: Tables) -> DataFrame:
    sequence = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'MKJ1' ELSE 'm kv\\n' || repeat('a', p_size) END")
    smiles = F.expr("if(p_partkey % 4 = 2, 'CCO.[Na+]', 'CCO')")
    return t.part.select("p_partkey", X.validate_pair(sequence, smiles).alias("problem"))


@query("""
SELECT s_suppkey, CASE WHEN lo < 0 AND hi > 0 THEN 'reversible' WHEN lo < 0 THEN 'reverse' ELSE 'forward' END AS direction
FROM (SELECT s_suppkey, s_acctbal - 3000 AS lo, s_acctbal + (s_suppkey % 2) * 5000 - 2000 AS hi FROM supplier)
""")
def b16_direction(t: Tables) -> DataFrame:
    df = t.supplier.withColumns({"lo": F.expr("s_acctbal - 3000"), "hi": F.expr("s_acctbal + (s_suppkey % 2) * 5000 - 2000")})
    return df.select("s_suppkey", X.direction("lo", "hi").alias("direction"))


@query("""
SELECT o_orderkey, round(log10(o_totalprice), 6) AS log_value FROM orders WHERE o_totalprice > 0 AND o_orderpriority NOT LIKE '%.%'
""")
def b17_log_labels(t: Tables) -> DataFrame:
    return X.log_labels(t.orders, "o_totalprice", "o_orderpriority").select("o_orderkey", F.round("log_value", 6).alias("log_value"))


@query("""
SELECT page_id, CASE WHEN trim(html) = '' THEN 'missing' WHEN
  length(html) - length(replace(html, '(', '')) = length(html) - length(replace(html, ')', '')) AND
  length(html) - length(replace(html, '[', '')) = length(html) - length(replace(html, ']', '')) AND
  list_bool_and(list_transform(range(1, 10), lambda d: (length(html) - length(replace(html, d::VARCHAR, ''))) % 2 = 0))
  THEN 'parseable' ELSE 'parse_failed' END AS structure_status FROM pages
""")
def b18_structure_status(t: Tables) -> DataFrame:
    return X.structure_status(t.pages, "html").select("page_id", "structure_status")


@query("""
WITH s AS (SELECT lang, source, k, ('0x' || substr(sha256(k), 1, 12))::BIGINT % 100 AS b FROM (SELECT lang, source, 'equation:' || trim(text) AS k FROM documents)),
x AS (SELECT lang, k, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split FROM s)
SELECT 'rows' AS metric, '' AS role, split, count(*) AS value FROM x GROUP BY split
UNION ALL SELECT 'distinct_keys', '', split, count(DISTINCT k) FROM x GROUP BY split
UNION ALL SELECT 'role_rows', lang, split, count(*) FROM x GROUP BY lang, split
UNION ALL SELECT 'crossing_keys', '', '', (SELECT count(*) FROM (SELECT k FROM x GROUP BY k HAVING count(DISTINCT split) > 1))
""")
def h1_d9_structural_split(t: Tables) -> DataFrame:
    return split_summary(structural_split(t.documents, "text", "doc_id"), "split", "split_key", "lang")
