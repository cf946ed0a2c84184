"""Small cases with known results."""

import hashlib
import math

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wickerwork.functions import text as X
from wickerwork.operators import acquisition, aggregates, evidence, governance, joins, learning, omics, pools, ranking, splits
from wickerwork.operators.graph import connected_components


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "formula, want",
    [("C6H12O6", {"C": 6, "H": 12, "O": 6}), ("CH3Cl", {"C": 1, "H": 3, "Cl": 1}), ("C2H5C", {"C": 3, "H": 5}), ("C1.5H2", {"C": 1.5, "H": 2}), ("C6R", None), ("(CH2)2", None), ("", None), ("c6", None), ("Rb2", {"Rb": 2})],
)
def test_formula(spark, formula, want):
    assert one(spark, X.parse_formula("f"), f=formula) == want


def test_element_count_tells_carbon_from_chlorine(spark):
    assert one(spark, X.element_count("f", "C"), f="ClCa") == 0.0


def test_bucket_is_the_same_everywhere(spark):
    assert one(spark, X.stable_bucket("k"), k="equation:a") == 32


def test_head_tail_and_applicability(spark):
    r = one(spark, X.applicability("s", "m"), s="A" * 1001, m="C" * 219)
    assert r.sequence.effective_length == 1000 and len(r.sequence.value) == 1000 and r.sequence.truncated and r.sequence.strategy == "head_tail"
    assert r.smiles.effective_length == 218 and r.out_of_domain
    r = one(spark, X.applicability("s", "m"), s="AC", m="CO")
    assert not r.out_of_domain and r.sequence.value == ["A", "C"]
    assert one(spark, X.head_tail_text("s", 5), s="abcdefgh") == "abfgh"


def test_smiles(spark):
    assert one(spark, X.tokenize_smiles("m"), m="CCl%12Br@@") == ["C", "Cl", "%12", "Br", "@@"]
    assert one(spark, X.validate_pair("s", "m"), s="mk v", m="CCO.[Na+]") == "multi_component_smiles"
    assert one(spark, X.validate_pair("s", "m"), s="mk v", m="CCO") is None


def test_ngram_words_of_short_text(spark):
    assert one(spark, X.ngram_words("s"), s="") == ["-="] and one(spark, X.ngram_words("s"), s="AB") == ["-AB", "AB="]


def test_json_and_numbers(spark):
    assert one(spark, X.json_size("j"), j='{"a": 1, "b": 2}') == 2 and one(spark, X.json_size("j"), j="[") == 0
    assert one(spark, X.to_num0("j"), j=" 1e3 ") == 1000.0 and one(spark, X.to_num0("j"), j="x") == 0.0


def test_ids(spark):
    r = one(spark, X.extract_ids("t"), t="P12345, PMID 12345678, RHEA:12345 and YMDB00123; CID 42")
    assert (r.uniprot, r.pmid, r.rhea, r.ymdb, r.pubchem_cid) == ("P12345", "12345678", "12345", "YMDB00123", "42")


def test_char_wb_ngrams(spark):
    assert one(spark, learning.char_wb_ngrams(F.col("t"), 3, 5), t="Ab c") == [" ab", "ab ", " ab ", " c "]


def test_pseudo_groups_share_a_cluster(spark):
    rows = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "id string")
    tokens = spark.createDataFrame([("P1", "protein_cluster:C"), ("P2", "protein_cluster:C"), ("P2", "x")], "id string, token string")
    got = {r.id: r for r in splits.unified_group_split(rows, "id", tokens).collect()}
    assert got["P1"].group_key == got["P2"].group_key != got["P3"].group_key and got["P1"].split == got["P2"].split


def test_compartments_do_not_change_the_signature(spark):
    stoich = spark.createDataFrame([("A", "a_c", -1.0), ("A", "b_c", 1.0), ("B", "a_m", 1.0), ("B", "b_c", -1.0), ("D", "a_c", -1.0), ("D", "a_m", 1.0)], "reaction_id string, met_id string, coeff double")
    mets = spark.createDataFrame([("a_c", "AAAA", ""), ("a_m", "AAAA", ""), ("b_c", "", "CCO")], "met_id string, inchikey string, smiles string")
    ids = mets.select("met_id", governance.canonical_id([("inchikey", "inchikey", True), ("smiles", "smiles", True)]).alias("c")).select("met_id", "c.*")
    equations = spark.createDataFrame([("A", "x"), ("B", "y"), ("D", "transport"), ("E", None)], "reaction_id string, equation string")
    got = {r.reaction_id: r.signature for r in governance.reaction_signature(stoich, ids, equations).collect()}
    assert got["A"] == got["B"] and got["D"].startswith("equation:") and got["E"] is None


def test_leaking_frame_fails(spark):
    df = spark.createDataFrame([("train", "C1"), ("test", "C1"), ("test", "C2")], "split string, cluster string")
    r = {r.dimension: r for r in splits.leakage_audit(df, {"cluster": "cluster", "none": "nullif(cluster, cluster)"}).collect()}
    assert (r["cluster"].status, r["cluster"].crossing, r["cluster"].examples, r["none"].status) == ("fail", 1, "C1", "missing")


def test_recall_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.2), (0, 0.7)], "label int, score double")
    assert learning.recall_threshold(df, "label", "score", 2 / 3).first()["threshold"] == 0.8


def test_metrics_and_bootstrap(spark):
    rows = [(1, 0.9, "a"), (0, 0.4, "a"), (1, 0.7, "b"), (0, 0.7, "b"), (1, 0.3, "c"), (0, 0.1, "d")]
    df = spark.createDataFrame(rows, "label int, score double, g string")
    m = learning.pu_metrics(df, "label", "score", 0.65).first()
    assert m.recall == pytest.approx(2 / 3) and m.unlabeled_positive_rate == pytest.approx(1 / 3)
    pairs = [(a, b) for y, a, _ in rows if y for z, b, _ in rows if not z]
    assert m.roc_auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert m.average_precision == pytest.approx(1 / 3 * (1 + 2 / 3 + 3 / 5))
    ci = {r.metric: r for r in learning.group_bootstrap(df, "g", "label", "score", 0.65, 60).collect()}
    assert ci["recall"].low <= m.recall <= ci["recall"].high and set(ci) >= {"roc_auc", "brier"}


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.1), (1, 1.0)], "y int, s double")
    assert {r.bin: r.rows for r in learning.calibration(df, "y", "s").collect()} == {2: 1, 1: 1, 9: 1}


def test_pu_sample_sizes(spark):
    df = spark.createDataFrame([(i, int(i < 20)) for i in range(100)], "id int, y int")
    s = learning.pu_sample(df, "id", "y", 0, 0.6, 1)
    assert s.where("y = 1").count() == 20 and s.where("y = 0").count() == 12


def test_pu_bagging_ranks_hidden_positives(spark):
    df = spark.createDataFrame([(i, int(i % 10 < 2), [float(i % 10 < 4), (i * 7 % 13) / 13.0]) for i in range(300)], "id int, y int, x array<double>")
    df = df.withColumn("x", array_to_vector("x"))
    got = learning.fit_pu_bagging(df, "id", "x", "y", members=3)(df).groupBy((F.col("id") % 10 < 4).alias("p")).agg(F.avg("score").alias("s"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    got = {r.p: r for r in got.collect()}
    assert got[True].s > got[False].s + 0.2 and got[False].lo >= 0 and got[True].hi <= 1


def test_expected_improvement(spark):
    df = spark.createDataFrame([(0.8, 0.1), (0.7, 0.2), (0.5, 0.05), (0.5, 0.0)], "m double, s double")
    got = [r.e for r in df.select(acquisition.expected_improvement(F.col("m"), F.col("s"), 0.7).alias("e")).collect()]
    z = (0.8 - 0.7 - 0.01) / 0.1
    want = 0.09 * 0.5 * (1 + math.erf(z / math.sqrt(2))) + 0.1 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    assert got[0] == pytest.approx(want, abs=1e-9) and got[0] > got[2] and got[3] == 0


def test_select_excludes(spark):
    stats = spark.createDataFrame([(i, float(i % 3)) for i in range(6)], "item int, bald double")
    got = acquisition.select_candidates(stats, "item", "bald", 3, spark.createDataFrame([(2,)], "item int")).collect()
    assert [(r.item, r["rank"]) for r in got] == [(5, 1), (1, 2), (4, 3)]
    assert acquisition.round_summary([spark.createDataFrame(got)]).first().best_score == 2.0


def test_waterfall(spark):
    rows = spark.createDataFrame([(1, "C2H6O", ""), (2, "", ""), (3, "C3H8O", ""), (4, "", ""), (5, "", "CCO"), (6, "", "")], "row_id int, formula string, structure string")
    cand = [(1, "mnx", "CCO", "C2H6O", True), (2, "mnx", "CCO", "", True), (2, "mnx", "COC", "", True), (3, "mnx", "CCO", "C2H6O", True), (4, "mnx", "INVALID", "", False), (4, "name", "O", "", True)]
    candidates = spark.createDataFrame([(*c, "db") for c in cand], "row_id int, tier string, structure string, formula string, parseable boolean, source string")
    got = {r.row_id: (r.decision, r.reason, r.structure) for r in governance.waterfall_resolve(rows, candidates, ["ymdb", "mnx", "name"]).collect()}
    assert got == {1: ("mapped", "mapped", "CCO"), 2: ("manual_review", "multiple_structures_for_key", None), 3: ("manual_review", "formula_conflict", None), 4: ("mapped", "mapped", "O"), 6: ("unresolved", "local_key_space_exhausted", None)}


def test_references(spark):
    reactions = spark.createDataFrame([("r1",), ("r1",)], "id string")
    compounds, routes = spark.createDataFrame([("c",)], "id string"), spark.createDataFrame([("x", ["r1", "MISSING"])], "id string, reactions array<string>")
    pairs = spark.createDataFrame([("p", "r1", "nope")], "id string, reaction string, compound string")
    got = {r.message for r in joins.check_references(reactions, compounds, routes, pairs).collect()}
    assert got == {"duplicate reaction id r1", "route x references unknown reaction MISSING", "pair p references unknown compound nope"}


def test_gated_scoring(spark):
    pairs = spark.createDataFrame([(1, "p", "c", "ACD"), (2, "p", "c", ""), (3, "q", "c", "A"), (4, "p", "c", "fail")], "id int, plugin string, capability string, sequence string")
    registry = spark.createDataFrame([("p", "c", "ready")], "plugin string, capability string, status string")

    def predictor(batch):
        if "fail" in set(batch["sequence"]):
            raise ValueError("bad")
        return [float(len(s)) for s in batch["sequence"]]

    got = {r.id: r for r in evidence.score_pairs(pairs, registry, "id", predictor, ["sequence"]).collect()}
    assert (got[1].status, got[1].value) == ("ready", 3.0) and got[2].reason == "missing_inputs" and got[3].reason == "not_in_registry"
    assert got[4].status == "error" and "bad" in got[4].reason


def test_evidence_contract(spark):
    ok = dict(k=1, uniprot="P12345", pmid="12345678", rhea="RHEA:12345", record_sha256="a" * 64, grade="A", automated=False, review_status="approved", reviewer="x")
    rows = [ok, ok | dict(k=2, automated=True), ok | dict(k=3, review_status="pending"), ok | dict(k=4, record_sha256="short", grade="F")]
    got = dict(evidence.validate_evidence(spark.createDataFrame(rows), "k").collect())
    assert got == {2: "automated_grade_too_high", 3: "grade_needs_approved_review", 4: "bad_digest|bad_grade"}


def test_incomplete_route(spark):
    routes = spark.createDataFrame([("x", ["r1", "r2"]), ("y", ["r1"])], "route string, reactions array<string>")
    got = {r.route: (r.status, r.missing) for r in evidence.complete_routes(routes, spark.createDataFrame([("r1", "e")], "reaction_id string, enzyme string")).collect()}
    assert got == {"x": ("incomplete", "r2"), "y": ("draft", "")}


def test_balance(spark):
    stoich = spark.createDataFrame([("ok", "a", -2.0), ("ok", "b", 1.0), ("bad", "a", -1.0), ("bad", "b", 1.0), ("gap", "a", 1.0), ("gap", "z", -1.0)], "reaction_id string, met_id string, coeff double")
    mets = spark.createDataFrame([("a", "H", 1), ("b", "H2", 2), ("z", "", None)], "met_id string, formula string, charge int")
    got = {r.reaction_id: r for r in aggregates.balance_audit(stoich, mets).collect()}
    assert got["ok"].formula_balanced and got["ok"].charge_balanced and got["ok"].element_imbalance is None
    assert not got["bad"].formula_balanced and got["bad"].element_imbalance == {"H": 1.0} and got["bad"].charge_imbalance == 1.0
    assert got["gap"].missing_formula == ["z"] and not got["gap"].formula_balanced and not got["gap"].charge_balanced


def test_audit_parses_formulas_once_dealt_out(spark, sf):
    from __spark_entry__ import QUERIES

    plan = QUERIES["d5_balance_audit"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsing = [i for i, line in enumerate(plan) if "regexp_extract_all" in line]
    assert len(parsing) == 2 and all("Repartition" in plan[i + 1] for i in parsing)
    # Each of the two mentions of a column of matches is one extraction, and no filter repeats them.
    assert all(plan[i].count("regexp_extract_all") == 2 for i in parsing)


def test_remediation_audits_once(spark, sf):
    from __spark_entry__ import QUERIES

    assert "lineitem" not in QUERIES["g11_remediation_action"](spark, sf)._jdf.queryExecution().toString()


def test_audit_of_repeated_compounds(spark):
    stoich = spark.createDataFrame([("r", "a", 1.0), ("r", "a", 1.0), ("r", None, 1.0), ("r", "gone", -1.0)], "reaction_id string, met_id string, coeff double")
    mets = spark.createDataFrame([("a", "", 1), ("a", "C(", None), ("a", "C", 1)], "met_id string, formula string, charge int")
    r = aggregates.balance_audit(stoich, mets).first()
    assert (r.missing_formula, r.unparsable_formula, r.missing_charge) == (["a", "gone"], ["a"], ["a", "gone"])
    assert r.element_imbalance == {"C": 2.0} and r.charge_imbalance == 4.0


def test_metabolite_gate(spark):
    df = spark.createDataFrame([("m", "", "", "", "", "")], "met_id string, smiles string, formula string, mapping_source string, source_database string, source_record_id string")
    r = governance.metabolite_quality(df).first()
    assert (r.availability, r.review, r.reason_code, r.source) == ("unresolved", "not_reviewed", "missing_formula_and_structure", "unrecorded")
    r = governance.metabolite_quality(df.withColumn("smiles", F.lit("CCO")), parser_available=False).first()
    assert (r.structure_status, r.availability, r.review) == ("parser_unavailable", "blocked", "review_required")


def test_remediation(spark):
    rows = [("ok", True, True, ["m"], []), ("out", False, True, ["sn_1"], ["r"]), ("map", False, False, ["sn_1", "gone"], []), ("rev", False, True, [], ["bad"]), ("none", False, None, [], [])]
    audit = spark.createDataFrame(rows, "reaction_id string, formula_balanced boolean, charge_balanced boolean, missing_formula array<string>, unparsable_formula array<string>")
    mets = spark.createDataFrame([("sn_1", "x", "R"), ("r", "Protein", "C6"), ("bad", None, "C("), ("m", "", "nan")], "met_id string, name string, formula string")
    got = {r.reaction_id: (r.action, r.issue_classes) for r in governance.remediation_action(audit, mets).collect()}
    template, macro, unmapped = "underground_template_metabolite_missing_formula", "macromolecule_or_redox_carrier_formula", "missing_formula_no_local_mapping"
    assert got == {
        "ok": ("training_ready_mass_charge_balanced", unmapped),
        "out": ("exclude_from_structure_sensitive_training_or_apply_curated_carrier_rules", f"{macro}|{template}"),
        "map": ("requires_external_structure_mapping", f"{unmapped}|{template}"),
        "rev": ("requires_manual_balance_review", "other_formula_issue"),
        "none": ("requires_manual_balance_review", ""),
    }


def test_components_and_unions(spark):
    got = dict(connected_components(spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)], "a string, b string")).collect())
    assert got["c"] == "a" and got["y"] == "x" and {got[f"n{i:02}"] for i in range(31)} == {"n00"}


def test_clusters_of_planted_near_copies(spark):
    base = hashlib.shake_256(b"x").hexdigest(150)
    rows = [(1, base), (2, base[:150] + "zz" + base[150:]), (3, base), (4, base[::-1]), (5, "")]
    got = dict(splits.similarity_clusters(spark.createDataFrame(rows, "id int, t string"), "id", "t", 5, 0.7, 0.7).collect())
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and got[5] == 5


def test_global_rank_without_gaps(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    got = ranking.global_rank(df, ["v"]).collect()
    assert sorted((r.v, r["rank"]) for r in got) == [(i, i + 1) for i in range(500)]


def test_global_rank_of_a_stored_table_loses_no_row(spark, tmp_path):
    """A scan is pruned to what each reading needs: range bounds sampled twice would differ and ranks would be lost."""
    df = spark.range(0, 60_000, 1, 12).select(F.xxhash64("id").alias("v"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("pad"))
    df.write.parquet(f"{tmp_path}/t")
    r = ranking.global_rank(spark.read.parquet(f"{tmp_path}/t"), ["v"]).agg(F.count("pad"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(r) == (60_000, 60_000, 1, 60_000)


def test_running_sums(spark):
    rows = [(g, i * 7 % 50, float(i)) for g in ("a", "b", None) for i in range(50)]
    got = ranking.running_sums(spark.createDataFrame(rows, "g string, k int, x double").repartition(7), ["g"], [F.desc("k")], {"s": "x"})
    assert {(r.g, r.k): r.s for r in got.collect()} == {(g, k): sum(x for h, j, x in rows if h == g and j >= k) for g, k, _ in rows}
    plain = ranking.running_sums(spark.range(100), [], ["id"], {"s": "id"})
    assert {r.id: r.s for r in plain.collect()} == {i: i * (i + 1) // 2 for i in range(100)}
    assert ranking.running_sums(spark.range(0), [], ["id"], {"s": "id"}).count() == 0 and ranking.global_rank(spark.range(0), ["id"]).count() == 0


def test_expression(spark):
    wide = spark.createDataFrame([("g1", "10.5", ""), ("g2", "x", "3")], "gene string, a string, b string")
    long = omics.expression_long(wide, "gene", ["a", "b"])
    assert {(r.gene_id, r.condition): r.value for r in long.collect()} == {("g1", "a"): 10.5, ("g1", "b"): 0.0, ("g2", "a"): 0.0, ("g2", "b"): 3.0}
    assert omics.expression_wide(long, ["a", "b"]).count() == 2


def test_pseudo_rules(spark):
    expr = spark.createDataFrame([(g, c, v) for g, vs in {"g1": [1, 2, 3, 4], "g2": [2, 4, 6, 8], "g3": [4, 3, 2, 1], "g4": [1, 1, 1, 1]}.items() for c, v in enumerate(map(float, vs))], "gene_id string, condition int, value double")
    stoich = spark.createDataFrame([("bare", "m"), ("r1", "m"), ("r2", "m")], "reaction_id string, met_id string")
    gpr = spark.createDataFrame([("r1", "g1"), ("r2", "g2")], "reaction_id string, gene_id string")
    got = omics.infer_pseudo_gpr(expr, stoich, gpr).collect()
    assert {(r.reaction_id, r.gene_id) for r in got} == {("bare", "g1"), ("bare", "g2")}
    pairs = spark.createDataFrame([("g1", "g3"), ("g1", "g4")], "gene_a string, gene_b string")
    assert {r.gene_b: round(r.correlation, 9) for r in omics.gene_correlation(expr, pairs).collect()} == {"g3": -1.0, "g4": 0.0}


def test_pools_merge(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert dict(pools.merge_registry(old, spark.createDataFrame([("b", 2)], "k string, v int"), ["k"]).collect()) == {"a": 1, "b": 2}


def test_benchmark(spark):
    exp = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, value double")
    obs = spark.createDataFrame([("a", 1.00001), ("b", 2.1)], "k string, value double")
    assert {r.k: r.within for r in evidence.benchmark_check(obs, exp, "k", 5e-5).collect()} == {"a": True, "b": False, "c": False}


def test_heads(spark):
    rows = [(i, [float(i % 2), float(i % 3 == 0)], i % 2 if i % 5 else None, i % 3, float(i % 2) * 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, e array<float>, b int, c int, r double")
    models = learning.fit_heads(df, "id", "e", {"b": ("b", "binary"), "c": ("c", "multiclass"), "r": ("r", "regression")})
    out = learning.apply_heads(df, "e", models).collect()
    assert sum(r.b_pred == r.id % 2 for r in out) > 110 and all(abs(sum(r.c_prob) - 1) < 1e-6 for r in out)
