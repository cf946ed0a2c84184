"""Evidence search, contracts, gated scoring and rule-based prioritisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.functions.text import classify_first_match, contains_any, extract_ids, has_text, null_text
from wickerwork.operators.graph import written
from wickerwork.operators.ranking import dedupe_first, top_k_per_group


def _all_text(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return F.lower(F.concat_ws(" ", *(null_text(F.col(c).cast("string")) for c in (cols or df.columns))))


def term_search(tables: Mapping[str, DataFrame], terms: Sequence[str], id_cols: Mapping[str, str]) -> DataFrame:
    """(source, id, hits): rows of any table whose joined columns contain one of the terms, with the terms found."""
    wanted, out = F.array(*(F.lit(t.lower()) for t in terms)), None
    for name, df in tables.items():
        found = df.select(F.lit(name).alias("source"), F.col(id_cols[name]).cast("string").alias("id"), _all_text(df).alias("_t"))
        found = found.select("source", "id", F.filter(wanted, lambda t: F.col("_t").contains(t)).alias("hits")).where(F.size("hits") > 0)
        found = found.withColumn("hits", F.array_join("hits", "|"))
        out = found if out is None else out.unionByName(found)
    return out


def term_search_by_table(df: DataFrame, id_col: str, text: str, terms: DataFrame) -> DataFrame:
    """Many one-word terms as a table(term): (id, hits) by an equi-join of words."""
    words = df.select(id_col, F.explode(F.array_distinct(F.split(F.lower(text), r"\W+"))).alias("term"))
    return words.join(terms.distinct(), "term").groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("hits"))


#: Characters of terms that one automaton holds: the bound of what every task is sent.
TERM_CHARACTERS = 4_000_000


def term_search_contained(df: DataFrame, id_col: str, text: str, terms: DataFrame, limit: int = TERM_CHARACTERS) -> DataFrame:
    """(id, hits): texts that contain any of terms(term), words, phrases or parts of words, case aside, with the terms found in order. All terms
    are sought in one pass by a multi-pattern automaton, whose terms are broadcast. Where they have more than `limit` characters they are
    dealt to several automata, each within it, and the texts are read once more for each. Blank and null terms are left out."""
    wanted = written(terms.select(F.lower("term").alias("term")).where(has_text("term")).distinct())
    parts = max(1, -(-(wanted.agg(F.sum(F.length("term"))).first()[0] or 0) * 5 // (limit * 4)))
    texts, found = df.select(F.col(id_col), F.lower(F.col(text)).alias("_text")), None

    def searching(words: list[str]):
        def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = ahocorasick.Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                yield pd.Series([sorted({w for _, w in automaton.iter(t)}) if t and words else [] for t in batch])

        return F.pandas_udf(search, "array<string>")

    for part in range(parts):
        words = [r.term for r in wanted.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect()]
        own = searching(words)(F.col("_text"))
        found = own if found is None else F.concat(found, own)
    return texts.select(id_col, found.alias("hits")).where(F.size("hits") > 0).withColumn("hits", F.array_join(F.array_sort("hits"), "|"))


def evidence_tier(text: Column, exact: Sequence[str], near: Sequence[str], family: Sequence[str], roles: Sequence[str], error: Column | None = None) -> Column:
    """A to E by exact, near and family terms and role words; Z for a failed query."""
    t = F.lower(text)
    is_exact, is_near, is_family, role = (contains_any(t, [x.lower() for x in xs]) for xs in (exact, near, family, roles))
    acts = contains_any(t, ("reaction", "catalytic", "activity", "enzyme"))
    tier = F.when(is_exact & role & acts, "A").when(is_exact, "B").when(is_near & is_family, "C").when(is_family | is_near, "D").otherwise("E")
    return F.when(error, "Z").otherwise(tier) if error is not None else tier


def enzyme_candidates(proteins: DataFrame, text_cols: Sequence[str], keep: Sequence[str], rules: Sequence[dict]) -> DataFrame:
    """Proteins whose text has one of `keep`, with relevance_class by the rules."""
    rows = proteins.where(contains_any(_all_text(proteins, text_cols), [k.lower() for k in keep]))
    return classify_first_match(rows, text_cols, rules, {"relevance_class": "other"})


def local_verdicts(candidates: DataFrame, matches: DataFrame, enzymes: DataFrame, key: str, class_col: str) -> DataFrame:
    """candidates(key, class) with direct_hits (rows of matches(key)), class_hits (rows of enzymes(class)) and verdict."""
    direct = matches.groupBy(key).agg(F.count("*").alias("direct_hits"))
    classes = enzymes.groupBy(class_col).agg(F.count("*").alias("class_hits"))
    out = candidates.join(direct, key, "left").join(classes, class_col, "left").fillna(0, ["direct_hits", "class_hits"])
    verdict = F.when(F.col("direct_hits") > 0, "direct_local_support").when(F.col("class_hits") > 0, "class_support_only").otherwise("no_local_support")
    return out.withColumn("verdict", verdict)


def _violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items())))
    rows = df.select(key, found.alias("violations")).where(F.size("violations") > 0)
    return rows.withColumn("violations", F.array_join("violations", "|"))


def validate_evidence(df: DataFrame, key: str) -> DataFrame:
    """(key, violations) of evidence records (uniprot, pmid, rhea, record_sha256, grade, automated, review_status, reviewer)."""
    shape = lambda c, p: has_text(c) & ~F.col(c).rlike(p)
    grade = F.col("grade")
    return _violations(
        df,
        key,
        {
            "bad_uniprot": shape("uniprot", r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"),
            "bad_pmid": shape("pmid", r"^[0-9]{4,9}$"),
            "bad_rhea": shape("rhea", r"^RHEA:[0-9]{5}$"),
            "bad_digest": ~F.coalesce("record_sha256", F.lit("")).rlike(r"^[0-9a-f]{64}$"),
            "bad_grade": ~F.coalesce(grade, F.lit("")).isin("A", "B", "C", "D", "E"),
            "automated_grade_too_high": F.col("automated") & grade.isin("A", "B"),
            "grade_needs_approved_review": grade.isin("A", "B") & ~((F.col("review_status") == "approved") & has_text("reviewer")),
        },
    )


def validate_results(df: DataFrame, key: str) -> DataFrame:
    """(key, violations) of prediction results (status, n_predictions, message, metrics, public_reference, dataset_name,
    dataset_version, snapshot_sha256)."""
    ready = F.col("status") == "ready"
    public = F.coalesce("public_reference", F.lit(False)) & has_text("dataset_name") & has_text("dataset_version")
    return _violations(
        df,
        key,
        {
            "unknown_status": ~F.coalesce("status", F.lit("")).isin("ready", "unsupported", "blocked", "error"),
            "ready_without_predictions": ready & (F.coalesce("n_predictions", F.lit(0)) == 0),
            "predictions_without_ready": ~ready & (F.col("n_predictions") > 0),
            "not_ready_without_message": ~ready & ~has_text("message"),
            "metrics_without_public_benchmark": has_text("metrics") & ~public,
            "metrics_without_snapshot_digest": has_text("metrics") & ~F.coalesce("snapshot_sha256", F.lit("")).rlike(r"^[0-9a-f]{64}$"),
        },
    )


def score_pairs(pairs: DataFrame, registry: DataFrame, key: str, predictor: Callable[[pd.DataFrame], Sequence[float]], inputs: Sequence[str]) -> DataFrame:
    """key, status, reason, value. pairs(key, plugin, capability, *inputs), registry(plugin, capability, status). Missing inputs and
    plug-ins that are not registered or not ready are unsupported; only the others reach the predictor, batch by batch;
    a batch that fails is retried row by row and the rows that fail are errors."""
    complete = F.lit(True)
    for c in inputs:
        complete = complete & has_text(F.col(c).cast("string"))
    known = registry.groupBy("plugin", "capability").agg(F.min("status").alias("_rs"))
    gate = pairs.join(known, ["plugin", "capability"], "left").withColumn(
        "reason", F.when(~complete, "missing_inputs").when(F.col("_rs").isNull(), "not_in_registry").when(F.col("_rs") != "ready", "plugin_not_ready")
    )
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                values, reasons = list(map(float, predictor(batch))), [None] * len(batch)
                if len(values) != len(batch):
                    raise ValueError("predictor returned another number of values")
            except Exception:
                values, reasons = [], []
                for i in range(len(batch)):
                    try:
                        values.append(float(list(predictor(batch.iloc[i : i + 1]))[0]))
                        reasons.append(None)
                    except Exception as problem:
                        values.append(None)
                        reasons.append(f"{type(problem).__name__}: {problem}"[:200])
            status = ["ready" if r is None else "error" for r in reasons]
            yield pd.DataFrame({key: batch[key], "status": status, "reason": reasons, "value": values})

    schema = f"{key} {kind}, status string, reason string, value double"
    scored = gate.where("reason IS NULL").select(key, *inputs).mapInPandas(run, schema)
    refused = gate.where("reason IS NOT NULL").select(key, F.lit("unsupported").alias("status"), "reason", F.lit(None).cast("double").alias("value"))
    return scored.unionByName(refused)


def requested_readiness(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """plugin, capability, requests, readiness of what pairs ask for."""
    asked = pairs.groupBy("plugin", "capability").agg(F.count("*").alias("requests"))
    out = asked.join(registry.groupBy("plugin", "capability").agg(F.min("status").alias("_s")), ["plugin", "capability"], "left")
    return out.withColumn("readiness", F.when(F.col("_s").isNull(), "not_registered").when(F.col("_s") == "ready", "ready").otherwise("not_ready")).drop("_s")


UNIPROT = (
    "primaryAccession string, organism struct<scientificName:string>, genes array<struct<geneName:struct<value:string>>>, "
    "proteinDescription struct<recommendedName:struct<fullName:struct<value:string>, ecNumbers:array<struct<value:string>>>>"
)


def flatten_uniprot(df: DataFrame, record: str) -> DataFrame:
    """accession, organism, genes, name, ec_numbers of UniProt JSON records; a malformed record gives nulls."""
    r = F.from_json(record, UNIPROT)
    name = r["proteinDescription"]["recommendedName"]
    return df.withColumn("_r", r).select(
        *df.columns,
        F.col("_r.primaryAccession").alias("accession"),
        F.col("_r.organism.scientificName").alias("organism"),
        F.array_distinct(F.transform("_r.genes", lambda g: g["geneName"]["value"])).alias("genes"),
        name["fullName"]["value"].alias("name"),
        F.array_distinct(F.transform(name["ecNumbers"], lambda e: e["value"])).alias("ec_numbers"),
    )


def collect_external(records: DataFrame, panel: DataFrame, text_cols: Sequence[str], keywords: Sequence[str], cap: int) -> DataFrame:
    """records(reaction_id, entry, priority, ...) with one of the keywords, one a (reaction, entry), the first `cap` a reaction; panel
    rows fill in for reactions and entries that are not there. origin: external or panel."""
    found = records.where(contains_any(_all_text(records, text_cols), [k.lower() for k in keywords]))
    one = top_k_per_group(found, ["reaction_id", "entry"], ["priority", *text_cols], 1, "_n").drop("_n")
    capped = top_k_per_group(one, "reaction_id", ["priority", "entry"], cap, "_n").drop("_n").withColumn("origin", F.lit("external"))
    fill = panel.join(capped, ["reaction_id", "entry"], "left_anti").withColumn("origin", F.lit("panel"))
    return capped.unionByName(fill, allowMissingColumns=True)


def family_sanity(df: DataFrame, text_cols: Sequence[str], rules: Sequence[dict]) -> DataFrame:
    """sanity_class, sanity_reason, sanity_score by a rule pack."""
    return classify_first_match(df, text_cols, rules, {"class": "unclassified", "reason": "no_rule", "score": 0.0}, prefix="sanity_")


TIER_BONUS = {"B": 0.7, "C": 0.4, "D": 0.2}


def engineering_score(sanity: Column, log_kcat_km: Column, pu: Column, flux: Column, external: Column, tier: Column) -> Column:
    bonus = F.lit(0.0)
    for t, x in TIER_BONUS.items():
        bonus = F.when(tier == t, x).otherwise(bonus)
    zero = F.lit(0.0)
    return (
        2 * F.coalesce(sanity, zero) + F.coalesce(log_kcat_km, zero) + F.coalesce(pu, zero) + F.least(F.coalesce(flux, zero), F.lit(0.4))
        + F.when(external, 1.0).otherwise(0.0) + bonus
    )


def p450_feasibility(df: DataFrame, packs: Mapping[str, tuple[Sequence[str], Sequence[dict], Mapping]]) -> DataFrame:
    """df(sanity_score, log_kcat_km, ...) with the outputs of the rule packs (name -> (text columns, rules, defaults)), which must give
    redox_score, expression_score, substrate_score and host_score, system_class, feasibility and action."""
    for text_cols, rules, default in packs.values():
        df = classify_first_match(df, text_cols, rules, dict(default))
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("sanity_score", "log_kcat_km", "redox_score", "expression_score", "substrate_score", "host_score")]
    df = df.withColumn("feasibility", F.round(sum(parts[1:], parts[0]), 6))
    system, f = F.col("system_class"), F.col("feasibility")
    action = (
        F.when((system == "self_sufficient") & (f >= 13), "test_first")
        .when((system == "fungal_cyp52") & (f >= 13), "test_with_cpr")
        .when((system == "mammalian") & (F.col("substrate_score") >= 4), "engineer_n_terminus")
        .when(system == "endogenous", "overexpress")
        .when(f >= 10, "second_round")
        .otherwise("deprioritise")
    )
    return df.withColumn("action", action)


def construct_matrix(designs: DataFrame, text_cols: Sequence[str], modules: Mapping[str, tuple[Sequence[dict], str]], key: Sequence[str], order: Sequence) -> DataFrame:
    """designs(score, risk, ...) with one text column a module (name -> (rules giving 'text', default)), one row a key, design_id by
    place in the whole order (dropped repeats leave gaps) and priority_tier."""
    for name, (rules, default) in modules.items():
        designs = classify_first_match(designs, text_cols, [{**r, "out": {name: r["out"]["text"]}} for r in rules], {name: default})
    kept = dedupe_first(designs, key, order, "_p")
    tier = (
        F.when((F.col("score") >= 24) & (F.col("risk") == "medium"), 1)
        .when((F.col("score") >= 22) & F.col("risk").isin("medium", "medium_high_activity"), 2)
        .when(F.col("score") >= 20, 3)
        .otherwise(4)
    )
    return kept.withColumns({"design_id": F.concat(F.lit("DESIGN:"), F.lpad(F.col("_p").cast("string"), 4, "0")), "priority_tier": tier}).drop("_p")


def apply_rules(rules: DataFrame, observed: DataFrame) -> DataFrame:
    """rules(rule_id, metric, operator, expected, result), observed(metric, value): matched and the result of rules that hold."""
    joined = rules.join(observed, "metric", "left")
    holds = (
        F.when(F.col("operator") == "equals", F.abs(F.col("value") - F.col("expected")) < 1e-12)
        .when(F.col("operator") == "greater_than_or_equal", F.col("value") >= F.col("expected"))
        .otherwise(F.lit(False))
    )
    return joined.withColumn("matched", F.coalesce(holds, F.lit(False))).withColumn("outcome", F.when(F.col("matched"), F.col("result")))


def complete_routes(routes: DataFrame, candidates: DataFrame) -> DataFrame:
    """routes(route, reactions array), candidates(reaction_id, enzyme): status draft only if every reaction has an enzyme, else the
    missing reactions."""
    steps = routes.select("route", F.explode("reactions").alias("reaction_id"))
    have = candidates.groupBy("reaction_id").agg(F.count("*").alias("enzymes"))
    per = steps.join(have, "reaction_id", "left").groupBy("route").agg(
        F.count("*").alias("steps"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("enzymes").isNull(), F.col("reaction_id").cast("string")))), "|").alias("missing")
    )
    return per.withColumn("status", F.when(F.col("missing") == "", "draft").otherwise("incomplete"))


def structured_evidence(records: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct rows of stable identifiers found in a text, review_status pending."""
    ids = records.select(*keep, extract_ids(text).alias("i")).select(*keep, "i.*")
    names = [c for c in ids.columns if c not in keep]
    return ids.where(F.coalesce(*(F.col(c) for c in names)).isNotNull()).dropDuplicates().withColumn("review_status", F.lit("pending"))


def flatten_scenarios(df: DataFrame, scenarios: str) -> DataFrame:
    """One row a scenario and check of an array of struct<name, checks array<struct<name, value>>>."""
    return df.select(*(c for c in df.columns if c != scenarios), F.explode(scenarios).alias("s")).select("*", F.explode("s.checks").alias("c")).withColumns(
        {"scenario": F.col("s.name"), "check": F.col("c.name"), "value": F.col("c.value")}
    ).drop("s", "c")


def compare_routes(df: DataFrame, route: str, metric: str, system: str, value: str, systems: Sequence[str]) -> DataFrame:
    """route, metric and one column a system."""
    return df.groupBy(route, metric).pivot(system, list(systems)).agg(F.max(value))


def page_status(df: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """df with found_keywords and page_status: empty, all_keywords, some_keywords, no_keywords."""
    wanted = F.array(*(F.lit(k.lower()) for k in keywords))
    found = F.filter(wanted, lambda k: F.lower(F.coalesce(F.col(text), F.lit(""))).contains(k))
    n = F.size(found)
    status = F.when(~has_text(text), "empty").when(n == len(keywords), "all_keywords").when(n > 0, "some_keywords").otherwise("no_keywords")
    return df.withColumns({"found_keywords": F.array_join(found, "|"), "page_status": status})


def benchmark_check(observed: DataFrame, expected: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, observed, expected, abs_error, within."""
    joined = expected.select(key, F.col("value").alias("expected")).join(observed.select(key, F.col("value").alias("observed")), key, "left")
    error = F.abs(F.col("observed") - F.col("expected"))
    return joined.select(key, "observed", "expected", error.alias("abs_error"), F.coalesce(error <= tolerance, F.lit(False)).alias("within"))


def overlap_eligibility(bench: DataFrame, train: DataFrame, dataset: str, content: str) -> DataFrame:
    """dataset, rows, overlapping, eligible: a benchmark that shares contents with the training data is not eligible."""
    seen = train.select(F.sha2(content, 256).alias("_h")).distinct().withColumn("_o", F.lit(True))
    joined = bench.withColumn("_h", F.sha2(content, 256)).join(seen, "_h", "left")
    out = joined.groupBy(dataset).agg(F.count("*").alias("rows"), F.count_if("_o").alias("overlapping"))
    return out.withColumn("eligible", F.col("overlapping") == 0)
