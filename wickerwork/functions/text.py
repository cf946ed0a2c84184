"""Scalar functions on text, maps and numbers, as columns (no Python in the hot path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = ("", "nan", "none", "null")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_text(c: Column | str) -> Column:
    """Whether c holds more than a marker of a missing value."""
    c = _c(c)
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*MISSING)


def null_text(c: Column | str) -> Column:
    return F.when(has_text(c), _c(c))


def nullify(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns with markers of missing values turned into real nulls."""
    return df.withColumns({c: null_text(c) for c in cols})


def split_multi(c: Column | str, seps: str = "|;", drop: Sequence[str] = (), distinct: bool = False) -> Column:
    """Parts of a multi-valued cell, trimmed, without missing ones and those in drop (case folded); distinct: sorted too."""
    parts = F.transform(F.split(_c(c), "[" + "".join("\\" + s for s in seps) + "]"), lambda x: F.trim(x))
    unwanted = [*MISSING, *(d.lower() for d in drop)]
    parts = F.coalesce(F.filter(parts, lambda x: ~F.lower(x).isin(*unwanted)), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(parts)) if distinct else parts


def compact_join(c: Column | str, sep: str = "|") -> Column:
    """Sorted distinct non-missing entries of an array, joined."""
    kept = F.filter(_c(c), lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin(*MISSING))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.trim(x)))), sep)


def first_text(*cols: Column | str) -> Column:
    return F.coalesce(*(null_text(c) for c in cols))


def stable_bucket(c: Column | str, buckets: int = 100) -> Column:
    """Same bucket on every engine: the first 12 hex digits of the SHA-256, modulo buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(_c(c), 256), 1, 12), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def assign_split(c: Column | str, cuts: Sequence[tuple[int, str]] = ((80, "train"), (90, "dev")), rest: str = "test") -> Column:
    bucket, out = stable_bucket(c), None
    for upto, name in cuts:
        out = (F if out is None else out).when(bucket < upto, name)
    return F.lit(rest) if out is None else out.otherwise(rest)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def classify_first_match(df: DataFrame, text_cols: Sequence[str], rules: Sequence[dict], default: dict, prefix: str = "") -> DataFrame:
    """First rule that matches gives its outputs. A rule: any_of (substrings of the columns' joined, lower-cased text), when
    (a SQL condition on df; both must hold where given), out (name -> value). default: the same outputs."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols)))
    hits = []
    for rule in rules:
        hit = contains_any(text, [t.lower() for t in rule["any_of"]]) if "any_of" in rule else F.lit(True)
        hits.append(hit & F.coalesce(F.expr(rule["when"]), F.lit(False)) if "when" in rule else hit)
    new = {}
    for name, value in default.items():
        out = None
        for hit, rule in zip(hits, rules, strict=True):
            out = (F if out is None else out).when(hit, F.lit(rule["out"].get(name, value)))
        new[prefix + name] = F.lit(value) if out is None else out.otherwise(F.lit(value))
    return df.withColumns(new)


def classify_by_table(df: DataFrame, key: Sequence[str], text: Column, rules: DataFrame) -> DataFrame:
    """Many rules as a table (rule_no, term, class): the class of the lowest rule_no whose term is a word of the text. Terms
    meet words in an equi-join, so the rule table may be large. key identifies a row of df."""
    words = df.select(*key, F.explode(F.array_distinct(F.split(F.lower(text), r"\W+"))).alias("term"))
    best = words.join(rules, "term").groupBy(*key).agg(F.min_by("class", "rule_no").alias("class"), F.min("rule_no").alias("rule_no"))
    return df.join(best, list(key), "left")


_ATOM = "([A-Z][a-z]?)([0-9]*\\.?[0-9]*)"


def parse_formula(c: Column | str) -> Column:
    """Molecular formula to map<element, count>; null for generic ones (R, brackets, signs) or if anything is left over."""
    c = F.trim(_c(c))
    parts = F.struct(c.alias("c"), F.regexp_extract_all(c, F.lit(_ATOM), 1).alias("elements"), F.regexp_extract_all(c, F.lit(_ATOM), 2).alias("numbers"))

    def atoms(p: Column) -> Column:
        elements, numbers = p["elements"], p["numbers"]
        pairs = F.zip_with(elements, numbers, lambda e, n: F.struct(e.alias("e"), F.when(n == "", 1.0).otherwise(n.try_cast("double")).alias("n")))
        keys = F.array_distinct(elements)
        counts = F.transform(keys, lambda k: F.aggregate(F.filter(pairs, lambda x: x["e"] == k), F.lit(0.0), lambda a, x: a + x["n"]))
        whole = F.array_join(F.zip_with(elements, numbers, lambda e, n: F.concat(e, n)), "") == p["c"]
        usable = (p["c"] != "") & whole & ~p["c"].rlike(r"R(?![a-z])|[()\[\]+\-]")
        return F.when(usable, F.map_from_arrays(keys, counts))

    return F.transform(F.array(parts), atoms)[0]  # in a lambda the two extractions run once a formula, else once for each mention


def element_count(c: Column | str, element: str = "C") -> Column:
    """Atoms of one element; 0 if the formula lacks it, null if it cannot be parsed."""
    atoms = parse_formula(c)
    return F.when(atoms.isNotNull(), F.coalesce(F.try_element_at(atoms, F.lit(element)), F.lit(0.0)))


def to_num0(c: Column | str) -> Column:
    return F.coalesce(F.trim(_c(c).cast("string")).try_cast("double"), F.lit(0.0))


def json_map(c: Column | str) -> Column:
    return F.from_json(_c(c), "map<string,double>", {"mode": "PERMISSIVE"})


def json_size(c: Column | str) -> Column:
    """Keys of a JSON object of numbers; 0 for null or malformed text."""
    parsed = json_map(c)
    return F.when(parsed.isNull(), 0).otherwise(F.size(parsed))


def norm_chebi(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(F.upper(_c(c)), r"^\s*(CHEBI:)?\s*|\D+$", ""), F.lit(""))


def norm_name(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(c), r"\s+", " ")))


def norm_inchikey(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(_c(c), r"\s+", ""))


# Shapes of public identifiers.
ID_SHAPES = {
    "uniprot": r"\b([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})\b",
    "pmid": r"(?i)\bPMID:?\s*([0-9]{4,9})\b",
    "rhea": r"(?i)\bRHEA:([0-9]{5})\b",
    "ymdb": r"\b(YMDB[0-9]+)\b",
    "pubchem_cid": r"(?i)\bCID:?\s*([0-9]+)\b",
}


def extract_ids(c: Column | str) -> Column:
    """Struct with the first identifier of each shape in the text, null where there is none."""
    first = lambda shape: F.nullif(F.regexp_extract(_c(c), shape, 1), F.lit(""))
    return F.struct(*(first(shape).alias(name) for name, shape in ID_SHAPES.items()))


def tokenize_smiles(c: Column | str) -> Column:
    """%nn as three characters, the two-character tokens, else single characters."""
    two = "|".join(("Cl", "Br", "Si", "Se", "se", "As", "Na", "Li", "Ca", "Mg", "Zn", "Fe", "Al", "@@"))
    return F.regexp_extract_all(_c(c), F.lit(f"(%..|{two}|.)"), 1)


def head_tail(tokens: Column | str, limit: int) -> Column:
    """An array cut to `limit` entries by taking them from both ends, with what was done: value, original_length,
    effective_length, truncated, strategy."""
    a = _c(tokens)
    n = F.size(a)
    head = limit // 2
    cut = F.concat(F.slice(a, 1, head), F.slice(a, -(limit - head), limit - head))
    long = n > limit
    return F.struct(
        F.when(long, cut).otherwise(a).alias("value"),
        n.alias("original_length"),
        F.least(n, F.lit(limit)).alias("effective_length"),
        long.alias("truncated"),
        F.when(long, "head_tail").otherwise("none").alias("strategy"),
    )


def head_tail_text(c: Column | str, limit: int) -> Column:
    c = _c(c)
    head = limit // 2
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, head), F.substring(c, -(limit - head), limit - head))).otherwise(c)


def applicability(sequence: Column | str, smiles: Column | str, sequence_limit: int = 1000, token_limit: int = 218) -> Column:
    """Truncation of a sequence and a SMILES; out_of_domain where either was cut."""
    letters = F.split(_c(sequence), "")
    s, t = head_tail(letters, sequence_limit), head_tail(tokenize_smiles(smiles), token_limit)
    return F.struct(s.alias("sequence"), t.alias("smiles"), (s["truncated"] | t["truncated"]).alias("out_of_domain"))


def ngram_words(c: Column | str, n: int = 3, start: str = "-", end: str = "=") -> Column:
    """Overlapping n-character words of the padded text."""
    padded = F.concat(F.lit(start), _c(c), F.lit(end))
    return F.when(F.length(padded) < n, F.array(padded)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    )


RESIDUES = "ACDEFGHIKLMNPQRSTVWYXBZUO"


def norm_sequence(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(_c(c), r"\s+", ""))


def validate_pair(sequence: Column | str, smiles: Column | str) -> Column:
    """Null if a pair can be scored, else the reason it cannot."""
    s, m = norm_sequence(sequence), F.trim(_c(smiles))
    return (
        F.when(s.isNull() | (s == ""), "missing_sequence")
        .when(~s.rlike(f"^[{RESIDUES}]+$"), "invalid_residue")
        .when(m.isNull() | (m == ""), "missing_smiles")
        .when(m.contains("."), "multi_component_smiles")
    )


def direction(lower: Column | str, upper: Column | str) -> Column:
    return F.when((_c(lower) < 0) & (_c(upper) > 0), "reversible").when(_c(lower) < 0, "reverse").otherwise("forward")


def log_labels(df: DataFrame, value: str, smiles: str, out: str = "log_value") -> DataFrame:
    """Rows with a positive value and a single-component structure, with log10 of the value."""
    return df.where((F.col(value) > 0) & ~F.coalesce(F.col(smiles), F.lit("")).contains(".")).withColumn(out, F.log10(value))


def brackets_balance(c: Column | str) -> Column:
    """Default structure check: brackets pair up and each ring digit occurs an even number of times."""
    c = _c(c)
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    ok = (count("(") == count(")")) & (count("[") == count("]")) & (F.trim(c) != "")
    for d in "123456789":
        ok = ok & (count(d) % 2 == 0)
    return ok


def structure_status(df: DataFrame, col: str, validator=None) -> DataFrame:
    """df with structure_status: missing, parseable or parse_failed. validator: a function of a Column giving a boolean Column
    (a pandas_udf, say); it runs once on each distinct structure. Default: brackets_balance."""
    distinct = df.select(F.col(col).alias("_s")).where(has_text("_s")).distinct()
    checked = distinct.withColumn("_ok", (validator or brackets_balance)(F.col("_s")))
    joined = df.join(checked, df[col] == F.col("_s"), "left")
    status = F.when(~has_text(col), "missing").when(F.coalesce("_ok", F.lit(False)), "parseable").otherwise("parse_failed")
    return joined.withColumn("structure_status", status).drop("_s", "_ok")
