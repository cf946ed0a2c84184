"""Leakage-safe splits: hash keys, sequence and cluster sets, similarity clusters and connected groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.functions.text import assign_split, has_text, stable_bucket
from wickerwork.operators.graph import connected_components, written
from wickerwork.operators.similarity import cut_forest, similarity_links, spanning_forest
from wickerwork.operators.skew import HEAVY_KEYS, LEAST, lookup_join


def _with_split(df: DataFrame, key: str = "split_key") -> DataFrame:
    return df.withColumns({"split_bucket": stable_bucket(key), "split": assign_split(key)})


def structural_split(df: DataFrame, equation: str, id_col: str) -> DataFrame:
    """df with split_key (the equation, else the id), split_bucket and split."""
    key = F.when(has_text(equation), F.concat(F.lit("equation:"), F.trim(equation))).otherwise(F.concat(F.lit("reaction_id:"), F.col(id_col).cast("string")))
    return _with_split(df.withColumn("split_key", key))


def _set_split(df: DataFrame, id_col: str, ids: DataFrame, token: Column, prefix: str, equation: str | None) -> DataFrame:
    sets = ids.groupBy(id_col).agg(F.array_sort(F.collect_set(token)).alias("_t"))
    joined = df.join(sets, id_col, "left")
    fallback = F.concat(F.lit("reaction_id:"), F.col(id_col).cast("string"))
    if equation:
        fallback = F.when(has_text(equation), F.concat(F.lit("equation:"), F.trim(equation))).otherwise(fallback)
    known = F.size(F.coalesce("_t", F.array().cast("array<string>"))) > 0
    key = F.when(known, F.concat(F.lit(prefix + ":"), F.sha2(F.array_join("_t", "|"), 256))).otherwise(fallback)
    return _with_split(joined.withColumns({"split_key": key, "fallback": ~known})).drop("_t")


def exact_sequence_split(df: DataFrame, id_col: str, ids: DataFrame, seqs: DataFrame, equation: str | None = None) -> DataFrame:
    """ids(id, seq_id), seqs(seq_id, sequence): rows with the same set of sequences get the same key; fallback says which rows
    had none and were keyed by equation or id."""
    tokens = ids.join(seqs.select("seq_id", F.sha2("sequence", 256).alias("_h")), "seq_id")
    return _set_split(df, id_col, tokens, F.col("_h"), "seqset", equation)


def cluster_split(df: DataFrame, id_col: str, ids: DataFrame, member_rep: DataFrame, equation: str | None = None) -> DataFrame:
    """ids(id, member), member_rep(member, representative): the key is the set of representatives."""
    tokens = ids.join(member_rep, "member")
    return _set_split(df, id_col, tokens, F.col("representative").cast("string"), "cluster_set", equation)


def similarity_clusters(df: DataFrame, id_col: str, text: str, k: int = 5, identity: float = 0.5, coverage: float = 0.5) -> DataFrame:
    """(member, representative): texts linked by shingle sets of that identity and coverage, directly or through others, are represented by
    the smallest id; every similar pair counts (see similarity_links). Others represent themselves."""
    linked = connected_components(similarity_links(df, id_col, text, k, identity, coverage).select("a", "b"))
    members = df.select(F.col(id_col).alias("member")).distinct()
    return members.join(linked.select(F.col("node").alias("member"), "component"), "member", "left").select("member", F.coalesce("component", "member").alias("representative"))


def threshold_sweep(df: DataFrame, id_col: str, text: str, thresholds: Sequence[float], coverage: float = 0.5, k: int = 5) -> DataFrame:
    """threshold, clusters, rows, train, dev, test, crossing_keys: the links down to the lowest threshold make one spanning forest, which is
    cut at every threshold; all thresholds are counted in one pass."""
    links = similarity_links(df, id_col, text, k, min(thresholds), coverage, tight=max(thresholds))
    cut = cut_forest(spanning_forest(links), thresholds)
    members = df.select(F.col(id_col).alias("node")).distinct().select("node", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    clusters = members.join(cut, ["threshold", "node"], "left").withColumn("representative", F.coalesce("component", "node").cast("string"))
    keyed = _with_split(clusters.withColumn("split_key", F.concat(F.lit("cluster_set:"), F.sha2("representative", 256))))
    counts = [F.count_if(F.col("split") == s) for s in ("train", "dev", "test")]
    per = keyed.groupBy("threshold", "split_key").agg(F.count("*").alias("rows"), *(c.alias(s) for c, s in zip(counts, ("train", "dev", "test"), strict=True)), F.count_distinct("split").alias("splits"))
    return per.groupBy("threshold").agg(
        F.count("*").alias("clusters"), *(F.sum(c).alias(c) for c in ("rows", "train", "dev", "test")), F.count_if(F.col("splits") > 1).alias("crossing_keys")
    )


def unified_group_split(rows: DataFrame, id_col: str, tokens: DataFrame) -> DataFrame:
    """rows with group_key and split: rows that share a token, directly or through others, are one group. tokens(id, token); a row
    without a token is a group of its own. The key is the hash of the group's smallest token.

    The graph is over ids: of a token that several ids have, each is linked to the smallest. Tokens meet by 16 bytes of their SHA-256, and
    their own text moves only as the smallest of an id."""
    named = tokens.where(F.col("token").isNotNull() & F.col(id_col).isNotNull())
    least_tokens = named.groupBy(id_col).agg(F.min("token").alias("own"))
    keyed = named.select(F.unhex(F.substring(F.sha2("token", 256), 1, 32)).alias("h"), F.col(id_col).alias("a"))
    shared = written(keyed.groupBy("h").agg(F.min("a").alias("b"), F.max("a").alias("z"), F.count("*").alias("n")).where("b <> z").select("h", "b", "n"))
    limit = max(LEAST, (shared.agg(F.sum("n")).first()[0] or 0) // HEAVY_KEYS)
    heavy, centres = shared.where(F.col("n") > limit).select("h"), shared.select("h", "b")
    met = lookup_join(keyed, centres, "h", heavy=heavy) if heavy.limit(1).count() else keyed.join(centres, "h")
    linked = connected_components(written(met.where("a <> b").select("a", "b").distinct()))

    lone = F.concat(F.lit("reaction_id:"), F.col(id_col).cast("string"))
    ids = rows.select(id_col).where(F.col(id_col).isNotNull()).union(least_tokens.select(id_col)).distinct().join(least_tokens, id_col, "left")
    ids = ids.join(linked.withColumnRenamed("node", id_col), id_col, "left").select(id_col, F.coalesce("own", lone).alias("own"), F.coalesce("component", id_col).alias("component"))
    ids = written(ids)
    anchors = ids.join(ids.groupBy("component").agg(F.min("own").alias("anchor")), "component").select(id_col, "anchor")
    out = rows.join(anchors, id_col).withColumn("group_key", F.concat(F.lit("unified:"), F.sha2("anchor", 256)))
    return out.withColumns({"split_bucket": stable_bucket("group_key"), "split": assign_split("group_key")}).drop("anchor")


def group_tokens(rows: DataFrame, id_col: str, lists: Mapping[str, str], equation: str, signature: str, substrates: str) -> DataFrame:
    """(id, token) of rows: prefix:value for each of lists (prefix -> array column), reaction:<signature> unless the equation is empty,
    substrates:<hash> where there is one."""
    prefixed = lambda p, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(p + ":"), x))
    parts = [prefixed(p, c) for p, c in lists.items()]
    parts.append(F.array_compact(F.array(F.when(has_text(equation) & F.col(signature).isNotNull(), F.concat(F.lit("reaction:"), F.col(signature))), F.when(F.col(substrates).isNotNull(), F.concat(F.lit("substrates:"), F.col(substrates))))))
    return rows.select(id_col, F.explode(F.concat(*parts)).alias("token")).distinct()


def leakage_audit(df: DataFrame, dims: Mapping[str, str], split: str = "split", examples: int = 10) -> DataFrame:
    """dimension, values, crossing, examples, status: values of a dimension (name -> SQL expression, an array or a value) that are in
    more than one split. Examples are the first by order; they are ranked before they are gathered."""
    long = None
    for name, expr in dims.items():
        e = df.select(F.col(split).alias("_s"), F.expr(expr).alias("v"))
        e = e.select("_s", F.explode("v").alias("v")) if dict(e.dtypes)["v"].startswith("array") else e
        one = e.select(F.lit(name).alias("dimension"), F.col("v").cast("string").alias("v"), "_s").where(has_text("v"))
        long = one if long is None else long.unionByName(one)
    per = long.groupBy("dimension", "v").agg(F.count_distinct("_s").alias("s"))
    counted = per.groupBy("dimension").agg(F.count("*").alias("values"), F.count_if(F.col("s") > 1).alias("crossing"))
    n = F.row_number().over(Window.partitionBy("dimension").orderBy("v"))
    shown = per.where("s > 1").withColumn("n", n).where(F.col("n") <= examples).groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("examples"))
    names = df.sparkSession.createDataFrame([(d,) for d in dims], "dimension string")
    out = names.join(counted, "dimension", "left").join(shown, "dimension", "left")
    status = F.when(F.col("values").isNull(), "missing").when(F.col("crossing") > 0, "fail").otherwise("pass")
    return out.select("dimension", F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("crossing", F.lit(0)).alias("crossing"), F.coalesce("examples", F.lit("")).alias("examples"), status.alias("status"))
