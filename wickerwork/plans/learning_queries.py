"""Queries of learning (I), acquisition (J) and expression tables (O)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.functions.text import assign_split
from wickerwork.operators import acquisition as J
from wickerwork.operators import learning as L
from wickerwork.operators import omics as O
from wickerwork.operators.graph import written
from wickerwork.plans.registry import Tables, query

#: A deterministic score of a document, the same in SQL: a tenth of its id's last two digits, pulled towards its label.
_SCORE = "round((doc_id * 37 % 100) / 100.0 * 0.7 + quality * 0.25, 4)"


def _scored(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", "quality", F.expr(f"cast({_SCORE} as double)").alias("score"))


_S = f"WITH s AS (SELECT doc_id, quality, ({_SCORE})::DOUBLE AS score FROM labels)"


@query("""
SELECT doc_id, lang || ' ; ' || source AS feature_text, n_chars::DOUBLE AS num_n_chars, CASE WHEN lang = 'en' THEN 2 ELSE 1 END::DOUBLE AS num_parts FROM documents
""")
def i1_prepare_features(t: Tables) -> DataFrame:
    df = t.documents.withColumn("parts", F.expr("if(lang = 'en', 'a|b|nan', 'x; ')"))
    return L.prepare_features(df, ["lang", "source"], ["n_chars"], ["parts"]).select("doc_id", "feature_text", "num_n_chars", "num_parts")


def _baseline_frame(t: Tables) -> tuple[DataFrame, list[str]]:
    docs = t.documents.join(t.labels, "doc_id").withColumn("split", assign_split(F.col("doc_id").cast("string")))
    df = L.prepare_features(docs, ["lang", "source"], ["n_chars"]).withColumn("num_lines", F.size(F.split("text", "\n")).cast("double"))
    _, vectors = L.char_wb_tfidf(df, "feature_text", "tfidf")
    nums = ["num_n_chars", "num_lines"]
    return L.feature_pipeline(nums, "tfidf").fit(vectors).transform(vectors), nums


@query()
def i2_i3_i4_baseline_scores(t: Tables) -> DataFrame:
    frame, _ = _baseline_frame(t)
    frame = written(frame.select("doc_id", "quality", "split", "features"))
    return L.fit_baseline(frame.where("split = 'train'"), "features", "quality")(frame).select("doc_id", "quality", "split", "score")


@query()
def i5_pu_bagging(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.when(F.col("label") < 3, 1).otherwise(0).alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    return L.fit_pu_bagging(rows, "vec_id", "x", "y")(rows).select("vec_id", "y", "score")


@query(_S + "SELECT max(score) AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS n, count(*) OVER () AS c FROM s WHERE quality = 1) WHERE n = ceil(0.9 * c - 1e-9)")
def i6_recall_threshold(t: Tables) -> DataFrame:
    return L.recall_threshold(_scored(t), "quality", "score", 0.9)


@query(_S + """
, c AS (SELECT score, sum(quality) AS pos, count(*) - sum(quality) AS neg FROM s GROUP BY 1),
k AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM c),
a AS (SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS ap, sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM k),
p AS (SELECT *, least(greatest(score, 1e-7), 1 - 1e-7) AS q FROM s)
SELECT count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS positives, round(count(*) FILTER (quality = 1 AND score >= 0.6) / sum(quality), 6) AS recall,
  round(count(*) FILTER (quality = 0 AND score >= 0.6) / (count(*) - sum(quality)), 6) AS unlabeled_positive_rate, round(avg(score) FILTER (quality = 1), 6) AS mean_score_positive,
  round(avg(score) FILTER (quality = 0), 6) AS mean_score_unlabeled, round((SELECT ap FROM a), 6) AS average_precision, round((SELECT auc FROM a), 6) AS roc_auc,
  round(avg((score - quality) ** 2), 6) AS brier, round(avg(-(quality * ln(q) + (1 - quality) * ln(1 - q))), 6) AS log_loss FROM p
""")
def i7_pu_metrics(t: Tables) -> DataFrame:
    m = L.pu_metrics(_scored(t), "quality", "score", 0.6)
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(_S + """
, b AS (SELECT *, CASE WHEN score < 0.1 THEN 0 WHEN score < 0.2 THEN 1 WHEN score < 0.30000000000000004 THEN 2 WHEN score < 0.4 THEN 3 WHEN score < 0.5 THEN 4
  WHEN score < 0.6000000000000001 THEN 5 WHEN score < 0.7000000000000001 THEN 6 WHEN score < 0.8 THEN 7 WHEN score < 0.9 THEN 8 ELSE 9 END AS bin FROM s)
SELECT bin, count(*) AS rows, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS positive_rate, round(abs(avg(score) - avg(quality)) * count(*) / (SELECT count(*) FROM s), 6) AS ece_part FROM b GROUP BY 1
""")
def i8_calibration(t: Tables) -> DataFrame:
    c = L.calibration(_scored(t), "quality", "score")
    return c.select("bin", "rows", *(F.round(x, 6).alias(x) for x in ("mean_score", "positive_rate", "ece_part")))


@query()
def i9_group_bootstrap(t: Tables) -> DataFrame:
    rows = _scored(t).join(t.documents.select("doc_id", "source"), "doc_id")
    return L.group_bootstrap(rows, "source", "quality", "score", 0.6)


@query("""
WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY 1 HAVING n >= 2)
SELECT w AS token, n AS count, (row_number() OVER (ORDER BY n DESC, w) + 3)::INTEGER AS index FROM c
UNION ALL SELECT unnest(['<pad>', '<unk>', '<eos>', '<sos>']), 0, unnest([0, 1, 2, 3])
""")
def i10_build_vocab(t: Tables) -> DataFrame:
    return L.build_vocab(t.benchmark.select(F.split("text", " ").alias("w")), "w", min_freq=2)


@query("""
WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY 1 HAVING n >= 2),
v AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) + 3 AS i FROM c),
l AS (SELECT item_id, unnest(string_split(text, ' ')[1:218]) AS w, generate_subscripts(string_split(text, ' ')[1:218], 1) AS pos FROM benchmark),
e AS (SELECT item_id, list(coalesce(i, 1) ORDER BY pos) AS ids FROM l LEFT JOIN v USING (w) GROUP BY 1)
SELECT item_id, array_to_string(list_concat([3], ids, [2], list_transform(range(0, 220), lambda x: 0))[1:220], ' ') AS ids FROM e
""")
def i11_encode_tokens(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", F.split("text", " ").alias("w"))
    coded = L.encode_tokens(words, "item_id", "w", L.build_vocab(words, "w", min_freq=2), 220, cut_whole=False)
    return coded.select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT item_id, '<sos> ' || text || ' <eos>' AS tokens FROM benchmark")
def i11_round_trip(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", F.split("text", " ").alias("w"))
    vocab = L.build_vocab(words, "w")
    longest = (words.agg(F.max(F.size("w"))).first()[0] or 0) + 2
    back = L.decode_tokens(L.encode_tokens(words, "item_id", "w", vocab, longest), "item_id", "ids", vocab)
    return back.select("item_id", F.array_join("tokens", " ").alias("tokens"))


def _regression(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", array_to_vector(F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 10).cast("double"), F.length("p_name").cast("double"))).alias("x"), F.col("p_retailprice").alias("y"))


@query()
def i12_holdout_regression(t: Tables) -> DataFrame:
    return L.holdout_regression(_regression(t), "p_partkey", "x", "y")


@query()
def i12_kfold_regression(t: Tables) -> DataFrame:
    return L.kfold_regression(_regression(t), "p_partkey", "x", "y")


@query("""
SELECT l_partkey, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(quantile_cont(l_quantity, 0.05), 6) AS low, round(quantile_cont(l_quantity, 0.95), 6) AS high FROM lineitem GROUP BY 1
""")
def i13_member_interval(t: Tables) -> DataFrame:
    out = L.member_interval(t.lineitem, "l_partkey", "l_quantity")
    return out.select("l_partkey", *(F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")))


@query()
def i14_fit_heads(t: Tables) -> DataFrame:
    df = t.embeddings.join(t.labels.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left")
    models = L.fit_heads(df, "vec_id", "embedding", {"class": ("label", "multiclass"), "toxic": ("toxic", "binary"), "quality": ("quality", "regression")})
    return L.apply_heads(df, "embedding", models).select("vec_id", "class_pred", "toxic_prob", "quality_pred")


@query()
def j1_ensemble(t: Tables) -> DataFrame:
    preds = J.fit_ensemble(t.embeddings.withColumn("y", (F.col("label") > 4).cast("int")), "vec_id", "embedding", "y", "binary", 5)
    return J.ensemble_stats(preds, "vec_id")


def _members(t: Tables) -> DataFrame:
    """Five members' probabilities of two classes, from the id alone."""
    p = F.expr("(vec_id * (member + 3) * 7 % 97 + 1) / 100.0D")
    rows = t.embeddings.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("member"))
    return rows.select("vec_id", "member", F.array(p, 1 - p).alias("prob"))


_M = """
WITH m AS (SELECT vec_id, (vec_id * (k + 3) * 7 % 97 + 1) / 100.0::DOUBLE AS p FROM embeddings, range(0, 5) AS r(k)),
e AS (SELECT vec_id, avg(p) AS mu, stddev_pop(p) AS sd, avg(-(p * ln(p + 1e-10) + (1 - p) * ln(1 - p + 1e-10))) AS h FROM m GROUP BY 1),
s AS (SELECT vec_id, mu, sd, -(mu * ln(mu + 1e-10) + (1 - mu) * ln(1 - mu + 1e-10)) AS entropy, h FROM e)
"""


@query(_M + "SELECT vec_id, round(mu, 6) AS mean, round(sd, 6) AS std, round(entropy, 6) AS entropy, round(entropy - h, 6) AS bald FROM s")
def j2_ensemble_stats(t: Tables) -> DataFrame:
    s = J.ensemble_stats(_members(t), "vec_id")
    return s.select("vec_id", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("std")[0], 6).alias("std"), F.round("entropy", 6).alias("entropy"), F.round("bald", 6).alias("bald"))


@query()
def j3_expected_improvement(t: Tables) -> DataFrame:
    s = J.ensemble_stats(_members(t), "vec_id")
    return s.select("vec_id", J.expected_improvement(F.col("mean")[0], F.col("std")[0], 0.6).alias("ei"))


@query(_M + "SELECT vec_id, round(bald, 6) AS score, rank FROM (SELECT vec_id, round(entropy - h, 9) AS bald, row_number() OVER (ORDER BY round(entropy - h, 9) DESC, vec_id) AS rank FROM s WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) WHERE rank <= 20")
def j4_select_candidates(t: Tables) -> DataFrame:
    stats = J.ensemble_stats(_members(t), "vec_id").withColumn("bald", F.round("bald", 9))
    used = t.labels.where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return J.select_candidates(stats, "vec_id", "bald", 20, used).withColumn("rank", F.col("rank").cast("long"))


@query("""
SELECT gene_id, condition, coalesce(TRY_CAST(v AS DOUBLE), 0) AS value FROM (
  SELECT event_id AS gene_id, unnest(['a', 'b']) AS condition, unnest([CASE WHEN event_id % 3 = 0 THEN '' ELSE event_id::VARCHAR END, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE user_id::VARCHAR END]) AS v FROM events)
""")
def o1_expression_long(t: Tables) -> DataFrame:
    wide = t.events.select("event_id", F.expr("if(event_id % 3 = 0, ' ', cast(event_id as string))").alias("a"), F.expr("if(event_id % 5 = 0, 'n/a', cast(user_id as string))").alias("b"))
    return O.expression_long(wide, "event_id", ["a", "b"])


def _expression(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("gene_id"), F.col("event_type").alias("condition")).agg(F.round(F.sum("value"), 4).alias("value"))


def _rules(t: Tables) -> DataFrame:
    users = t.events.select("user_id").distinct()
    return users.select((F.col("user_id") % 60).alias("reaction_id"), F.col("user_id").alias("gene_id"))


_E = """
WITH x AS (SELECT user_id AS g, event_type AS c, round(sum(value), 4) AS v FROM events GROUP BY 1, 2), r AS (SELECT DISTINCT user_id % 60 AS rx, user_id AS g FROM events),
q AS (SELECT c, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM x GROUP BY 1), n AS (SELECT rx, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT c, rx, count(*) AS seen, max(v) AS top, bool_or(v >= hi) AS any_high, bool_and(v < lo) AS all_low, any_value(lo) AS lo FROM r JOIN x USING (g) JOIN q USING (c) GROUP BY 1, 2)
"""


@query("SELECT user_id AS gene_id, coalesce(round(sum(value) FILTER (event_type = 'click'), 4), 0) AS click, coalesce(round(sum(value) FILTER (event_type = 'view'), 4), 0) AS view FROM events GROUP BY 1")
def o1_expression_wide(t: Tables) -> DataFrame:
    return O.expression_wide(_expression(t), ["click", "view"])


@query(_E + "SELECT c AS condition, rx AS reaction_id, round((lo - top) / greatest(lo, 1e-10), 6) AS penalty FROM p JOIN n USING (rx) WHERE all_low AND seen = n")
def o2_low_expression_penalty(t: Tables) -> DataFrame:
    return O.low_expression_penalty(_expression(t), _rules(t)).withColumn("penalty", F.round("penalty", 6))


@query(_E + "SELECT c AS condition, rx AS reaction_id, CASE WHEN any_high THEN 'high' ELSE 'low' END AS class FROM p JOIN n USING (rx) WHERE any_high OR (all_low AND seen = n)")
def o3_expression_classes(t: Tables) -> DataFrame:
    return O.expression_classes(_expression(t), _rules(t))


@query(_E + """
, g AS (SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM events),
k AS (SELECT a, b, count(*) AS n, corr(x.v, y.v) AS r, stddev_pop(x.v) AS sx, stddev_pop(y.v) AS sy FROM g JOIN x ON x.g = a JOIN x AS y ON y.g = b AND y.c = x.c GROUP BY 1, 2)
SELECT a AS gene_a, b AS gene_b, CASE WHEN n >= 3 THEN round(CASE WHEN sx < 1e-12 OR sy < 1e-12 THEN 0 ELSE r END, 6) END AS correlation FROM k
""")
def o4_gene_correlation(t: Tables) -> DataFrame:
    pairs = t.events.select(F.col("user_id").alias("gene_a"), (F.col("user_id") + 1).alias("gene_b")).distinct()
    return O.gene_correlation(_expression(t), pairs).withColumn("correlation", F.round("correlation", 6))


def _stoich(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_suppkey") % 500).alias("reaction_id"), F.col("l_partkey").alias("met_id")).distinct()


@query("""
WITH s AS (SELECT DISTINCT l_suppkey % 500 AS r, l_partkey AS m FROM lineitem), s2 AS (SELECT * FROM s WHERE m NOT IN (SELECT m FROM s GROUP BY m HAVING count(*) > 100)),
p AS (SELECT a.r AS reaction_id, b.r AS neighbour, count(*) AS shared FROM s2 a JOIN s2 b ON a.m = b.m AND a.r <> b.r GROUP BY 1, 2)
SELECT reaction_id, neighbour, shared FROM (SELECT *, row_number() OVER (PARTITION BY reaction_id ORDER BY shared DESC, neighbour) AS n FROM p) WHERE n <= 10
""")
def o5_metabolite_neighbours(t: Tables) -> DataFrame:
    return O.metabolite_neighbours(_stoich(t), 10, hub_degree=100)


@query("""
WITH s AS (SELECT DISTINCT l_suppkey % 200 AS r, l_partkey % 40 AS m FROM lineitem UNION SELECT DISTINCT l_suppkey % 200, -1 FROM lineitem),
p AS (SELECT a.r AS reaction_id, b.r AS neighbour, count(*) AS shared FROM s a JOIN s b ON a.m = b.m AND a.r <> b.r GROUP BY 1, 2)
SELECT reaction_id, neighbour, shared FROM (SELECT *, row_number() OVER (PARTITION BY reaction_id ORDER BY shared DESC, neighbour) AS n FROM p) WHERE n <= 20
""")
def o5_hub_neighbours(t: Tables) -> DataFrame:
    """No metabolite is left out, though one (-1) is in every reaction and others are in many."""
    own = t.lineitem.select((F.col("l_suppkey") % 200).alias("reaction_id"), (F.col("l_partkey") % 40).alias("met_id"))
    every = own.select("reaction_id", F.lit(-1).cast("long").alias("met_id"))
    return O.metabolite_neighbours(own.union(every).distinct(), 20, pairs_up_to=50)


@query("""
WITH x AS (SELECT user_id AS g, event_type AS c, round(sum(value), 4) AS v FROM events GROUP BY 1, 2), ru AS (SELECT DISTINCT user_id % 60 AS r, user_id AS g FROM events),
s AS (SELECT DISTINCT l_suppkey % 500 AS r, l_partkey AS m FROM lineitem), s2 AS (SELECT * FROM s WHERE m NOT IN (SELECT m FROM s GROUP BY m HAVING count(*) > 100)),
p AS (SELECT a.r, b.r AS o, count(*) AS shared FROM s2 a JOIN s2 b ON a.m = b.m AND a.r <> b.r WHERE a.r NOT IN (SELECT r FROM ru) GROUP BY 1, 2),
nb AS (SELECT r, o FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY shared DESC, o) AS n FROM p) WHERE n <= 10),
cand AS (SELECT DISTINCT nb.r, ru.g FROM nb JOIN ru ON ru.r = nb.o),
q AS (SELECT a.r, a.g AS a, b.g AS b FROM cand a JOIN cand b ON a.r = b.r AND a.g <> b.g),
k AS (SELECT a, b, count(*) AS n, corr(x.v, y.v) AS r, stddev_pop(x.v) AS sx, stddev_pop(y.v) AS sy
  FROM (SELECT DISTINCT a, b FROM q) JOIN x ON x.g = a JOIN x AS y ON y.g = b AND y.c = x.c GROUP BY 1, 2),
mean AS (SELECT q.r, a, round(avg(CASE WHEN n >= 3 THEN CASE WHEN sx < 1e-12 OR sy < 1e-12 THEN 0 ELSE k.r END END), 9) AS m FROM q JOIN k USING (a, b) GROUP BY 1, 2)
SELECT r AS reaction_id, a AS gene_id, m AS mean_correlation, n::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY m DESC, a) AS n FROM mean WHERE m >= 0.2) WHERE n <= 5
""")
def o6_infer_pseudo_gpr(t: Tables) -> DataFrame:
    return O.infer_pseudo_gpr(_expression(t), _stoich(t), _rules(t), 0.2, 10, hub_degree=100)


@query("""
SELECT s_suppkey AS reaction_id, CASE WHEN s_suppkey % 2 = 0 THEN 'g1 or g2' ELSE r END AS rule, s_suppkey % 2 = 1 AND r IS NOT NULL AS rule_inferred
FROM supplier LEFT JOIN (SELECT l_suppkey, string_agg(k::VARCHAR, ' or ' ORDER BY n) AS r FROM (
  SELECT l_suppkey, l_partkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE n <= 3 GROUP BY 1) ON l_suppkey = s_suppkey
""")
def o7_apply_pseudo_gpr(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_suppkey").alias("reaction_id"), F.col("l_partkey").alias("gene_id")).distinct()
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("reaction_id").orderBy("gene_id"))).where("rank <= 3")
    reactions = t.supplier.select(F.col("s_suppkey").alias("reaction_id"), F.expr("if(s_suppkey % 2 = 0, 'g1 or g2', '')").alias("rule"))
    return O.apply_pseudo_gpr(reactions, ranked)


@query("SELECT count(*) AS genes, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) AS covered, round(100.0 * count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) / count(*), 6) AS percent FROM part")
def o8_gene_coverage(t: Tables) -> DataFrame:
    out = O.gene_coverage(t.lineitem.select(F.col("l_partkey").alias("gene_id")), t.part.select(F.col("p_partkey").alias("gene_id")))
    return out.withColumn("percent", F.round("percent", 6))
