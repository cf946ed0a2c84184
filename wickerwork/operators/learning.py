"""Features, positive-unlabelled learning and its evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.functions.text import json_size, split_multi, to_num0
from wickerwork.operators.batched_logit import fit_batched, mean_probability
from wickerwork.operators.graph import written
from wickerwork.operators.ranking import global_rank, running_sums
from wickerwork.operators.resampling import group_bootstrap  # noqa: F401  part of this family


def prepare_features(df: DataFrame, text_cols: Sequence[str], num_cols: Sequence[str] = (), list_cols: Sequence[str] = (), json_cols: Sequence[str] = ()) -> DataFrame:
    """df with feature_text (' ; '-joined fields) and num_ columns: numbers (0 where none), list lengths, JSON map sizes."""
    new = {"feature_text": F.concat_ws(" ; ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols))}
    new |= {f"num_{c}": to_num0(c) for c in num_cols}
    new |= {f"num_{c}": F.size(split_multi(c)).cast("double") for c in list_cols}
    new |= {f"num_{c}": json_size(c).cast("double") for c in json_cols}
    return df.withColumns(new)


def _part(text: Column, width: Column):
    return lambda i: F.substring(text, i, width)


def char_wb_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside word boundaries: every word is padded by a blank on both sides; a word shorter than n gives its
    padded self once."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        per = []
        for n in range(low, high + 1):
            width = F.lit(n)
            run = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), _part(padded, width))
            seen_before = F.length(padded) < (n if n > low else 0)
            per.append(F.when(seen_before, F.array().cast("array<string>")).otherwise(run))
        return F.concat(*per)

    return F.flatten(F.transform(words, grams))


def char_wb_tfidf(df: DataFrame, text: str, out: str = "tfidf", max_terms: int = 60_000, min_df: int = 2):
    """(fitted stages, df with out): counts of n-grams, smoothed inverse document frequency + 1, unit length."""
    grams = df.withColumn("_grams", char_wb_ngrams(F.col(text)))
    counter = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=max_terms, minDF=min_df).fit(grams)
    counted = counter.transform(grams)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
    scale = ElementwiseProduct(inputCol="_tf", outputCol="_scaled", scalingVec=Vectors.dense([x + 1.0 for x in idf.idf.toArray()]))
    stages = [counter, scale, Normalizer(inputCol="_scaled", outputCol=out, p=2.0)]

    def apply(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("_grams", char_wb_ngrams(F.col(text)))
        for s in stages:
            frame = s.transform(frame)
        return frame.drop("_grams", "_tf", "_scaled")

    return apply, apply(df)


def feature_pipeline(num_cols: Sequence[str], text_vector: str, out: str = "features") -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(num_cols), outputCol="_num", handleInvalid="keep"),
            StandardScaler(inputCol="_num", outputCol="_std", withMean=False, withStd=True),
            VectorAssembler(inputCols=["_std", text_vector], outputCol=out),
        ]
    )


def fit_baseline(train: DataFrame, features: str, label: str, iterations: int = 50):
    """Class-balanced logistic regression; returns a function that adds score to a frame."""
    counts = {r["l"]: r["n"] for r in train.groupBy(F.col(label).cast("int").alias("l")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    weighted = train.withColumn("_w", weight).withColumn(label, F.col(label).cast("double"))
    model = LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w", maxIter=iterations, regParam=1.0 / max(total, 1), standardization=False).fit(weighted)
    return lambda df: model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def pu_draw(df: DataFrame, id_col: str, label: str, members: Sequence[int], ratio: float, seed: int) -> DataFrame:
    """For each member (_m) exactly round(ratio * positives) unlabelled rows, those with the smallest hashes of (seed, member, id), all
    in one pass. Only hashes a little above the expected cut are ranked; if a member has too few after all, every row is."""
    positives, rows = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    n = max(1, int(round(ratio * positives)))
    share = n / max(rows, 1)
    unlabelled = df.where(F.col(label) == 0).withColumn("_m", F.explode(F.array(*(F.lit(m) for m in members))))
    unlabelled = unlabelled.withColumns({"_h": F.pmod(F.xxhash64(F.lit(seed), "_m", F.col(id_col)), F.lit(1 << 40)), "_one": F.lit(1)})
    near = unlabelled.where(F.col("_h") < min(1.0, share + 6 * math.sqrt(share / max(rows, 1)) + 1e-6) * float(1 << 40))
    enough = near.groupBy("_m").agg(F.count("*").alias("c")).where(F.col("c") >= min(n, rows)).count() == len(members)
    ranked = running_sums(near if enough else unlabelled, ["_m"], ["_h", id_col], {"_r": "_one"})
    return ranked.where(F.col("_r") <= n).drop("_h", "_one", "_r")


def pu_sample(df: DataFrame, id_col: str, label: str, member: int, ratio: float, seed: int) -> DataFrame:
    """All positives and one member's unlabelled rows."""
    return df.where(F.col(label) == 1).unionByName(pu_draw(df, id_col, label, [member], ratio, seed).drop("_m"))


#: Features up to which all members are fitted together; beyond, second derivatives would be too many numbers.
BATCHED_WIDTH = 300


def fit_pu_bagging(df: DataFrame, id_col: str, features: str, label: str, members: int = 25, ratio: float = 0.6, seed: int = 0, iterations: int = 40, parallelism: int = 4):
    """Bagged logistic regressions; returns a function that gives a frame score, the members' mean. Ids should be unique. With up to
    BATCHED_WIDTH features all members are fitted in the same passes over the rows (see fit_batched), with more each by itself,
    `parallelism` of them at a time; both minimise the same."""
    table = written(df.select(id_col, features, label))
    drawn = written(pu_draw(table, id_col, label, range(members), ratio, seed))
    first = table.select(features).first()
    width = len(first[0]) if first else 0
    if width <= BATCHED_WIDTH:
        weights = lambda own: F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda m: F.array_contains(own, m).cast("double"))
        chosen = drawn.groupBy(id_col).agg(F.collect_set("_m").alias("_own"))
        some = table.where(F.col(label) == 0).join(chosen, id_col).select(features, F.lit(0.0).alias("y"), weights(F.col("_own")).alias("w"))
        every = table.where(F.col(label) == 1).select(features, F.lit(1.0).alias("y"), F.array_repeat(F.lit(1.0), members).alias("w"))
        rows = written(every.unionByName(some).select(vector_to_array(features).alias("x"), "y", "w"))
        beta = fit_batched(rows, members, width, 0.01, iterations)
        return lambda frame: frame.withColumn("score", mean_probability(vector_to_array(features), beta))

    def fit(m: int):
        sample = table.where(F.col(label) == 1).unionByName(drawn.where(F.col("_m") == m).drop("_m")).withColumn(label, F.col(label).cast("double"))
        return LogisticRegression(featuresCol=features, labelCol=label, maxIter=iterations, regParam=0.01, probabilityCol=f"_p{m}", rawPredictionCol="_raw", predictionCol="_pred").fit(sample)

    with ThreadPoolExecutor(parallelism) as pool:
        models = list(pool.map(inheritable_thread_target(df.sparkSession)(fit), range(members)))

    def score(frame: DataFrame) -> DataFrame:
        out = frame
        for m in models:
            out = m.transform(out).drop("_raw", "_pred")
        mean = sum((vector_to_array(f"_p{i}")[1] for i in range(members)), F.lit(0.0)) / members
        return out.withColumn("score", mean).drop(*(f"_p{i}" for i in range(members)))

    return score


def recall_threshold(df: DataFrame, label: str, score: str, target: float) -> DataFrame:
    """threshold: the highest cut that keeps at least the target share of positives, which are counted by distinct score."""
    per = df.where(F.col(label) == 1).groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    cum = running_sums(per, [], [F.desc("threshold")], {"kept": "n"}).join(F.broadcast(total))
    return cum.where(F.col("kept") >= F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(float(target)) - 1e-9))).agg(F.max("threshold").alias("threshold"))


def pu_metrics(df: DataFrame, label: str, score: str, threshold: float, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per group of `by`: n, positives, recall, unlabeled_positive_rate, mean_score_positive, mean_score_unlabeled,
    average_precision (step), roc_auc (ties averaged), brier, log_loss. Rows are first summed by score."""
    w = F.col(weight) if weight else F.lit(1.0)
    by = list(by)
    y, s = F.col(label).cast("double"), F.col(score)
    p = F.least(F.greatest(s, F.lit(1e-7)), F.lit(1 - 1e-7))
    per = df.groupBy(*by, s.alias("_s")).agg(
        F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg"), F.sum(w * F.pow(s - y, 2)).alias("b"), F.sum(-w * (y * F.log(p) + (1 - y) * F.log(1 - p))).alias("ll")
    )
    cum = running_sums(per, by, [F.desc("_s")], {"tp": "pos", "fp": "neg"})
    out = cum.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("_neg"),
        F.sum(F.when(F.col("_s") >= threshold, F.col("pos")).otherwise(0.0)).alias("_tp"),
        F.sum(F.when(F.col("_s") >= threshold, F.col("neg")).otherwise(0.0)).alias("_fp"),
        F.sum(F.col("_s") * F.col("pos")).alias("_sp"),
        F.sum(F.col("_s") * F.col("neg")).alias("_sn"),
        F.sum(F.col("pos") * F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0.0))).alias("_ap"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("_auc"),
        F.sum("b").alias("_b"),
        F.sum("ll").alias("_ll"),
    )
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    return out.select(
        *by,
        "n",
        "positives",
        over("_tp", "positives").alias("recall"),
        over("_fp", "_neg").alias("unlabeled_positive_rate"),
        over("_sp", "positives").alias("mean_score_positive"),
        over("_sn", "_neg").alias("mean_score_unlabeled"),
        over("_ap", "positives").alias("average_precision"),
        (F.col("_auc") / F.nullif(F.col("positives") * F.col("_neg"), F.lit(0.0))).alias("roc_auc"),
        over("_b", "n").alias("brier"),
        over("_ll", "n").alias("log_loss"),
    )


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """bin, rows, mean_score, positive_rate, ece_part of equal bins, the last one closed; the sum of ece_part is the expected
    calibration error. A score is compared with the literal edges."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    edges[-1] = 1.0
    bin_ = F.lit(bins - 1)
    for i in range(bins - 2, -1, -1):
        bin_ = F.when(F.col(score) < F.lit(edges[i + 1]), i).otherwise(bin_)
    per = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("rows"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
    total = df.agg(F.count("*").alias("_n"))
    part = F.abs(F.col("mean_score") - F.col("positive_rate")) * F.col("rows") / F.col("_n")
    return per.join(F.broadcast(total)).select("bin", "rows", "mean_score", "positive_rate", part.alias("ece_part"))


def build_vocab(df: DataFrame, tokens: str, min_freq: int = 1, max_size: int | None = None, specials: Sequence[str] = ("<pad>", "<unk>", "<eos>", "<sos>")) -> DataFrame:
    """token, count, index: specials first, then by falling count, then token. Only words that can be in it are ranked."""
    counted = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("count")).where((F.col("count") >= min_freq) & ~F.col("token").isin(*specials))
    if max_size is not None:
        counted = counted.orderBy(F.desc("count"), "token").limit(max(0, max_size - len(specials)))
        ranked = counted.withColumn("index", F.row_number().over(Window.orderBy(F.desc("count"), "token")) + len(specials) - 1)
    else:
        ranked = global_rank(counted, [F.desc("count"), "token"], "_r").withColumn("index", F.col("_r") + len(specials) - 1).drop("_r")
    head = df.sparkSession.createDataFrame([(t, 0, i) for i, t in enumerate(specials)], "token string, count long, index int")
    return head.unionByName(ranked.select("token", "count", F.col("index").cast("int").alias("index")))


def encode_tokens(df: DataFrame, id_col: str, tokens: str, vocab: DataFrame, length: int, cut_whole: bool = True) -> DataFrame:
    """id and ids (array<int>) of fixed length: sos, tokens, eos, then pads. cut_whole cuts the finished sequence, otherwise the tokens
    are cut so that sos and eos stay."""
    special = {n: i for i, n in enumerate(("<pad>", "<unk>", "<eos>", "<sos>"))}
    base = df.select(id_col, F.slice(tokens, 1, length if cut_whole else max(0, length - 2)).alias("_t"))
    long = base.select(id_col, F.posexplode("_t").alias("pos", "token")).join(vocab.select("token", "index"), "token", "left")
    per = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("index", F.lit(special["<unk>"])).alias("i")))).alias("_i"))
    ids = F.transform(F.coalesce("_i", F.array().cast("array<struct<pos:int,i:int>>")), lambda x: x["i"])
    full = F.slice(F.concat(F.array(F.lit(special["<sos>"])), ids, F.array(F.lit(special["<eos>"])), F.array_repeat(F.lit(special["<pad>"]), length)), 1, length)
    return base.join(per, id_col, "left").select(id_col, full.alias("ids"))


def decode_tokens(df: DataFrame, id_col: str, ids: str, vocab: DataFrame, with_pad: bool = False) -> DataFrame:
    """id and tokens, start and end marks among them; pads only with with_pad."""
    long = df.select(id_col, F.posexplode(ids).alias("pos", "index")).join(vocab.select("index", "token"), "index")
    kept = long if with_pad else long.where("token <> '<pad>'")
    out = kept.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    return df.select(id_col).join(out, id_col, "left").select(id_col, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def regression_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """n, r2, pearson, rmse, mae."""
    d = F.col(truth) - F.col(pred)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(d * d).alias("_sse"), F.var_pop(truth).alias("_v"), F.covar_pop(truth, pred).alias("_c"), F.stddev_pop(truth).alias("_st"), F.stddev_pop(pred).alias("_sp"), F.avg(F.abs(d)).alias("mae"))
    return out.select(*by, "n", (1 - F.col("_sse") / F.nullif(F.col("_v") * F.col("n"), F.lit(0.0))).alias("r2"), (F.col("_c") / F.nullif(F.col("_st") * F.col("_sp"), F.lit(0.0))).alias("pearson"), F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae")


def _fold(id_col: str, seed: int, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(k)).cast("int")


def _forest(seed: int, trees: int, features: str, label: str):
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=8, seed=seed)


#: Rows of a partition of the forests' input.
FOREST_ROWS = 50_000


def _dealt(df: DataFrame, id_col: str) -> DataFrame:
    """df dealt by id into partitions of about FOREST_ROWS rows and sorted there. A small file, however many rows it has, would be one task;
    and a forest's samples depend on the partitions, which are so the same on every cluster."""
    return df.repartition(max(1, math.ceil(df.count() / FOREST_ROWS)), id_col).sortWithinPartitions(id_col)


def holdout_regression(df: DataFrame, id_col: str, features: str, label: str, reps: int = 5, percent: int = 20, trees: int = 20) -> DataFrame:
    """rep and the metrics of a random forest on the held-out percent of rows, chosen by a hash, repeated."""
    df, out = _dealt(df, id_col), None
    for rep in range(reps):
        fold = _fold(id_col, rep, 100) < percent
        model = _forest(rep, trees, features, label).fit(df.where(~fold))
        one = regression_metrics(model.transform(df.where(fold)), label, "prediction").select(F.lit(rep).alias("rep"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def kfold_regression(df: DataFrame, id_col: str, features: str, label: str, k: int = 5, trees: int = 20) -> DataFrame:
    """fold and the metrics on it of a random forest fitted to the others."""
    df, out = _dealt(df, id_col), None
    for i in range(k):
        fold = _fold(id_col, 0, k) == i
        model = _forest(i, trees, features, label).fit(df.where(~fold))
        one = regression_metrics(model.transform(df.where(fold)), label, "prediction").select(F.lit(i).alias("fold"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def member_interval(preds: DataFrame, item: str, value: str) -> DataFrame:
    """item, mean, std (population), low and high (5 and 95 %) over ensemble members; uncalibrated."""
    return preds.groupBy(item).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, 0.05).alias("low"), F.percentile(value, 0.95).alias("high"))


def fit_heads(df: DataFrame, id_col: str, embedding: str, tasks: dict[str, tuple[str, str]], validation: int = 20, seed: int = 0, weight: str | None = None) -> dict:
    """One model a task on the rows that have its label. tasks: name -> (label column, 'multiclass', 'binary' or 'regression'); a
    deterministic hash keeps `validation` percent of rows out. Returns name -> model; features column: _x."""
    x = df.withColumn("_x", array_to_vector(F.col(embedding).cast("array<double>"))).where(_fold(id_col, seed, 100) >= validation)
    models = {}
    for name, (label, kind) in tasks.items():
        rows = x.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double"))
        if kind == "regression":
            est = LinearRegression(featuresCol="_x", labelCol="_y", regParam=0.01, predictionCol=f"{name}_pred")
        else:
            family = "multinomial" if kind == "multiclass" else "binomial"
            est = LogisticRegression(featuresCol="_x", labelCol="_y", family=family, regParam=0.01, maxIter=30, probabilityCol=f"{name}_prob", rawPredictionCol=f"{name}_raw", predictionCol=f"{name}_pred")
        if weight:
            est = est.setWeightCol(weight)
        models[name] = est.fit(rows)
    return models


def apply_heads(df: DataFrame, embedding: str, models: dict) -> DataFrame:
    out = df.withColumn("_x", array_to_vector(F.col(embedding).cast("array<double>")))
    for name, model in models.items():
        out = model.transform(out).drop(f"{name}_raw")
        if f"{name}_prob" in out.columns:
            out = out.withColumn(f"{name}_prob", vector_to_array(f"{name}_prob"))
    return out.drop("_x")
