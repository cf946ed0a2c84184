"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerwork.llm.shared import bound_batches, durable
from wickerwork.llm.words import WordBatch, mix, pieces

_U = np.uint64
FEATURES = [
    "log_words", "lexicon_density", "log_lexicon_hits", "lexicon_weight", "disguised_density", "second_person_rate",
    "hits_near_second_person", "capital_share", "capital_words", "exclamation_rate", "question_rate", "punctuation_rate",
    "digit_in_word_rate", "symbol_in_word_rate", "stretched_rate", "beyond_ascii_share",
]
#: Stems are the first so many bytes of a word.
STEM_BYTES = (4, 5, 6, 7, 8)
# Second-person words of the corpus's languages.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tus vosotros vuestro os"
).split()
# Letters that digits and signs stand for in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_UNMASKED = _PLAIN.copy()
for _sign, _letter in DISGUISES.items():
    _UNMASKED[ord(_sign)] = ord(_letter)


def _hash_spans(data: np.ndarray, table: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hash of `length` bytes from each start, folded by table; spans may run over the buffer's end."""
    padded = np.concatenate([table[data], np.zeros(length, np.uint8)])
    out = np.zeros(len(start), _U)
    for i in range(length):
        out = (out << _U(8)) | padded[start + i].astype(_U)
    return mix(out + _U(length))


def _word_key(word: str) -> int:
    raw = word.encode()[:8]
    return int(mix(np.array([int.from_bytes(raw, "big") + len(raw)], _U))[0])


class _Tokens:
    """Words of a batch without leading punctuation, and their stems."""

    def __init__(self, texts: list[str]):
        self.words = WordBatch(texts, fold=True)
        data, start, end = self.words.data, self.words.start.copy(), self.words.end
        for _ in range(3):
            start += _PUNCT[data[start]] & (start < end - 1)
        stop = end.copy()
        for _ in range(3):
            stop -= _PUNCT[data[stop - 1]] & (stop - 1 > start)
        self.start, self.stop = start, stop

    def stems(self, table: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of words of at least `length` bytes, hashes of their stems)."""
        long = np.flatnonzero(self.stop - self.start >= length)
        return long, _hash_spans(self.words.data, table, self.start[long], length)


@dataclass
class Lexicon:
    """Stems that toxic training texts have far oftener than others: by stem length sorted hashes and their log odds."""

    keys: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def hits(self, tokens: _Tokens, table: np.ndarray) -> np.ndarray:
        """Per word the largest weight of its stems, 0 without a hit."""
        out = np.zeros(len(tokens.start))
        for length, keys in self.keys.items():
            if len(keys):
                at, h = tokens.stems(table, length)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out[at] = np.maximum(out[at], np.where(keys[place] == h, self.weights[length][place], 0.0))
        return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES a text; an empty text gives zeros."""
    rows = []
    second = np.sort(np.array([_word_key(w) for w in SECOND_PERSON if len(w.encode()) <= 8], _U))
    for lo, hi in pieces(texts):
        t = _Tokens(texts[lo:hi])
        w, data = t.words, t.words.data
        first = w.first
        n = np.diff(first).astype(np.float64)
        per_word = 1 / np.maximum(n, 1)
        hit = lexicon.hits(t, _PLAIN)
        disguised = (lexicon.hits(t, _UNMASKED) > 0) & (hit == 0)
        size = t.stop - t.start
        person = np.zeros(len(t.start), bool)
        for length in {len(x.encode()) for x in SECOND_PERSON}:
            at = np.flatnonzero(size == length)
            h = _hash_spans(data, _PLAIN, t.start[at], length)
            place = np.minimum(np.searchsorted(second, h), len(second) - 1)
            person[at] = second[place] == h
        owner = np.repeat(np.arange(hi - lo), np.diff(first))
        index = np.arange(len(owner))
        near = np.concatenate([[0], np.cumsum(person)])
        from_, to = np.maximum(index - 5, first[owner]), np.minimum(index + 6, first[owner + 1])
        close = ((hit > 0) | disguised) & (near[to] > near[from_])
        in_word = lambda mask: _counts(mask[data], t.start, t.stop)
        letters, uppers, digits = in_word(_LETTER), in_word(_UPPER), in_word(_DIGIT)
        signs = in_word(_PUNCT)
        same = np.zeros(len(data), bool)
        same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
        bounds = np.concatenate([w.offset, [len(data)]])
        volume = np.maximum(np.diff(bounds) - 1, 1).astype(np.float64)
        of_bytes = lambda mask: _sums(mask, bounds) / volume
        of_words = lambda mask: _sums(mask, first) * per_word
        hits = _sums(hit > 0, first)
        rows.append(
            np.column_stack(
                [
                    np.log1p(n), hits * per_word, np.log1p(hits), _sums(hit, first) * per_word, of_words(disguised), of_words(person),
                    _sums(close, first) * per_word, of_bytes(_UPPER[data]), of_words((uppers >= 2) & (uppers == letters)),
                    of_bytes(data == 33), of_bytes(data == 63), of_bytes(_PUNCT[data]), of_words((letters > 0) & (digits > 0)),
                    of_words((letters > 1) & (signs > 0)), of_words(_counts(same, t.start, t.stop) > 0), of_bytes(data >= 128),
                ]
            )
        )
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _counts(mask: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[stop] - total[start]


def _learn_lexicon(train: DataFrame, most: int) -> Lexicon:
    """From train(text, toxic): per stem the number of toxic and other texts that have it, counted in the tasks and summed by
    Spark; kept are at most `most` stems with a support of 1 % of the toxic texts (3 at least) and a ratio of 12."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, toxic = batch["text"].tolist(), batch["toxic"].to_numpy()
            for lo, hi in pieces(texts):
                t = _Tokens(texts[lo:hi])
                owner = np.repeat(np.arange(hi - lo), np.diff(t.words.first))
                for length in STEM_BYTES:
                    at, h = t.stems(_PLAIN, length)
                    pair = np.unique(np.rec.fromarrays([h, owner[at]], names="h,d"))
                    keys, inverse = np.unique(pair.h, return_inverse=True)
                    hot = np.bincount(inverse, weights=toxic[lo:hi][pair.d], minlength=len(keys))
                    all_ = np.bincount(inverse, minlength=len(keys))
                    yield pd.DataFrame({"length": length, "h": keys.view(np.int64), "hot": hot.astype(np.int64), "n": all_})

    bound_batches(train.sparkSession)
    totals = train.agg(F.sum("toxic").alias("hot"), F.count("*").alias("n")).first()
    hot, cold = totals["hot"] or 0, totals["n"] - (totals["hot"] or 0)
    if not hot or not cold:
        return Lexicon()
    support = max(3, int(0.01 * hot))
    counted = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(run, "length int, h long, hot long, n long")
    ratio = ((F.col("hot") + 0.1) / F.lit(float(hot))) / ((F.col("n") - F.col("hot") + 0.5) / F.lit(float(cold)))
    found = (
        counted.groupBy("length", "h").agg(F.sum("hot").alias("hot"), F.sum("n").alias("n"))
        .where(F.col("hot") >= support).withColumn("weight", F.log(ratio)).where(F.col("weight") >= float(np.log(12.0)))
        .orderBy(F.desc("hot"), "length", "h").limit(most).toPandas()
    )
    lexicon = Lexicon()
    for length in STEM_BYTES:
        own = found[found["length"] == length]
        keys = own["h"].to_numpy(np.int64).view(_U)
        order = np.argsort(keys)
        lexicon.keys[length], lexicon.weights[length] = keys[order], own["weight"].to_numpy(np.float64)[order]
    return lexicon


def _with_features(df: DataFrame, lexicon: Lexicon, text: tuple[str, ...] = ("text",)) -> DataFrame:
    """df, its columns passed through as they are, with the vector _features of the text (a column, or a field of a struct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text[0])
            for field_name in text[1:]:
                column = column.field(field_name)
            made = features([t or "" for t in column.to_pylist()], lexicon)
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(FEATURES))
            column = pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "_features"])

    bound_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("_features", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema).withColumn("_features", array_to_vector("_features"))


class ToxicityModel:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: Lexicon, trees=None, calibration=None, base_rate: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.base_rate = lexicon, trees, calibration, base_rate

    def apply(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, score): every row of docs, whatever its columns, and its score (0 to 1); a null text scores as an empty one. A narrow
        map: no shuffle."""
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.base_rate))
        scored = self.trees.transform(_with_features(rows, self.lexicon, ("row", text_col)))
        scored = scored.withColumn("_raw", vector_to_array("_probability")[1])
        scored = self.calibration.transform(scored)
        # Calibrated levels are steps; a trace of the raw score keeps the order inside a step.
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated") * 0.999 + F.col("_raw") * 0.001))
        return scored.select("row", score.alias("score"))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every row."""
        scored = self.apply(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        return scored.select("row.doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def keep_clean(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of docs, as they are, that score below 0.5."""
        return self.apply(docs, text_col).where(F.col("score") < 0.5).select("row.*")


def held_out(id_: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(folds)) == 0


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = 16_000, lexicon_size: int = 400, trees: int = 20, depth: int = 3,
) -> ToxicityModel:
    """Learn from labelled rows outside the held-out fold. About sample_rows of them (a hash sample; the documented bound, which
    also bounds the broadcast that joins them to their texts) are used; equal texts count once. Three quarters of these
    fit lexicon and trees, one quarter the isotonic calibration. With fewer than 3 rows of either class the model is
    the rate of toxic labels. Null ids and null labels are not learned from; repeated labels count once, the largest."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    usable = usable.where(~held_out(F.col("doc_id")))
    share = min(1.0, sample_rows / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    rows = durable(rows.withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(4)) == 0))
    counts = {(r["calibrate"], r["toxic"]): r["n"] for r in rows.groupBy("calibrate", "toxic").agg(F.count("*").alias("n")).collect()}
    hot = counts.get((True, 1), 0) + counts.get((False, 1), 0)
    rate = hot / max(1, sum(counts.values()))
    if min(counts.get((False, 1), 0), counts.get((False, 0), 0)) < 3:
        return ToxicityModel(Lexicon(), base_rate=rate)
    lexicon = _learn_lexicon(rows.where("NOT calibrate"), lexicon_size)
    table = durable(_with_features(rows, lexicon).select("toxic", "calibrate", "_features")).coalesce(6)
    names = {"rawPredictionCol": "_raw_prediction", "probabilityCol": "_probability", "predictionCol": "_prediction"}
    booster = GBTClassifier(labelCol="toxic", featuresCol="_features", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, maxBins=64)
    for name, column in names.items():
        booster.set(booster.getParam(name), column)
    fitted = booster.fit(table.where("NOT calibrate").withColumn("toxic", F.col("toxic").cast("double")))
    both = min(counts.get((True, 1), 0), counts.get((True, 0), 0)) >= 3
    raw = fitted.transform(table.where("calibrate") if both else table).select(
        F.col("toxic").cast("double").alias("toxic"), vector_to_array("_probability")[1].alias("_raw")
    )
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="_raw", predictionCol="_calibrated").fit(raw)
    return ToxicityModel(lexicon, fitted, calibration, rate)
