"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerwork.llm.shared import bound_batches, durable
from wickerwork.llm.words import WordBatch, mix, pieces

_U = np.uint64
#: Longer training sequences are worked on in pieces of so many tokens side by side; messages carry the states over the borders.
PIECE = 512
#: Longer texts are scored by products of transfer matrices of their parts, side by side, and not step by step.
LONG_TEXT = 8192


@dataclass
class HMM:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (K, C)

    @staticmethod
    def guess(states: int, prior: np.ndarray, rng: np.random.Generator) -> HMM:
        move = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
        emit = prior * rng.gamma(2.0, 0.5, (states, len(prior)))
        return HMM(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def model(self, prior: np.ndarray) -> HMM:
        """Expected counts to probabilities; each state's emissions lean on the classes' overall rates, so none is zero."""
        start, move = self.start + 1.0, self.move + 0.1
        emit = self.emit + 20.0 * prior
        return HMM(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


@dataclass
class Pieces:
    """Whole sequences in pieces of at most PIECE classes: obs (n, PIECE), each piece's length, and whether it goes on from the piece before."""

    obs: np.ndarray
    length: np.ndarray
    goes_on: np.ndarray

    @staticmethod
    def of(sequences: list[np.ndarray], most: int = PIECE) -> Pieces:
        size = np.array([len(s) for s in sequences], np.int64)
        per = (size + most - 1) // most
        flat = np.concatenate([np.zeros(0, np.uint16), *sequences])
        row0 = np.cumsum(per) - per
        within = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        obs = np.zeros((int(per.sum()), min(most, int(size.max(initial=1)))), np.int64)
        obs[np.repeat(row0, size) + within // most, within % most] = flat
        length = np.full(len(obs), most, np.int64)
        last = row0[per > 0] + per[per > 0] - 1
        length[last] = size[per > 0] - (per[per > 0] - 1) * most
        goes_on = np.ones(len(obs), bool)
        goes_on[row0[per > 0]] = False
        return Pieces(obs, length, goes_on)


def _messages(hmm: HMM, x: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Of every piece: the states' probabilities given all tokens before it, and the weights that all tokens after it give its last states.
    The product of a piece's steps after its first token carries both over the piece; only sequences of several pieces need it."""
    n, k = len(x.obs), len(hmm.start)
    enter, leave = np.zeros((n, k)), np.ones((n, k))
    goes_on = np.flatnonzero(x.goes_on)
    if not len(goes_on):
        return enter, leave
    several = np.unique(np.concatenate([goes_on - 1, goes_on]))
    order = several[np.argsort(-x.length[several], kind="stable")]
    length, emit = x.length[order], np.ascontiguousarray(hmm.emit.T)
    steps = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for t in range(1, int(length[0])):
        m = int(np.searchsorted(-length, -t, side="left"))
        moved = (steps[:m].reshape(m * k, k) @ hmm.move).reshape(m, k, k) * emit[x.obs[order[:m], t]][:, None, :]
        steps[:m] = moved / moved.sum((1, 2))[:, None, None]
    product = dict(zip(order.tolist(), steps, strict=True))
    for i in goes_on:
        own = (enter[i - 1] @ hmm.move if x.goes_on[i - 1] else hmm.start) * emit[x.obs[i - 1, 0]]
        enter[i] = own @ product[i - 1]
        enter[i] /= enter[i].sum()
    for i in goes_on[::-1]:
        leave[i - 1] = hmm.move @ (emit[x.obs[i, 0]] * (product[i] @ leave[i]))
        leave[i - 1] /= leave[i - 1].sum()
    return enter, leave


def expect(hmm: HMM, x: Pieces, into: Counts) -> None:
    """Forward-backward over whole sequences; adds the expected counts of states, moves and classes to `into`."""
    if not len(x.obs):
        return
    enter, leave = _messages(hmm, x)
    order = np.argsort(-x.length, kind="stable")
    obs, length, goes_on, enter, leave = x.obs[order], x.length[order], x.goes_on[order], enter[order], leave[order]
    steps, n, k = int(length[0]), len(length), len(hmm.start)
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # pieces longer than t
    emit = np.ascontiguousarray(hmm.emit.T)
    alpha, scale = np.zeros((steps, n, k)), np.ones((steps, n))
    for t in range(steps):
        m = active[t]
        before = alpha[t - 1, :m] @ hmm.move if t else np.where(goes_on[:, None], enter @ hmm.move, hmm.start[None, :])
        a = before * emit[obs[:m, t]]
        scale[t, :m] = a.sum(1)
        alpha[t, :m] = a / scale[t, :m, None]
    beta = leave / (alpha[length - 1, np.arange(n)] * leave).sum(1)[:, None]
    for t in range(steps - 1, -1, -1):
        m = active[t]
        ahead = emit[obs[:m, t]] * beta[:m] / scale[t, :m, None]
        if t:
            into.move += hmm.move * (alpha[t - 1, :m].T @ ahead)
        else:
            into.move += hmm.move * (enter[goes_on].T @ ahead[goes_on])
            into.start += (alpha[0] * beta)[~goes_on].sum(0)
        alpha[t, :m] *= beta[:m]
        beta[:m] = ahead @ hmm.move.T
    inside = np.arange(steps)[:, None] < length[None, :]
    classes, weights = obs[:, :steps].T[inside], alpha[inside]
    for i in range(k):
        into.emit[i] += np.bincount(classes, weights=weights[:, i], minlength=into.emit.shape[1])


def _packs(sequences: Iterator[np.ndarray], tokens: int = 600_000) -> Iterator[list[np.ndarray]]:
    """Lists of sequences whose pieces have room for about so many tokens: bounds what forward-backward holds."""
    held, n = [], 0
    for x in sequences:
        held.append(x)
        n += max(len(x), PIECE)
        if n > tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def log_likelihoods(hmm: HMM, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log of each whole sequence's probability; 0 for an empty one."""
    out = np.zeros(len(sequences))
    size = np.array([len(s) for s in sequences], np.int64)
    for i in np.flatnonzero(size > LONG_TEXT):
        out[i] = _long_likelihood(hmm, sequences[i].astype(np.int64))
    order = np.array([i for i in np.argsort(-size, kind="stable") if 0 < size[i] <= LONG_TEXT], np.int64)
    if not len(order):
        return out
    length = size[order]
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    begin = np.cumsum(length) - length
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    emit, total, alpha = np.ascontiguousarray(hmm.emit.T), np.zeros(len(order)), None
    for t in range(length[0]):
        m = active[t]
        a = (alpha[:m] @ hmm.move if t else hmm.start[None, :]) * emit[flat[begin[:m] + t]]
        scale = a.sum(1)
        alpha = a / scale[:, None]
        total[:m] += np.log(scale)
    out[order] = total
    return out


def _long_likelihood(hmm: HMM, obs: np.ndarray) -> float:
    states, emit = len(hmm.start), hmm.emit.T
    first = hmm.start * emit[obs[0]]
    total = np.log(first.sum())
    vector, rest = first / first.sum(), obs[1:]
    parts = max(1, int(np.sqrt(len(rest))))
    length = len(rest) // parts
    block = rest[: parts * length].reshape(parts, length)
    product, scale = np.broadcast_to(np.eye(states), (parts, states, states)).copy(), np.zeros(parts)
    for t in range(length):
        product = (product @ hmm.move) * emit[block[:, t]][:, None, :]
        size = product.sum((1, 2))
        product /= size[:, None, None]
        scale += np.log(size)
    for p in range(parts):
        vector = vector @ product[p]
        total += np.log(vector.sum()) + scale[p]
        vector /= vector.sum()
    for c in rest[parts * length :]:
        vector = (vector @ hmm.move) * emit[c]
        total += np.log(vector.sum())
        vector /= vector.sum()
    return float(total)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(7)) == 2


def _endings(words: WordBatch, buckets: int) -> np.ndarray:
    """Class of a rare word: a hash of its last three bytes."""
    out = np.zeros(len(words.start), _U)
    for back in (1, 2, 3):
        at = np.maximum(words.end - back, words.start)
        byte = words.data[at].astype(_U)
        byte = np.where((byte >= 65) & (byte <= 90), byte + _U(32), byte)
        out = (out << _U(8)) | byte
    return (mix(out) % _U(buckets)).astype(np.int32)


def _commonest(counts: DataFrame, most: int) -> pd.DataFrame:
    """At most `most` rows of counts, the commonest first: all whose count is in the upper of the classes (64 to an octave, so
    a few thousand in all) that together hold no more. Neither a sort nor a limit, whose cost would grow with the tasks."""
    level = F.floor(F.log2("c") * 64)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).toPandas().sort_values("level", ascending=False)
    fitting = levels[levels["n"].cumsum() <= most]
    if fitting.empty:
        return counts.limit(0).toPandas()
    return counts.where(level >= int(fitting["level"].min())).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = 8,
    own_classes: int = 2000,
    buckets: int = 1024,
    local_words: int = 131_072,
    iterations: int = 3,
    warm_rows: int = 1500,
    trace: list | None = None,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text is its words (A-Z lower-cased) and one end. base_score is the add-one unigram log10 probability; score is
    that of a hidden Markov model over word classes times the word's add-one share of its class. The
    own_classes commonest words are classes of their own, other words fall into `buckets` classes by their ending, so
    the model has states * classes parameters whatever the corpus. Baum-Welch starts from a fit to about warm_rows
    texts and 500 * warm_rows tokens (a hash sample without texts over 100,000 tokens, only a starting point: a documented bound of
    what the driver holds) and then runs `iterations` times over all training texts, each as one whole sequence: every
    task returns expected counts, Spark sums them, and the last sums are the model. Scores are exact: the forward recursion
    runs over the whole text. `trace`, if given, gets the final HMM.

    Word counts are Spark aggregates over all training texts, keyed by a 64-bit word hash. The local_words
    commonest (a fixed bound) are looked up in the tasks, all other words of a text are joined with the counts in a
    shuffle; no such word is frequent, so no task gets a hot key. Training texts are those whose
    crc32(id as text) mod 7 is not 2. Null text counts as empty, a null id as ''; rows may repeat; other columns are
    ignored. Without any training text all probabilities are 1 and scores 0. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    kind = docs.select(id_col).dtypes[0][1]
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(F.col(id_col)).alias("held_out"))

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in pieces(texts):
                words = WordBatch(texts[lo:hi], fold=True)
                keys, at, n = np.unique(words.hash, return_index=True, return_counts=True)
                yield pd.DataFrame({"h": keys.view(np.int64), "bucket": _endings(words, buckets)[at], "c": n})

    train = source.where(~F.col("held_out"))
    counted = train.select("text").mapInPandas(count_words, "h long, bucket int, c long")
    counts = durable(counted.groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c")))
    ends = train.count()
    by_bucket = counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()  # at most `buckets` rows
    n_train = int(by_bucket["c"].sum()) + ends
    v_train = int(by_bucket["v"].sum()) + (1 if ends else 0)
    top = _commonest(counts, local_words)
    own = top.iloc[:own_classes]
    bucket_c, bucket_v = np.zeros(buckets), np.zeros(buckets)
    bucket_c[by_bucket["bucket"]], bucket_v[by_bucket["bucket"]] = by_bucket["c"], by_bucket["v"]
    np.subtract.at(bucket_c, own["bucket"].to_numpy(), own["c"].to_numpy(np.float64))
    np.subtract.at(bucket_v, own["bucket"].to_numpy(), 1.0)
    log_share = np.log10(bucket_c + bucket_v + 1.0)  # what a word of the bucket is divided by
    end_class = own_classes + buckets
    prior = np.concatenate([np.pad(own["c"].to_numpy(np.float64), (0, own_classes - len(own))), bucket_c, [ends]]) + 0.5
    prior /= prior.sum()
    order = np.argsort(top["h"].to_numpy(np.int64).view(_U))
    top_keys = top["h"].to_numpy(np.int64).view(_U)[order]
    top_log = np.log10(top["c"].to_numpy(np.float64) + 1.0)[order]
    top_class = np.where(np.arange(len(top)) < own_classes, np.arange(len(top)), -1)[order]
    end_log, unit_log = float(np.log10(ends + 1.0)), float(np.log10(n_train + v_train + 1.0))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in pieces(texts):
                words = WordBatch(texts[lo:hi], fold=True)
                bucket = _endings(words, buckets)
                place = np.minimum(np.searchsorted(top_keys, words.hash), max(0, len(top_keys) - 1))
                local = top_keys[place] == words.hash if len(top_keys) else np.zeros(len(words.hash), bool)
                class_ = np.where(local, top_class[place], -1) if len(top_keys) else np.full(len(words.hash), -1)
                in_bucket = class_ < 0
                class_ = np.where(in_bucket, own_classes + bucket, class_).astype(np.uint16)
                log_c = np.where(local, top_log[place], 0.0) if len(top_keys) else np.zeros(len(words.hash))
                of = lambda x: np.add.reduceat(np.append(x, 0.0), words.first[:-1]) * (np.diff(words.first) > 0)  # noqa: B023, E731
                first = words.first
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[lo:hi].to_numpy(),
                        "held_out": batch["held_out"].iloc[lo:hi].to_numpy(),
                        "n_tokens": np.diff(first) + 1,
                        "known_local": of(local).astype(np.int64),
                        "log_local": of(log_c),
                        "log_share": of(np.where(in_bucket, np.where(local, log_c, 0.0) - log_share[bucket], 0.0)),
                        "classes": [np.append(class_[a:b], np.uint16(end_class)).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)],
                        "tail": [words.hash[a:b][~local[a:b]].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)],
                    }
                )

    coded = source.mapInPandas(
        encode,
        f"doc_id {kind}, held_out boolean, n_tokens long, known_local long, log_local double, log_share double, classes binary, tail array<long>",
    )
    coded = durable(coded.withColumn("row", F.monotonically_increasing_id()))

    n_classes = end_class + 1
    empty = lambda: Counts(np.zeros(states), np.zeros((states, states)), np.zeros((states, n_classes)))
    learning = coded.where("NOT held_out").select("row", "classes")
    share = min(1.0, warm_rows / max(1, ends), 500 * warm_rows / max(1, n_train))
    drawn = learning.where(F.pmod(F.xxhash64("row", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))
    warm = drawn.where(F.octet_length("classes") <= 200_000).toPandas()
    sample = [Pieces.of(x) for x in _packs(np.frombuffer(x, np.uint16) for x in warm.sort_values("row")["classes"])]
    hmm = HMM.guess(states, prior, np.random.default_rng(5))
    for _ in range(15 if sample else 0):
        sums = empty()
        for x in sample:
            expect(hmm, x, sums)
        hmm = sums.model(prior)

    for _ in range(iterations if ends else 0):
        current = hmm

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = empty()
            for held in _packs(np.frombuffer(x, np.uint16) for batch in batches for x in batch["classes"]):
                expect(current, Pieces.of(held), sums)  # noqa: B023
            table = np.concatenate([sums.start[:, None], sums.move, sums.emit], axis=1)
            yield pd.DataFrame({"i": np.arange(table.size), "x": table.ravel()})

        summed = learning.select("classes").mapInPandas(step, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
        cells = summed.toPandas()  # states * (1 + states + classes) rows
        table = np.zeros(states * (1 + states + n_classes))
        table[cells["i"].to_numpy()] = cells["x"].to_numpy()
        table = table.reshape(states, -1)
        hmm = Counts(table[:, 0], table[:, 1 : 1 + states], table[:, 1 + states :]).model(prior)
    final = hmm
    if trace is not None:
        trace.append(final)

    def likelihood(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = log_likelihoods(final, [np.frombuffer(x, np.uint16) for x in batch["classes"]])
            yield batch.drop(columns="classes").assign(log_classes=found / np.log(10.0))

    passed = coded.select("row", "doc_id", "held_out", "n_tokens", "known_local", "log_local", "log_share", "classes").mapInPandas(
        likelihood, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known_local long, log_local double, log_share double, log_classes double"
    )
    rare = (
        coded.select("row", F.explode("tail").alias("h"))
        .join(counts.select("h", "c"), "h")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("c") + 1.0)).alias("log_rare"), F.count("*").alias("known_rare"))
    )
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    base = F.col("log_local") + log_rare + end_log - F.col("n_tokens") * unit_log
    score = F.col("log_classes") + F.col("log_share") + log_rare
    return passed.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known_local") + F.coalesce("known_rare", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (score if ends else base).alias("score"),
    )
