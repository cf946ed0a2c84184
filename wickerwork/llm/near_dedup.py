"""Near-duplicate detection: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.llm.components import components
from wickerwork.llm.shared import bound_batches, durable
from wickerwork.llm.words import WordBatch, mix, pieces

_U = np.uint64
#: Ids are prefiltered by this many hash values at most: the bound of the broadcast in _texts_of.
ID_BUCKETS = 1 << 19
#: Buckets of more members are compared inside tasks, in blocks of about BLOCK by BLOCK members, or fewer of long texts, so that
#: either side has about BLOCK_SHINGLES.
SMALL_BUCKET = 16
BLOCK = 400
BLOCK_SHINGLES = 500_000


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(seed)) | _U(1)


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles (A-Z lower-cased; fewer words: the whole
    sequence as one; no words: none)."""
    keys = _odd(width, 0x2545F4914F6CDD1D)
    for lo, hi in pieces(texts):
        batch = WordBatch(texts[lo:hi], fold=True)
        h, n = batch.hash, len(batch.hash)
        full = np.zeros(max(0, n - width + 1), _U)
        for j in range(width if len(full) else 0):
            full += h[j : n - width + 1 + j] * keys[j]
        full = mix(full)
        first = batch.first
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                yield mix((h[a:b] * keys[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a))
            else:
                yield np.zeros(0, _U)


class OnePermutation:
    """One hash of each element; its top bits choose the bin, the smallest hash of a bin is the bin's value. An empty bin
    copies the first filled one of its own fixed random order of bins (optimal densification)."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, bins = bands, rows, bands * rows
        self.bins = bins
        self.edges = np.array([(b << 64) // bins for b in range(bins)], dtype=_U)
        rng = np.random.default_rng(20_011)
        self.order = np.stack([rng.permutation(bins) for _ in range(bins)])
        self.keys = _odd(rows, 0x9E6C63D0876A9A47)
        self.salt = mix(np.arange(bands, dtype=_U) + _U(77))

    def bucket_keys(self, values: np.ndarray) -> np.ndarray:
        """One int64 a band; values sorted, not empty."""
        at = np.searchsorted(values, self.edges)
        upto = np.append(at[1:], len(values))
        filled = upto > at
        mins = values[np.minimum(at, len(values) - 1)]
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.order[empty]
            mins[empty] = mins[order[np.arange(len(empty)), filled[order].argmax(1)]]
        return mix((mins.reshape(self.bands, self.rows) * self.keys).sum(1, dtype=_U) + self.salt).view(np.int64)


def _sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = OnePermutation(bands, rows)
        for batch in batches:
            n, hi, lo, keys = [], [], [], []
            for values in shingle_sets(batch["text"].tolist(), width):
                n.append(len(values))
                digest = np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64)
                hi.append(digest[0])
                lo.append(digest[1])
                keys.append(hasher.bucket_keys(values) if len(values) else np.zeros(0, np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "n": n, "hi": hi, "lo": lo, "keys": keys})

    docs = docs.withColumn("digest", F.md5("text"))
    return docs.mapInPandas(run, f"doc_id {docs.dtypes[0][1]}, digest string, n long, hi long, lo long, keys array<long>")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (doc_id, text) without most rows whose id is not in ids(doc_id). A filter only: the hash values broadcast are at
    most ID_BUCKETS, whatever the number of ids."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).cast("int")
    few = ids.select(bucket.alias("b")).distinct()
    return docs.withColumn("b", bucket).join(F.broadcast(few), "b", "left_semi").drop("b")


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets have 100 * |A and B| >= percent * |A or B|."""
    kind = docs.dtypes[0][1]
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = _texts_of(docs, ids)
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(dict.fromkeys([*batch["text_a"], *batch["text_b"]]))
            place = {t: i for i, t in enumerate(texts)}
            sets = list(shingle_sets(texts, width))
            keep = []
            for ta, tb in zip(batch["text_a"], batch["text_b"], strict=True):
                x, y = sets[place[ta]], sets[place[tb]]
                common = _common(x, y)
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, f"a {kind}, b {kind}").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of left and right sets (sorted, distinct): a product of 0/1 matrices over the elements that occur
    on both sides, `columns` of them at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    flat = [np.concatenate([np.zeros(0, _U), *sets]) for sets in (left, right)]
    owner = [np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (left, right)]
    shared = np.intersect1d(*flat)
    if not len(shared):
        return out
    entries = []
    for values, who in zip(flat, owner, strict=True):
        column = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        kept = np.flatnonzero(shared[column] == values)
        kept = kept[np.argsort(column[kept], kind="stable")]
        entries.append((column[kept], who[kept]))
    for lo in range(0, len(shared), columns):
        sides = []
        for (column, who), sets in zip(entries, (left, right), strict=True):
            a, b = np.searchsorted(column, (lo, lo + columns))
            dense = np.zeros((len(sets), min(columns, len(shared) - lo)), np.float32)
            dense[who[a:b], column[a:b] - lo] = 1.0
            sides.append(dense)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _open_members(met: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Members of the buckets that hold several components: component, and of the bucket its shingles, its largest component (main,
    its rows and shingles) and a random member (centre, its component cc and size n2)."""
    known = labels.select(F.col("node").alias("doc_id"), "component")
    own = met.where("c > 2").join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rank = F.xxhash64("doc_id", "band", "key", F.lit(turn))
    by_component = own.groupBy("band", "key", "component").agg(
        F.count("*").alias("m"), F.sum("n").alias("w"), F.min(F.struct(rank.alias("r"), F.col("doc_id").alias("centre"), F.col("component").alias("cc"), F.col("n").alias("n2"))).alias("pick")
    )
    state = (
        by_component.groupBy("band", "key")
        .agg(F.count("*").alias("parts"), F.max_by("component", F.struct("m", "component")).alias("main"), F.max(F.struct("m", "component", "w")).alias("most"), F.sum("w").alias("weight"), F.min("pick").alias("pick"))
        .where("parts > 1")
        .select("band", "key", "main", F.col("most.m").alias("main_rows"), F.col("most.w").alias("main_weight"), "weight", "pick.centre", "pick.cc", "pick.n2")
    )
    return own.join(state, ["band", "key"])


def _more_stars(met, labels, compared, texts, width, percent, similar_size) -> DataFrame:
    """Links found with a centre of its own for every bucket that holds several components."""
    pairs = _open_members(met, labels, 1).where("component <> cc").where(similar_size)
    pairs = pairs.select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct()
    return durable(confirm(pairs.join(compared, ["a", "b"], "left_anti"), texts, width, percent))


def _between_components(met, labels, texts, width, percent, similar_size) -> DataFrame:
    """All links between members of one bucket that are in different components."""
    kind = dict(met.dtypes)["doc_id"]
    members = durable(_open_members(met, labels, 2).select("band", "key", "c", "main", "main_rows", "weight", "main_weight", "doc_id", "component", "n"))
    small = members.where(F.col("c") <= SMALL_BUCKET)
    left = small.where("component <> main").select("band", "key", F.col("doc_id").alias("x"), F.col("component").alias("cx"), "n")
    right = small.select("band", "key", F.col("doc_id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("n2"))
    pairs = left.join(right, ["band", "key"]).where("cx <> cy").where(similar_size)
    pairs = durable(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = confirm(pairs, texts, width, percent)

    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("int")
    others = blocks(F.col("c") - F.col("main_rows"), F.col("weight") - F.col("main_weight"))
    large = members.where(F.col("c") > SMALL_BUCKET).withColumns({"tb": blocks(F.col("c"), F.col("weight")), "pb": others})
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = large.where("component <> main").select("band", "key", own("pb").alias("i"), each("tb").alias("j"), "doc_id", "component", "n", F.lit(True).alias("probe"))
    targets = large.select("band", "key", each("pb").alias("i"), own("tb").alias("j"), "doc_id", "component", "n", F.lit(False).alias("probe"))
    together = probes.union(targets)
    together = together.join(_texts_of(texts, large.select("doc_id")), "doc_id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        distinct = list(dict.fromkeys(group["text"]))
        sets = dict(zip(distinct, shingle_sets(distinct, width), strict=True))
        ids, component = group["doc_id"].to_numpy(), group["component"].to_numpy()
        own = [sets[t] for t in group["text"]]
        size = np.array([len(x) for x in own], np.int64)
        is_probe = group["probe"].to_numpy(bool)
        probe, target = np.flatnonzero(is_probe), np.flatnonzero(~is_probe)
        common = common_counts([own[i] for i in probe], [own[j] for j in target])
        either = size[probe][:, None] + size[target][None, :] - common
        linked = (common > 0) & (100 * common >= percent * either) & (component[probe][:, None] != component[target][None, :])
        at = np.nonzero(linked)
        x, y = ids[probe[at[0]]], ids[target[at[1]]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    inside = together.groupBy("band", "key", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")
    return durable(found.union(inside).distinct())


def _classified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """near_duplicates with the digest of every row's text."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = durable(_sketch(source, width, bands, rows))
    taking_part = sketches.where("doc_id IS NOT NULL AND n > 0")
    nth = F.row_number().over(Window.partitionBy("hi", "lo").orderBy("doc_id"))
    reps = durable(taking_part.withColumn("nth", nth).where("nth = 1").select("doc_id", "n", "hi", "lo", "keys"))

    members = reps.select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("doc_id").alias("low")).where("c > 1")
    # Bucket members that have company; every later step reads this table.
    met = durable(members.join(shared, ["band", "key"]).select("band", "key", "c", "low", "doc_id", "n"))
    similar_size = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"

    sizes = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("n2"))
    star = met.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"), "n").distinct()
    compared = durable(star.join(sizes, "a").where(similar_size).select("a", "b"))
    text_source = source.where("doc_id IS NOT NULL")
    links = durable(confirm(compared, text_source, width, percent))
    links = links.union(_more_stars(met, components(links), compared, text_source, width, percent, similar_size))
    labels = components(links)
    found = _between_components(met, labels, text_source, width, percent, similar_size)
    if found.limit(1).count():
        labels = components(links.union(found))

    classes = (
        taking_part.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
        .join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    )
    return sketches.join(classes, ["hi", "lo"], "left").select(
        "doc_id",
        "digest",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce((F.col("n") == 0) | (F.col("component") == F.col("doc_id")), F.lit(True)).alias("kept"),
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their word-shingle sets is at least percent / 100;
    component_id is the smallest id reachable over links, kept says doc_id = component_id.

    Equal sets are first reduced to one class (combined before the shuffle), so copies cost nothing. Classes meet in
    banded buckets: with 32 bands of 4, a pair at the threshold shares none with probability 5e-8. Each bucket
    links its members to one centre (a star), and every candidate is confirmed on the full sets. Confirmed links are
    joined into components. Buckets that still hold several components get a second star, with a centre of their own
    each. What is then still in different components is compared exactly: members of other components than the
    bucket's largest against all members, as pairs in buckets of at most SMALL_BUCKET members, else block by block
    inside tasks, which return links only. So no link is lost, no bucket is capped, and the rows emitted do not grow
    with the square of a group.

    Null text and texts without words have no shingles and are linked with nothing. Rows with a null id take no
    part: component_id null, kept true. Rows with the same id share that id's place in the order. Other columns are
    ignored. An empty table gives an empty result.
    """
    return _classified(docs, id_col, text_col, width, percent, bands, rows).drop("digest")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; rows with a null id stay. Rows of one id are judged each by its own text."""
    gone = _classified(docs, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias("_near_id"), F.col("digest").alias("_near_digest")).distinct()
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(gone, (docs[id_col] == F.col("_near_id")) & (digest == F.col("_near_digest")), "left_anti").select(*docs.columns)
