"""Removal of repeated passages and lines by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerwork.llm.shared import bound_batches, durable, partitions_of, split_by_weight
from wickerwork.llm.words import WordBatch, mix, pieces, span_hashes

_U = np.uint64
_LOW = _U((1 << 24) - 1)
#: What a mark in the table of marks stands for.
FINGERPRINT, WHOLE_TEXT, LINE, REPEATS_ITSELF = range(4)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` entries, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


class Passages:
    """A passage is min_words words. It holds `window` reflowed lines of `width` words, one beginning at every word; its fingerprint is
    the line with the smallest hash. So equal passages have equal fingerprints at equal places."""

    def __init__(self, min_words: int):
        self.min_words = min_words
        self.window = min(62, max(1, 2 * min_words // 3 + 1))  # a passage's place before its fingerprint is a bit of a 64-bit mask
        self.width = min_words - self.window + 1

    def winnow(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of several texts at once (first: index of each text's first word, and the end): where their passages begin, where each one's
        fingerprint begins (the last of equal ones), and the hashes of all lines."""
        n = len(words) - self.min_words + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.arange(len(words) - self.width + 1)
        lines = mix(span_hashes(words, at, at + self.width))
        low = _sliding_min((lines & ~_LOW) | (_LOW - (at.astype(_U) & _LOW)), self.window)
        stop = np.repeat(first[1:], np.diff(first))[:n]
        start = np.flatnonzero(np.arange(n) + self.min_words <= stop)
        mark = start + (((_LOW - (low[start] & _LOW)).astype(np.int64) - start) & int(_LOW))
        return start, mark, lines

    def hashes(self, words: np.ndarray, start: np.ndarray) -> np.ndarray:
        return mix(span_hashes(words, start, start + self.min_words))

    def repeated_inside(self, words: np.ndarray, first: np.ndarray, start: np.ndarray, mark: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Which passages stand further up in the same text too. Only those whose fingerprint's hash does are looked at."""
        out = np.zeros(len(start), bool)
        if not len(start):
            return out
        owner = np.searchsorted(first, start, side="right").astype(_U)
        runs = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
        _, which, count = np.unique(lines[mark[runs]] ^ mix(owner[runs]), return_inverse=True, return_counts=True)
        open_ = np.flatnonzero(np.repeat(count[which] > 1, np.diff(np.r_[runs, len(mark)])))
        _, once = np.unique(self.hashes(words, start[open_]) ^ mix(owner[open_]), return_index=True)
        out[open_] = True
        out[open_[once]] = False
        return out


def _lines(words: WordBatch) -> tuple[np.ndarray, np.ndarray]:
    """First word and length in words of every physical line that has words."""
    line = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    return begin, np.diff(np.r_[begin, len(line)])


def _short_lines(words: WordBatch, p: Passages, line_words: int | None) -> tuple[np.ndarray, np.ndarray]:
    if not line_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, size = _lines(words)
    own = (size >= line_words) & (size < p.min_words)
    return begin[own], size[own]


def _marks(texts: DataFrame, p: Passages, line_words: int | None) -> DataFrame:
    """(doc_id, version, pos, kind, mark): fingerprints of passages that are new in their text; digests of whole texts of a passage and
    more; hashes of physical lines of line_words words and more that are shorter than a passage; texts that repeat their own passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in pieces(texts):
                words = WordBatch(texts[lo:hi], fold=False)
                first = words.first
                start, mark, lines = p.winnow(words.hash, first)
                again = p.repeated_inside(words.hash, first, start, mark, lines)
                chosen = np.unique(mark[~again])
                size = np.diff(first)
                whole = np.flatnonzero(size >= p.min_words)
                line, n_words = _short_lines(words, p, line_words)
                own = np.unique(np.searchsorted(first, start[again], side="right") - 1)
                owner_of = lambda at: np.searchsorted(first, at, side="right") - 1  # noqa: B023, E731
                owner = np.concatenate([owner_of(chosen), whole, owner_of(line), own])
                parts = [(chosen, lines[chosen] if len(chosen) else np.zeros(0, _U)), (first[whole], mix(span_hashes(words.hash, first[whole], first[whole + 1]) + size[whole].astype(_U)))]
                parts += [(line, mix(span_hashes(words.hash, line, line + n_words) + n_words.astype(_U))), (first[own], np.zeros(len(own), _U))]
                pos = np.concatenate([x for x, _ in parts]) - first[owner]
                kind = np.repeat(np.arange(4, dtype=np.int8), [len(x) for x, _ in parts])
                value = np.concatenate([x for _, x in parts]).view(np.int64)
                taken = pa.array(owner + lo)
                columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(pos.astype(np.int32)), pa.array(kind), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "pos", "kind", "mark"])

    return texts.mapInArrow(run, f"doc_id {texts.dtypes[0][1]}, version int, pos int, kind tinyint, mark long")


def _never_empty(keys: DataFrame) -> DataFrame:
    """keys and 0, so that plans stay alike whether there are hot keys or not; rows of a key here are only treated as hot ones."""
    return keys.where(F.col(keys.columns[0]) != 0).union(keys.sparkSession.range(1).select(F.lit(0).cast("long")))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs twice or more, and a column hot: those of hot keys (see split_by_weight) are never dealt by key."""
    often = durable(rows.groupBy(key).agg(F.count("*").alias("c")).where("c > 1"))
    hot, cold = split_by_weight(often, "c")
    hot = F.broadcast(_never_empty(hot.select(key)))
    common = rows.join(hot, key).withColumn("hot", F.lit(True))
    others = rows.join(hot, key, "left_anti").join(cold.select(key).hint("shuffle_hash"), key).withColumn("hot", F.lit(False))
    return durable(common.unionByName(others))


def _later(places: DataFrame, key: str) -> DataFrame:
    """(doc_id, version, pos) of all places of a key but its first, in the order of these columns; counts are combined before the shuffle."""
    repeated = _repeated(places, key)

    def of(part: DataFrame, spread: bool) -> DataFrame:
        first = part.groupBy(key).agg(F.min(F.struct("doc_id", "version", "pos")).alias("first"))
        joined = part.join(F.broadcast(first) if spread else first, key)
        return joined.where("struct(doc_id, version, pos) <> first").select("doc_id", "version", "pos")

    return of(repeated.where("hot"), True).unionByName(of(repeated.where("NOT hot"), False))


def _extended(asked: DataFrame, p: Passages) -> DataFrame:
    """For texts with places (of fingerprints): a row for each, with the fingerprint, where its first passage begins, and the hashes of all its
    passages, which extend it to both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in pieces(texts):
                words = WordBatch(texts[lo:hi], fold=False)
                start, mark, lines = p.winnow(words.hash, words.first)
                places = batch.column(3).slice(lo, hi - lo)
                wanted = np.zeros(len(words.hash), bool)
                wanted[np.repeat(words.first[:-1], places.value_lengths().to_numpy()) + places.flatten().to_numpy()] = True
                kept = wanted[mark]
                start, mark = start[kept], mark[kept]
                if not len(start):
                    continue
                runs = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
                owner = np.searchsorted(words.first, mark[runs], side="right") - 1
                taken = pa.array(owner + lo)
                held = pa.ListArray.from_arrays(pa.array(np.r_[runs, len(start)].astype(np.int32)), pa.array(p.hashes(words.hash, start).view(np.int64)))
                columns = [pa.array(lines[mark[runs]].view(np.int64)), batch.column(0).take(taken), batch.column(1).take(taken)]
                columns += [pa.array((start[runs] - words.first[owner]).astype(np.int32)), held]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "doc_id", "version", "start", "passages"])

    return asked.mapInArrow(run, f"mark long, doc_id {asked.dtypes[0][1]}, version int, start int, passages array<long>")


def _compare(held: pa.Table) -> pa.RecordBatch:
    """Of whole groups of rows with one fingerprint, in order: (doc_id, version, start, mask); bit j of a row's mask says that an
    earlier row has its passage j."""
    rows = held.combine_chunks().to_batches()[0]
    passages, sizes = rows.column(4).flatten().to_numpy(), rows.column(4).value_lengths().to_numpy().astype(np.int64)
    order = np.argsort(passages, kind="stable")
    again = np.zeros(len(passages), bool)
    again[order[1:]] = passages[order[1:]] == passages[order[:-1]]
    begin = np.cumsum(sizes) - sizes
    mask = np.add.reduceat(again.astype(np.int64) << (np.arange(len(passages)) - np.repeat(begin, sizes)), begin)
    taken = pa.array(np.flatnonzero(mask))
    return pa.RecordBatch.from_arrays([*(rows.column(c).take(taken) for c in (1, 2, 3)), pa.array(mask[mask != 0])], ["doc_id", "version", "start", "mask"])


def _compare_groups(rows: DataFrame) -> DataFrame:
    """rows, sorted by fingerprint inside each partition, a group at a time: a worker holds a batch and the group that runs over its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            marks = batch.column(0).to_numpy()
            if not len(marks):
                continue
            cut = int(np.searchsorted(marks, marks[-1]))  # where the last group begins
            before = open_ + ([batch.slice(0, cut)] if cut else [])
            if cut or (open_ and open_[-1].column(0)[0].as_py() != marks[0]):
                if before:
                    yield _compare(pa.Table.from_batches(before))
                open_ = []
            open_.append(batch.slice(cut))
        if open_:
            yield _compare(pa.Table.from_batches(open_))

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[1][1]}, version int, start int, mask long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, line_words: int | None = None) -> DataFrame:
    """What has an earlier occurrence, one row per text that holds any: doc_id, version (a hash of the text), copy (the whole text has one),
    itself (some passages have one in the same text), masks (passages: start of the first, and a bit for each word on) and lines (first words).

    Earlier is by doc_id, then version, then place; words are compared, not layout. A passage is any min_words words. Of the
    passages of a text that are new in it, winnowing keeps the fingerprints (Passages). Fingerprints that occur once are dropped; counts
    are combined before the shuffle. Copies of whole texts go by one digest. For all others each fingerprint is extended to
    both sides: the hashes of the passages that it stands for are sorted by fingerprint, and a task looks through one group at a time for
    passages with an earlier occurrence. Fingerprints that hold a large share of the rows are not grouped: their passages are
    rows of their own whose first occurrence is an aggregate. So exactly the passages with an earlier occurrence are found, whoever has it.
    """
    bound_batches(docs.sparkSession)
    p = Passages(min_words)
    texts = _versions(docs, id_col, text_col)
    marks = durable(_marks(texts, p, line_words))
    of_kind = lambda kind: marks.where(F.col("kind") == kind).select("doc_id", "version", "pos", "mark")
    text = ["doc_id", "version"]

    copies = _later(of_kind(WHOLE_TEXT), "mark").select(*text).distinct()
    copies = durable(copies.withColumn("copy", F.lit(True)))
    met = _repeated(of_kind(FINGERPRINT), "mark")
    hot = F.broadcast(_never_empty(durable(met.where("hot").select("mark").distinct())))  # fewer than 4 n rows
    places = met.join(copies.hint("shuffle_hash"), text, "left_anti").groupBy(*text).agg(F.collect_set("pos").alias("places"))  # at most a text's fingerprints
    asked = _only(texts, durable(places)).select("doc_id", "version", "text", "places")
    held = durable(_extended(asked, p))

    grouped = held.join(hot, "mark", "left_anti").select("mark", *text, "start", "passages")
    grouped = grouped.repartition(partitions_of(docs.sparkSession), "mark").sortWithinPartitions("mark", *text, "start")
    common = held.join(hot, "mark").select(*text, "start", F.posexplode("passages").alias("n", "passage"))
    common = common.select(*text, (F.col("start") + F.col("n")).alias("pos"), "passage")
    found = _compare_groups(grouped).unionByName(_later(common, "passage").select(*text, F.col("pos").alias("start"), F.lit(1).cast("long").alias("mask")))

    kinds = {"copy": "boolean", "itself": "boolean", "mask": "struct<start:int,mask:bigint>", "line": "int"}
    row = lambda df, **own: df.select(*text, *(own.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
    parts = [
        row(copies, copy=F.lit(True)),
        row(of_kind(REPEATS_ITSELF), itself=F.lit(True)),
        row(found, mask=F.struct("start", "mask")),
        row(_later(of_kind(LINE), "mark"), line=F.col("pos")),
    ]
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return everything.groupBy(*text).agg(
        F.coalesce(F.bool_or("copy"), F.lit(False)).alias("copy"),
        F.coalesce(F.bool_or("itself"), F.lit(False)).alias("itself"),
        F.collect_list("mask").alias("masks"),  # at most a text's passages
        F.collect_set("line").alias("lines"),  # at most a text's lines
    )


def _covered(words: WordBatch, p: Passages, line_words: int | None, copy: np.ndarray, itself: np.ndarray, masks: pa.ListArray, lines: pa.ListArray) -> np.ndarray:
    """Which words of some texts lie in passages or lines that have an earlier occurrence; a text's copy, itself, masks and lines as in repeats."""
    first, n = words.first, len(words.hash)
    of_copy = np.repeat(copy, np.diff(first))
    edges = np.zeros(n + 1, np.int64)
    flat = masks.flatten()
    start = flat.field(0).to_numpy() + np.repeat(first[:-1], masks.value_lengths().to_numpy())
    bits = flat.field(1).to_numpy()
    begin = np.concatenate([np.zeros(0, np.int64), *(start[(bits >> j) & 1 > 0] + j for j in range(p.window))])
    if copy.any() or itself.any():
        all_, mark, hashes = p.winnow(words.hash, first)
        again = p.repeated_inside(words.hash, first, all_, mark, hashes) if itself.any() else np.zeros(len(all_), bool)
        begin = np.concatenate([begin, all_[again | of_copy[all_]]])
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + p.min_words, -1)
    line, size = _short_lines(words, p, line_words)
    gone = np.zeros(n + 1, bool)
    gone[lines.flatten().to_numpy() + np.repeat(first[:-1], lines.value_lengths().to_numpy())] = True
    own = gone[line] | of_copy[line] if len(line) else gone[:0]
    np.add.at(edges, line[own], 1)
    np.add.at(edges, line[own] + size[own], -1)
    return np.cumsum(edges[:-1]) > 0


def _spans(words: WordBatch, covered: np.ndarray, i: int) -> list[tuple[int, int, int]]:
    """(start byte, stop byte, words) of the covered stretches of text i."""
    a, b = words.first[i], words.first[i + 1]
    edges = a + np.flatnonzero(np.diff(np.r_[False, covered[a:b], False].astype(np.int8)))
    return [(int(words.start[s] - words.offset[i]), int(words.end[e - 1] - words.offset[i]), int(e - s)) for s, e in zip(edges[::2], edges[1::2], strict=True)]


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return texts.withColumn("version", F.hash("text")).select("doc_id", "version", "text")


def _hash_values(wanted: DataFrame, id_col: str) -> DataFrame:
    """The hash values, at most 2**19 of them, that ids of wanted have: a bounded filter that may be broadcast."""
    return wanted.select(_hash_value(F.col(id_col)).alias("h")).distinct()


def _hash_value(id_):
    return F.pmod(F.xxhash64(id_), F.lit(1 << 19)).cast("int")


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts joined with wanted on (doc_id, version), rows that are alike once. The texts are first filtered by a hash of the id,
    so that a small share of wanted texts means a small shuffle."""
    few = _hash_values(wanted, "doc_id")
    near = texts.withColumn("h", _hash_value(F.col("doc_id"))).join(F.broadcast(few), "h", "left_semi").drop("h")
    return near.join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])


def cut_out(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text without the byte spans. A cut, with the white space around it, becomes one line break."""
    data, at, left = text.encode("utf-8", "surrogatepass"), 0, []
    for start, stop, _ in spans:
        left.append(data[at:start])
        at = stop
    left.append(data[at:])
    return "\n".join(x for x in (y.decode("utf-8", "replace").strip() for y in left) if x)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, line_words: int | None = None, drop_empty: bool = False
) -> DataFrame:
    """docs, all columns, with later repeats deleted from the text; plus words_cut, bytes_cut.

    Every word goes that lies in a passage of min_words words with an earlier occurrence, wherever in a line it begins, and, with
    line_words, in a physical line of line_words words and more with an earlier occurrence. No others go, and the first
    occurrence always stays; occurrences are those of the given texts (see repeats). With drop_empty, rows of whose text nothing
    is left go. Null texts and rows with a null id are returned as they are. Rows with the same id and text count as one
    occurrence and stay or change together. A row's other columns are untouched, whatever their names; columns
    named words_cut or bytes_cut are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("words_cut", "bytes_cut")
    p = Passages(min_words)
    found = durable(repeats(docs, id_col, text_col, min_words, line_words))
    few = F.broadcast(_hash_values(found, "doc_id"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    id_, text = F.col("row")[id_col], F.col("row")[text_col]
    keyed = keyed.withColumn("h", _hash_value(id_))
    far = keyed.join(few, "h", "left_anti").select("row.*", F.lit(0).alias("words_cut"), F.lit(0).alias("bytes_cut"))
    near = keyed.join(few, "h", "left_semi").select("row", id_.alias("doc_id"), F.hash(text).alias("version"))
    near = near.join(found, ["doc_id", "version"], "left").drop("doc_id", "version")
    schema = T.StructType([*docs.schema.fields, T.StructField("words_cut", T.IntegerType()), T.StructField("bytes_cut", T.IntegerType())])
    names, at = [*docs.columns, "words_cut", "bytes_cut"], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at].to_pylist()
            words_cut, bytes_cut = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
            touched = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            for lo, hi in pieces([texts[i] for i in touched]):
                rows = touched[lo:hi]
                words = WordBatch([texts[i] for i in rows], fold=False)
                copy, itself, masks, lines = (batch.column(c).take(pa.array(rows)) for c in (1, 2, 3, 4))
                copy, itself = (x.to_numpy(zero_copy_only=False).astype(bool) for x in (copy, itself))
                covered = _covered(words, p, line_words, copy, itself, masks, lines)
                for k, i in enumerate(rows):
                    if spans := _spans(words, covered, k):
                        texts[i] = cut_out(texts[i], spans)
                        words_cut[i], bytes_cut[i] = sum(s[2] for s in spans), sum(s[1] - s[0] for s in spans)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words_cut), pa.array(bytes_cut)], names)

    out = near.select("row", "copy", "itself", "masks", "lines").mapInArrow(run, schema)
    if drop_empty:
        out = out.where((F.col("words_cut") == 0) | (F.col(f"`{text_col}`") != ""))
    return out.unionByName(far)
