"""Phrase collocation mining: phrases counted in HAT-tries that spill sorted runs, merged per prefix partition, then scored exactly."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerwork.llm.shared import bound_batches, durable
from wickerwork.llm.words import mix, span_hashes

_U = np.uint64
_ID_BITS = 20
#: Longest phrase that the packed ids can hold: one word and a suffix of three.
LONGEST = 4
#: A task forgets its words, after spilling all it has counted, when it knows so many (ids stay below 2 ** _ID_BITS).
MAX_WORDS = 300_000
#: A task spills its largest subtrees until half is left when it holds so many phrases.
MAX_ENTRIES = 500_000
#: A container of more suffixes bursts into one container for each next word.
BURST = 2048
#: Bytes of text that are words at a time.
SLICE = 1 << 20
#: Bits of the filter of frequent phrases: 16 a phrase, at least and at most so many (8 MB, the bound of the broadcast).
FILTER_BITS = (1 << 16, 1 << 26)
#: Single words are the parts of many phrases: their counts are joined in so many copies.
SALT = 16

# Signs that end a piece, and the one they are all mapped to.
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = ord(".")
_FOLD = bytearray(range(256))
_FOLD[65:91] = bytes(range(97, 123))
_FOLD[9] = 32
for _b in _BREAKS:
    _FOLD[_b] = _BREAK
_FOLD = bytes(_FOLD)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, _BREAK]] = False
_KEYS = mix(np.arange(1, LONGEST + 1, dtype=_U) * _U(0x2545F4914F6CDD1D)) | _U(1)
_LENGTH = _U(0x9E3779B97F4A7C15)

#: Prefix partitions: the runs of a language that are summed together.
PARTS = 512
#: Phrases that a prefix partition gathers from its runs, at least, before they are summed.
MERGE = 500_000

SCHEMA = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("prefix", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


@dataclass
class Words:
    """Words of a slice of text: their bytes data[start:end], the piece each is in, and a 64-bit hash; the first `known` of them were in
    the slice before, which a phrase over the border needs."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    hash: np.ndarray
    known: int

    def phrases(self, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word whether a phrase of `size` words of one piece starts there that ends among the new words; and all such phrases' hashes."""
        m = max(0, len(self.start) - size + 1)
        here = self.piece[:m] == self.piece[size - 1 : m + size - 1]
        here[: max(0, self.known - size + 1)] = False
        h = np.full(m, (salt + size) % 2**64, _U)
        for j in range(size):
            h += self.hash[j : m + j] * _KEYS[j]
        return here, mix(h)


def word_slices(texts: list[bytes], keep: int) -> Iterator[Words]:
    """The words of all texts in order, about SLICE bytes at a time, after the last `keep` words of the slice before."""
    data = b".".join(texts).translate(_FOLD) + b"."
    at, head, known = 0, b"", 0
    while at < len(data):
        cut = data.find(b" ", at + SLICE)
        stop = len(data) if cut < 0 else cut
        own = head + data[at:stop]
        at = stop
        raw = np.frombuffer(own, np.uint8)
        inside = np.concatenate([[False], _IN_WORD[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        spans = span_hashes(raw.astype(_U) + _U(1), start, end)
        yield Words(own, start, end, np.cumsum(raw == _BREAK)[start], mix(spans + (end - start).astype(_U) * _LENGTH), known)
        known = min(keep, len(start))
        head = own[start[len(start) - known] :] if known else b""


def has_bits(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & _U(len(bitmap) * 64 - 1)
    return (bitmap[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def salt_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


class HatTrie:
    """Counts of phrases of `size` word ids: below each first word a container, a hash table from the packed ids of the other words to
    a count. A container of more than BURST suffixes bursts: a node of containers by the next word takes its place, as deep as words last."""

    def __init__(self, size: int):
        self.size, self.root, self.entries, self.held = size, {}, 0, {}

    def add(self, first: np.ndarray, suffix: np.ndarray, count: np.ndarray) -> None:
        """Arrays sorted by first."""
        edges = np.flatnonzero(np.diff(first)) + 1
        suffix, count = suffix.tolist(), count.tolist()
        bounds = [0, *edges.tolist(), len(suffix)]
        for word, lo, hi in zip(first[bounds[:-1]].tolist(), bounds, bounds[1:], strict=False):
            before = self.entries
            node = self.root.get(word)
            if node is None:
                node = self.root[word] = (False, {})
            self.root[word] = self._into(node, self.size - 1, suffix[lo:hi], count[lo:hi])
            self.held[word] = self.held.get(word, 0) + self.entries - before

    def _into(self, node: tuple, left: int, suffix: list, count: list) -> tuple:
        """node is (burst, table); left: words of the suffix. Returns what stands there afterwards."""
        burst, table = node
        if burst:
            shift = _ID_BITS * (left - 1)
            by_next: dict[int, tuple[list, list]] = {}
            for k, c in zip(suffix, count, strict=True):
                keys, counts = by_next.setdefault(k >> shift, ([], []))
                keys.append(k & (1 << shift) - 1)
                counts.append(c)
            for word, (keys, counts) in by_next.items():
                table[word] = self._into(table.get(word, (False, {})), left - 1, keys, counts)
            return node
        before, get = len(table), table.get
        for k, c in zip(suffix, count, strict=True):
            table[k] = get(k, 0) + c
        self.entries += len(table) - before
        if left < 2 or len(table) <= BURST:
            return node
        self.entries -= len(table)
        return self._into((True, {}), left, list(table), list(table.values()))

    def largest(self) -> list[int]:
        return sorted(self.held, key=lambda w: (-self.held[w], w))

    def take(self, word: int, suffixes: list[int], counts: list[int]) -> int:
        """Move the whole subtree of a first word out of the trie to the end of suffixes and counts; returns its phrases."""

        def walk(node, left, head):
            burst, table = node
            if burst:
                for nxt, child in table.items():
                    walk(child, left - 1, (head << _ID_BITS) | nxt)
            elif head:
                head <<= _ID_BITS * left
                suffixes.extend([head | k for k in table])
                counts.extend(table.values())
            else:
                suffixes.extend(table)
                counts.extend(table.values())

        walk(self.root.pop(word), self.size - 1, 0)
        taken = self.held.pop(word)
        self.entries -= taken
        return taken


class PhraseCounter:
    """Counts frequent phrases of one language in a task by their words, in one HAT-trie for each size; spilled subtrees come out as sorted
    runs. sizes: size -> the filter that both parts of one word less pass (None: any); own: size -> the filter that the phrases pass. Words that
    no phrase needs get no id."""

    def __init__(self, lang: str, sizes: Mapping[int, np.ndarray | None], own: Mapping[int, np.ndarray] | None = None):
        self.lang, self.sizes, self.own, self.salt = lang, sizes, own or {}, salt_of(lang)
        self.total = 0
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[int, int] = {}
        self.text: list[bytes] = []
        self.tries = {size: HatTrie(size) for size in self.sizes}

    @property
    def entries(self) -> int:
        return sum(t.entries for t in self.tries.values())

    def feed(self, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for words in word_slices(texts, max(self.sizes) - 1):
            self.total += len(words.start) - words.known
            self._count(words)
            if len(self.text) > MAX_WORDS:
                yield from self.spill(0)
                self._forget()
            elif self.entries > MAX_ENTRIES:
                yield from self.spill(MAX_ENTRIES // 2)

    def _count(self, words: Words) -> None:
        starts = {}
        for size, parts in self.sizes.items():
            here, hashes = words.phrases(size, self.salt)
            if size in self.own:
                here &= has_bits(self.own[size], hashes)
            if parts is not None and len(here):
                known = has_bits(parts, words.phrases(size - 1, self.salt)[1])
                here &= known[: len(here)] & known[1 : len(here) + 1]
            starts[size] = np.flatnonzero(here)
        used = np.zeros(len(words.start), bool)
        for size, at in starts.items():
            for j in range(size):
                used[at + j] = True
        places = np.flatnonzero(used)
        if not len(places):
            return
        distinct, first, inverse = np.unique(words.hash[places], return_index=True, return_inverse=True)
        own_ids = np.empty(len(distinct), np.int64)
        for i, (h, at) in enumerate(zip(distinct.tolist(), places[first].tolist(), strict=True)):
            found = self.ids.get(h)
            if found is None:
                found = self.ids[h] = len(self.text)
                self.text.append(words.data[words.start[at] : words.end[at]])
            own_ids[i] = found
        ids = np.zeros(len(words.start), np.int64)
        ids[places] = own_ids[inverse]
        for size, at in starts.items():
            if len(at):
                self._add(size, ids, at)

    def _add(self, size: int, ids: np.ndarray, at: np.ndarray) -> None:
        first, suffix = ids[at], np.zeros(len(at), np.int64)
        for j in range(1, size):
            suffix = (suffix << _ID_BITS) | ids[at + j]
        order = np.lexsort((suffix, first)) if size > 1 else np.argsort(first, kind="stable")
        first, suffix = first[order], suffix[order]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (suffix[1:] != suffix[:-1])])
        start = np.flatnonzero(new)
        self.tries[size].add(first[start], suffix[start], np.diff(np.append(start, len(first))))

    def spill(self, down_to: int) -> Iterator[pa.RecordBatch]:
        """Whole subtrees, largest first, until down_to phrases are left; about 50,000 phrases make a run, sorted by phrase."""
        for size, trie in self.tries.items():
            least = down_to // len(self.tries)
            firsts, sizes, suffixes, counts = [], [], [], []
            for word in trie.largest():
                if trie.entries <= least:
                    break
                firsts.append(word)
                sizes.append(trie.take(word, suffixes, counts))
                if len(counts) > 50_000:
                    yield self._run(size, np.repeat(firsts, sizes), suffixes, counts)
                    firsts, sizes, suffixes, counts = [], [], [], []
            if counts:
                yield self._run(size, np.repeat(firsts, sizes), suffixes, counts)

    def _run(self, size: int, first: np.ndarray, suffixes: list[int], counts: list[int]) -> pa.RecordBatch:
        ids, suffix = np.empty((len(counts), size), np.int64), np.array(suffixes, np.int64)
        for j in range(size - 1, 0, -1):
            ids[:, j] = suffix & (1 << _ID_BITS) - 1
            suffix = suffix >> _ID_BITS
        ids[:, 0] = first
        used, place = np.unique(ids, return_inverse=True)
        texts = pa.array([self.text[i] for i in used.tolist()], pa.binary()).cast(pa.string())
        columns = [texts.take(pa.array(place.reshape(ids.shape)[:, j])) for j in range(size)]
        joined = lambda some: pc.binary_join_element_wise(*some, " ") if len(some) > 1 else some[0]
        run = pa.table({
            "lang": pa.repeat(pa.scalar(self.lang), len(counts)), "size": pa.repeat(pa.scalar(size, pa.int32()), len(counts)),
            "prefix": joined(columns[:2]), "phrase": joined(columns), "n": pa.array(counts, pa.int64()),
        })
        return run.sort_by("phrase").combine_chunks().to_batches()[0]

    def flush(self) -> Iterator[pa.RecordBatch]:
        """All there is; the words are forgotten."""
        yield from self.spill(0)
        if self.total:
            yield pa.RecordBatch.from_pydict({"lang": [self.lang], "size": [0], "prefix": [""], "phrase": [""], "n": [self.total]}, schema=SCHEMA)
        self.total = 0
        self._forget()


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    return texts


def _hashed(docs: DataFrame, size: int, parts) -> DataFrame:
    """(h, n): phrases of `size` words of docs(lang, text) by hash alone, of which both parts pass the filter, summed over slices of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                salt = salt_of(lang)
                for words in word_slices(texts, size - 1):
                    here, hashes = words.phrases(size, salt)
                    if parts is not None and len(here):
                        known = has_bits(parts.value, words.phrases(size - 1, salt)[1])
                        here &= known[: len(here)] & known[1 : len(here) + 1]
                    found, n = np.unique(hashes[here], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long")


def packed(run: pa.RecordBatch) -> pa.RecordBatch:
    """A sorted run (lang, size, prefix, phrase, n) of one language and size as a row for each prefix partition: lang, size, part, its phrases
    in order with a line feed between them, which no word holds, and their counts as 64-bit integers."""
    prefix = run.column(2).cast(pa.binary())
    bounds = np.frombuffer(prefix.buffers()[1], np.int32, len(prefix) + 1, 4 * prefix.offset).astype(np.int64)
    raw = np.frombuffer(prefix.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    some = bounds[1:] > bounds[:-1]
    part = np.zeros(len(prefix), np.int64)
    if some.any():
        part[some] = (mix(span_hashes(raw.astype(_U) + _U(1), bounds[:-1][some], bounds[1:][some])) % _U(PARTS)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    edges = np.append(first, len(order)).astype(np.int32)
    phrases = pa.ListArray.from_arrays(pa.array(edges), run.column(3).take(pa.array(order)))
    counts = run.column(4).to_numpy()[order].tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(run.column(0)[0], len(parts)), pa.repeat(run.column(1)[0], len(parts)), pa.array(parts.astype(np.int32)),
            pc.binary_join(phrases, "\n"), pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(edges * np.int32(8)), pa.py_buffer(counts)]),
        ],
        names=["lang", "size", "part", "phrases", "counts"],
    )


def _summed(run: pa.Table) -> pa.Table:
    return run.group_by(["size", "phrase"]).aggregate([("n", "sum")]).rename_columns(["size", "phrase", "n"])


def merged(rows: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, n) with n >= least or size 0 of packed rows that are sorted by lang and part: equal phrases of a partition's runs summed."""
    key, held, added, distinct = None, [], 0, 0

    def done() -> Iterator[pa.RecordBatch]:
        total = _summed(pa.concat_tables(held))
        total = total.filter(pc.or_(pc.greater_equal(total["n"], least), pc.equal(total["size"], 0)))
        if total.num_rows:
            yield from total.add_column(0, "lang", pa.repeat(pa.scalar(key[0]), total.num_rows)).combine_chunks().to_batches()

    for batch in rows:
        for i, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if now != key:
                if held:
                    yield from done()
                key, held, added, distinct = now, [], 0, 0
            n = np.frombuffer(batch.column(4)[i].as_buffer(), np.int64)
            phrases = pc.split_pattern(batch.column(3).slice(i, 1), "\n").flatten()
            held.append(pa.table({"size": pa.repeat(batch.column(1)[i], len(n)), "phrase": phrases, "n": pa.array(n)}))
            added += len(n)
            if added > max(MERGE, distinct):  # so that many distinct phrases are not summed anew for each run
                held = [_summed(pa.concat_tables(held))]
                added, distinct = 0, held[0].num_rows
    if held:
        yield from done()


def _runs(docs: DataFrame, sizes: Mapping, own: Mapping) -> DataFrame:
    """Packed sorted runs (lang, size, part, phrases, counts) of the phrases in docs(lang, text) that PhraseCounter counts; size 0 is the number
    of words. sizes and own hold broadcast filters."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda filters: {k: f and f.value for k, f in filters.items()}
        counters: dict[str, PhraseCounter] = {}
        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                if lang not in counters:
                    counters[lang] = PhraseCounter(lang, read(sizes), read(own))
                yield from counters[lang].feed(texts)
            while sum(c.entries for c in counters.values()) > MAX_ENTRIES or sum(len(c.text) for c in counters.values()) > MAX_WORDS or len(counters) > 1000:
                fullest = max(counters, key=lambda x: (counters[x].entries + len(counters[x].text), x))
                yield from counters.pop(fullest).flush()
        for counter in counters.values():
            yield from counter.flush()

    return docs.mapInArrow(lambda batches: map(packed, counted(batches)), "lang string, size int, part int, phrases string, counts binary")


def bit_filter(frequent: DataFrame):
    """A broadcast bit map with the hashes h of all frequent phrases set: 16 bits a phrase within FILTER_BITS. A phrase that is not in it is
    not frequent; of others some may be in it, the more the fuller it is, which costs work and nothing else."""
    bits = max(FILTER_BITS[0], min(FILTER_BITS[1], 1 << (16 * frequent.count()).bit_length()))
    place = F.col("h").bitwiseAND(bits - 1)
    cells = frequent.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(bits // 64, _U)
    bitmap[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(_U)
    return frequent.sparkSession.sparkContext.broadcast(bitmap)


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, size, phrase, n) of the phrases of docs(lang, text) of 1 to `longest` words with n >= least, and, as size 0, all words of a language.

    A phrase is frequent only if its two parts of one word less are. So words are counted by hash first, then pairs of frequent words,
    then triples of frequent pairs; a sum may hold several phrases, so that no frequent one is missed. One more pass counts by their words,
    in HAT-tries, the phrases whose sums reach `least`, and the longest ones of which both parts' do. Its runs are packed, a row for
    each prefix partition (a hash of the first two words), and meet by language and partition, where equal phrases are summed."""
    filters = {0: None}
    for size in range(1, longest):
        sums = _hashed(docs, size, filters[size - 1]).groupBy("h").agg(F.sum("n").alias("n"))
        filters[size] = bit_filter(durable(sums.where(f"n >= {least}").select("h")))
    sizes = {size: filters[size - 1] if size == longest else None for size in range(1, longest + 1)}
    runs = _runs(docs, sizes, {size: filters[size] for size in range(1, longest)}).repartition("lang", "part").sortWithinPartitions("lang", "part")
    return durable(runs.mapInArrow(lambda rows: merged(rows, least), "lang string, size int, phrase string, n long"))


def mine_collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, within_percent: int = 80
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` (at most 4) words that occur a >= least times.

    Texts are lower-cased (A-Z) and cut at .,;:!? and \\x0A-\\x0D into pieces; words are runs of other than space and tab; phrases do not
    cross pieces. Cutting a phrase in two gives score floor(2000000 a / (l + r)) with l and r the counts of the two parts; the lowest
    counts, of equal ones the first. A phrase inside a longer one with 100 f(longer) >= within_percent a is dropped. Order: score and
    a descending, then the phrase's bytes. Products are taken in decimals of 38 digits.

    Null text counts as empty, a null language is 'und'. A task holds at most MAX_ENTRIES phrases and MAX_WORDS words, and a slice of
    SLICE bytes of a text, however long. Repeated rows count each. Other columns are ignored; an empty table gives an empty result.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases of 2 to {LONGEST} words")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = frequent_phrases(texts, least, longest)
    totals = found.where("size = 0").groupBy("lang").agg(F.sum("n").alias("words"))
    words, longer = found.where("size = 1"), found.where("size > 1")
    candidates = longer.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    counts = longer.select("lang", F.col("phrase").alias("part"), F.lit(0).alias("salt"), "n").union(words.select("lang", "phrase", salts, "n"))
    join = lambda a, b: F.array_join(F.slice("w", F.lit(a), b), " ")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALT)).cast("int")
    part = lambda k, side, size, text: F.when(F.size("w") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.when(size == 1, salt).otherwise(0).alias("salt"), text.alias("part")))
    cuts = [c for k in range(1, longest) for c in (part(k, "l", F.lit(k), join(1, F.lit(k))), part(k, "r", F.size("w") - k, join(k + 1, F.size("w") - k)))]
    needs = candidates.select("lang", "phrase", "a", F.explode(F.array_compact(F.array(*cuts))).alias("p")).select("lang", "phrase", "a", "p.*")
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("n")))
    sides = needs.join(counts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a").agg(*(of(k, s).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"))
    exact = lambda x: x.cast("decimal(20,0)")
    score = lambda k: F.expr(f"cast(2000000 as decimal(18,0)) * cast(a as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cut = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    scored = sides.select("lang", "phrase", "a", F.least(*(cut(k) for k in range(1, longest))) if longest > 2 else cut(1)).toDF("lang", "phrase", "a", "c")

    inside = lambda size, at: F.when((F.size("w") > size) & (F.size("w") >= size + at), join(at + 1, F.lit(size)))
    inner = [inside(size, at) for size in range(2, longest) for at in range(longest - size + 1)]
    if inner:
        held = candidates.select("lang", F.col("a").alias("most"), F.explode(F.array_compact(F.array(*inner))).alias("phrase"))
        held = held.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
        scored = scored.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * exact(F.col("most")) < within_percent * exact(F.col("a")), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", F.col("words").alias("n"), "c.score")


#: The same by counting every phrase of every piece.
COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(x, '[ \x09]+'), lambda y: y <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
u AS (SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS j FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.j, x.f AS l, y.f AS r, (2000000::HUGEINT * u.a // (x.f + y.f)) AS score FROM u
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[j + 1:u.k], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS i FROM s),
i AS (SELECT lang, sub, max(a) AS most FROM (
  SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS sub FROM c, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.sub = b.phrase
  WHERE b.i = 1 AND (most IS NULL OR 100 * most < 80 * a))
SELECT lang, rank::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
