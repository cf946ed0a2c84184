"""Byte-level BPE encoding and decoding with a published vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.llm.shared import bound_batches

#: A piece of more bytes is merged with a heap instead of repeated scans; same result, n log n.
LONG_PIECE = 96
#: Pieces a Python worker remembers before it starts afresh; bounds its memory.
CACHE_PIECES = 400_000
# Fixed values of the published byte-level format: the split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The format writes bytes as printable letters: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Encoder and decoder for a vocabulary file of the byte-level kind (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.base = len(self.bytes_of)
        self.merge = {}  # left id * base + right id -> rank
        self.union = []  # by rank, the id of the union
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[left] * self.base + vocab[right]] = rank
            self.union.append(vocab[left + right])
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.decimal = [str(i) for i in range(self.base)]
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge_piece(self, data: bytes) -> list[int]:
        """parts holds the ids between boundaries, ranks the rank of each adjacent pair; the lowest rank, leftmost
        first, loses its boundary, and only its two neighbours are looked up again."""
        parts = [self.byte_id[b] for b in data]
        if len(parts) > LONG_PIECE:
            return self._merge_long(parts)
        get, base, none = self.merge.get, self.base, len(self.union)
        ranks = [get(a * base + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i] = self.union[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] * base + parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] * base + parts[i], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        merge, base, n = self.merge, self.base, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        waiting = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := merge.get(parts[i] * base + parts[j])) is not None:
                heapq.heappush(waiting, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            rank, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue  # made void by an earlier merge
            parts[i], parts[j] = self.union[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        if self.special is not None and any(x in text for x in self.added):
            return list(chain.from_iterable([self.added[x]] if x in self.added else self._ordinary(x) for x in self.special.split(text) if x))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        pieces, cache = self.split.findall(text), self.cache
        for p in set(pieces).difference(cache):
            cache[p] = tuple(self.merge_piece(p.encode("utf-8", "surrogatepass")))
        ids = list(chain.from_iterable(map(cache.__getitem__, pieces)))
        if len(cache) > CACHE_PIECES:
            cache.clear()
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _load(path: str) -> ByteBPE:
    return ByteBPE(path)


def bpe_encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, digests: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, with digests ids_sha256 and decoded_sha256 (of the ids and of their decoding),
    with_ids ids (array<int>). A narrow map over Arrow batches: no shuffle, and a lost task is just run again.

    vocabulary is the path of the published file; it must be readable on every executor and is read once a worker.
    The strings of special tokens in a text become those tokens. Null text counts as empty: no tokens. Null and
    repeated ids pass through; other columns are ignored; very long pieces are merged with a heap.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id " + docs.select(id_col).dtypes[0][1] + ", n_tokens long"
    schema += ", ids_sha256 string, decoded_sha256 string" if digests else ""
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _load(vocabulary)
        for batch in batches:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in batch["text"]:
                ids = coder.encode(text)
                n.append(len(ids))
                if digests:
                    ids_sha.append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
            out = {"doc_id": batch["doc_id"], "n_tokens": n}
            out |= {"ids_sha256": ids_sha, "decoded_sha256": text_sha} if digests else {}
            out |= {"ids": all_ids} if with_ids else {}
            yield pd.DataFrame(out)

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInPandas(run, schema)


def bpe_decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids give an empty text."""
    bound_batches(tokens.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _load(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [coder.decode([] if x is None else list(x)) for x in batch["ids"]]})

    source = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInPandas(run, f"doc_id {source.dtypes[0][1]}, text string")
