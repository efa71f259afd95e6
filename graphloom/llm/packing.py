"""Packing by multiway Karmarkar-Karp differencing.

Each task tokenizes its documents and gathers what is left of them after full windows have been cut off, until a pool of
`pool_windows` windows is full. A pool is dealt into k windows: partial partitions with the widest spread are merged first,
the fullest window of one with the emptiest of the other, so that imbalances cancel out. If a window still exceeds the
capacity, k rises by one. There is no shuffle, and a task holds one pool at a time, so memory does not grow with the input.

Null text: an empty document, of the end id alone. Repeated rows are packed each on its own. Empty table: no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PairTable, padded
from .common import id_and_text, small

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words that a worker remembers; then those stay that the batch at hand has.
WORDS_KEPT = 1_000_000
#: Texts within these letters need no normalization but lower case; the pattern cuts them as the tokenizer does.
OTHER = re.compile("[\u0130\u0180-\U0010ffff]|<\\|").search
LETTER, NUMBER, SPACE = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+").findall


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies show each byte by: printable ones of Latin-1 stand for themselves, the others, in
    their order, for the letters from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordIds(dict):
    """A word in lower case, as the tokenizer cuts texts -> its ids as little-endian 32-bit bytes. A batch's new words are
    merged together. Texts with other letters go to the tokenizer's library as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        shown = byte_letters()
        if lost := [b for b, c in enumerate(shown) if c not in vocab or c + suffix not in vocab]:
            raise ValueError(f"the vocabulary has no entry for the bytes {lost}")
        self.inner, self.last = (np.array([vocab[c + x] for c in shown], np.int32) for x in ("", suffix))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable({(vocab[a], vocab[b]): (vocab[a + b], i) for i, (a, b) in enumerate(merges)}, max(vocab.values()) + 1)

    def __missing__(self, word: str) -> bytes:
        return self.merged([word])[0]

    def merged(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        ids[np.cumsum(size) - 1] = self.last[flat[np.cumsum(size) - 1]]
        out = self.pairs.merged(padded(ids, size))
        blob, end = out[out >= 0].astype("<u4").tobytes(), 4 * np.cumsum((out >= 0).sum(1))
        return [blob[a:b] for a, b in zip([0, *end.tolist()], end.tolist(), strict=False)]

    def learn(self, words: set[str]) -> None:
        words = {w for w in words if len(w) <= 48}
        new = sorted(words - self.keys(), key=len)
        if len(self) + len(new) > WORDS_KEPT:
            for w in self.keys() - words:
                del self[w]
        for i in range(0, len(new), 16384):
            self.update(zip(new[i : i + 16384], self.merged(new[i : i + 16384]), strict=True))

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def all_ids(self, texts: list[str]) -> Iterator[bytes]:
        cut = [None if OTHER(t) else TOKENS(t.lower()) for t in texts]
        self.learn({w for ws in cut if ws for w in ws})
        for text, words in zip(texts, cut, strict=True):
            yield self.library(text) if words is None else b"".join(map(self.__getitem__, words))  # long words are merged here


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """A worker's own: its next tasks use what it has remembered, WORDS_KEPT words at most."""
    return WordIds(path)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k windows of near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, n in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = n
        heap.append((-n, i, sums, [(i,)] + [()] * (k - 1)))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        held = [x + y if x and y else x or y for x, y in zip(in_a, reversed(in_b), strict=True)]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), tie, sums, [held[j] for j in order]))
        tie += 1
    return [list(x) for x in heap[0][3]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as differencing fills without exceeding the capacity; each size must fit by itself."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = [w for w in differencing(sizes, k) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        k += 1


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 2, pool_windows: int = 96, longest: int = 1024, fill: float = 0.998) -> DataFrame:
    """One row for each piece of a document: where it starts there, its window and its place in it (SCHEMA).

    fill: the share of a pool's capacity at which it is closed; the document that crosses it is cut there.
    longest: what is left of a document is cut to pieces of that size, for finer differences.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    full = int(pool_windows * capacity * fill)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(tokenizer), struct.pack("<I", end_id)
        at = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        pool: list[tuple] = []
        pooled = sequence = 0

        def flush() -> None:
            nonlocal pooled, sequence
            for w in windows([p[2] for p in pool], capacity) if pool else []:
                offset = 0
                for i in w:
                    rows.append((*pool[i], at + sequence, offset))
                    offset += pool[i][2]
                sequence += 1
            pool.clear()
            pooled = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for whole in it:
            for b in small(whole, 4 << 20):
                for doc_id, ids in zip(b.column(0).to_pylist(), ids_of.all_ids(b.column(1).to_pylist()), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    piece = lambda s, size: (doc_id, s, size, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + size)]), n)  # noqa: B023, E731
                    while n - start >= capacity:
                        rows.append((*piece(start, capacity), at + sequence, 0))
                        sequence += 1
                        start += capacity
                    while start < n:
                        size = min(n - start, longest, full - pooled)
                        pool.append(piece(start, size))
                        pooled += size
                        start += size
                        if pooled >= full:
                            flush()
                    if len(rows) >= 20_000:
                        yield batch()
        flush()
        if rows:
            yield batch()

    return id_and_text(docs).mapInArrow(run, SCHEMA)
