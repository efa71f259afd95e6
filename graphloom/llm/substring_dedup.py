"""Removal of passages that occur elsewhere: seed and extend on winnowed anchors.

Of the hashes of all `seed`-word grams of a window of `length` words, winnowing selects the smallest, the right one of equals:
equal windows select equal anchors at equal places. Consecutive windows that select the same occurrence of an anchor are a run.
Runs meet by their anchor. A run whose whole extent (all words that its windows cover) occurs again is a match in full,
extended both ways to its ends. Where an anchor has different extents, one representative of each is extended window by
window, and windows that meet mark the place where the match ends. What is marked, joined up, are the maximal repeats.

Extents and windows meet by 128 bits of hashes (two bases, mixed) and are aggregated before they are shuffled; no pair of
occurrences is ever made, so a passage that a third of all documents share costs a row each. Nothing is broadcast. Counts are
written before they are joined, so that both sides of such a join are plain exchanges, which can be split where a key is hot.

Null texts are empty. Repeated rows are each other's copies, so all windows of theirs are removed. Texts under `length` words
keep all. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, drop, row_key

BASES = (0x9E3779B97F4A7C13, 0xD6E8FEB86659FD93)
KEPT = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any spans of a text from sums of words' hashes times powers of an odd base, and the base's inverse."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, base: int):
        n = len(words) + 1
        if base not in self.powers or len(self.powers[base][0]) < n:
            size = max(n, 1 << 15)
            make = lambda b: np.cumprod(np.array([1, *[b] * (size - 1)], np.uint64), dtype=np.uint64)
            self.powers[base] = make(base), make(pow(base, -1, 1 << 64))
        up, self.down = (p[:n] for p in self.powers[base])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:-1], dtype=np.uint64)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def runs(words: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """anchor's hash, extent's hash, first and last window of each run."""
    n = len(words)
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    one, two = (Rolling(words, b) for b in BASES)
    i = np.arange(n - seed + 1)
    gram = one.spans(i, i + seed)
    view = np.lib.stride_tricks.sliding_window_view(gram, length - seed + 1)[:, ::-1]
    picked = np.empty(len(view), np.int64)
    for k in range(0, len(view), 4096):
        picked[k : k + 4096] = np.arange(k, min(k + 4096, len(view))) + length - seed - view[k : k + 4096].argmin(1)
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    last = np.concatenate([first[1:], [len(picked)]]) - 1
    anchor = picked[first]
    extent = mix(two.spans(first, last + length) + (anchor - first).astype(np.uint64))
    return gram[anchor], extent, first, last


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def repeats(docs: DataFrame, length: int = 35, seed: int = 8) -> DataFrame:
    """k_id, k_text, runs: an array of (a, b); windows a to b (their first words' places) of a row of docs occur elsewhere too."""
    docs = row_key(docs)

    def anchored(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHashes()
        found = [runs(hashes.of(t.encode().split()), length, seed) for t in b.column("text").to_pylist()]
        sizes = [len(f[0]) for f in found]
        columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
        key = [np.repeat(b.column(k).to_numpy(zero_copy_only=False), sizes) for k in ("k_id", "k_text")]
        return pa.RecordBatch.from_arrays(_longs(*key, *columns), names=["k_id", "k_text", "anchor", "extent", "a", "b"])

    found = cut(docs.mapInArrow(batches(anchored), "k_id long, k_text long, anchor long, extent long, a long, b long"))
    # an anchor that occurs once has no match; m and n are all a hot anchor needs, so no task sees its rows together
    again = cut(found.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"))  # a table: the join's exchange can then be split
    met = cut(found.join(again, "anchor"))
    drop(found, again)
    extents = cut(met.groupBy("anchor", "extent").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("m", "k_id", "k_text", "a", "b"))))
    full = met.join(extents.where("n > 1").select("anchor", "extent"), ["anchor", "extent"]).select("k_id", "k_text", "a", "b")

    # n < m: the anchor has other extents too
    extend = extents.where("n < m").select("k_id", "k_text", F.struct("a", "b", (F.col("n") == 1).alias("open")).alias("run"))
    by_doc = extend.groupBy("k_id", "k_text").agg(F.collect_list("run").alias("runs"))

    def windows(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes, out = WordHashes(), [[] for _ in range(6)]
        for text, k_id, k_text, rs in zip(b.column("text").to_pylist(), b.column("k_id").to_pylist(), b.column("k_text").to_pylist(), b.column("runs").to_pylist(), strict=True):
            words = hashes.of(text.encode().split())
            start = np.concatenate([np.arange(r["a"], r["b"] + 1) for r in rs])
            hs = [Rolling(words, base).spans(start, start + length) for base in BASES]
            row = (np.full(len(start), k_id), np.full(len(start), k_text), *hs, start, np.repeat([r["open"] for r in rs], [r["b"] + 1 - r["a"] for r in rs]))
            for o, c in zip(out, row, strict=True):
                o.append(c)
        return pa.RecordBatch.from_arrays([*_longs(*(np.concatenate(o) for o in out[:5])), pa.array(np.concatenate(out[5]).astype(bool))], names=["k_id", "k_text", "w1", "w2", "a", "open"])

    texts = docs.select("k_id", "k_text", "text")
    joined = texts.join(by_doc, ["k_id", "k_text"]).select("k_id", "k_text", "text", "runs")
    # repeated rows give their windows twice, but never open ones: an extent in both of two such rows occurs twice
    ends = cut(joined.mapInArrow(batches(windows), "k_id long, k_text long, w1 long, w2 long, a long, open boolean"))
    twice = cut(ends.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"))
    extended = ends.where("open").join(twice, ["w1", "w2"]).select("k_id", "k_text", "a", F.col("a").alias("b"))
    marks = cut(full.unionByName(extended).groupBy("k_id", "k_text").agg(F.collect_set(F.struct("a", "b")).alias("runs")))
    drop(met, extents, ends, twice)
    return marks


def without_repeats(docs: DataFrame, length: int = 35, seed: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept, the words that stay, for every row of docs."""
    found = repeats(docs, length, seed)

    def remove(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, rs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if rs:
                np.add.at(gone, [r["a"] for r in rs], 1)
                np.add.at(gone, [r["b"] + length for r in rs], -1)
            gone = np.cumsum(gone)[:-1] > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if rs else b" ".join(words)
            rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = row_key(docs).join(found, ["k_id", "k_text"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(batches(remove), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
