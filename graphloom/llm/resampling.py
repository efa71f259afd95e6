"""Importance resampling towards a target distribution.

Features are runs of 1 to `n` words. Each batch interns them in an open-addressed table held in numpy: a feature's XXH64 names the
slot where probing starts, and a slot with the same key is taken only after its bytes have been compared, so a collision goes on to
the next slot. A slot has its feature's bucket and its count. The bucket counts of the raw and of the target texts come from the
counts of slots, a row for each task and bucket; a second pass over the raw texts gathers the buckets' gains by the slots of
the occurrences. The buckets, a parameter, bound everything that the driver and a task hold besides a batch.

The draw: scores are whole numbers, so their counts give the lowest score that is drawn; only rows from there on are dealt out by
ranges of (score, id) and numbered, range by range. Rows of one score and id are dealt to several ranges.

Null text: no words, no features. Null id: drawn as one with an empty id; after all others of its score. Repeated rows: a row each, all
of one score, in any order among themselves. Empty table: no rows. Texts of any length count whole. Other columns never reach the operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .hashes import crc32, same_bytes, words_at, xxh64

#: What a byte counts as: letters in lower case, digits and bytes beyond ASCII stay, all others part words.
WORD = np.array([b + 32 * (65 <= b <= 90) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
#: Ends a text; no byte of a word.
END = 10
#: Bytes of text whose features are interned together.
BATCH = 1 << 20


def features(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as bytes, words parted by one space; start, length and text of each feature; words of each text."""
    column = column.cast(pa.large_string())
    offset = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offset[0] : offset[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    flat = np.insert(WORD[raw], offset[1:] - offset[0], END)
    inside = flat > 32
    keep = inside | (flat == END)
    keep[1:] |= inside[:-1]
    flat = flat[keep]
    inside = np.concatenate([[False], flat > 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    text = np.cumsum(flat == END)[start] if len(start) else np.zeros(0, np.int64)
    found = [(start, end - start, text)]
    for k in range(1, n):
        first = np.flatnonzero(text[: max(0, len(text) - k)] == text[k:])
        found.append((start[first], end[first + k] - start[first], text[first]))
    return flat, *(np.concatenate(x) for x in zip(*found, strict=True)), np.bincount(text, minlength=len(column))


class Table:
    """The features of a batch: slot, of each occurrence; bucket and count, of each slot in use."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int):
        lanes = words_at(flat)
        key, size = xxh64(flat, lanes, start, length), 1 << max(4, int(2 * len(start) - 1).bit_length())
        owner = np.full(size, -1, np.int64)
        at = (key & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(len(start))
        while len(todo):
            here = at[todo]
            free = owner[here] < 0
            owner[here[free]] = todo[free]
            mine = owner[here]
            other = np.flatnonzero(mine != todo)
            a, b = todo[other], mine[other]
            differ = key[a] != key[b]
            maybe = np.flatnonzero(~differ)
            differ[maybe] = ~same_bytes(flat, lanes, start[a[maybe]], length[a[maybe]], start[b[maybe]], length[b[maybe]])
            todo = a[differ]
            at[todo] = (at[todo] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        number = np.zeros(size, np.int64)
        number[used] = np.arange(len(used))
        self.slot = number[at]
        own = owner[used]
        self.bucket = crc32(flat, start[own], length[own]) % buckets
        self.count = np.bincount(self.slot, minlength=len(own))


def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for whole in it for b in small(whole, BATCH) if b.num_rows)


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n) of a table with the one column text: what each task has counted."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(it):
            flat, start, length, _, _ = features(b.column(0), n)
            t = Table(flat, start, length, buckets)
            total += np.bincount(t.bucket, t.count, buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, n: int, buckets: int) -> np.ndarray:
    """The gain of each bucket, whole numbers."""
    both = bucket_counts(raw, n, buckets).withColumn("target", F.lit(False)).unionByName(bucket_counts(target, n, buckets).withColumn("target", F.lit(True)))
    count = {False: [0] * buckets, True: [0] * buckets}
    for bucket, k, is_target in both.collect():  # two rows a bucket at most
        count[is_target][bucket] = k
    s_all, t_all = (float(sum(count[x]) + buckets) for x in (False, True))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(count[False], count[True], strict=True)], np.int64)


def chance(key: Column, seed: int) -> Column:
    """A whole number of Gumbel noise, from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    text = lambda df: df.select(F.coalesce(df["text"], F.lit("")).alias("text"))
    gain = gains(text(docs), text(target), n, buckets)

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(it):
            flat, start, length, of, words = features(b.column(1), n)
            t = Table(flat, start, length, buckets)
            many = np.bincount(of, minlength=b.num_rows)
            total = np.bincount(of, gain[t.bucket][t.slot], b.num_rows).astype(np.int64)
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, many, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    out = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + chance(F.col("doc_id"), seed))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row: `percent` of the rows of at least `least_words` words
    are drawn, the highest scores first, then smaller ids."""
    rows = cut(scored(docs, target, n, buckets, seed).withColumn("row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least_words
    counts = rows.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    by_score = dict(counts.collect())  # whole numbers between bounds that the formulas set, some 100,000 at most
    left = draw = percent * sum(by_score.values()) // 100
    lowest = None
    for score in sorted(by_score, reverse=True):
        if left <= 0:
            break
        lowest, left = score, left - by_score[score]
    columns = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = fit & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a partition's number, and places within it
    dealt = rows.where(high).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns, F.monotonically_increasing_id().alias("place"))
    numbered = cut(dealt)
    part = F.shiftright("place", 33)
    sizes = dict(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a number for each partition
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    offsets = rows.sparkSession.createDataFrame([*before.items()], "part long, before long")
    placed = numbered.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.select(*columns, F.when(rank <= draw, rank).alias("rank")).unionByName(rows.where(~high).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The ids that are drawn, in the order of their ranks within each part."""
    return resampled(docs, target, **how).where("rank is not null").select("doc_id", "rank")

