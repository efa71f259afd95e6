"""Ranked lexical search of stated items over all documents, by buckets of impact vectors.

One pass turns each document into the counts of those terms that the items have. A term's impact in a document and its weight in
an item are whole numbers, and a score is the product of two such vectors. A task orders the vectors of a batch by length, longest
first, and cuts them to buckets. What an item has found so far in this task sets its threshold: a bucket whose longest vector,
times the item's, stays below it is passed over for this item (Cauchy-Schwarz). In other buckets the product over the item's heaviest
coordinates is made through lists of the bucket's terms; with the length of what is left of both vectors, or the largest impacts that
the light coordinates have in the bucket, it bounds each document's score. Those that could reach the threshold are scored anew over all coordinates, in integers. A task hands on the best `k` of each
item; these meet by item and part of the tasks first, then by item, so no group grows with the documents.

Items are taken in blocks of bounded bytes: a block's terms and items are what is sent to tasks and what comes to the driver.

Null texts have no terms; a document or item without any has no rows. Null ids come last among equal scores. Repeated rows, of either
table: each counts, and is ranked, on its own. Ties go by smaller doc_id. Empty tables: no rows. Texts of any length count whole.
Columns of other names never reach the operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small
from .resampling import WORD

#: A byte's place in a word, or a blank.
LETTERS = bytes(WORD)
#: Bytes of text that are read together.
BATCH = 4 << 20
#: Vectors in a bucket: the first ones set thresholds, so they are few. Cells of items by documents at a time.
FIRST, MOST, CELLS = 32, 1024, 1 << 20
#: An item's light coordinates, whose product is bounded only, hold this share of its length.
LIGHT = 0.05
#: For floating point in bounds.
SLACK = 1 + 1e-9
LAST = 2**63 - 1


def terms(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms (numbers of those in the vocabulary, ascending) and counts of every row with a term."""
    size = max(1, len(vocabulary))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in (x for whole in it for x in small(whole, BATCH) if x.num_rows):
            found, n, known = [], np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column(1).to_pylist()):
                own = terms(text)
                mine = [x for w in own if (x := number(w)) is not None]
                n[i], known[i] = len(own), len(mine)
                found.append(np.array(mine, np.int64))
            key, many = np.unique(np.concatenate(found) + np.repeat(np.arange(b.num_rows), known) * size, return_counts=True)
            edge = np.searchsorted(key, np.arange(b.num_rows + 1) * size)
            lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (key % size, many)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>")


@dataclass
class Items:
    """Items as vectors over the vocabulary: rows of (item, term, weight), an item's heaviest coordinates first."""

    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    length: np.ndarray
    heavy: np.ndarray  # of each row
    light: np.ndarray  # the length of an item's light coordinates

    @staticmethod
    def of(texts: list[list[int]], weight: np.ndarray) -> Items:
        item = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        pair, many = np.unique(item * len(weight) + np.array([x for t in texts for x in t], np.int64), return_counts=True)
        item, term = np.divmod(pair, len(weight))
        w = weight[term] * many
        order = np.lexsort((term, -w, item))
        item, term, w = item[order], term[order], w[order]
        squares = w.astype(np.float64) ** 2
        length = np.bincount(item, squares, len(texts))
        upto = np.cumsum(squares) - np.concatenate([[0.0], np.cumsum(length)])[item]  # within the item, this row too
        heavy = (length[item] - (upto - squares)) > (LIGHT**2) * length[item]
        light = np.sqrt(np.bincount(item, squares * ~heavy, len(texts)))
        return Items(item, term, w, np.sqrt(length), heavy, light)


class Best:
    """The best k of each item so far: scores (0: none) and ids."""

    def __init__(self, items: int, k: int):
        self.score, self.id = np.zeros((items, k), np.int64), np.full((items, k), LAST, np.int64)

    @property
    def threshold(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        k = self.score.shape[1]
        mine = np.unique(item)
        item = np.concatenate([item, np.repeat(mine, k)])
        score, doc = np.concatenate([score, self.score[mine].ravel()]), np.concatenate([doc, self.id[mine].ravel()])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < k
        self.score[item[keep], place[keep]], self.id[item[keep], place[keep]] = score[keep], doc[keep]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and the range of each."""
    size = high - low
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of], of


def search(items: Items, best: Best, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int) -> int:
    """Takes documents into best. Rows of (doc, term, impact) by document; size: of the vocabulary. Gives the pairs scored."""
    squares = impact.astype(np.float64) ** 2
    length = np.bincount(doc, squares, len(ids))
    order = np.argsort(-length, kind="stable")  # by length, longest first
    edge = np.searchsorted(doc, np.arange(len(ids) + 1))
    begin, width, pairs = 0, FIRST, 0
    rows_of = np.searchsorted(items.item, np.arange(len(items.length) + 1))
    while begin < len(order):
        bucket = order[begin : begin + width]
        begin, width = begin + width, min(2 * width, MOST, max(FIRST, CELLS // max(1, len(items.length))))
        longest = math.sqrt(length[bucket[0]])
        if not longest:
            break  # no coordinates from here on
        asks = np.flatnonzero(items.length * longest * SLACK >= best.threshold)
        if not len(asks):
            continue
        at, own = spread(edge[bucket], edge[bucket + 1])
        by_term = np.argsort(term[at], kind="stable")
        listed = term[at][by_term]
        local = np.full(len(items.length), -1)
        local[asks] = np.arange(len(asks))
        rows = np.flatnonzero(items.heavy & (local[items.item] >= 0))
        place, of = spread(np.searchsorted(listed, items.term[rows]), np.searchsorted(listed, items.term[rows], "right"))
        entry = by_term[place]
        cell = local[items.item[rows]][of] * len(bucket) + own[entry]
        cells = len(asks) * len(bucket)
        done = np.bincount(cell, items.weight[rows][of] * impact[at[entry]].astype(np.float64), cells)
        seen = np.bincount(cell, squares[at[entry]], cells)
        left = np.sqrt(np.maximum(np.tile(length[bucket], len(asks)) - seen, 0))
        # the light coordinates: no more than their lengths give, nor than the largest impact that each has in the bucket
        largest = np.zeros(size)
        np.maximum.at(largest, term[at], impact[at])
        most = np.bincount(items.item, ~items.heavy * items.weight * largest[items.term], len(items.length))[asks]
        bound = (done + np.minimum(np.repeat(items.light[asks], len(bucket)) * left, np.repeat(most, len(bucket)))) * SLACK
        alive = np.flatnonzero((bound >= np.repeat(best.threshold[asks], len(bucket))) & (bound > 0))
        pairs += len(alive)
        item, d = asks[alive // len(bucket)], alive % len(bucket)
        # exactly: each of the item's coordinates is looked up in the document
        keys = own * size + term[at]
        row, of = spread(rows_of[item], rows_of[item + 1])
        want = d[of] * size + items.term[row]
        where = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        part = np.where(keys[where] == want, items.weight[row] * impact[at[where]], 0)
        score = np.zeros(len(alive), np.int64)
        np.add.at(score, of, part)
        fits = (score > 0) & (score >= best.threshold[item])
        if fits.any():
            best.add(item[fits], score[fits], ids[bucket[d[fits]]])
    return pairs


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, saturation: int = 8, length_share: int = 75, block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item."""
    listed = cut(items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    blocks = math.ceil((listed.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) / block_bytes)
    parts = [_block(docs, listed.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i), k, saturation, length_share) for i in range(blocks)]
    kind = listed.schema["item_id"].dataType.simpleString()
    if not parts:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = reduce(DataFrame.unionByName, parts)
    for by in (("row", "part"), ("row",)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.join(listed.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: DataFrame, k: int, saturation: int, length_share: int) -> DataFrame:
    """row (of the item), part (of the tasks), score and doc_id: what each task finds for these items."""
    listed = items.select("row", "text").collect()  # some block_bytes
    words = [terms(r["text"]) for r in listed]
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in words for w in t}))}
    table = cut(vectors(docs, vocabulary))
    n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # of this block's terms
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * d + 1))) for d in df.tolist()], np.int64)
    asked = Items.of([[vocabulary[w] for w in t] for t in words], weight) if vocabulary else None
    number = np.array([r["row"] for r in listed], np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(number), k)
        for b in it if asked is not None else ():
            ids = b.column(0).fill_null(LAST).to_numpy()
            offset = b.column(2).offsets.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(offset))
            term, count = (b.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            m = np.array([100 - length_share + length_share * n * n_docs // n_terms for n in b.column(1).to_pylist()], np.int64)
            impact = 1_000_000_000 * count // (1000 * count + saturation * m[doc])
            search(asked, best, ids, doc, term, impact, len(vocabulary))
        item, place = np.nonzero(best.score)
        doc = best.id[item, place]
        part = np.full(len(item), TaskContext.get().partitionId() % 64, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(number[item]), pa.array(part), pa.array(best.score[item, place]), pa.array(doc, mask=doc == LAST)], names=["row", "part", "score", "doc_id"])

    return table.mapInArrow(run, "row long, part int, score long, doc_id long")
