"""SimHash near-duplicates: segment popcounts, a grid range join, an exact check, and connected components.

A fingerprint is mapped to the counts of set bits of its thirty-two 2-bit segments. Each differing bit changes one count by one,
so the Manhattan distance of two such vectors is a lower bound of the Hamming distance. The vectors lie on a grid of six
blocks of segments. Two within distance 3 differ in at most 3 blocks, so they share a cell in at least one of the
C(6,3) = 20 choices of 3 blocks: an exact cover. A cell is named by the counts of 16 segments, of some 24 bits of entropy, so
that cells stay small as fingerprints grow in number. A cell of more than `cell` fingerprints is covered by a second grid in
the same way, of segments of bits that lie far apart; what is still too many is dealt to lists, and each two lists of a cell
meet under a key of their own. Inside a list, the difference of total popcounts (the coarsest of the bounds) gives the
range to compare, the vectors' Manhattan distance is tested next, then the bits. Of the links found, a list hands on a
spanning forest only.

Equal fingerprints are one row with their smallest id from the start, so copies never multiply. Null ids form no smallest id:
a component of null ids alone has a null component_id. Empty and null texts have fingerprint zero. Texts of any length count whole.
Columns of other names never reach the operator. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, drop, id_and_text
from .components import smallest_reachable

#: Widths in 2-bit segments of the six blocks of the grid.
BLOCKS = (6, 6, 5, 5, 5, 5)
#: For the second grid, bit i goes to this place.
FAR = [i * 29 % 64 for i in range(64)]


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        bits += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(batches(run), "doc_id long, fp long")


def segments(fp: np.ndarray) -> np.ndarray:
    """The popcounts of 32 segments for each fingerprint."""
    bits = np.unpackbits(fp.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 32, 2)
    return bits[:, :, 0] + bits[:, :, 1]


def apart(fp: np.ndarray) -> np.ndarray:
    """fp with its bits in places far apart."""
    bits = np.unpackbits(fp.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.ascontiguousarray(np.packbits(bits[:, FAR], axis=1)).view(">u8").ravel().astype(np.uint64).view(np.int64)


def cell_keys(fp: np.ndarray, bits: int = 3) -> np.ndarray:
    """A row for each choice of blocks: the keys of the cells that the fingerprints lie in."""
    pop, at, block = segments(fp).astype(np.int64), 0, []
    for width in BLOCKS:
        block.append(sum(pop[:, at + i] * 3**i for i in range(width)))
        at += width
    keys = []
    for j, some in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - bits)):
        key = np.full(len(fp), j, np.int64)
        for k in some:
            key = key * 3 ** BLOCKS[k] + block[k]
        keys.append(key)
    return np.stack(keys)


def cells(fps: DataFrame, bits: int = 3, again: bool = False) -> DataFrame:
    """(cell, fp): the grid cells that each fingerprint lies in, one for each choice of blocks. again: fps has cells already, and
    each of them is covered by the second grid; a cell's name is then a hash of both names."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = cell_keys(apart(fp) if again else fp, bits)
        if again:
            old = b.column("cell").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            mixed = (old * np.uint64(0x9E3779B97F4A7C15)) ^ (keys.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            keys = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(fp, len(keys)))], names=["cell", "fp"])

    return fps.select("cell", "fp").mapInArrow(batches(run), "cell long, fp long") if again else fps.select("fp").mapInArrow(batches(run), "cell long, fp long")


def forest(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over all pairs of a with b within the given number of differing bits."""
    b = b[np.argsort(np.bitwise_count(b.view(np.uint64)), kind="stable")]
    pop_b, seg_b = np.bitwise_count(b.view(np.uint64)).astype(np.int64), segments(b).astype(np.int8)
    seg_a, pop_a = segments(a).astype(np.int8), np.bitwise_count(a.view(np.uint64)).astype(np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    left, right = [], []
    for i in range(len(a)):
        lo, hi = np.searchsorted(pop_b, (pop_a[i] - bits, pop_a[i] + bits + 1))
        near = np.flatnonzero(np.abs(seg_b[lo:hi] - seg_a[i]).sum(1) <= bits) + lo
        near = near[np.bitwise_count((b[near] ^ a[i]).view(np.uint64)) <= bits]
        x = int(a[i])
        for y in b[near].tolist():
            if y != x and (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                left.append(x)
                right.append(y)
    return left, right


def counted(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, n) of cells with more than one fingerprint, as a table, and the members of these cells with n."""
    there = cut(members.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    return there, members.join(there, "cell")


def links(fps: DataFrame, bits: int = 3, cell: int = 1024) -> DataFrame:
    """(a, b): links between distinct fingerprints that span every component; fps has one row for each fingerprint."""
    first, members = counted(cells(fps, bits))
    members = cut(members)
    hot = members.where(F.col("n") > cell)
    second, refined = counted(cells(hot, bits, again=True))
    every = members.where(F.col("n") <= cell).unionByName(refined)
    part = F.when(F.col("n") > cell, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / cell))).otherwise(F.lit(0)).alias("part")
    lists = cut(every.select("cell", "fp", "n", part).groupBy("cell", "n", "part").agg(F.collect_list("fp").alias("a")))
    drop(first, second, members)

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        left, right = [], []
        for x in b.column(0):
            own = [v.values.to_numpy() for v in x.values]
            one, two = forest(own[0], own[-1], bits)
            left += one
            right += two
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    inside = lists.select(F.array("a").alias("lists"))
    # a list of a large cell goes to each key (own part, other part), so each two lists meet in a group of two
    large = lists.where(F.col("n") > cell).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / cell) - 1))).where("part <> other")
    across = large.groupBy("cell", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")).agg(F.collect_list("a").alias("lists")).where(F.size("lists") == 2).select("lists")
    # comparing takes far more time than the bytes tell, so lists are dealt out by number
    dealt = inside.unionByName(across).repartition(4 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.mapInArrow(batches(run), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = cut(found)
    drop(lists)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row of docs."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = links(classes, bits)
    members = smallest_reachable(edges, classes.select(F.col("fp").alias("node"), "low"))
    drop(edges)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    joined = prints.join(members.select(F.col("node").alias("fp"), F.col("low").alias("component_id")), "fp", "left")
    return joined.select("doc_id", hexed, "component_id")


def keyed(docs: DataFrame) -> DataFrame:
    """Each row of docs as `row`, its text, and the longs that name it: no_id (1 for a null id), k_id, k_text, k_row."""
    row, id_, text = F.struct(*(docs[c] for c in docs.columns)), docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit(""))
    return docs.select(row.alias("row"), text.alias("text"), id_.isNull().cast("long").alias("no_id"), F.coalesce(id_, F.lit(-(2**63))).alias("k_id"), F.xxhash64(text).alias("k_text"), F.xxhash64(row).alias("k_row"))


KEY = ["no_id", "k_id", "k_text", "k_row"]


def classed(docs: DataFrame, class_of: Callable[[str], int]) -> DataFrame:
    """(node, low, n): the classes of texts, the smallest row key in each, and how many rows have just this key."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        node = np.fromiter(map(class_of, b.column(0).to_pylist()), np.uint64, b.num_rows)
        return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *b.columns[1:]], names=["node", *KEY])

    rows = keyed(docs).select("text", *KEY).mapInArrow(batches(run), "node long, " + ", ".join(f"{k} long" for k in KEY))
    counted = rows.groupBy("node", *KEY).agg(F.count("*").alias("n"))
    return cut(counted.groupBy("node").agg(F.min(F.struct(*KEY, "n")).alias("m")).select("node", F.struct(*(F.col(f"m.{k}") for k in KEY)).alias("low"), F.col("m.n").alias("n")))


def take(docs: DataFrame, keys: DataFrame, at_most: int = 100_000) -> DataFrame:
    """One row (keyed) of docs for each row key in keys (low, n)."""
    keys, rows = keys.select("low.*", "n"), keyed(docs)
    # only keys of repeated rows need grouping; it runs before the shuffle where these keys are few
    repeated = keys.where("n > 1")
    few = repeated.limit(at_most + 1).count() <= at_most
    grouped = rows.join(F.broadcast(repeated) if few else repeated, KEY).groupBy(*KEY).agg(F.first("row").alias("row"), F.first("text").alias("text"))
    return rows.join(keys.where("n = 1"), KEY).select("row", "text").unionByName(grouped.select("row", "text"))


def survivors(docs: DataFrame, classes: DataFrame, edges: DataFrame, starred: bool = False) -> DataFrame:
    """docs, all columns, with one row of each component: the one of its smallest id, a null id being the largest. starred: edges come from
    stars()."""
    heads = smallest_reachable(edges, classes.select("node", "low"), starred).select("low").distinct()
    return take(docs, cut(heads.join(classes.select("low", "n"), "low"))).select("row.*")


def one_of_each(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """docs, all columns, with one row of each component of op6."""
    classes = classed(docs, lambda t: fingerprint(t, shingle))
    return survivors(docs, classes, links(classes.select(F.col("node").alias("fp")), bits))
