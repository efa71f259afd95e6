"""Near copies for the pipeline: pairs of texts whose SimHash fingerprints over five-word shingles differ in at most 3 bits, found by the
grid of `simhash`, and pairs whose sets of these shingles have a Jaccard similarity of 0.8 or more. Both are links of one graph, of each
of whose components a row stays.

At 0.8 the bits of two fingerprints differ by about ten of 64, too many for an exact cover of the grid of `simhash`: its cells would
hold most of the corpus. So candidates of the second kind come from MinHash: `BANDS` keys of `ROWS` minima each. Two sets of similarity s share no key
with probability (1 - s**4)**25: 2e-6 at 0.8. Every candidate pair that isn't yet in one component is then tested on the sets
themselves.

A key that n texts share could give n * n pairs. Up to `few` texts of a key all meet; of a larger key, some texts (`first`, by a
fixed hash) are centres that the others meet. What has come into one component by then needs no test any more. Larger keys that
still hold texts of several components are dealt to lists of bounded size, and each two lists of a key meet in a group of their own,
where all intersections come from one product of matrices, and a spanning forest of the links is handed on. Two lists meet only if
their texts can be alike: sizes at 0.8 or more differ by a quarter at most, so lists hold texts of a range of sizes, and meet those
of the next range; and the largest component of a key has lists of its own, which don't meet each other. No pair is left out. The lists
meet in waves, each of which moves about twice the bytes of the sets (128 MB at least), and a wave sees the components of the last one.

Equal texts, but for case and white space, are one class from the start. Null texts are empty, and empty texts are equal. A text
of fewer than five words is one shingle. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, drop
from .components import stars
from .simhash import classed, fingerprint, survivors, take
from .simhash import links as fingerprint_links

BANDS, ROWS = 25, 4
_R = np.random.default_rng(80)
SCALE = _R.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _R.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def class_of(text: str) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Distinct hashes of all runs of `size` words."""
    words = text.encode().lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """A key for each band."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[i : i + 4096, None] * SCALE + SHIFT).min(0))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), j) for j, r in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def bands(docs: DataFrame) -> DataFrame:
    """(band, node), n: how many classes share the key, for keys that more than one has."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(0).to_pylist()
        node = np.repeat(np.array([class_of(t) for t in texts], np.uint64).view(np.int64), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([minima(shingles(t)) for t in texts])), pa.array(node)], names=["band", "node"])

    all_ = cut(docs.select(F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(batches(run), "band long, node long").distinct())
    out = cut(all_.join(all_.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"))
    drop(all_)
    return out


def sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, s): the shingles of each class."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(0).to_pylist()
        return pa.RecordBatch.from_arrays([pa.array(np.array([class_of(t) for t in texts], np.uint64).view(np.int64)), pa.array([shingles(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["node", "s"])

    return cut(take(docs, classes.select("low", "n")).select("text").mapInArrow(batches(run), "node long, s array<long>"))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of each node."""
    return rows.join(roots.select(F.col("b").alias("node"), F.col("a").alias("new")), "node", "left").withColumn("root", F.coalesce("new", "node")).drop("new")


def hits(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a are alike to which of b."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
    words, column, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    row, keep = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes)), times[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column, both = row[order], column[order], np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(shared[-1]) + 1 if len(words) else 0, 2048):
        here = slice(*np.searchsorted(column, (low, low + 2048)))
        some = np.zeros((len(a) + len(b), 2048), np.float32)
        some[row[here], column[here] - low] = 1
        both += some[: len(a)] @ some[len(a) :].T
    return both * 100 >= percent * (sizes[0][:, None] + sizes[1] - both)


def forest(nodes: list[np.ndarray], roots: list[np.ndarray], hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Links among the hits of the first list with the second that span what they connect, texts of one root being connected."""
    label, left, right = np.unique(np.concatenate(roots), return_inverse=True)[1], [], []
    mine, theirs = label[: len(nodes[0])], label[len(nodes[0]) :]  # views: both change with label
    for i in range(len(hit)):
        near = np.flatnonzero(hit[i] & (theirs != mine[i]))
        if len(near):
            new, at = np.unique(theirs[near], return_index=True)
            left += [int(nodes[0][i])] * len(new)
            right += nodes[1][near[at]].tolist()
            label[np.isin(label, new)] = mine[i]
    return left, right


def meet(members: DataFrame, own: DataFrame, percent: int, weight: int, texts: int) -> DataFrame:
    """(a, b): links between texts (band, node, root, k: the size of its set) of one key and different roots."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        left, right = [], []
        for x in b.column(0):
            lists = [v.values for v in x.values]
            nodes, roots = ([v.field(c).to_numpy() for v in (lists[0], lists[-1])] for c in ("node", "root"))
            sets_ = [[s.values.to_numpy() for s in v.field("s")] for v in (lists[0], lists[-1])]
            one, two = forest(nodes, roots, hits(*sets_, percent))
            left += one
            right += two
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    spark = members.sparkSession
    most = members.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    # the range of sizes, a little over a quarter, and the largest component's bit
    kind = F.floor(F.log("k") / np.log(101 / percent)) * 2 + (F.col("root") == F.col("most")).cast("int")
    split = cut(members.join(most, "band").select("band", "node", "root", "k", kind.alias("kind")))
    counts = split.groupBy("band", "kind").agg(F.ceil(F.greatest(F.sum("k") / weight, F.count("*") / texts)).alias("parts"))
    dealt = split.join(counts, ["band", "kind"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    lists = cut(dealt.join(own, "node").groupBy("band", "kind", "part").agg(F.collect_list(F.struct("node", "root", "s")).alias("texts")))
    others = lists.join(counts.select("band", F.col("kind").alias("other"), "parts"), "band")
    others = others.where("abs(shiftright(kind, 1) - shiftright(other, 1)) <= 1 and kind & other & 1 = 0")
    others = others.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    me, you = F.shiftleft("kind", 32) + F.col("part"), F.shiftleft("other", 32) + F.col("at")
    pairs = others.select("band", F.least(me, you).alias("x"), F.greatest(me, you).alias("y"), "texts")
    # comparing takes far more time than the bytes tell, so pairs are dealt out by number
    pairs = pairs.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "band", "x", "y").groupBy("band", "x", "y").agg(F.collect_list("texts").alias("lists"))
    out = cut(pairs.select("lists").mapInArrow(batches(run), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    drop(split, lists)
    return out


def links(docs: DataFrame, classes: DataFrame, percent: int = 80, first: int = 2, few: int = 4, weight: int = 1 << 17, texts: int = 1024, moved: float = 2, least: int = 1 << 24, known: DataFrame | None = None) -> DataFrame:
    """(a, b), as stars() gives them: the components of links between classes of at least this similarity, and of links known already, which
    need no test. A list holds about
    `weight` shingles and `texts` texts; a wave moves about `moved` times the sets, or `least` shingles if that is more."""
    members = bands(docs)
    own = sets(docs, classes.join(members.select("node").distinct(), "node"))
    place = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(2**30)) * F.col("n") / 2**30
    centres = members.where((place < first) | (F.col("n") <= few)).select("band", F.col("node").alias("c"))
    chosen = cut(members.join(centres, "band").where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct())
    sized = chosen.join(own.select(F.col("node").alias("a"), F.col("s").alias("s")), "a").join(own.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    both = F.size(F.array_intersect("s", "t"))
    alike = sized.where(both * 100 >= percent * (F.size("s") + F.size("t") - both)).select("a", "b")
    edges = cut(alike if known is None else alike.unionByName(known))
    roots = stars(edges)
    large = rooted(members.where(F.col("n") > few), roots)
    mixed = large.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x <> y").select("band", "m")
    large = cut(large.join(mixed, "band").join(own.select("node", F.size("s").alias("k")), "node").select("band", "node", "k", "m"))
    drop(members, chosen)
    # a text goes to some m / texts lists of its key
    work = large.agg(F.sum(F.col("k") * (1 + F.col("m") / texts))).first()[0]
    waves = 0 if work is None else int(np.ceil(work / max(moved * own.agg(F.sum(F.size("s"))).first()[0], least)))
    for w in range(waves):
        here = rooted(large.where(F.pmod(F.xxhash64("band", F.lit(3)), F.lit(waves)) == w), roots)
        found = meet(here, own, percent, weight, texts)
        old, edges = (edges, roots, found), cut(roots.unionByName(found))
        roots = stars(edges)
        drop(*old)
    drop(large, own, edges)
    return roots


def close_prints(docs: DataFrame, shingle: int = 5, bits: int = 3) -> DataFrame:
    """(a, b): links between classes that span every component of fingerprints within this number of bits."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(0).to_pylist()
        node, fp = (np.fromiter((f(t) for t in texts), np.uint64, len(texts)).view(np.int64) for f in (class_of, lambda t: fingerprint(t, shingle)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(fp)], names=["node", "fp"])

    prints = cut(docs.select(F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(batches(run), "node long, fp long").distinct())
    first = cut(prints.groupBy("fp").agg(F.min("node").alias("first")))
    near = fingerprint_links(first.select("fp"), bits)
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    apart = near.join(end("a"), "a").join(end("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    out = cut(apart.unionByName(prints.join(first, "fp").where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))))
    drop(prints, first, near)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component: the one of its smallest id, a null id being the largest."""
    classes = classed(docs, class_of)
    prints = close_prints(docs)
    roots = links(docs, classes, known=prints)
    drop(prints)
    return survivors(docs, classes, roots, starred=True)
