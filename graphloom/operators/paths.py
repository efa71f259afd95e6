"""Property paths: an edge is (s, o), two term columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut, delete, drop, fresh, names, once, write
from .patterns import term_columns


def edge(quads: DataFrame, p: str) -> DataFrame:
    return quads.where(F.col("p") == p).select(term_columns("s").alias("s"), term_columns("o").alias("o"))


def inverse(path: DataFrame) -> DataFrame:
    return path.select(F.col("o").alias("s"), F.col("s").alias("o"))


def sequence(*paths: DataFrame) -> DataFrame:
    """Keeps duplicates: a pair for each way."""
    step = lambda a, b: a.select("s", F.col("o").alias("via")).join(b.select(F.col("s").alias("via"), "o"), "via").select("s", "o")
    return reduce(step, paths)


def alternative(*paths: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, paths)


def negated(quads: DataFrame, *predicates: str, inverse_predicates: tuple[str, ...] = ()) -> DataFrame:
    out = []
    if predicates or not inverse_predicates:
        out.append(quads.where(~F.col("p").isin(*predicates)) if predicates else quads)
    out = [q.select(term_columns("s").alias("s"), term_columns("o").alias("o")) for q in out]
    if inverse_predicates:
        out.append(inverse(quads.where(~F.col("p").isin(*inverse_predicates)).select(term_columns("s").alias("s"), term_columns("o").alias("o"))))
    return reduce(DataFrame.unionByName, out)


def nodes(quads: DataFrame) -> DataFrame:
    return quads.select(F.explode(F.array(term_columns("s"), term_columns("o"))).alias("n")).distinct()


def identity(quads: DataFrame) -> DataFrame:
    return nodes(quads).select(F.col("n").alias("s"), F.col("n").alias("o"))


def zero_or_one(path: DataFrame, quads: DataFrame) -> DataFrame:
    return path.unionByName(identity(quads)).distinct()


def one_or_more(path: DataFrame) -> DataFrame:
    """All pairs that a walk joins, as a set. A round doubles the length of walks: pairs whose shortest walk has just `length` edges are
    extended by all pairs known, so each longer shortest walk up to twice that length is met. Each round is a table in the shared
    folder; those that a later one holds are deleted, and the last one, the result, stays until the caller drops it."""
    found, length = cut(path.distinct().withColumn("d", F.lit(1).cast("long"))), 1
    while True:
        first = found.where(F.col("d") == length).select("s", F.col("o").alias("via"), F.col("d").alias("before"))
        longer = first.join(found.select(F.col("s").alias("via"), "o", "d"), "via").groupBy("s", "o").agg(F.min(F.col("before") + F.col("d")).alias("d"))
        new = cut(longer.join(found, ["s", "o"], "left_anti"))
        if new.isEmpty():
            drop(new)
            return found.select("s", "o")
        both = cut(found.unionByName(new))
        drop(found, new)
        found, length = both, length * 2


def zero_or_more(path: DataFrame, quads: DataFrame) -> DataFrame:
    return one_or_more(path).unionByName(identity(quads)).distinct()


#: Rounds of a search before chains are looked for.
PLAIN = 32


class Parts:
    """A table in folders by a hash of one column, which grows by additions; a round reads the folders of the nodes it asks for only."""

    def __init__(self, df: DataFrame, by: str, parts: int):
        self.spark, self.by, self.parts, self.schema, self.folders = df.sparkSession, by, parts, df.schema, []

    def add(self, df: DataFrame) -> set[int]:
        """The numbers of the parts that have got rows."""
        folder = fresh(self.spark, "parts")
        rows = df.select(*self.schema.names, F.pmod(F.xxhash64(self.by), F.lit(self.parts)).cast("int").alias("part"))
        write(rows.hint("rebalance", "part"), folder, "part")
        there = {int(x.removeprefix("part=")) for x in names(self.spark, folder) if x.startswith("part=")}
        self.folders.append((folder, there))
        return there

    def read(self, asked: set[int] | None = None, last: bool = False) -> DataFrame:
        """The rows of these parts; last: of the last addition."""
        paths = [f"{folder}/part={p}" for folder, there in self.folders[-1:] * last or self.folders for p in sorted(there if asked is None else there & asked)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def drop(self) -> None:
        for folder, _ in self.folders:
            delete(self.spark, folder)
        self.folders = []


#: Edges in a part of a search, about, and parts at most.
PART_ROWS, MOST_PARTS = 1_000_000, 256


def reach(path: DataFrame, starts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(s, o): what walks of one edge or more from the bound ends `starts` (one column, n) reach, as a set. All starts are searched
    together, a round an edge further, and a round reads the edges and what is reached by now for the nodes of its front alone, by
    parts of about `part_rows` edges. A search of more than PLAIN rounds gets shortcuts along chains first, so its rounds are few on long walks
    too. To bind the other end, give inverse(path) and turn the result around. Null nodes have no edges."""
    path, first = once(path), starts.select(F.col("n").alias("s"), F.col("n").alias("o")).where("s is not null").distinct()
    parts = min(MOST_PARTS, 1 + path.count() // part_rows)
    edges = Parts(path.select("s", "o"), "s", parts)
    edges.add(path.select("s", "o").where("s is not null and o is not null").distinct())
    found, met, begin = (Parts(first, "o", parts) for _ in range(3))
    asked, front, turn = begin.add(first), begin.read(last=True), 0
    while asked:
        step = edges.read(asked).select(F.col("s").alias("via"), F.col("o").alias("to")).join(front.select("s", F.col("o").alias("via")), "via")
        step, reached = step.select("s", F.col("to").alias("o")).distinct(), {0}
        if parts > 1:  # its parts tell which of those found by now are to be read
            reached = met.add(step)
            step = met.read()
        asked = found.add(step.join(found.read(reached), ["s", "o"], "left_anti"))
        met.drop()
        front, turn = found.read(last=True), turn + 1
        if turn == PLAIN and asked:
            edges.add(_shortcuts(edges.read(), first.select(F.col("o").alias("n"))))
            asked, front = {*range(parts)}, found.read().unionByName(begin.read())  # shortcuts may begin at any node met by now
    out = cut(found.read())
    for p in (edges, found, begin):
        p.drop()
    return out


def _jump(links: DataFrame) -> DataFrame:
    """Links (pred, node) of chains and rings to rows (node, pred, head, d, low, done): the head of the chain that node is on, and how far it
    is; what is not done is on a ring, of which low is the least node. A round doubles how far each row sees."""
    links = cut(links.select("node", "pred", F.col("pred").alias("head"), F.lit(1).cast("long").alias("d"), F.least("node", "pred").alias("low"), F.lit(False).alias("done")))
    for _ in range(1 + math.ceil(math.log2(links.count() + 2))):
        above = links.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("d").alias("more"), F.col("low").alias("lower"), F.col("done").alias("above"))
        seen = links.where("not done").join(above, "head", "left").select("node", "pred", F.coalesce("next", "head").alias("head"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.least("low", "lower").alias("low"), (F.col("next").isNull() | F.col("above")).alias("done"))
        both = cut(links.where("done").unionByName(seen))
        drop(links)
        links = both
    return links


def _shortcuts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(s, o) from the head of each chain to its nodes, and from a start (n) on a chain to those behind it, which are results. A chain
    goes on while a node has one edge in, and its edge's source one out; a ring is cut before its least node."""
    one = lambda by: edges.groupBy(by).agg(F.count("*").alias("n")).where("n = 1").select(by)
    links = edges.where("s <> o").join(one("s"), "s", "left_semi").join(one("o"), "o", "left_semi").select(F.col("s").alias("pred"), F.col("o").alias("node"))
    first = _jump(links)
    rings = _jump(first.where("not done and node <> low").select("pred", "node"))
    chains = first.where("done").unionByName(rings.where("done")).select("head", "node", "d")
    on = chains.join(starts.select(F.col("n").alias("node")), "node").select("head", F.col("node").alias("start"), F.col("d").alias("from"))
    behind = chains.join(on, "head").where(F.col("d") > F.col("from")).select(F.col("start").alias("s"), F.col("node").alias("o"))
    return chains.select(F.col("head").alias("s"), F.col("node").alias("o")).unionByName(behind)


def reach_or_self(path: DataFrame, starts: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """reach(), and each start with itself."""
    return reach(path, starts, part_rows).unionByName(starts.select(F.col("n").alias("s"), F.col("n").alias("o")).where("s is not null")).distinct()
