"""Searches from bound ends against brute force."""

import random

from graphloom.operators import paths as P
from pyspark.sql import functions as F


def walks(edges, starts):
    out, after = set(), {}
    for s, o in edges:
        after.setdefault(s, set()).add(o)
    for n in starts:
        todo = [n]
        while todo:
            for o in after.get(todo.pop(), ()):
                if (n, o) not in out:
                    out.add((n, o))
                    todo.append(o)
    return out


def reached(spark, edges, starts, **how):
    path = spark.createDataFrame(edges, "s long, o long")
    got = [tuple(r) for r in P.reach(path, spark.createDataFrame([(n,) for n in starts], "n long"), **how).collect()]
    assert len(got) == len({*got})
    return {*got}


def test_reach_equals_brute_force(spark):
    r = random.Random(4)
    for part_rows in (10**6, 20):
        edges = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(5, 5), (None, 3), (3, None)]
        starts = [1, 2, 2, 5, None, 999]
        want = walks([e for e in edges if None not in e], {1, 2, 5})
        assert reached(spark, edges, starts, part_rows=part_rows) == want
    assert reached(spark, [(1, 2)], []) == set() and reached(spark, [], [1]) == set()
    path = spark.createDataFrame([(1, 2), (2, 3)], "s long, o long")
    assert {tuple(x) for x in P.reach_or_self(path, spark.range(1, 2).select(F.col("id").alias("n"))).collect()} == {(1, 1), (1, 2), (1, 3)}


def test_long_walks_take_few_rounds(spark, monkeypatch):
    """Chains that meet, a long ring that is reached, a ring that is not, and branches off both."""
    rounds = []
    add = P.Parts.add
    monkeypatch.setattr(P.Parts, "add", lambda self, df: rounds.append(self.by) or add(self, df))
    chain = [(i, i + 1) for i in range(1600)]
    ring = [(5000 + i, 5000 + (i + 1) % 700) for i in range(700)]
    edges = chain + ring + [(1000, 5000), (5350, 1500), (1500, 1200), (9000, 9001), (9001, 9000), (30, 7000)] + [(7000 + i, 7001 + i) for i in range(50)]
    starts = [0, 1590, 5600, *range(100, 900, 200)]
    monkeypatch.setattr(P, "PLAIN", 6)
    assert reached(spark, edges, starts) == walks(edges, starts)
    n = rounds.count("o")
    assert n < 30, n  # a round has one addition; an edge further each time would take two thousand


def test_work_grows_with_what_is_reached(spark, monkeypatch):
    """On 100,000 edges, a search from one node reads the parts of its front."""
    edges = spark.range(100_000).select(F.col("id").alias("s"), (F.col("id") * 2 + 7).alias("o"))
    asked = []
    read = P.Parts.read
    monkeypatch.setattr(P.Parts, "read", lambda self, parts=None, last=False: (asked.append((self.by, parts)) if parts is not None else None) or read(self, parts, last))
    got = {tuple(x) for x in P.reach(edges, spark.createDataFrame([(3,)], "n long"), part_rows=1000).collect()}
    want, n = set(), 3
    while n < 100_000:
        n = n * 2 + 7
        want.add((3, n))
    assert got == want
    assert all(len(parts) == 1 for by, parts in asked if by == "s")  # one of a hundred parts a round
