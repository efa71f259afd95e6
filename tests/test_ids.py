"""Patterns over ids beside patterns over terms, colliding hashes, and the plan of a subject join."""

import random

import pytest
from graphloom.functions import terms as T
from graphloom.operators.patterns import Solutions, join, match
from graphloom.sources import ids as I
from graphloom.sources.quads import SCHEMA
from pyspark.sql import functions as F

X = "http://x/"


@pytest.fixture
def quads(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        s, kind = (f"{X}s{r.randrange(60)}", T.IRI) if i % 7 else (f"b{r.randrange(5)}", T.BNODE)
        o = r.choice([(f"{X}s{r.randrange(60)}", T.IRI, None, None), (str(r.randrange(9)), T.LITERAL, T.XSD + "integer", None), (str(r.randrange(9)), T.LITERAL, T.XSD + "string", None), ("a", T.LITERAL, T.LANG_STRING, r.choice(["en", "fr"]))])
        rows.append((X + f"g{i % 2}", s, kind, X + r.choice("pqr"), *o, None))
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


def narrow(term, turn):
    """Few values at first, so that nearly all terms collide, and still some at the next turn."""
    h = I.hashed(term, turn)
    return F.pmod(h, F.lit(7)) if turn == 0 else F.pmod(h, F.lit(200)) if turn == 1 else h


@pytest.mark.parametrize("hash_", [I.hashed, narrow])
def test_patterns_over_ids_equal_those_over_terms(spark, quads, hash_):
    ids = I.encode(quads, 4, hash_)
    try:
        once = quads.distinct()
        assert ids.terms.count() == ids.terms.select("id").distinct().count() == ids.terms.drop("id").distinct().count()
        assert ids.exceptions.isEmpty() == (hash_ is I.hashed)
        for o in ("?b", T.literal(3), T.literal("a", lang="fr"), X + "s5"):
            names = ["a", "b"] if isinstance(o, str) and o == "?b" else ["a"]
            assert bag(ids.decoded(ids.match("?a", X + "p", o)).df.select(*names)) == bag(match(once, "?a", X + "p", o).df.select(*names))
        assert bag(ids.decoded(ids.match("?a", X + "p", "?b", g=X + "g1")).df) == bag(match(once, "?a", X + "p", "?b", g=X + "g1").df)
        both = lambda q: join(join(q("?a", X + "p", "?b"), q("?a", X + "q", "?c")), q("?b", X + "r", "?d"))
        got, want = ids.decoded(both(ids.match)).df, both(lambda s, p, o: match(once, s, p, o)).df
        assert bag(got.select("a", "b", "c", "d")) == bag(want.select("a", "b", "c", "d")) and got.count() > 10
        assert ids.match(X + "nobody", X + "p", "?b").df.isEmpty()
        assert bag(ids.decoded(ids.match("?a", X + "p", "?a")).df) == bag(match(once, "?a", X + "p", "?a").df)
    finally:
        ids.drop()


def test_subject_joins_need_no_exchange(spark, quads):
    ids = I.encode(quads, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        star = join(join(ids.match("?a", X + "p", "?b"), ids.match("?a", X + "q", "?c")), ids.match("?a", X + "r", "?d"))
        assert "SortMergeJoin" in (plan := star.df._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
        shown = ids.decoded(Solutions(star.df.select("b")), "b").df._jdf.queryExecution().executedPlan().toString()
        assert shown.count("Exchange") == 1  # what is decoded; not the dictionary
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        ids.drop()


def test_no_quads(spark, quads):
    ids = I.encode(quads.where("false"), 2)
    assert ids.terms.isEmpty() and ids.match("?a", X + "p", "?b").df.isEmpty()
    ids.drop()
    assert not spark.catalog.tableExists(ids.names[0])
