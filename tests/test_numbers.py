"""Numbers of all types in one exact order, and comparisons with their errors."""

import itertools
import random
from decimal import Decimal, getcontext

import numpy as np
import pytest
from graphloom.functions import terms as T
from graphloom.operators import aggregates as A
from pyspark.sql import functions as F

getcontext().prec = 200
INTEGER, DECIMAL, DOUBLE, FLOAT = (T.XSD + t for t in ("integer", "decimal", "double", "float"))
EDGES = [
    ("9007199254740992", INTEGER), ("9007199254740993", INTEGER), ("9007199254740992.0", DOUBLE), ("9007199254740992.5", DECIMAL), ("99999999999999999999", INTEGER),
    ("100000000000000000001", INTEGER), ("1e20", DOUBLE), ("1.0E20", DOUBLE), ("-1e20", DOUBLE), ("-100000000000000000001", INTEGER), ("INF", DOUBLE), ("-INF", DOUBLE), ("0", INTEGER),
    ("-0.0", DOUBLE), ("0.0", DECIMAL), ("+0012.500", DECIMAL), ("12.5", DOUBLE), ("0.1", FLOAT), ("0.1", DECIMAL), ("0.1", DOUBLE), ("0.00012", DECIMAL), ("-0.0012", DECIMAL), ("-12", INTEGER),
    ("-123", INTEGER), ("1" * 60, INTEGER), ("1" * 59 + "2", INTEGER), ("1e-300", DOUBLE), ("1e300", DOUBLE), (".5", DECIMAL), ("5.", DECIMAL), ("999." + "9" * 40, DECIMAL), ("1000", INTEGER), ("-1000", INTEGER), ("-999." + "9" * 40, DECIMAL),
]


def rows():
    r = random.Random(2)
    out = [*EDGES]
    for _ in range(40):
        out += [(str(r.randrange(-(10 ** r.randrange(1, 40)), 10 ** r.randrange(1, 40))), INTEGER), (format(Decimal(r.randrange(-(10**9), 10**9)).scaleb(-r.randrange(15)), "f"), DECIMAL), (repr(r.uniform(-1, 1) * 10 ** r.randrange(-30, 30)), DOUBLE)]
    return out


def value(lex, dt):
    if lex in ("INF", "-INF"):
        return Decimal(lex.replace("INF", "Infinity"))
    return Decimal(str(np.float32(lex))) if dt == FLOAT else Decimal(repr(float(lex))) if dt == DOUBLE else Decimal(lex)


def terms(spark, pairs):
    return spark.createDataFrame(pairs, "l string, d string").select(T.make(T.LITERAL, F.col("l"), F.col("d")).alias("t"))


def test_order_of_numbers(spark):
    df = terms(spark, rows()).select("t", T.number_key(F.col("t")).alias("k"))
    got = [(value(r["t"]["lex"], r["t"]["dt"]), r["k"]) for r in df.collect()]
    for (x, a), (y, b) in itertools.combinations(got, 2):
        assert (a < b) == (x < y) and (a == b) == (x == y)
    nan = terms(spark, [("NaN", DOUBLE), ("x", INTEGER), ("1e5", INTEGER), ("1e5", DECIMAL)]).select(T.number_key(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in nan] == ["6", None, None, None] and max(k for _, k in got) < "6"
    least, most = df.agg(A.least(F.col("t")).alias("a"), A.greatest(F.col("t")).alias("b")).first()
    assert (least["lex"], most["lex"]) == ("-INF", "INF")
    big = terms(spark, [("99999999999999999999", INTEGER), ("100000000000000000001", INTEGER), ("1e20", DOUBLE)])
    assert big.agg(A.greatest(F.col("t")).alias("x")).first()["x"]["lex"] == "100000000000000000001"
    assert [r["t"]["lex"] for r in big.orderBy(T.sort_key(F.col("t"))).collect()] == ["99999999999999999999", "1e20", "100000000000000000001"]


COMPARISONS = {"=": T.equal, "!=": T.unequal, "<": T.less, ">": T.greater, "<=": T.at_most, ">=": T.at_least}
HOLDS = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}


@pytest.mark.parametrize("op", COMPARISONS)
def test_comparisons_of_numbers(spark, op):
    """Integers and decimals exactly; as doubles as soon as one is."""
    t = terms(spark, [*EDGES, ("NaN", DOUBLE)])
    pairs = t.select(F.col("t").alias("a")).crossJoin(t.select(F.col("t").alias("b"))).select("a", "b", COMPARISONS[op](F.col("a"), F.col("b")).alias("v"))
    for r in pairs.collect():
        a, b = ((x["lex"], x["dt"]) for x in (r["a"], r["b"]))
        rough = {DOUBLE, FLOAT} & {a[1], b[1]}
        x, y = (float(x[0].replace("INF", "inf").replace("NaN", "nan")) if rough else Decimal(x[0]) for x in (a, b))
        assert r["v"] is HOLDS[op](x, y), (a, op, b)


def test_comparisons_of_other_terms(spark):
    def holds(op, a, b):
        return spark.range(1).select(COMPARISONS[op](a, b).alias("v")).first()["v"]

    text, odd, other = T.literal("a"), T.literal("x", INTEGER), T.literal("y", INTEGER)
    assert holds("<=", text, text) is True and holds(">=", text, T.literal("b")) is False and holds("!=", text, T.literal("b")) is True
    assert holds("=", odd, other) is None and holds("!=", odd, other) is None and holds("=", odd, odd) is True and holds("<", odd, T.literal(1)) is None
    assert holds("=", T.literal("maybe", T.XSD + "boolean"), T.literal(False)) is None
    assert holds("<", T.literal(False), T.literal(True)) is True and holds(">=", T.literal("1", T.XSD + "boolean"), T.literal(True)) is True
    day = lambda x: T.literal(x, T.XSD + "date")
    assert holds("<=", day("2024-01-01"), day("2024-01-01")) is True and holds(">", day("2024-01-01"), text) is None
    assert holds("!=", T.iri("http://x/a"), text) is True and holds("<", T.iri("http://x/a"), text) is None
