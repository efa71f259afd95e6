"""Joins of solutions with unbound variables, and filters inside EXISTS, against brute force."""

import random

import pytest
from graphloom.functions import terms as T
from graphloom.operators.patterns import TERM, Solutions, exists, join, minus, optional, with_exists
from pyspark.sql import functions as F


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def table(spark, tmp_path, name, names, maybe, seed, n=40):
    """Solutions over names, of texts a to c or unbound, read from files."""
    r = random.Random(seed)
    rows = [tuple(None if x in maybe and r.random() < 0.4 else r.choice("abc") for x in names) for _ in range(n)]
    spark.createDataFrame(rows, ", ".join(f"{x} string" for x in names)).write.parquet(str(tmp_path / name))
    df = spark.read.parquet(str(tmp_path / name)).select(*(F.when(F.col(x).isNotNull(), T.literal(F.col(x))).cast(TERM).alias(x) for x in names))
    return Solutions(df, frozenset(maybe)), [dict(zip(names, row, strict=True)) for row in rows]


def compatible(x, y):
    return all(x[n] is None or y[n] is None or x[n] == y[n] for n in x.keys() & y.keys())


def merged(x, y):
    return {n: x.get(n) if x.get(n) is not None else y.get(n) for n in {**x, **y}}


def bag(s, extra=()):
    names = sorted(s.names)
    return sorted((tuple(v if n in extra else None if v is None else v["lex"] for n, v in zip(names, r, strict=True)) for r in s.df.select(*names).collect()), key=repr)


def plain(rows, names):
    return sorted((tuple(r.get(n) for n in sorted(names)) for r in rows), key=repr)


SIDES = [
    (["u", "v", "w", "x", "y"], {"u", "v", "w", "x"}, ["u", "v", "w", "x", "z"], {"u", "v", "w", "x"}),
    (["u", "v", "y"], {"u"}, ["u", "v", "z"], set()),
    (["u", "v", "y"], set(), ["u", "v", "z"], {"v", "z"}),
    (["u", "y"], {"u", "y"}, ["u", "z"], {"u"}),
]


@pytest.mark.parametrize("case", range(len(SIDES)))
def test_unbound_variables_equal_brute_force(spark, tmp_path, case):
    an, am, bn, bm = SIDES[case]
    a, x = table(spark, tmp_path, "a", an, am, case)
    b, y = table(spark, tmp_path, "b", bn, bm, case + 10)
    got = join(a, b)
    assert bag(got) == plain([merged(i, j) for i in x for j in y if compatible(i, j)], got.names)
    text = formatted(got.df)
    assert sum(z.startswith("Location") for z in text.split("\n")) == 2  # each side is scanned once
    assert "NestedLoop" not in text and "Cartesian" not in text
    shares = lambda i, j: any(i[n] is not None and j[n] is not None for n in i.keys() & j.keys())
    assert bag(minus(a, b)) == plain([i for i in x if not any(compatible(i, j) and shares(i, j) for j in y)], an)
    some = [any(compatible(i, j) for j in y) for i in x]
    assert bag(exists(a, b)) == plain([i for i, s in zip(x, some, strict=True) if s], an)
    assert bag(exists(a, b, negated=True)) == plain([i for i, s in zip(x, some, strict=True) if not s], an)
    flagged = with_exists(a, b, "zz")
    assert bag(flagged, {"zz"}) == plain([{**i, "zz": s} for i, s in zip(x, some, strict=True)], flagged.names)
    left = optional(a, b)
    want = [merged(i, j) for i in x for j in y if compatible(i, j)] + [{**dict.fromkeys(bn), **i} for i, s in zip(x, some, strict=True) if not s]
    assert bag(left) == plain(want, left.names)
    for s in (minus(a, b), exists(a, b), flagged, left):
        assert "NestedLoop" not in formatted(s.df) and "Cartesian" not in formatted(s.df)


@pytest.mark.parametrize("case", range(len(SIDES)))
def test_filters_inside_exists_see_outer_variables(spark, tmp_path, case):
    an, am, bn, bm = SIDES[case]
    a, x = table(spark, tmp_path, "a", an, am, case)
    b, y = table(spark, tmp_path, "b", bn, bm, case + 10)
    condition = T.less(F.col("y"), F.col("z"))
    holds = lambda i, j: compatible(i, j) and i["y"] is not None and j["z"] is not None and i["y"] < j["z"]
    some = [any(holds(i, j) for j in y) for i in x]
    got = exists(a, b, condition=condition)
    assert bag(got) == plain([i for i, s in zip(x, some, strict=True) if s], an)
    assert bag(exists(a, b, negated=True, condition=condition)) == plain([i for i, s in zip(x, some, strict=True) if not s], an)
    flagged = with_exists(a, b, "zz", condition)
    assert bag(flagged, {"zz"}) == plain([{**i, "zz": s} for i, s in zip(x, some, strict=True)], flagged.names)
    assert "NestedLoop" not in formatted(got.df) and "Cartesian" not in formatted(got.df)


def test_outer_variable_of_no_key(spark, tmp_path):
    """Nothing shared: the filter alone ties the two sides."""
    a, x = table(spark, tmp_path, "a", ["y"], set(), 1, 9)
    b, y = table(spark, tmp_path, "b", ["z"], set(), 2, 3)
    got = exists(a, b, condition=T.less(F.col("y"), F.col("z")))
    assert bag(got) == plain([i for i in x if any(i["y"] < j["z"] for j in y)], ["y"])
