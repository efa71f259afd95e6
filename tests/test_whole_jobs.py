"""Queries do their whole job, and no task holds more than its share."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.plans import access as acl
from graphloom.plans import updates as U
from graphloom.queries import QUERIES, SQL
from graphloom.shared import MOST_PARTS
from graphloom.sources.quads import NS, table_quads
from graphloom.streaming.deltas import decoded

SF = "/root/testdata/sf0.001"


def test_negated_sets_see_all_columns(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    n, back = QUERIES["q38b_negated_orders"](spark, SF).select("n", "back").first()
    assert (n, back) == (6 * orders.count(), 5 * orders.count())
    assert all(f"count({c})" in SQL["q38b_negated_orders"] for c in orders.columns)


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def customers(spark):
    return table_quads(spark.read.parquet(f"{SF}/customer.parquet"), "customer")


@pytest.mark.parametrize("name", ["distinct", "fold", "route", "typed"])
def test_rows_are_dealt_before_they_are_grouped(spark, name):
    """The task that reads a file of one row group groups none of the rows that it makes."""
    q = customers(spark)
    changes = U.data(q, "insert", 0)
    made = {
        "distinct": lambda: changes,
        "fold": lambda: U.fold(changes),
        "route": lambda: acl.route(changes, q.where("false"), [acl.Group("g", (acl.GraphSpec(NS + "g", acl.ByPrefix(NS)),))], [("g", ())]),
        "typed": lambda: QUERIES["q61_typed_aggregates"](spark, SF),
    }[name]()
    lines = plan(made)
    last = max(i for i, x in enumerate(lines) if "Exchange" in x)
    assert any("Aggregate" in x for x in lines) and not any("Aggregate" in x for x in lines[last:])


def test_large_changes_are_not_broadcast(spark):
    """However few bytes their files have."""
    q = customers(spark)
    after = U.commit(q, U.fold(U.data(q, "delete", 0)), broadcast_bytes=0)
    assert not any("BroadcastExchange" in x for x in plan(after)) and after.count() == 0


def test_large_changes_keep_the_parts_that_rows_are_dealt_to(spark):
    """With more parts, the task that reads a file would hold all quads that it makes before it writes them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        q = customers(spark)
        after = U.commit(q, U.fold(U.data(q.where(f"p = '{NS}c_name'"), "delete", 0)), broadcast_bytes=0)
        dealt = [x for x in plan(after) if "Exchange" in x]
        assert len(dealt) == 2 and all(f", {MOST_PARTS})" in x for x in dealt)
        assert after.count() == q.count() * 6 // 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_row_of_the_changes_meets_others_by_its_object(spark, monkeypatch):
    """A type or a country of very many rows made one task of a join; its types are sent to all tasks instead."""
    monkeypatch.setattr(acl, "HOT", 3)
    q, nations = customers(spark), table_quads(spark.read.parquet(f"{SF}/nation.parquet"), "nation")
    changes = U.data(q.unionByName(nations), "insert", 0)
    types, hot = acl.resource_types(changes, q.where("false"))
    assert not any("Join" in x for x in plan(types))
    want = {r[0] for r in changes.where("o_kind = 2").groupBy("o").count().where("count > 3").select("o").collect()}
    assert {r[0]: r[1] for r in hot.collect()} == {o: [NS + "nation"] if o.startswith(NS + "nation/") else [] for o in want}
    rule = acl.ByType((NS + "nation",), predicates=acl.none_except(), inverse=acl.none_except(NS + "c_nation"))
    specs = [acl.Group("l", (acl.GraphSpec(NS + "links", rule),)), acl.Cleanup("clean")]
    stored = [(c, g) for c, g in ((changes, nations.where("false")), (U.data(q, "insert", 0), nations))]  # types given and stored
    for c, s in stored:
        got = acl.route(c, s, specs, [("l", ()), ("clean", ())])
        assert got.count() == q.where(f"p = '{NS}c_nation'").count() and got.select("g").distinct().count() == 1


def test_json_terms_are_parsed_once(spark):
    """Each name of a part of the term parsed its JSON again."""
    texts = spark.createDataFrame([('{"type":"literal","value":"a","xml:lang":"en"}',), ('{"type":"uri","value":"b"}',), ("{",), (None,)], "t string")
    out = texts.repartition(1).select(decoded(F.col("t")).alias("x"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {tuple(r.x) if r.x else None for r in out.collect()} == {(3, "a", T.LANG_STRING, "en"), (2, "b", None, None), None}
