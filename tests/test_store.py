"""The store of versions: what a commit writes, what a read scans, and that all ways of writing give the same quads."""

import os
import random

import pytest
from graphloom.functions import terms as T
from graphloom.operators.patterns import Solutions, term_columns
from graphloom.plans import access as acl
from graphloom.plans import updates as U
from graphloom.sources import store as S
from graphloom.sources.quads import IDENTITY, SCHEMA
from pyspark.sql import functions as F

X = "http://x/"
CHANGE = SCHEMA + ", op string"


def quad(g, s, p, o, lang=None):
    return X + g, X + s, T.IRI, p if p == T.RDF_TYPE else X + p, X + o, T.IRI, None, lang, None


def rows(df):
    return sorted((tuple(r) for r in df.select(*IDENTITY).collect()), key=repr)


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture
def data(spark):
    return spark.createDataFrame([quad(f"g{i % 3}", f"s{i}", "p", f"o{j}") for i in range(200) for j in range(2)] + [quad("g0", f"s{i}", T.RDF_TYPE, "Thing" if i % 2 else "Person") for i in range(200)], SCHEMA)


def test_commit_writes_touched_parts_only(spark, data, tmp_path):
    store = S.Store(spark, str(tmp_path / "store"), slots=4, buckets=16)
    assert store.create(data.unionByName(data)) == 0
    old, before = rows(store.read(0)), files(tmp_path)
    assert old == rows(data)
    changes = spark.createDataFrame([(*quad("g1", "s1", "p", f"new{i}"), "insert") for i in range(9)] + [(*quad("g0", "s0", "p", "o1"), "delete")], CHANGE)
    touched = changes.select(store.quads.part).distinct().count()
    assert store.commit(changes) == 1
    after = files(tmp_path)
    assert before.items() <= after.items()  # nothing is written over
    assert {f.split("/")[-2] for f in after.keys() - before.keys() if "/quads/" in f} == {f"part={r[0]}" for r in changes.select(store.quads.part).distinct().collect()}
    assert touched <= 2 < len({f.split("/")[-2] for f in before if "/quads/" in f}) and not any("/types/" in f for f in after.keys() - before.keys())
    assert rows(store.read(0)) == old
    assert rows(store.read()) == sorted((set(old) - {quad("g0", "s0", "p", "o1")[:8]}) | {quad("g1", "s1", "p", f"new{i}")[:8] for i in range(9)}, key=repr)


def test_a_part_that_loses_all_quads_is_empty(spark, tmp_path):
    one = spark.createDataFrame([quad("g", "s", "p", "o", "en")], SCHEMA)
    store = S.Store(spark, str(tmp_path / "s"), 2, 4)
    store.create(one)
    store.commit(one.withColumn("op", F.lit("delete")))
    assert rows(store.read()) == [] and store.read().columns == store.quads.columns
    store.commit(one.withColumn("op", F.lit("insert")), "append")
    assert rows(store.read()) == rows(one) and rows(store.read(1)) == []
    empty = S.Store(spark, str(tmp_path / "e"))
    empty.create(one.where("false"))
    assert rows(empty.read()) == [] and empty.types().collect() == []


@pytest.mark.parametrize("how", ["rewrite", "append", "mixed"])
def test_versions_equal_replay(spark, data, tmp_path, how):
    r, state = random.Random(how), {q[:8] for q in rows(data)}
    store = S.Store(spark, str(tmp_path / "s"), 2, 8)
    store.create(data)
    seen = {0: state}
    for i in range(5):
        picked = {quad(f"g{r.randrange(3)}", f"s{r.randrange(12)}", r.choice(["p", T.RDF_TYPE]), f"o{r.randrange(3)}"): r.choice(["insert", "delete"]) for _ in range(30)}
        version = store.commit(spark.createDataFrame([(*q, op) for q, op in picked.items()], CHANGE), r.choice(["rewrite", "append"]) if how == "mixed" else how)
        state = state - {q[:8] for q, op in picked.items() if op == "delete"} | {q[:8] for q, op in picked.items() if op == "insert"}
        seen[version] = state
        if i == 3:
            seen[store.compact(0)] = state
    for version, want in seen.items():
        assert rows(store.read(version)) == sorted(want, key=repr)
        types = {tuple(x) for x in store.types(version=version).select("resource", "type").collect()}
        assert types == {(q[1], q[4]) for q in want if q[3] == T.RDF_TYPE}
    assert rows(store.read(graphs=[X + "g1"], subjects=[X + "s1", X + "s4"])) == sorted((q for q in state if q[0] == X + "g1" and q[1] in (X + "s1", X + "s4")), key=repr)
    assert rows(store.read(graphs=[])) == []


def test_reads_prune_parts_and_never_shuffle_the_store(spark, data, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"), 4, 16)
    store.create(data)
    store.commit(spark.createDataFrame([(*quad("g0", "s5", T.RDF_TYPE, "Late"), "insert")], CHANGE), "append")
    one = store.read(graphs=[X + "g1"], subjects=[X + "s4"])
    scans = [x for x in formatted(one).split("\n") if x.startswith("PartitionFilters")]
    assert scans and all("part#" in x for x in scans)
    read = store.read(0, graphs=[X + "g1"], subjects=[X + "s4"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) <= 1
    asked = S.cut(spark.createDataFrame([(X + "s5",), (X + "s8",)], "resource string"))
    found = store.types(asked)
    assert {tuple(x) for x in found.collect()} == {(X + "s5", X + "Thing"), (X + "s5", X + "Late"), (X + "s8", X + "Person")}
    # the stored side of every join is read where it lies: exchanges stand above the joins, or over the few changes
    joins = [line for line in plan(found).split("\n") if "Join" in line]
    assert joins and all("BroadcastHashJoin" in x for x in joins)


def test_two_writers_of_one_version(spark, data, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path / "s"), 1, 2)
    store.create(data)
    change = spark.createDataFrame([(*quad("g0", "s1", "p", "x"), "insert")], CHANGE)
    store.commit(change)
    monkeypatch.setattr(store, "latest", lambda: 0)  # a writer that began before that commit
    with pytest.raises(Exception, match="exist|File already"):
        store.commit(change, "append")
    assert S.Store(spark, store.folder, 1, 2).versions() == [0, 1]


def test_ten_statements_scan_the_base_once_each(spark, data, tmp_path):
    data.write.parquet(str(tmp_path / "base"))
    base, r = spark.read.parquet(str(tmp_path / "base")), random.Random(1)
    scans = []

    def statement(i):
        s, p = f"s{r.randrange(6)}", "p" if i % 3 else T.RDF_TYPE

        def solve(state):
            scans.append(sum(x.startswith("Location") and "/base]" in x for x in formatted(state).split("\n")))
            changed = state.where((F.col("s") == X + s) & (F.col("p") == (X + p if p == "p" else p)))
            return U.data(changed, "delete", 0).unionByName(U.data(changed.withColumn("o", F.concat("o", F.lit(f"+{i}"))), "insert", 1))

        return solve, s, X + "p" if p == "p" else p

    steps = [statement(i) for i in range(10)]
    state = {q for q in rows(base)}
    for i, (_, s, p) in enumerate(steps):
        hit = {q for q in state if q[1] == X + s and q[3] == p}
        state = state - hit | {(*q[:4], q[4] + f"+{i}", *q[5:]) for q in hit}
    assert rows(U.sequential(base, [x[0] for x in steps])) == sorted(state, key=repr)
    assert scans == [1] * 10
    assert rows(U.sequential(base, [])) == rows(base)


def test_update_of_a_store_by_groups(spark, data, tmp_path):
    """Types come from the store; what no group writes is denied; with sudo all is written."""
    store = S.Store(spark, str(tmp_path / "s"), 2, 4)
    store.create(data)
    everyone = acl.Group("all", tuple(acl.GraphSpec(X + f"g{i}") for i in range(3)), usage=frozenset({acl.READ_FOR_WRITE}))
    people = acl.Group("people", (acl.GraphSpec(X + "people", acl.ByType((X + "Person",))),))
    solve = lambda view: Solutions(view.where(F.col("p") == X + "p").select(term_columns("s").alias("x")).distinct())
    flag = [(acl.APPLICATION_GRAPH, "?x", X + "flag", T.literal(True))]
    version, routed, denied = U.update_store(store, [everyone, people, acl.Cleanup("clean")], [("all", ()), ("people", ()), ("clean", ())], solve, [], flag)
    assert routed.count() == store.read(version, graphs=[X + "people"]).count() == 100 and denied.count() == 100
    version, routed, denied = U.update_store(store, [], None, solve, [], flag, how="append")
    assert store.read(version, graphs=[acl.APPLICATION_GRAPH]).count() == routed.count() == 200 and denied.count() == 0


def test_large_changes_are_not_broadcast(spark, data, monkeypatch):
    folded = U.fold(U.data(data.where(F.col("p") == X + "p"), "delete", 0))
    assert "BroadcastExchange" in plan(U.commit(data, folded))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        after = U.commit(data, folded, broadcast_bytes=100)
        assert "BroadcastExchange" not in plan(after) and after.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
