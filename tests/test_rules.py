"""The rules of terms, joins, access and updates on hand-made quads."""

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import aggregates as A
from graphloom.operators import paths as P
from graphloom.operators.patterns import Solutions, join, minus, optional, union, values
from graphloom.plans import access as acl
from graphloom.plans import updates as U
from graphloom.sources.nquads import read_nquads
from graphloom.sources.quads import SCHEMA, read_version, write_version
from graphloom.streaming.deltas import folder_target, publish, since, subscribe, to_all

X = "http://x/"


def quads(spark, *rows):
    full = [(g, s, T.IRI, p, o, k, dt, None, None) for g, s, p, o, k, dt in rows]
    return spark.createDataFrame(full, SCHEMA)


def q(g, s, p, o, k=T.IRI, dt=None):
    return g, X + s, p if p == T.RDF_TYPE else X + p, X + o if k == T.IRI else o, k, dt


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_terms(spark):
    five, text = T.literal(5), T.literal("5")
    assert value(spark, T.equal(five, T.literal("5.0", T.XSD + "decimal"))) is True
    assert value(spark, T.equal(five, text)) is False
    assert value(spark, T.equal(T.literal("a", X + "t"), T.literal("b", X + "t"))) is None
    assert value(spark, T.truth(T.literal(""))) is False and value(spark, T.truth(T.iri(X))) is None
    assert value(spark, T.if_(F.lit(None).cast("boolean"), F.lit(1), F.lit(2))) is None
    assert value(spark, T.rounded(F.lit(-2.5))) == -2
    t = T.literal("2024-01-02T10:00:00+05:00", T.XSD + "dateTime")
    assert value(spark, T.date_part(t, "hours")) == 10 and value(spark, T.tz(t)) == "+05:00" and value(spark, T.timezone(t)) == "PT5H"
    assert value(spark, T.encode_for_uri(F.lit("a b~*"))) == "a%20b~%2A"
    assert value(spark, T.number(T.cast(T.literal("x"), "integer"))) is None
    assert value(spark, T.after(F.lit("abc"), F.lit("z"))) == "" and value(spark, T.before(F.lit("abc"), F.lit("c"))) == "ab"


def test_aggregate_errors(spark):
    df = spark.range(2).select(F.when(F.col("id") == 0, T.literal(1)).otherwise(T.literal("x")).alias("t"))
    assert df.agg(A.total(F.col("t")).alias("v")).first()["v"] is None
    assert df.where("false").agg(A.total(F.col("t")).alias("v")).first()["v"]["lex"] == "0"


def bag(s: Solutions):
    return sorted((tuple(None if v is None else v["lex"] for v in r) for r in s.df.select(*sorted(s.names)).collect()), key=repr)


def test_unbound_variables(spark):
    a = values(spark, ["x", "y"], [(T.literal("1"), None), (T.literal("2"), T.literal("b"))])
    b = values(spark, ["x", "y"], [(T.literal("1"), T.literal("a")), (None, T.literal("b"))])
    assert bag(join(a, b)) == [("1", "a"), ("1", "b"), ("2", "b")]
    assert bag(minus(a, b)) == []
    c = values(spark, ["y"], [(T.literal("z"),)])
    assert bag(minus(a, c)) == [("1", None), ("2", "b")]
    assert bag(optional(a, c)) == [("1", "z"), ("2", "b")]
    assert bag(union(c, values(spark, ["x"], [(T.literal("1"),)]))) == [("1", None), (None, "z")]


def test_routing_and_cleanup(spark):
    changes = U.data(quads(spark, q("any", "a", T.RDF_TYPE, "Person"), q("any", "a", "name", "A", T.LITERAL, T.XSD + "string"), q("any", "b", "name", "B", T.LITERAL, T.XSD + "string")), "insert", 0)
    stored = quads(spark, q("g", "a", T.RDF_TYPE, "Thing"))
    people = acl.Group("people", (acl.GraphSpec(X + "people/", acl.ByType((X + "Person",))),))
    things = acl.Group("things", (acl.GraphSpec(X + "things/", acl.ByType((X + "Thing",))),))
    specs = [people, things, acl.Cleanup("clean")]
    out = acl.route(changes, stored, specs, [("people", ("1",)), ("things", ()), ("clean", ())])
    assert {r["g"] for r in out.collect()} == {X + "people/1"}  # the type in the update goes before the stored one
    kept = acl.route(changes, stored, specs, [("people", ("1",))])
    assert kept.where(F.col("g") == acl.APPLICATION_GRAPH).count() == 3
    assert acl.unwritten(changes, out).count() == 1  # b has no type
    assert acl.read_view(stored, []).count() == 0


def test_fold_commit_equals_replay(spark):
    import random

    r = random.Random(3)
    log = [(i, r.choice(["insert", "delete"]), r.randrange(5)) for i in range(40)]
    old = quads(spark, *(q("g", f"s{i}", "p", "o") for i in range(3)))
    state = {0, 1, 2}
    for _, op, i in log:
        state = state | {i} if op == "insert" else state - {i}
    changes = None
    for seq, op, i in log:
        c = U.data(quads(spark, q("g", f"s{i}", "p", "o")), op, seq)
        changes = c if changes is None else changes.unionByName(c)
    assert {r["s"] for r in U.commit(old, U.fold(changes)).collect()} == {f"{X}s{i}" for i in state}


def test_files_and_feed(spark, tmp_path):
    (tmp_path / "a.nq").write_text('<http://x/a> <http://x/p> "v\\"1"@en <http://x/g> .\n_:b <http://x/p> "2"^^<http://www.w3.org/2001/XMLSchema#integer> .\nnonsense\n')
    got = read_nquads(spark, str(tmp_path / "a.nq"))
    assert sorted((r["s"].split("-")[-1], r["o"], r["o_lang"], r["o_num"]) for r in got.collect()) == [("b", "2", None, 2.0), ("http://x/a", 'v"1', "en", None)]
    write_version(got, str(tmp_path / "store"), 1)
    assert read_version(spark, str(tmp_path / "store"), 1).count() == 2
    publish(U.data(got, "insert", 7), "call", str(tmp_path / "feed"))
    seen = []
    subscribe(spark, str(tmp_path / "feed"), lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 2 and since(spark, str(tmp_path / "feed"), 7).count() == 0


def test_one_or_more_has_no_longest_walk(spark):
    chain = [(i, i + 1) for i in range(300)]
    ring = [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)] + [(1003, 2000), (2000, 2000)]
    d = spark.createDataFrame(chain + ring + ring, "s long, o long")
    want = {(i, j) for i in range(300) for j in range(i + 1, 301)} | {(1000 + i, 1000 + j) for i in range(7) for j in range(7)} | {(1000 + i, 2000) for i in range(7)} | {(2000, 2000)}
    got = [tuple(r) for r in P.one_or_more(d).collect()]
    assert len(got) == len(want) and set(got) == want
    assert P.one_or_more(d.where("false")).isEmpty()


def test_strings_before_and_after_keep_their_tags(spark):
    a, bare = T.literal("abcabc", lang="en"), T.literal("abc")
    shown = lambda c: (lambda v: v and (v["lex"], v["lang"]))(value(spark, c))
    assert shown(T.strbefore(a, T.literal("c"))) == ("ab", "en") and shown(T.strafter(a, T.literal("b", lang="en"))) == ("cabc", "en")
    assert shown(T.strbefore(a, T.literal("z"))) == ("", None) == shown(T.strafter(a, T.literal("z")))
    assert shown(T.strbefore(a, T.literal(""))) == ("", "en") and shown(T.strafter(a, T.literal(""))) == ("abcabc", "en")
    assert shown(T.strbefore(a, T.literal("c", lang="fr"))) is None and shown(T.strafter(bare, T.literal("c", lang="en"))) is None
    assert shown(T.strbefore(T.literal(5), bare)) is None and shown(T.strafter(bare, bare)) == ("", None)


def test_iris_under_a_base(spark):
    base = "http://a/b/c/d;p?q"
    want = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x"}
    got = spark.createDataFrame([(k,) for k in want], "k string").select("k", T.resolved(T.literal(F.col("k")), base)["lex"].alias("v")).collect()
    assert {r["k"]: r["v"] for r in got} == want
    assert value(spark, T.resolved(T.literal(5), base)) is None and value(spark, T.resolved(T.iri("x"), base))["lex"] == "http://a/b/c/x"


def test_positive(spark):
    assert value(spark, T.positive(T.literal(-5)))["lex"] == "-5" and value(spark, T.positive(T.literal("x"))) is None


def test_groups_of_a_request(spark):
    own = lambda session: spark.createDataFrame([("1",), ("2",), (None,), ("1",)] if session == "me" else [], "v string")
    specs = [acl.Group("public", (acl.GraphSpec(X + "p"),), usage=frozenset({acl.READ})), acl.Group("own", (acl.GraphSpec(X + "own/"),), access=own), acl.Cleanup("clean")]
    mine = acl.resolve(specs, "me")
    assert mine[0] == ("public", ()) and sorted(mine[1:3]) == [("own", ("1",)), ("own", ("2",))] and mine[3] == ("clean", ())
    assert acl.resolve(specs, "me", sudo=True) is None and acl.resolve(specs) == [("public", ()), ("clean", ())]
    text = acl.encode_groups([*mine, mine[0]])
    assert acl.decode_groups(text) == mine == acl.resolve(specs, None, stated=text) and acl.decode_groups(None) is None and acl.decode_groups("[]") == []
    assert acl.used_groups(specs, mine, acl.READ) == mine[:3] and ("public", ()) not in acl.used_groups(specs, mine, acl.WRITE) and acl.used_groups(specs, mine, acl.WRITE)[-1] == ("clean", ())
    assert {r["g"] for r in acl.graph_names(spark, specs, "me").collect()} == {*acl.readable_graphs(specs, mine)} == {X + "p", X + "own/1", X + "own/2"}


def test_excluded_types(spark):
    """A resource of an excluded type alone does not match; another type of its own does."""
    changes = U.data(quads(spark, q("any", "a", "name", "A"), q("any", "b", "name", "B"), q("any", "c", "name", "C")), "insert", 0)
    stored = quads(spark, q("g", "a", T.RDF_TYPE, "Draft"), q("g", "b", T.RDF_TYPE, "Draft"), q("h", "b", T.RDF_TYPE, "Page"))
    specs = [acl.Group("pages", (acl.GraphSpec(X + "pages", acl.ByType(without=(X + "Draft",))),)), acl.Cleanup("clean")]
    out = acl.route(changes, stored, specs, [("pages", ()), ("clean", ())])
    assert {(r["s"], r["g"]) for r in out.collect()} == {(X + "b", X + "pages")}


def test_delta_targets(spark, tmp_path):
    """Each target gets each batch; a batch that is delivered again replaces itself."""
    rows = U.data(quads(spark, *(q("g", f"s{i}", "p", "o") for i in range(25))), "insert", 3)
    publish(rows, "call", str(tmp_path / "feed"))
    seen = []
    target = to_all(lambda df, n: seen.append((n, df.count())), folder_target(str(tmp_path / "sets"), size=10))
    subscribe(spark, str(tmp_path / "feed"), target, str(tmp_path / "cp")).awaitTermination(60)
    assert [n for _, n in seen] == [25]
    target(spark.read.parquet(str(tmp_path / "feed")), seen[0][0])
    bodies = [r["body"] for r in spark.read.json(str(tmp_path / "sets")).collect()]
    assert len(bodies) == 3 and sum(b.count('"graph":') for b in bodies) == 25 and all(b.startswith('{"changeSets":[{"insert":[') for b in bodies)


def test_released_results_leave_nothing_else(spark):
    from graphloom import shared

    folder = shared.checkpoint_dir(spark)
    before = {*shared.names(spark, folder)}
    old = quads(spark, *(q("g", f"s{i}", "p", "o") for i in range(9)))
    gone = U.fold(U.data(old.where(F.col("s") == X + "s1"), "delete", 0))
    out = shared.released(spark, lambda: U.commit(old, gone))
    assert out.count() == 8 and len({*shared.names(spark, folder)} - before) == 1
    shared.drop(out)
    assert {*shared.names(spark, folder)} == before
