"""The registered queries over the given tables, each with its SQL. Whole tables are mapped to quads or to star projections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .operators import aggregates as A
from .operators import paths as P
from .operators.patterns import Solutions, ask, bgp, collection, construct, exists, join, match, minus, optional, union, values, with_exists
from .plans import access as acl
from .plans import example
from .plans import updates as U
from .plans.pruning import Class, graphs_for, subject_types
from .shared import cut, delete, fresh, released, spread
from .sources.ids import encode
from .sources.nquads import bad_lines, nquads, read_nquads
from .sources.quads import BASE_GRAPH, NS, mapped, star, table_quads, tables
from .sources.store import Store
from .streaming.deltas import change_rows, change_sets, decoded, encoded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def iri_sql(table: str, column: str) -> str:
    return f"'{NS}{table}/' || {column}::varchar"


def lex(name: str) -> Column:
    return F.col(name)["lex"].alias(name)


def num(name: str) -> Column:
    return T.number(F.col(name))


@query("SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def q01_region_balance(spark, sf):
    c = star(read(spark, sf, "customer"), "customer", na="c_nation", b="c_acctbal")
    n = star(read(spark, sf, "nation"), "nation", r="n_region").withColumnRenamed("s", "na")
    r = star(read(spark, sf, "region"), "region", region="r_name").withColumnRenamed("s", "r")
    return c.join(n, "na").join(r, "r").groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum("b"), 2).alias("balance"))


@query("SELECT r_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def q01b_region_balance_quads(spark, sf):
    q = mapped(spark, sf, "customer", "nation", "region")
    s = bgp(q, ("?c", T.RDF_TYPE, NS + "customer"), ("?c", NS + "c_nation", "?na"), ("?c", NS + "c_acctbal", "?b"), ("?na", NS + "n_region", "?r"), ("?r", NS + "r_name", "?region"))
    return s.df.groupBy("region").agg(F.count("*").alias("n"), A.total(F.col("b")).alias("balance")).select(lex("region"), "n", F.round(num("balance"), 2).alias("balance"))


@query(f"SELECT {iri_sql('customer', 'c_custkey')} AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 5000")
def q02_filter(spark, sf):
    s = match(mapped(spark, sf, "customer"), "?c", NS + "c_acctbal", "?b").where(T.less(T.literal(5000), F.col("b")))
    return s.df.select(lex("c"), num("b").alias("b"))


@query("SELECT p_partkey AS k, round(p_retailprice * p_size + 1, 4) AS v FROM part")
def q03_bind(spark, sf):
    s = bgp(mapped(spark, sf, "part"), ("?x", NS + "p_partkey", "?k"), ("?x", NS + "p_retailprice", "?p"), ("?x", NS + "p_size", "?z"))
    s = s.bind("product", T.arithmetic("*", F.col("p"), F.col("z")))
    return s.bind("v", T.arithmetic("+", F.col("product"), T.literal(1))).df.select(num("k").cast("long").alias("k"), F.round(num("v"), 4).alias("v"))


@query("SELECT DISTINCT c_mktsegment AS seg FROM customer")
def q04_distinct(spark, sf):
    return match(mapped(spark, sf, "customer"), "?c", NS + "c_mktsegment", "?seg").select("seg").distinct().df.select(lex("seg"))


@query(f"SELECT {iri_sql('orders', 'o_orderkey')} AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q05_top(spark, sf):
    q = table_quads(read(spark, sf, "orders"), "orders", columns=["o_totalprice"])
    s = match(q, "?o", NS + "o_totalprice", "?t").df
    return s.orderBy(T.sort_key(F.col("t")).desc(), F.expr("cast(regexp_extract(o.lex, '[0-9]+$', 0) as long)")).limit(10).select(lex("o"), num("t").alias("t"))


@query("SELECT n_name AS n FROM nation ORDER BY n_name LIMIT 7 OFFSET 5")
def q06_offset(spark, sf):
    return match(mapped(spark, sf, "nation"), "?x", NS + "n_name", "?n").df.orderBy(T.sort_key(F.col("n"))).offset(5).limit(7).select(lex("n"))


@query("SELECT count(*) > 0 AS answer FROM customer WHERE c_acctbal < 0")
def q07_ask(spark, sf):
    return ask(match(mapped(spark, sf, "customer"), "?c", NS + "c_acctbal", "?b").where(num("b") < 0))


@query(f"SELECT {iri_sql('nation', 'n_nationkey')} AS s, '{NS}inRegion' AS p, {iri_sql('region', 'n_regionkey')} AS o FROM nation UNION SELECT {iri_sql('region', 'n_regionkey')}, '{NS}has', {iri_sql('nation', 'n_nationkey')} FROM nation")
def q08_construct(spark, sf):
    s = match(mapped(spark, sf, "nation"), "?n", NS + "n_region", "?r")
    return construct(s, ("?n", T.iri(NS + "inRegion"), "?r"), ("?r", T.iri(NS + "has"), "?n")).select(lex("s"), lex("p"), lex("o"))


@query(f"SELECT {iri_sql('nation', 'n_nationkey')} AS n, CASE WHEN s_acctbal > 5000 THEN {iri_sql('supplier', 's_suppkey')} END AS u FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def q09_optional(spark, sf):
    q = mapped(spark, sf, "nation", "supplier")
    inner = bgp(q, ("?u", NS + "s_nation", "?n"), ("?u", NS + "s_acctbal", "?b"))
    return optional(match(q, "?n", T.RDF_TYPE, NS + "nation"), inner, num("b") > 5000).df.select(lex("n"), lex("u"))


@query("SELECT c_name AS n, NULL::double AS b FROM customer WHERE c_acctbal < 0 UNION ALL SELECT NULL, s_acctbal FROM supplier")
def q10_union(spark, sf):
    q = mapped(spark, sf, "customer", "supplier")
    a = bgp(q, ("?x", NS + "c_name", "?n"), ("?x", NS + "c_acctbal", "?a")).where(num("a") < 0).select("n")
    return union(a, match(q, "?y", NS + "s_acctbal", "?b").select("b")).df.select(lex("n"), num("b").alias("b"))


@query(f"SELECT {iri_sql('customer', 'c_custkey')} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q11_minus(spark, sf):
    q = mapped(spark, sf, "customer", "orders")
    return minus(match(q, "?c", T.RDF_TYPE, NS + "customer"), match(q, "?o", NS + "o_cust", "?c")).df.select(lex("c"))


@query("SELECT n_name AS n FROM nation")
def q12_minus_disjoint(spark, sf):
    q = mapped(spark, sf, "nation", "region")
    return minus(match(q, "?x", NS + "n_name", "?n"), match(q, "?y", NS + "r_name", "?m")).df.select(lex("n"))


@query(f"SELECT {iri_sql('customer', 'c_custkey')} AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q13_exists(spark, sf):
    q = mapped(spark, sf, "customer", "orders")
    big = bgp(q, ("?o", NS + "o_cust", "?c"), ("?o", NS + "o_totalprice", "?t")).where(num("t") > 300000)
    return exists(match(q, "?c", T.RDF_TYPE, NS + "customer"), big).df.select(lex("c"))


@query(f"SELECT {iri_sql('customer', 'c_custkey')} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q14_not_exists(spark, sf):
    q = mapped(spark, sf, "customer", "orders")
    big = bgp(q, ("?o", NS + "o_cust", "?c"), ("?o", NS + "o_totalprice", "?t")).where(num("t") > 300000)
    return exists(match(q, "?c", T.RDF_TYPE, NS + "customer"), big, negated=True).df.select(lex("c"))


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def q15_values(spark, sf):
    v = values(spark, ["seg"], [(T.literal("BUILDING"),), (T.literal("MACHINERY"),)])
    return join(match(mapped(spark, sf, "customer"), "?c", NS + "c_mktsegment", "?seg"), v).df.groupBy("seg").agg(F.count("*").alias("n")).select(lex("seg"), "n")


@query("SELECT c_mktsegment AS seg, tag, count(*) AS n FROM customer JOIN (VALUES ('BUILDING', 'b'), (NULL, 'all')) v(w, tag) ON w IS NULL OR w = c_mktsegment GROUP BY 1, 2")
def q16_values_undef(spark, sf):
    v = values(spark, ["seg", "tag"], [(T.literal("BUILDING"), T.literal("b")), (None, T.literal("all"))])
    return join(match(mapped(spark, sf, "customer"), "?c", NS + "c_mktsegment", "?seg"), v).df.groupBy("seg", "tag").agg(F.count("*").alias("n")).select(lex("seg"), lex("tag"), "n")


@query("SELECT c_name AS n, k FROM customer JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1 HAVING count(*) > 15) ON o_custkey = c_custkey")
def q17_sub_select(spark, sf):
    q = mapped(spark, sf, "customer", "orders")
    inner = match(q, "?o", NS + "o_cust", "?c").df.groupBy("c").agg(F.count("*").alias("k")).where("k > 15")
    return join(match(q, "?c", NS + "c_name", "?n"), Solutions(inner)).df.select(lex("n"), "k")


def by_segment(spark, sf, *more: str) -> DataFrame:
    """Customers in a graph for each market segment, other tables in the base graph."""
    c = table_quads(read(spark, sf, "customer"), "customer", F.concat(F.lit(NS + "graphs/segment/"), "c_mktsegment"))
    return c.unionByName(tables(spark, sf, *more)) if more else c


@query(f"SELECT '{NS}graphs/segment/' || c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1")
def q18_graph(spark, sf):
    s = match(by_segment(spark, sf, "nation"), "?c", T.RDF_TYPE, NS + "customer", g="?g")
    return s.df.groupBy("g").agg(F.count("*").alias("n")).select(lex("g"), "n")


@query("SELECT l_returnflag AS f, l_linestatus AS st, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10")
def q19_group_having(spark, sf):
    s = star(read(spark, sf, "lineitem"), "lineitem", f="l_returnflag", st="l_linestatus", q="l_quantity")
    return s.groupBy("f", "st").agg(F.count("*").alias("n"), F.round(F.sum("q"), 2).alias("q")).where("n > 10")


@query("SELECT c_nationkey AS k, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1")
def q20_count_distinct(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_nationkey", "?k"), ("?c", NS + "c_mktsegment", "?m"))
    return s.df.groupBy("k").agg(A.count(F.col("m"), distinct=True).alias("n")).select(num("k").cast("int").alias("k"), "n")


@query("SELECT c_mktsegment AS seg, round(avg(c_acctbal), 4) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
def q21_avg_min_max(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_mktsegment", "?seg"), ("?c", NS + "c_acctbal", "?b"))
    out = s.df.groupBy("seg").agg(A.average(F.col("b")).alias("a"), A.least(F.col("b")).alias("lo"), A.greatest(F.col("b")).alias("hi"))
    return out.select(lex("seg"), F.round(num("a"), 4).alias("a"), num("lo").alias("lo"), num("hi").alias("hi"))


@query("SELECT c_nationkey AS k, min(c_name) AS n FROM customer GROUP BY 1")
def q22_sample(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_nationkey", "?k"), ("?c", NS + "c_name", "?n"))
    return s.df.groupBy("k").agg(A.sample(F.col("n")).alias("n")).select(num("k").cast("int").alias("k"), lex("n"))


@query("SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def q23_group_concat(spark, sf):
    s = bgp(mapped(spark, sf, "nation", "region"), ("?x", NS + "n_region", "?y"), ("?y", NS + "r_name", "?r"), ("?x", NS + "n_name", "?n"))
    return s.df.groupBy("r").agg(A.group_concat(F.col("n"), "|").alias("names")).select(lex("r"), "names")


@query("SELECT 0::bigint AS n, 0::double AS s, 0::double AS a, '' AS c FROM (SELECT count(*) FROM customer)")
def q24_empty_group(spark, sf):
    s = match(mapped(spark, sf, "customer"), "?c", NS + "c_acctbal", "?b").where(num("b") > 1e12)
    return s.df.agg(F.count("*").alias("n"), T.number(A.total(F.col("b"))).alias("s"), T.number(A.average(F.col("b"))).alias("a"), A.group_concat(F.col("b")).alias("c"))


@query("SELECT c_custkey AS k, lower(c_name) AS lo, length(c_name) AS len, substring(c_name, 3, 4) AS sub, split_part(c_name, '#', 1) AS bef, CASE WHEN contains(c_name, '#') THEN substring(c_name, strpos(c_name, '#') + 1) ELSE '' END AS aft, starts_with(c_name, 'C') AS st FROM customer")
def q25_strings(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_custkey", "?k"), ("?c", NS + "c_name", "?n")).df
    n, mark = T.text(F.col("n")), F.lit("#")
    bef = F.when(F.contains(n, mark), T.before(n, mark)).otherwise(n)
    return s.select(num("k").cast("long").alias("k"), T.lower(F.col("n"))["lex"].alias("lo"), T.number(T.strlen(F.col("n"))).cast("long").alias("len"), T.substr(F.col("n"), 3, 4)["lex"].alias("sub"), bef.alias("bef"), T.after(n, mark).alias("aft"), T.starts(F.col("n"), T.literal("C")).alias("st"))


@query("SELECT p_partkey AS k, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r FROM part WHERE regexp_matches(lower(p_type), 'steel|brass')")
def q26_regex(spark, sf):
    s = bgp(mapped(spark, sf, "part"), ("?x", NS + "p_partkey", "?k"), ("?x", NS + "p_name", "?n"), ("?x", NS + "p_type", "?t"))
    s = s.where(T.regex(T.text(F.col("t")), "steel|brass", "i"))
    return s.df.select(num("k").cast("long").alias("k"), T.replace(T.text(F.col("n")), "[aeiou]", "*").alias("r"))


@query("SELECT year(ts)::int AS y, month(ts)::int AS m, hour(ts)::int AS h, count(*) AS n FROM events GROUP BY 1, 2, 3")
def q27_dates(spark, sf):
    t = match(table_quads(read(spark, sf, "events"), "events", columns=["ts"]), "?e", NS + "ts", "?t").df
    part = lambda p: T.date_part(F.col("t"), p)
    return t.groupBy(part("year").alias("y"), part("month").alias("m"), part("hours").alias("h")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS n, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
def q28_hashes(spark, sf):
    n = F.col("n")
    return match(mapped(spark, sf, "nation"), "?x", NS + "n_name", "?n").df.select(lex("n"), T.hashed(n, "md5")["lex"].alias("m"), T.hashed(n, "sha256")["lex"].alias("s"))


@query("SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS v, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'done' END, 'open') AS st FROM orders")
def q29_if_coalesce(spark, sf):
    s = bgp(mapped(spark, sf, "orders"), ("?o", NS + "o_orderkey", "?k"), ("?o", NS + "o_totalprice", "?t"), ("?o", NS + "o_orderstatus", "?u")).df
    done = T.if_(T.equal(F.col("u"), T.literal("F")), F.lit("done"), F.lit(None).cast("string"))
    return s.select(num("k").cast("long").alias("k"), T.if_(num("t") > 100000, F.lit("high"), F.lit("low")).alias("v"), F.coalesce(done, F.lit("open")).alias("st"))


@query("SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal)::bigint AS c, floor(c_acctbal)::bigint AS f, floor(c_acctbal + 0.5)::bigint AS r FROM customer")
def q30_numbers(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_custkey", "?k"), ("?c", NS + "c_acctbal", "?b")).df
    b = F.col("b")
    of = lambda f, name: T.number(f(b)).cast("long").alias(name)
    return s.select(num("k").cast("long").alias("k"), T.number(T.abs_(b)).alias("a"), of(T.ceil, "c"), of(T.floor, "f"), of(T.round_, "r"))


@query("SELECT count(*) * 2 AS iris, count(*) * 5 AS literals, count(*) * 3 AS numbers, 0::bigint AS blanks FROM customer")
def q31_term_tests(spark, sf):
    o = match(tables(spark, sf, "customer"), "?s", "?p", "?o").where(F.col("p")["lex"] != NS + "none").df
    n = lambda c: F.count(F.when(c, 1))
    return o.agg(n(T.is_blank(F.col("o"))).alias("blanks"), n(T.is_iri(F.col("o"))).alias("iris"), n(T.is_literal(F.col("o"))).alias("literals"), n(T.is_numeric(F.col("o"))).alias("numbers"))


@query("SELECT lang AS l, count(*) AS n FROM documents WHERE lang LIKE 'e%' GROUP BY 1")
def q32_lang(spark, sf):
    s = match(table_quads(read(spark, sf, "documents"), "documents", columns=["text"]), "?d", NS + "text", "?t").df
    tag = T.lang(F.col("t"))
    return s.where(T.lang_matches(tag, F.lit("en")) | T.lang_matches(tag, F.lit("es"))).groupBy(tag.alias("l")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS k, p_partkey::double AS d, floor(p_retailprice)::bigint AS i FROM part")
def q33_casts(spark, sf):
    s = bgp(mapped(spark, sf, "part"), ("?x", NS + "p_partkey", "?k"), ("?x", NS + "p_retailprice", "?p")).df
    return s.select(num("k").cast("long").alias("k"), T.number(T.call(T.XSD + "double", F.col("k"))).alias("d"), T.number(T.call(T.XSD + "integer", F.col("p"))).cast("long").alias("i"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def q34_sequence_inverse(spark, sf):
    q = tables(spark, sf, "nation")
    e = P.edge(q, NS + "n_region")
    same = Solutions(P.sequence(e, P.inverse(e)).select(F.col("s").alias("x"), F.col("o").alias("y")))
    return join(join(same, match(q, "?x", NS + "n_name", "?a")), match(q, "?y", NS + "n_name", "?b")).df.select(lex("a"), lex("b"))


@query("SELECT c_nationkey AS n, count(*) AS k FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def q35_alternative(spark, sf):
    q = tables(spark, sf, "customer", "supplier")
    e = P.alternative(P.edge(q, NS + "c_nation"), P.edge(q, NS + "s_nation"))
    return e.groupBy(F.regexp_extract(F.col("o")["lex"], "[0-9]+$", 0).cast("int").alias("n")).agg(F.count("*").alias("k"))


def turns(spark, sf) -> DataFrame:
    """Each turn of a conversation links to the next."""
    c = read(spark, sf, "conversations").select("conv_id", "turn")
    name = lambda t: T.iri(F.concat(F.lit(NS + "conversations/"), F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.join(nxt, ["conv_id", "turn"]).select(name(F.col("turn")).alias("s"), name(F.col("turn") + 1).alias("o"))


def turn_quads(spark, sf) -> DataFrame:
    null = F.lit(None).cast("string")
    kind = F.lit(T.IRI).cast("tinyint")
    return turns(spark, sf).select(F.lit(BASE_GRAPH).alias("g"), F.col("s")["lex"].alias("s"), kind.alias("s_kind"), F.lit(NS + "next").alias("p"), F.col("o")["lex"].alias("o"), kind.alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"), F.lit(None).cast("double").alias("o_num"))


TURNS = "WITH RECURSIVE e AS (SELECT a.conv_id AS c, a.turn AS s, b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r AS (SELECT c, s, o FROM e UNION SELECT r.c, r.s, e.o FROM r JOIN e ON r.c = e.c AND r.o = e.s), n AS (SELECT c, s AS t FROM e UNION SELECT c, o FROM e) "


@query(TURNS + f"SELECT '{NS}conversations/' || c || '/' || s AS s, '{NS}conversations/' || c || '/' || o AS o FROM r")
def q36_one_or_more(spark, sf):
    return P.one_or_more(turns(spark, sf)).select(lex("s"), lex("o"))


@query(TURNS + f"SELECT '{NS}conversations/' || c || '/' || s AS s, '{NS}conversations/' || c || '/' || o AS o FROM (SELECT * FROM r UNION SELECT c, t, t FROM n)")
def q37_zero_or_more(spark, sf):
    q = turn_quads(spark, sf)
    return P.zero_or_more(P.edge(q, NS + "next"), q).select(lex("s"), lex("o"))


@query(TURNS + f"SELECT '{NS}conversations/' || c || '/' || s AS s, '{NS}conversations/' || c || '/' || o AS o FROM (SELECT c, s, o FROM e UNION SELECT c, t, t FROM n)")
def q37b_zero_or_one(spark, sf):
    q = turn_quads(spark, sf)
    return P.zero_or_one(P.edge(q, NS + "next"), q).select(lex("s"), lex("o"))


@query("SELECT count(*) * 3 AS n FROM nation")
def q38_negated(spark, sf):
    return P.negated(tables(spark, sf, "nation"), T.RDF_TYPE, NS + "n_name").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey + 1) % (SELECT count(*) FROM nation) AS o FROM nation), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s::bigint AS s, o::bigint AS o FROM r")
def q39_cycle(spark, sf):
    n = read(spark, sf, "nation")
    size = n.agg(F.count("*").alias("size"))
    e = n.join(F.broadcast(size)).select(T.literal(F.col("n_nationkey")).alias("s"), T.literal((F.col("n_nationkey") + 1) % F.col("size")).alias("o"))
    key = lambda c: F.col(c)["lex"].cast("long").alias(c)
    return P.one_or_more(e).select(key("s"), key("o"))


@query("WITH RECURSIVE e AS (SELECT a.conv_id AS c, a.turn AS s, b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), f AS (SELECT conv_id AS c, min(turn) AS t FROM conversations GROUP BY conv_id), r AS (SELECT e.c, s, o FROM e JOIN f ON e.c = f.c AND s = t UNION SELECT r.c, r.s, e.o FROM r JOIN e ON r.c = e.c AND r.o = e.s) SELECT r.c AS c, r.o AS t, 'after' AS what FROM r UNION ALL SELECT e.c, e.s, 'before' FROM e JOIN conversations v ON v.conv_id = e.c AND v.turn = e.o WHERE v.turn = (SELECT min(turn) + 1 FROM conversations m WHERE m.conv_id = e.c)")
def q107_reach_from_bound_ends(spark, sf):
    """What follows each conversation's first turn, and what goes before its second: searches that start at bound ends."""
    c = read(spark, sf, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("t"))
    name = lambda t: T.iri(F.concat(F.lit(NS + "conversations/"), F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string")))).alias("n")
    edges = cut(turns(spark, sf))
    after = P.reach(edges, first.select(name(F.col("t"))))
    before = P.inverse(P.reach(P.inverse(edges), first.select(name(F.col("t") + 1))))
    part = lambda x, i: F.split(F.col(x)["lex"], "/")[i].cast("long")
    shown = lambda df, x, what: df.select(part(x, 4).alias("c"), part(x, 5).alias("t"), F.lit(what).alias("what"))
    return shown(after, "o", "after").unionByName(shown(before, "s", "before"))


def segments() -> list:
    return [acl.Group("segment", (acl.GraphSpec(NS + "graphs/segment/"),)), acl.Group("shared", (acl.GraphSpec(BASE_GRAPH),), usage=frozenset({acl.READ}))]


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY 1")
def q40_segment_graphs(spark, sf):
    graphs = acl.readable_graphs(segments(), [("segment", ("BUILDING",)), ("segment", ("FURNITURE",))])
    view = acl.read_view(by_segment(spark, sf), graphs)
    return match(view, "?c", NS + "c_mktsegment", "?seg").df.groupBy("seg").agg(F.count("*").alias("n")).select(lex("seg"), "n")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def q41_merged_once(spark, sf):
    q = by_segment(spark, sf)
    q = q.unionByName(q.where(F.col("g") == NS + "graphs/segment/BUILDING").withColumn("g", F.lit(BASE_GRAPH)))
    view = acl.read_view(q, acl.readable_graphs(segments(), [("segment", ("BUILDING",)), ("shared", ())]))
    return match(view, "?c", T.RDF_TYPE, NS + "customer").df.agg(F.count("*").alias("n"))


@query("SELECT 0::bigint AS n, count(*) * 7 AS stored FROM customer")
def q42_no_groups(spark, sf):
    """Without groups, and with sudo."""
    q = by_segment(spark, sf)
    count = lambda graphs, name: match(acl.read_view(q, graphs), "?s", "?p", "?o").df.agg(F.count("*").alias(name))
    return count(acl.readable_graphs(segments(), []), "n").join(F.broadcast(count(None, "stored")))  # a row each


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def q43_graph_stripped(spark, sf):
    """GRAPH <another segment> in the query of a caller who may read one segment: the clause does not count."""
    view = acl.read_view(by_segment(spark, sf), acl.readable_graphs(segments(), [("segment", ("BUILDING",))]))
    s = match(view, "?c", NS + "c_mktsegment", "?seg", g=NS + "graphs/segment/MACHINERY")
    return s.df.groupBy("seg").agg(F.count("*").alias("n")).select(lex("seg"), "n")


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey = 3 AND c_mktsegment = (SELECT min(c_mktsegment) FROM customer WHERE c_nationkey = 3)")
def q44_access_by_query(spark, sf):
    q = by_segment(spark, sf)

    def of(session: str | None) -> DataFrame:
        s = join(match(q, "?c", NS + "c_nation", session or NS + "none"), match(q, "?c", NS + "c_mktsegment", "?m")).df
        return s.groupBy().agg(F.min(F.col("m")["lex"]).alias("m"))

    specs = [acl.Group("segment", (acl.GraphSpec(NS + "graphs/segment/"),), access=of)]
    view = acl.read_view(q, acl.readable_graphs(specs, acl.allowed_groups(specs, NS + "nation/3")))
    return match(view, "?c", NS + "c_nation", NS + "nation/3").df.agg(F.count("*").alias("n"))


@query("SELECT count(*) * 3 + (SELECT count(*) FROM nation) AS n, count(*) AS regions FROM region")
def q45_insert_data(spark, sf):
    old = tables(spark, sf, "region")
    new = table_quads(read(spark, sf, "nation"), "nation", columns=[])
    after = U.commit(old, U.fold(U.data(new.unionByName(new), "insert", 0).unionByName(U.data(old, "insert", 1))))
    return after.agg(F.count("*").alias("n"), F.count(F.when(F.col("o") == NS + "region", 1)).alias("regions"))


@query("SELECT count(*) AS left_, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS gone FROM customer WHERE c_acctbal >= 0")
def q46_delete_where(spark, sf):
    q = table_quads(read(spark, sf, "customer"), "customer", columns=["c_acctbal"])
    s = match(q, "?c", NS + "c_acctbal", "?b").where(num("b") < 0)
    changes = U.instantiate(s, [(BASE_GRAPH, "?c", NS + "c_acctbal", "?b")], "delete", 0)
    after = U.commit(q, U.fold(changes)).where(F.col("p") == NS + "c_acctbal").agg(F.count("*").alias("left_"))
    return after.join(F.broadcast(changes.agg(F.count("*").alias("gone"))))


@query("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS st FROM orders")
def q47_modify(spark, sf):
    q = table_quads(read(spark, sf, "orders"), "orders", columns=["o_orderkey", "o_orderstatus"])
    s = match(q, "?o", NS + "o_orderstatus", T.literal("F"))
    p = NS + "o_orderstatus"
    after = U.commit(q, U.fold(U.modify(s, [(BASE_GRAPH, "?o", p, T.literal("F"))], [(BASE_GRAPH, "?o", p, T.literal("finished"))])))
    return join(match(after, "?o", NS + "o_orderkey", "?k"), match(after, "?o", p, "?st")).df.select(num("k").cast("long").alias("k"), lex("st"))


def two_types(spark, sf) -> DataFrame:
    return U.data(tables(spark, sf, "customer", "supplier", "nation"), "insert", 0)


def routed(spark, sf, specs: list, allowed: list) -> DataFrame:
    changes = two_types(spark, sf)
    nothing = changes.select(*U.COLUMNS).where(F.lit(False))
    return acl.route(changes, nothing, specs, allowed)


def per_graph(df: DataFrame) -> DataFrame:
    return df.groupBy("g").agg(F.count("*").alias("n"))


@query(f"SELECT '{acl.APPLICATION_GRAPH}' AS g, (SELECT count(*) FROM customer) * 7 + (SELECT count(*) FROM supplier) * 6 + (SELECT count(*) FROM nation) * 5 AS n UNION ALL SELECT '{NS}graphs/people', (SELECT count(*) FROM customer) * 7 + (SELECT count(*) FROM supplier) * 6")
def q48_route_by_type(spark, sf):
    specs = [acl.Group("people", (acl.GraphSpec(NS + "graphs/people", acl.ByType((NS + "customer", NS + "supplier"))),))]
    return per_graph(routed(spark, sf, specs, [("people", ())]))


@query(f"SELECT '{NS}graphs/s1' AS g, count(*) * 6 AS n FROM supplier WHERE s_suppkey::varchar LIKE '1%'")
def q49_route_by_prefix(spark, sf):
    specs = [acl.Group("one", (acl.GraphSpec(NS + "graphs/s1", acl.ByPrefix(NS + "supplier/1")),)), acl.Cleanup("clean")]
    return per_graph(routed(spark, sf, specs, [("one", ()), ("clean", ())]))


@query(f"SELECT '{NS}graphs/public' AS g, count(*) * 6 AS n FROM customer UNION ALL SELECT '{NS}graphs/names', count(*) FROM customer")
def q50_route_predicates(spark, sf):
    kind = (NS + "customer",)
    specs = [acl.Group("p", (acl.GraphSpec(NS + "graphs/public", acl.ByType(kind, predicates=acl.all_except(NS + "c_acctbal"))), acl.GraphSpec(NS + "graphs/names", acl.ByType(kind, predicates=acl.none_except(NS + "c_name"))))), acl.Cleanup("clean")]
    return per_graph(routed(spark, sf, specs, [("p", ()), ("clean", ())]))


@query(f"SELECT '{NS}graphs/links' AS g, (SELECT count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)) AS n")
def q51_route_inverse(spark, sf):
    rule = acl.ByType((NS + "nation",), predicates=acl.none_except(), inverse=acl.none_except(NS + "c_nation"))
    return per_graph(routed(spark, sf, [acl.Group("l", (acl.GraphSpec(NS + "graphs/links", rule),)), acl.Cleanup("clean")], [("l", ()), ("clean", ())]))


@query(f"SELECT true AS cleaned, 0::bigint AS n UNION ALL SELECT false, (SELECT count(*) FROM customer) * 7 + (SELECT count(*) FROM supplier) * 6 + (SELECT count(*) FROM nation) * 5")
def q52_cleanup(spark, sf):
    specs = [acl.Group("people", (acl.GraphSpec(NS + "graphs/people", acl.ByType((NS + "customer",))),)), acl.Cleanup("clean")]
    left = lambda allowed, c: routed(spark, sf, specs, allowed).agg(F.lit(c).alias("cleaned"), F.count(F.when(F.col("g") == acl.APPLICATION_GRAPH, 1)).alias("n"))
    return left([("people", ()), ("clean", ())], True).unionByName(left([("people", ())], False))


@query("SELECT 'snapshot' AS mode, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'sequential', count(*) FROM orders WHERE o_orderstatus IN ('O', 'F')")
def q53_snapshot(spark, sf):
    q = table_quads(read(spark, sf, "orders"), "orders", columns=["o_orderstatus"])
    p = NS + "o_orderstatus"

    def step(a: str, b: str, seq: int):
        return lambda state: U.modify(match(state, "?o", p, T.literal(a)), [(BASE_GRAPH, "?o", p, T.literal(a))], [(BASE_GRAPH, "?o", p, T.literal(b))], seq)

    steps = [step("F", "O", 0), step("O", "X", 2)]
    count = lambda state, mode: match(state, "?o", p, T.literal("X")).df.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
    one = U.commit(q, U.fold(steps[0](q).unionByName(steps[1](q))))
    return count(one, "snapshot").unionByName(count(U.sequential(q, steps), "sequential"))


@query("SELECT user_id AS u, CASE arg_max(event_type, event_id) WHEN 'signup' THEN 'insert' ELSE 'delete' END AS op FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1")
def q54_last_op_wins(spark, sf):
    e = read(spark, sf, "events").where(F.col("event_type").isin("signup", "error"))
    null = F.lit(None).cast("string")
    iri = F.lit(T.IRI).cast("tinyint")
    changes = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "insert").otherwise("delete").alias("op"), F.lit(BASE_GRAPH).alias("g"), F.col("user_id").cast("string").alias("s"), iri.alias("s_kind"), F.lit(T.RDF_TYPE).alias("p"), F.lit(NS + "member").alias("o"), iri.alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"), F.lit(None).cast("double").alias("o_num"))
    return U.fold(changes).select(F.col("s").cast("long").alias("u"), "op")


@query("SELECT count(*) * 7 AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q55_add_graph(spark, sf):
    q = by_segment(spark, sf)
    a, b = (NS + "graphs/segment/" + x for x in ("BUILDING", "MACHINERY"))
    return U.commit(q, U.fold(U.add_graph(q, a, b))).where(F.col("g") == b).agg(F.count("*").alias("n"))


@query("SELECT op, count(*) AS n FROM supplier CROSS JOIN (VALUES ('delete'), ('insert')) v(op) WHERE s_acctbal < 0 GROUP BY op")
def q56_delta_rows(spark, sf):
    q = table_quads(read(spark, sf, "supplier"), "supplier", columns=["s_acctbal"])
    s = match(q, "?x", NS + "s_acctbal", "?b").where(num("b") < 0)
    changes = U.modify(s, [(BASE_GRAPH, "?x", NS + "s_acctbal", "?b")], [(BASE_GRAPH, "?x", NS + "s_acctbal", T.literal(0))])
    return change_rows(changes, "call-1").groupBy("op").agg(F.count("*").alias("n"))


@query("SELECT count(*) * 4 AS n FROM nation")
def q56b_change_sets(spark, sf):
    q = table_quads(read(spark, sf, "nation"), "nation", columns=["n_name", "n_regionkey"])
    bodies = change_sets(change_rows(U.data(q, "insert", 0), "call-1"), size=20)
    return bodies.agg(F.sum(F.regexp_count("body", F.lit('"graph":'))).cast("long").alias("n"))


@query("SELECT c_mktsegment AS seg, count(*) AS n, 1 AS graphs FROM customer GROUP BY 1")
def q57_pruning(spark, sf):
    """The same rows as without pruning; the pruned pattern scans the customers' graph only."""
    rules = [(NS + "graphs/people", acl.ByType((NS + "customer",))), (BASE_GRAPH, acl.ByType((NS + "nation", NS + "region")))]
    model = [Class(NS + "customer", (NS + "c_mktsegment", NS + "c_name")), Class(NS + "nation", (NS + "n_name",))]
    q = table_quads(read(spark, sf, "customer"), "customer", NS + "graphs/people").unionByName(tables(spark, sf, "nation", "region"))
    graphs = graphs_for(rules, subject_types(model, [NS + "c_mktsegment"]), NS + "c_mktsegment")
    view = acl.read_view(q, graphs)
    return match(view, "?c", NS + "c_mktsegment", "?seg").df.groupBy("seg").agg(F.count("*").alias("n")).select(lex("seg"), "n", F.lit(len(graphs)).alias("graphs"))


@query("SELECT c_custkey AS k, c_name AS n FROM customer ORDER BY c_name LIMIT 50 OFFSET 25")
def q06b_offset_customers(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_custkey", "?k"), ("?c", NS + "c_name", "?n")).df
    return s.orderBy(T.sort_key(F.col("n"))).offset(25).limit(50).select(num("k").cast("long").alias("k"), lex("n"))


@query(f"SELECT {iri_sql('orders', 'o_orderkey')} AS s, '{NS}by' AS p, {iri_sql('customer', 'o_custkey')} AS o FROM orders UNION SELECT {iri_sql('customer', 'o_custkey')}, '{NS}made', {iri_sql('orders', 'o_orderkey')} FROM orders")
def q08b_construct_orders(spark, sf):
    s = match(mapped(spark, sf, "orders"), "?o", NS + "o_cust", "?c")
    return construct(s, ("?o", T.iri(NS + "by"), "?c"), ("?c", T.iri(NS + "made"), "?o")).select(lex("s"), lex("p"), lex("o"))


@query(f"SELECT {iri_sql('customer', 'c_custkey')} AS c FROM customer WHERE c_acctbal >= 0 OR c_mktsegment <> 'BUILDING'")
def q12b_minus_two_variables(spark, sf):
    q = mapped(spark, sf, "customer")
    b = bgp(q, ("?c", NS + "c_mktsegment", T.literal("BUILDING")), ("?c", NS + "c_acctbal", "?b")).where(num("b") < 0)
    return minus(match(q, "?c", NS + "c_acctbal", "?b"), b).df.select(lex("c"))


@query("SELECT c_nationkey AS k, string_agg(c_name, '|' ORDER BY c_name) AS names, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def q23b_group_concat_customers(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_nationkey", "?k"), ("?c", NS + "c_name", "?n"), ("?c", NS + "c_mktsegment", "?m"))
    out = s.df.groupBy("k").agg(A.group_concat(F.col("n"), "|").alias("names"), A.group_concat(F.col("m"), "|", distinct=True).alias("segments"))
    return out.select(num("k").cast("int").alias("k"), "names", "segments")


@query("SELECT c_custkey AS k, sha1(c_name) AS a, sha256(c_name) AS b FROM customer")
def q28b_hashes_customers(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_custkey", "?k"), ("?c", NS + "c_name", "?n")).df
    return s.select(num("k").cast("long").alias("k"), T.hashed(F.col("n"), "sha1")["lex"].alias("a"), T.hashed(F.col("n"), "sha256")["lex"].alias("b"))


@query("SELECT n_name AS a, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def q34b_sequence_orders(spark, sf):
    """o_cust / c_nation / n_name."""
    q = mapped(spark, sf, "orders", "customer", "nation")
    walk = P.sequence(*(P.edge(q.quads(NS + p), NS + p) for p in ("o_cust", "c_nation", "n_name")))
    return walk.groupBy(F.col("o")["lex"].alias("a")).agg(F.count("*").alias("n"))


@query("SELECT count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) AS n, count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) AS back FROM orders")
def q38b_negated_orders(spark, sf):
    """!(a | o_cust), and its inverse !^(a | o_cust | o_orderkey), over all columns of the orders."""
    q = table_quads(read(spark, sf, "orders"), "orders", columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    forward = P.negated(q, T.RDF_TYPE, NS + "o_cust").agg(F.count("*").alias("n"))
    back = P.negated(q, inverse_predicates=(T.RDF_TYPE, NS + "o_cust", NS + "o_orderkey")).agg(F.count("*").alias("back"))
    return forward.join(F.broadcast(back))  # a row each


RINGS = "WITH RECURSIVE c AS (SELECT a.conv_id AS c, a.turn AS s, b.turn AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 UNION SELECT conv_id, max(turn), min(turn) FROM conversations GROUP BY conv_id), r AS (SELECT c, s, o FROM c UNION SELECT r.c, r.s, c.o FROM r JOIN c ON r.c = c.c AND r.o = c.s) "


@query(RINGS + "SELECT c, s::bigint AS s, o::bigint AS o FROM r")
def q39b_cycle_conversations(spark, sf):
    """The last turn of each conversation links to its first one, so that all turns reach all."""
    t = read(spark, sf, "conversations").select("conv_id", "turn")
    first = t.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("top"))
    step = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("o")), ["conv_id", "turn"])
    name = lambda c, n: T.iri(F.concat_ws("/", F.col(c).cast("string"), F.col(n).cast("string")))
    e = step.select(name("conv_id", "turn").alias("s"), name("conv_id", "o").alias("o")).unionByName(first.select(name("conv_id", "top").alias("s"), name("conv_id", "low").alias("o")))
    part = lambda c, i: F.split(F.col(c)["lex"], "/")[i].cast("long")
    return P.one_or_more(e).select(part("s", 0).alias("c"), part("s", 1).alias("s"), part("o", 1).alias("o"))


@query("SELECT count(*) * 7 + (SELECT count(*) FROM orders) AS n, count(*) AS customers FROM customer")
def q45b_insert_orders(spark, sf):
    old = tables(spark, sf, "customer")
    new = table_quads(read(spark, sf, "orders"), "orders", columns=[])
    after = U.commit(old, U.fold(U.data(new.unionByName(new), "insert", 0).unionByName(U.data(old, "insert", 1))))
    return after.agg(F.count("*").alias("n"), F.count(F.when(F.col("o") == NS + "customer", 1)).alias("customers"))


@query("SELECT count(*) * 7 - (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS n FROM customer")
def q46b_delete_data(spark, sf):
    q = tables(spark, sf, "customer")
    gone = q.where((F.col("p") == NS + "c_mktsegment") & (F.col("o") == "BUILDING"))
    return U.commit(q, U.fold(U.data(gone, "delete", 0))).agg(F.count("*").alias("n"))


@query("SELECT count(*) * 3 AS n, count(*) * 3 AS known FROM orders")
def q56c_change_sets_orders(spark, sf):
    """JSON messages of the orders' changes; their objects decode to the terms that were encoded."""
    q = table_quads(read(spark, sf, "orders"), "orders", columns=["o_orderkey", "o_orderstatus"])
    rows = cut(change_rows(U.data(q, "insert", 0), "call-1"))  # read three times
    bodies = change_sets(rows, size=500).agg(F.sum(F.regexp_count("body", F.lit('"graph":'))).cast("long").alias("n"))
    o = F.struct(F.col("o_kind").alias("kind"), F.col("o").alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    back = decoded(F.to_json(encoded(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))))
    return bodies.join(F.broadcast(rows.agg(F.count(F.when(back.eqNullSafe(o), 1)).alias("known"))))  # a row each


@query("SELECT c_custkey AS k, c_mktsegment IN ('BUILDING', 'MACHINERY') AS a, c_nationkey NOT IN (1, 2, 3) AS b FROM customer")
def q58_in(spark, sf):
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_custkey", "?k"), ("?c", NS + "c_mktsegment", "?m"), ("?c", NS + "c_nationkey", "?n")).df
    a = T.in_(F.col("m"), T.literal("BUILDING"), T.literal("MACHINERY"), T.literal(5))
    return s.select(num("k").cast("long").alias("k"), a.alias("a"), (~T.in_(F.col("n"), T.literal(1), T.literal(2.0), T.literal("3", T.XSD + "decimal"))).alias("b"))


@query("SELECT o_orderkey AS k, (o_orderkey::hugeint * 9007199254740993 + 1)::varchar AS big, o_orderkey::hugeint * 9007199254740993 = o_orderkey::hugeint * 9007199254740993 + 1 AS same FROM orders")
def q59_exact_integers(spark, sf):
    s = match(mapped(spark, sf, "orders"), "?o", NS + "o_orderkey", "?k").df
    # a step at a time: a term that an expression uses is a column by then
    s = s.withColumn("product", T.arithmetic("*", F.col("k"), T.literal("9007199254740993", T.XSD + "integer")))
    s = s.withColumn("more", T.arithmetic("+", F.col("product"), T.literal(1)))
    return s.select(num("k").cast("long").alias("k"), F.col("more")["lex"].alias("big"), T.equal(F.col("product"), F.col("more")).alias("same"))


@query("SELECT p_partkey AS k, rtrim(rtrim((p_size::decimal(18, 1) * 0.1::decimal(18, 1) + 0.2::decimal(18, 1))::varchar, '0'), '.') AS v, rtrim(rtrim((p_size::decimal(18, 2) / 4)::decimal(18, 4)::varchar, '0'), '.') AS q, (-p_size)::varchar AS neg FROM part")
def q60_exact_decimals(spark, sf):
    s = bgp(mapped(spark, sf, "part"), ("?x", NS + "p_partkey", "?k"), ("?x", NS + "p_size", "?z")).df
    decimal = lambda x: T.literal(x, T.XSD + "decimal")
    s = s.withColumn("tenth", T.arithmetic("*", F.col("z"), decimal("0.1")))
    v = T.arithmetic("+", F.col("tenth"), decimal("0.2"))
    return s.select(num("k").cast("long").alias("k"), v["lex"].alias("v"), T.arithmetic("/", F.col("z"), T.literal(4))["lex"].alias("q"), T.negative(F.col("z"))["lex"].alias("neg"))


@query("SELECT c_nationkey AS k, sum(c_custkey)::varchar AS s, sum(DISTINCT length(c_mktsegment))::varchar AS d, round(avg(c_custkey), 4) AS a, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1")
def q61_typed_aggregates(spark, sf):
    """Sums are terms: they go into the next expression as they are."""
    s = bgp(mapped(spark, sf, "customer"), ("?c", NS + "c_nationkey", "?k"), ("?c", NS + "c_custkey", "?x"), ("?c", NS + "c_mktsegment", "?m"))
    out = spread(s.df, "x").groupBy("k").agg(A.total(F.col("x")).alias("s"), A.total(T.strlen(F.col("m")), distinct=True).alias("d"), A.average(F.col("x"), distinct=True).alias("a"), A.count_solutions("m", distinct=True).alias("n"))
    zero = T.arithmetic("+", F.col("s"), T.literal(0))
    return out.select(num("k").cast("int").alias("k"), zero["lex"].alias("s"), lex("d"), F.round(num("a"), 4).alias("a"), "n")


@query(f"SELECT doc_id AS k, lang AS tag, upper(lang) AS up, '{T.LANG_STRING}' AS dt, true AS same, true AS tagged FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def q62_tags_and_types(spark, sf):
    """STRLANG, STRDT, DATATYPE, sameTerm, BOUND, and tags that functions keep."""
    s = bgp(mapped(spark, sf, "documents"), ("?d", NS + "doc_id", "?k"), ("?d", NS + "lang", "?l"), ("?d", NS + "text", "?t")).df
    made = T.strlang(F.col("l"), F.col("l"))
    typed = T.strdt(T.literal("1"), T.XSD + "integer")
    same = T.same_term(T.literal(1), typed) & F.col("t").isNotNull()
    tagged = T.lang_matches(T.lang(T.upper(made)), F.lower(F.col("t")["lang"]))
    return s.select(num("k").cast("long").alias("k"), T.lang(F.col("t")).alias("tag"), T.upper(made)["lex"].alias("up"), T.datatype(F.col("t"))["lex"].alias("dt"), same.alias("same"), tagged.alias("tagged"))


@query("SELECT count(*) AS n, count(*) AS blanks, count(*) AS uuids, 1 AS times, count(*) AS chances FROM customer")
def q63_fresh_terms(spark, sf):
    """BNODE, UUID, STRUUID, NOW, RAND: each customer's own, but the time."""
    s = match(mapped(spark, sf, "customer"), "?c", T.RDF_TYPE, NS + "customer").df
    s = s.select(T.bnode().alias("b"), T.uuid().alias("u"), T.struuid().alias("v"), T.now().alias("t"), T.rand().alias("r"))
    inside = (num("r") >= 0) & (num("r") < 1)
    return s.agg(F.count("*").alias("n"), F.count_distinct(F.when(T.is_blank(F.col("b")), F.col("b")["lex"])).alias("blanks"), F.count_distinct(F.when(T.is_iri(F.col("u")) & F.col("u")["lex"].startswith("urn:uuid:"), F.col("u")["lex"])).alias("uuids"), F.count_distinct("t").cast("int").alias("times"), F.count(F.when(inside, 1)).alias("chances"))


@query(f"SELECT {iri_sql('customer', 'c_custkey')} AS c, c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS marked FROM customer")
def q64_exists_in_expression(spark, sf):
    q = mapped(spark, sf, "customer", "orders")
    big = bgp(q, ("?o", NS + "o_cust", "?c"), ("?o", NS + "o_totalprice", "?t")).where(num("t") > 300000)
    s = with_exists(match(q, "?c", NS + "c_acctbal", "?b"), big.select("c"), "big").df
    return s.select(lex("c"), ((num("b") < 0) | F.col("big")).alias("marked"))


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal >= 0 OR c_nationkey IN (SELECT s_nationkey FROM supplier)")
def q65_exists_unbound(spark, sf):
    """The nation is bound for customers in debt only; for others, any supplier's nation will do."""
    q = mapped(spark, sf, "customer", "supplier")
    debt = bgp(q, ("?c", NS + "c_acctbal", "?b"), ("?c", NS + "c_nation", "?na")).where(num("b") < 0).select("c", "na")
    s = optional(match(q, "?c", T.RDF_TYPE, NS + "customer"), debt)
    return exists(s, match(q, "?x", NS + "s_nation", "?na").select("na")).df.agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def q66_from_named(spark, sf):
    """FROM NAMED two segments: GRAPH ?g sees these only; the default graph is empty."""
    graphs = [NS + "graphs/segment/" + x for x in ("BUILDING", "MACHINERY")]
    default, named = acl.dataset(by_segment(spark, sf), named=graphs)
    s = union(match(named, "?c", NS + "c_mktsegment", "?seg", g="?g").select("seg"), match(default, "?c", NS + "c_mktsegment", "?seg").select("seg"))
    return s.df.groupBy("seg").agg(F.count("*").alias("n")).select(lex("seg"), "n")


@query("SELECT o_orderkey AS k, o_custkey AS a, o_orderstatus AS b FROM orders")
def q67_collection(spark, sf):
    """Each order has a list of two items, its customer and its status, kept in cells of blank nodes."""
    o = read(spark, sf, "orders")
    null, key = F.lit(None).cast("string"), F.col("o_orderkey").cast("string")
    cell = lambda i: F.concat(F.lit(f"c{i}-"), key)

    def entry(s, s_kind, p, x, kind, dt=None):
        return F.struct(s.alias("s"), F.lit(s_kind).cast("tinyint").alias("s_kind"), F.lit(p).alias("p"), x.alias("o"), F.lit(kind).cast("tinyint").alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"))

    rows = [entry(F.concat(F.lit(NS + "orders/"), key), T.IRI, NS + "list", cell(1), T.BNODE), entry(cell(1), T.BNODE, T.RDF_NS + "first", F.col("o_custkey").cast("string"), T.LITERAL, T.XSD + "integer"), entry(cell(1), T.BNODE, T.RDF_NS + "rest", cell(2), T.BNODE), entry(cell(2), T.BNODE, T.RDF_NS + "first", F.col("o_orderstatus"), T.LITERAL, T.XSD + "string"), entry(cell(2), T.BNODE, T.RDF_NS + "rest", F.lit(T.RDF_NS + "nil"), T.IRI)]
    q = o.select(F.inline(F.array(*rows))).select(F.lit(BASE_GRAPH).alias("g"), "*", null.alias("o_lang"))
    s = join(match(q, "?o", NS + "list", "?l"), collection(q, "?l", "?a", "?b"))
    return s.df.select(F.regexp_extract(F.col("o")["lex"], "[0-9]+$", 0).cast("long").alias("k"), num("a").cast("long").alias("a"), lex("b"))


@query("SELECT 'written' AS what, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0) AS n UNION ALL SELECT 'left', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0) UNION ALL SELECT 'denied', 0")
def q68_update_by_groups(spark, sf):
    """A caller of one segment flags customers in debt: WHERE sees that segment alone, and the flag goes to the segment's graph."""
    groups = [acl.Group("segment", (acl.GraphSpec(NS + "graphs/segment/", acl.ByType((NS + "customer",))),)), acl.Cleanup("clean")]
    debt = lambda view: match(view, "?c", NS + "c_acctbal", "?b").where(num("b") < 0)
    allowed = [("segment", ("BUILDING",)), ("clean", ())]
    flag = (acl.APPLICATION_GRAPH, "?c", NS + "debt", T.literal(True))
    after, routed_, denied = U.update(by_segment(spark, sf), groups, allowed, debt, [], [flag])
    here = (F.col("g") == NS + "graphs/segment/BUILDING") & (F.col("p") == NS + "debt")
    n = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n(routed_.where(here), "written").unionByName(n(after.where(here), "left")).unionByName(n(denied, "denied"))


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def q69_graphs_as_table(spark, sf):
    """The graphs that a session may read stay a table, joined with the quads."""
    q = by_segment(spark, sf)
    of = lambda session: bgp(q, ("?c", NS + "c_nation", session or NS + "none"), ("?c", NS + "c_mktsegment", "?m")).df.select(F.col("m")["lex"].alias("m")).distinct()
    view = acl.read_view(q, acl.graph_names(spark, [acl.Group("segment", (acl.GraphSpec(NS + "graphs/segment/"),), access=of)], NS + "nation/3"))
    return match(view, "?c", NS + "c_mktsegment", "?seg").df.groupBy("seg").agg(F.count("*").alias("n")).select(lex("seg"), "n")


@query("SELECT o_orderkey AS k, encode AS e, c AS c, cast_ AS d FROM (SELECT o_orderkey, replace(o_orderstatus || ' /' || o_orderkey, ' ', '%20') AS x, replace(replace(o_orderstatus || ' /' || o_orderkey, ' ', '%20'), '/', '%2F') AS encode, o_orderstatus || '-' || o_orderkey AS c, o_orderkey::double AS cast_ FROM orders)")
def q70_concat_encode(spark, sf):
    s = bgp(mapped(spark, sf, "orders"), ("?o", NS + "o_orderkey", "?k"), ("?o", NS + "o_orderstatus", "?u")).df
    key = T.cast(F.col("k"), "string")
    both = lambda mark: T.concat(F.col("u"), T.literal(mark), key)
    return s.select(num("k").cast("long").alias("k"), T.encode_for_uri(T.text(both(" /"))).alias("e"), T.text(both("-")).alias("c"), T.number(T.cast(key, "double")).alias("d"))


@query("SELECT n_name AS n, r_name AS r FROM nation CROSS JOIN region")
def q71_product(spark, sf):
    """Patterns without a shared variable; here of fixed size. EBV: FILTER(?n) keeps what is no empty text."""
    q = mapped(spark, sf, "nation", "region")
    return bgp(q, ("?x", NS + "n_name", "?n"), ("?y", NS + "r_name", "?r")).where(F.col("n")).df.select(lex("n"), lex("r"))


def in_a_store(spark, quads: DataFrame, work: Callable[[Store], DataFrame]) -> DataFrame:
    """What work makes of a store of these quads; the store is deleted once that is written."""
    store = Store(spark, fresh(spark, "store"), slots=2, buckets=8)
    store.create(quads)
    out = released(spark, lambda: work(store))
    delete(spark, store.folder)
    return out


def set_source(store: Store, at_least: int, source: str, how: str) -> int:
    """Gives documents of at least so many characters a source, in one update of the store."""
    p = NS + "source"
    s = bgp(store.read(), ("?d", NS + "n_chars", "?n"), ("?d", p, "?s")).where(num("n") >= at_least)
    return store.commit(U.fold(U.modify(s, [(BASE_GRAPH, "?d", p, "?s")], [(BASE_GRAPH, "?d", p, T.literal(source))])), how)


def sources(store: Store, version: int, step: str) -> DataFrame:
    s = match(store.read(version), "?d", NS + "source", "?s").df
    return s.groupBy("s").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), lex("s"), "n")


def document_quads(spark, sf, *columns: str) -> DataFrame:
    return table_quads(read(spark, sf, "documents"), "documents", columns=[*columns])


@query("SELECT 'old' AS step, source AS s, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 2 UNION ALL SELECT 'new', CASE WHEN n_chars >= 5000 THEN 'long' ELSE source END, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2")
def q100_store_versions(spark, sf):
    """An update of stored quads writes the parts that it touches; the version before stays as it was."""

    def work(store: Store) -> DataFrame:
        new = set_source(store, 5000, "long", "rewrite")
        return sources(store, 0, "old").unionByName(sources(store, new, "new"))

    return in_a_store(spark, document_quads(spark, sf, "source", "n_chars"), work)


STEPS = "CASE WHEN n_chars >= 9000 THEN 'c' WHEN n_chars >= 3000 THEN 'b' WHEN n_chars >= 1000 THEN 'a' ELSE source END"


@query(f"SELECT step, {STEPS} AS s, count(*) AS n FROM documents CROSS JOIN (VALUES ('folded'), ('compacted')) v(step) WHERE source IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'first', CASE WHEN n_chars >= 1000 THEN 'a' ELSE source END, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2")
def q101_merge_on_read(spark, sf):
    """Three updates that only add their changes; a read folds them over the store, and so does a version that is written whole again."""

    def work(store: Store) -> DataFrame:
        first, _, last = [set_source(store, n, s, "append") for n, s in ((1000, "a"), (3000, "b"), (9000, "c"))]
        return reduce(DataFrame.unionByName, [sources(store, first, "first"), sources(store, last, "folded"), sources(store, store.compact(0), "compacted")])

    return in_a_store(spark, document_quads(spark, sf, "source", "n_chars"), work)


MARKED = f"(SELECT 'texts' AS k, count(*) AS n FROM documents WHERE n_chars >= 5000 UNION ALL SELECT 'marks', count(*) FROM labels WHERE toxic = 1)"


@query(f"SELECT what, '{NS}graphs/' || k AS g, n FROM {MARKED} CROSS JOIN (VALUES ('routed'), ('stored')) v(what) UNION ALL SELECT 'denied', '', 0")
def q102_route_by_stored_types(spark, sf):
    """Flags long documents and toxic labels. The update states no types: they come from the store's table of types, of the resources that
    it names, and each flag goes to its type's graph."""
    every = acl.Group("all", (acl.GraphSpec(BASE_GRAPH),), usage=frozenset({acl.READ_FOR_WRITE}))
    texts, marks = (acl.Group(n, (acl.GraphSpec(f"{NS}graphs/{n}", acl.ByType((NS + t,))),)) for n, t in (("texts", "documents"), ("marks", "labels")))
    allowed = [(n, ()) for n in ("all", "texts", "marks", "clean")]

    def found(view: DataFrame) -> Solutions:
        return union(match(view, "?x", NS + "n_chars", "?n").where(num("n") >= 5000).select("x"), match(view, "?x", NS + "toxic", T.literal(1)).select("x"))

    def work(store: Store) -> DataFrame:
        version, routed_, denied = U.update_store(store, [every, texts, marks, acl.Cleanup("clean")], allowed, found, [], [(acl.APPLICATION_GRAPH, "?x", NS + "flag", T.literal(True))], how="append")
        count = lambda df, what: df.groupBy("g").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "g", "n")
        stored = store.read(version, graphs=[NS + "graphs/texts", NS + "graphs/marks"])
        return reduce(DataFrame.unionByName, [count(routed_, "routed"), count(stored, "stored"), denied.agg(F.lit("denied").alias("what"), F.lit("").alias("g"), F.count("*").alias("n"))])

    quads = document_quads(spark, sf, "n_chars").unionByName(table_quads(read(spark, sf, "labels"), "labels", columns=["toxic"]))
    return in_a_store(spark, quads, work)


@query("SELECT 'left' AS what, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n UNION ALL SELECT 'denied', 0")
def q103_sudo_update(spark, sf):
    """With sudo nothing is routed, and nothing is denied, in the application graph either."""
    q = table_quads(read(spark, sf, "customer"), "customer", columns=["c_acctbal"])
    debt = lambda view: match(view, "?c", NS + "c_acctbal", "?b").where(num("b") < 0)
    after, _, denied = U.update(q, [], None, debt, [], [(acl.APPLICATION_GRAPH, "?c", NS + "debt", T.literal(True))])
    n = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n(after.where(F.col("p") == NS + "debt"), "left").unionByName(n(denied, "denied"))


@query("SELECT a.conv_id AS c, a.turn AS t, EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role <> a.role) AS answered FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = a.role AND b.turn < a.turn)")
def q104_correlated_exists(spark, sf):
    """The first turn of each role in a conversation, and whether a later one of another role follows: filters inside EXISTS compare
    with variables outside."""
    q = mapped(spark, sf, "conversations")
    turn = lambda s, t, r: bgp(q, (s, NS + "conv_id", "?c"), (s, NS + "turn", t), (s, NS + "role", r))
    first = exists(turn("?x", "?t", "?r"), turn("?y", "?u", "?r").select("c", "u", "r"), negated=True, condition=T.less(F.col("u"), F.col("t")))
    later = turn("?z", "?v", "?o").select("c", "v", "o")
    s = with_exists(first, later, "answered", T.less(F.col("t"), F.col("v")) & T.unequal(F.col("o"), F.col("r")))
    return s.df.select(num("c").cast("long").alias("c"), num("t").cast("int").alias("t"), "answered")


RULES = "(VALUES ('en', 'src0', 'long', NULL, 'a'), (NULL, 'src1', NULL, 1, 'b'), ('de', NULL, NULL, NULL, 'c'), (NULL, NULL, 'short', 0, 'd'), (NULL, NULL, NULL, NULL, 'e')) r(l, s, k, t, tag)"
LOOSE = "(SELECT d.doc_id, CASE WHEN n_chars >= 500 THEN lang END AS l, CASE WHEN n_chars < 4000 THEN source END AS s, CASE WHEN n_chars >= 3000 THEN 'long' WHEN n_chars < 800 THEN 'short' END AS k, toxic AS t FROM documents d LEFT JOIN labels USING (doc_id)) d"
FITS = "(r.l IS NULL OR d.l IS NULL OR r.l = d.l) AND (r.s IS NULL OR d.s IS NULL OR r.s = d.s) AND (r.k IS NULL OR d.k IS NULL OR r.k = d.k) AND (r.t IS NULL OR d.t IS NULL OR r.t = d.t)"
SHARES = "(r.l = d.l OR r.s = d.s OR r.k = d.k OR r.t = d.t)"


@query(f"SELECT d.doc_id AS d, tag AS what FROM {LOOSE} JOIN {RULES} ON {FITS} UNION ALL SELECT d.doc_id, 'minus' FROM {LOOSE} WHERE NOT EXISTS (SELECT 1 FROM {RULES} WHERE {FITS} AND {SHARES}) UNION ALL SELECT d.doc_id, 'exists' FROM {LOOSE} WHERE EXISTS (SELECT 1 FROM {RULES} WHERE tag < 'd' AND {FITS})")
def q105_four_unbound(spark, sf):
    """Documents of which language, source, size and label may be unbound meet rules with UNDEF in the same four places."""
    d = bgp(mapped(spark, sf, "documents"), ("?d", NS + "doc_id", "?id"), ("?d", NS + "n_chars", "?n"), ("?d", NS + "lang", "?lang"), ("?d", NS + "source", "?source"))
    d = d.bind("l", F.when(num("n") >= 500, F.col("lang"))).bind("s", F.when(num("n") < 4000, F.col("source")))
    d = d.bind("k", F.when(num("n") >= 3000, T.literal("long")).when(num("n") < 800, T.literal("short"))).select("id", "l", "s", "k")
    d = optional(d, bgp(mapped(spark, sf, "labels"), ("?x", NS + "doc_id", "?id"), ("?x", NS + "toxic", "?t")).select("id", "t"))
    term = lambda x: None if x is None else T.literal(x)
    rows = [("en", "src0", "long", None, "a"), (None, "src1", None, 1, "b"), ("de", None, None, None, "c"), (None, None, "short", 0, "d"), (None, None, None, None, "e")]
    rules = values(spark, ["l", "s", "k", "t", "tag"], [tuple(map(term, r)) for r in rows])
    shown = lambda s, what: s.df.select(num("id").cast("long").alias("d"), what.alias("what"))
    some = Solutions(rules.df.where(F.col("tag")["lex"] < "d"), rules.maybe)
    found = [shown(join(d, rules), F.col("tag")["lex"]), shown(minus(d, rules.select("l", "s", "k", "t")), F.lit("minus")), shown(exists(d, some.select("l", "s", "k", "t")), F.lit("exists"))]
    return reduce(DataFrame.unionByName, found)


BIG = "100000000000000000000"


@query(f"SELECT g, CASE WHEN hi * 10 % 10 = 5 THEN hi::varchar ELSE hi::hugeint::varchar END AS hi, le, gt, same, unlike FROM (SELECT doc_id // 10 AS g, max(v) AS hi, count(*) FILTER (v <= {BIG}.0::decimal(38, 1) + 100.5) AS le, count(*) FILTER (v > {BIG}.0::decimal(38, 1) + 100.5) AS gt, 0::bigint AS same, count(*) AS unlike FROM (SELECT doc_id, {BIG}.0::decimal(38, 1) + CASE doc_id % 3 WHEN 2 THEN 0 ELSE doc_id + (doc_id % 3) * 0.5::decimal(2, 1) END AS v FROM documents) GROUP BY 1)")
def q106_number_order(spark, sf):
    """Integers, decimals and doubles that a double can't tell apart, in one exact order; NaN is equal to nothing."""
    s = match(mapped(spark, sf, "documents"), "?d", NS + "doc_id", "?k").df
    k = num("k").cast("decimal(38,0)")
    whole = (F.lit(BIG).cast("decimal(38,0)") + k).cast("decimal(38,0)").cast("string")
    v = F.when(k % 3 == 0, T.literal(whole, T.XSD + "integer")).when(k % 3 == 1, T.literal(F.concat(whole, F.lit(".5")), T.XSD + "decimal")).otherwise(T.literal("1.0E20", T.XSD + "double"))
    limit, nan = T.literal("100000000000000000100.5", T.XSD + "decimal"), T.literal("NaN", T.XSD + "double")
    s = s.select(F.floor(num("k") / 10).alias("g"), v.alias("v"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    v = F.col("v")
    out = s.groupBy("g").agg(A.greatest(v).alias("hi"), n(T.at_most(v, limit), "le"), n(T.greater(v, limit), "gt"), n(T.equal(nan, nan) | T.at_least(v, nan) | T.at_most(v, nan), "same"), n(T.unequal(nan, v), "unlike"))
    return out.select("g", lex("hi"), "le", "gt", "same", "unlike")


@query("SELECT doc_id AS d, sha256(text) AS text, lang AS tag, 0::bigint AS bad FROM documents WHERE text IS NOT NULL")
def q108_nquads_round_trip(spark, sf):
    """Whole texts as lines of N-Quads, with every other line in disorder (blanks, a comment), read again."""
    folder = fresh(spark, "lines")
    lines = nquads(table_quads(read(spark, sf, "documents"), "documents", columns=["text"], predicate=NS + "text"))
    odd = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    lines.select(F.when(odd, F.concat(F.lit("\t "), F.regexp_replace("value", "^(<[^>]*>) (<[^>]*>) ", "$1$2"), F.lit("# <a> <b> <c> ."))).otherwise(F.col("value"))).write.option("compression", "gzip").text(folder)
    bad = bad_lines(spark, folder).agg(F.count("*").alias("bad"))
    key = F.regexp_extract("s", "[0-9]+$", 0).cast("long").alias("d")
    out = cut(read_nquads(spark, folder).select(key, F.sha2(F.col("o").cast("binary"), 256).alias("text"), F.col("o_lang").alias("tag")).join(F.broadcast(bad)))  # a row
    delete(spark, folder)
    return out


@query("SELECT doc_id AS d, lang AS l, n_chars::bigint AS n, 1 AS times FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL")
def q109_template_blank_nodes(spark, sf):
    """CONSTRUCT with a blank node in three triples, and INSERT with one in two: each document has its own, and its triples meet."""
    s = bgp(mapped(spark, sf, "documents"), ("?d", NS + "doc_id", "?id"), ("?d", NS + "lang", "?l"), ("?d", NS + "n_chars", "?n"))
    p = lambda x: T.iri(NS + x)
    triples = construct(s, ("?d", p("about"), "_:a"), ("_:a", p("l"), "?l"), ("_:a", p("n"), "?n"))
    part = lambda name, a, b: triples.where(F.col("p")["lex"] == NS + name).select(F.col("s").alias(a), F.col("o").alias(b))
    built = part("about", "d", "a").join(part("l", "a", "l"), "a").join(part("n", "a", "n"), "a")
    seen = built.groupBy("a").agg(F.count("*").cast("int").alias("times"))  # no node is shared
    changes = cut(U.instantiate(s.select("d", "n"), [("?d", NS + "about", "_:x"), ("_:x", NS + "n", "?n")], "insert", 0))
    stored = bgp(changes, ("?d", NS + "about", "?x"), ("?x", NS + "n", "?n")).df.select("d", F.col("n").alias("again"))
    return built.join(seen, "a").join(stored, "d").where(F.col("n") == F.col("again")).select(F.regexp_extract(F.col("d")["lex"], "[0-9]+$", 0).cast("long").alias("d"), lex("l"), num("n").cast("long").alias("n"), "times")


@query("SELECT d.doc_id AS d, lang AS l, source AS s, toxic AS t FROM documents d JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND source IS NOT NULL AND toxic IS NOT NULL")
def q120_ids(spark, sf):
    """Patterns over 8-byte ids: documents' stars, whose joins by subject need no exchange, met by labels through equal numbers."""
    quads = document_quads(spark, sf, "doc_id", "lang", "source").unionByName(table_quads(read(spark, sf, "labels"), "labels", columns=["doc_id", "toxic"]))
    ids = encode(quads)
    star_ = lambda s, *patterns: reduce(join, [ids.match(s, NS + p, o) for p, o in patterns])
    documents = exists(star_("?d", ("doc_id", "?k"), ("lang", "?l"), ("source", "?s")), ids.match("?d", T.RDF_TYPE, NS + "documents"))
    labels = exists(star_("?x", ("doc_id", "?k"), ("toxic", "?t")), ids.match("?x", T.RDF_TYPE, NS + "labels")).select("k", "t")
    found = ids.decoded(Solutions(join(documents, labels).df.select("k", "l", "s", "t"))).df
    out = cut(found.select(num("k").cast("long").alias("d"), lex("l"), lex("s"), num("t").cast("int").alias("t")))
    ids.drop()
    return out


@query(f"SELECT '{NS}graphs/dump' AS g, {iri_sql('documents', 'doc_id')} AS s, 1 + (n_chars IS NOT NULL)::bigint + (source IS NOT NULL)::bigint AS n FROM documents UNION ALL SELECT '{NS}graphs/dump', {iri_sql('labels', 'doc_id')}, 1 + (toxic IS NOT NULL)::bigint + (quality IS NOT NULL)::bigint FROM labels UNION ALL SELECT '{NS}graphs/users/' || (SELECT source FROM documents WHERE doc_id = 0), {iri_sql('labels', 'doc_id')}, 1 FROM labels WHERE toxic IS NOT NULL")
def q121_example_configuration(spark, sf):
    """Documents and labels, written by the session of document 0, whose source is its user."""
    quads = document_quads(spark, sf, "n_chars", "source").unionByName(table_quads(read(spark, sf, "labels"), "labels", columns=["toxic", "quality"]))
    d = mapped(spark, sf, "documents")
    user_of = lambda session: match(d, session or NS + "none", NS + "source", "?u").df.select(F.col("u")["lex"].alias("u"))
    specs = example.groups(user_of)
    routed_ = acl.route(U.data(quads, "insert", 0), quads.where(F.lit(False)), specs, acl.resolve(specs, NS + "documents/0"))
    return routed_.groupBy("g", "s").agg(F.count("*").alias("n"))
