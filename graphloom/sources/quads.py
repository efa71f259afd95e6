"""Quads: relational tables mapped to RDF, and versions of a quad store in Parquet, each written whole (sources/store.py has parts).

quads: g, s, s_kind, p, o, o_kind, o_dt, o_lang, and o_num, a numeric shadow of the object for push-down only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import IRI, LANG_STRING, LITERAL, RDF_TYPE, XSD

NS = "http://ex.org/"
BASE_GRAPH = NS + "graphs/base"
IDENTITY = ["g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
SCHEMA = "g string, s string, s_kind tinyint, p string, o string, o_kind tinyint, o_dt string, o_lang string, o_num double"
#: Key columns; a table without one is keyed by a hash of the whole row.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}
LINKS = {"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}
TYPES = {"int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date", "string": "string"}


def subject(df: DataFrame, table: str) -> Column:
    if keys := KEYS.get(table):
        return F.concat(F.lit(f"{NS}{table}/"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    return F.concat(F.lit(f"{NS}{table}/"), F.sha2(F.to_json(F.struct(*df.columns)), 256))


def table_terms(df: DataFrame, table: str, columns: list[str] | None = None) -> dict[str, tuple]:
    """Each predicate of a mapped table with its object: (text, kind, datatype, language, numeric shadow)."""
    null = F.lit(None).cast("string")
    found: dict[str, tuple] = {RDF_TYPE: (F.lit(NS + table), IRI, None, null, None)}
    for name, kind in df.dtypes:
        if kind not in TYPES or columns is not None and name not in columns:
            continue
        value = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else F.col(name)
        if name == "text" and "lang" in df.columns:
            found[NS + name] = (value, LITERAL, LANG_STRING, F.col("lang"), None)
        else:
            found[NS + name] = (value, LITERAL, XSD + TYPES[kind], null, F.col(name) if TYPES[kind] in ("integer", "double", "float") else None)
        if name in LINKS:
            found[NS + name.removesuffix("key")] = (F.concat(F.lit(f"{NS}{LINKS[name]}/"), F.col(name).cast("string")), IRI, None, null, None)
    return found


def table_quads(df: DataFrame, table: str, graph: str | Column = BASE_GRAPH, columns: list[str] | None = None, predicate: str | None = None) -> DataFrame:
    """One pass over df: a row's type, its columns as typed literals, its keys of other tables as links besides. A column
    named in no `columns` is not read; the language of a text is the column lang, if there is one. predicate: only that one,
    without rows for others."""

    def entry(p: str, o: Column, kind: int, dt: str | None, lang: Column, num: Column | None) -> Column:
        return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).cast("tinyint").alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), lang.alias("o_lang"), (F.lit(None) if num is None else num).cast("double").alias("o_num"))

    found = [entry(p, *o) for p, o in table_terms(df, table, columns).items() if predicate in (None, p)]
    graph = F.lit(graph) if isinstance(graph, str) else graph
    if predicate is None:
        rows = df.select(graph.alias("g"), subject(df, table).alias("s"), F.inline(F.array(*found)))
    else:
        rows = df.select(graph.alias("g"), subject(df, table).alias("s"), *(found[0][x].alias(x) for x in ("p", "o", "o_kind", "o_dt", "o_lang", "o_num")))
    return rows.where("o is not null").select("g", "s", F.lit(IRI).cast("tinyint").alias("s_kind"), "p", "o", "o_kind", "o_dt", "o_lang", "o_num")


@dataclass(frozen=True)
class Mapped:
    """Tables mapped to RDF that are not unpivoted before a pattern asks: a pattern with a known predicate reads one column, and
    patterns that share a subject are one projection of the wide table."""

    frames: dict
    graph: str = BASE_GRAPH

    def quads(self, predicate: str | None = None) -> DataFrame:
        own = [table_quads(df, t, self.graph, predicate=predicate) for t, df in self.frames.items() if predicate is None or predicate in table_terms(df, t)]
        if not own:
            own = [table_quads(df, t, self.graph).where(F.lit(False)) for t, df in [*self.frames.items()][:1]]
        return reduce(DataFrame.unionByName, own)


def mapped(spark: SparkSession, sf_dir: str, *names: str) -> Mapped:
    return Mapped({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def tables(spark: SparkSession, sf_dir: str, *names: str, graph: str | Column = BASE_GRAPH) -> DataFrame:
    out = None
    for name in names:
        q = table_quads(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, graph)
        out = q if out is None else out.unionByName(q)
    return out


def star(df: DataFrame, table: str, **columns: str) -> DataFrame:
    """Triple patterns that share a subject over one mapped class, as one projection of the wide table: s, and each variable
    with its column; a link gives the other row's IRI."""
    def value(c: str) -> Column:
        key = f"{c}key"
        return F.concat(F.lit(f"{NS}{LINKS[key]}/"), F.col(key).cast("string")) if key in LINKS and key in df.columns else F.col(c)

    return df.select(subject(df, table).alias("s"), *(value(c).alias(v) for v, c in columns.items()))


def write_version(quads: DataFrame, folder: str, version: int) -> None:
    """A new version's folder, a part for each graph, sorted so that scans can skip by predicate and subject."""
    quads.repartition("g", F.pmod(F.xxhash64("s"), F.lit(64))).sortWithinPartitions("g", "p", "s").write.partitionBy("g").parquet(f"{folder}/v={version}")


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={version}").select(*(x.split()[0] for x in SCHEMA.split(", ")))
