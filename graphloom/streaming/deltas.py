"""The change feed: change rows, change sets in JSON, and a stream of them.

Published are the routed operations in the order of their statements, no-ops included. Rows are appended to a folder; consumers
read it as a stream with foreachBatch, or as a batch for all since a sequence number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import BNODE, IRI, LANG_STRING, LITERAL, XSD

SCHEMA = "call string, seq int, op string, g string, s string, s_kind tinyint, p string, o string, o_kind tinyint, o_dt string, o_lang string, o_num double"


def encoded(kind: Column, lex: Column, dt: Column, lang: Column) -> Column:
    """A term as in the JSON of query results; absent fields are left out by to_json."""
    name = F.when(kind == IRI, "uri").when(kind == LITERAL, "literal").otherwise("bnode")
    shown = F.when((kind == LITERAL) & lang.isNull() & (dt != XSD + "string"), dt)
    return F.struct(name.alias("type"), lex.alias("value"), shown.alias("datatype"), lang.alias("xml:lang"))


def decoded(term: Column) -> Column:
    """The term that encoded() shows so; term: JSON text, which is parsed once, however often its parts are named."""

    def made(t: Column) -> Column:
        kind = F.when(t["type"] == "uri", IRI).when(t["type"].isin("literal", "typed-literal"), LITERAL).when(t["type"] == "bnode", BNODE).cast("tinyint")
        tag = t["xml:lang"]
        dt = F.when(kind == LITERAL, F.coalesce(F.when(tag.isNotNull(), F.lit(LANG_STRING)), t["datatype"], F.lit(XSD + "string")))
        return F.when(kind.isNotNull() & t["value"].isNotNull(), F.struct(kind.alias("kind"), t["value"].alias("lex"), dt.alias("dt"), tag.alias("lang")))

    return F.transform(F.array(F.from_json(term, "type string, value string, datatype string, `xml:lang` string")), made)[0]


def change_rows(routed: DataFrame, call: str) -> DataFrame:
    return routed.select(F.lit(call).alias("call"), *(x.split()[0] for x in SCHEMA.split(", ")[1:]))


def change_sets(rows: DataFrame, size: int = 1000) -> DataFrame:
    """(call, seq, op, part, body): JSON messages of at most about `size` quads each, so that a large change is no one message."""
    null = F.lit(None).cast("string")
    uri = lambda c: encoded(F.lit(IRI), F.col(c), null, null)
    quad = F.struct(uri("g").alias("graph"), encoded(F.col("s_kind"), F.col("s"), null, null).alias("subject"), uri("p").alias("predicate"), encoded(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")).alias("object"))
    counts = rows.groupBy("call", "seq", "op").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = rows.join(counts, ["call", "seq", "op"]).withColumn("part", F.pmod(F.xxhash64("g", "s", "p", "o"), "parts"))
    sets = dealt.groupBy("call", "seq", "op", "part").agg(F.to_json(F.sort_array(F.collect_list(quad))).alias("quads"))
    return sets.select("call", "seq", "op", "part", F.concat(F.lit('{"changeSets":[{"'), "op", F.lit('":'), "quads", F.lit("}]}")).alias("body"))


def publish(routed: DataFrame, call: str, folder: str) -> None:
    change_rows(routed, call).write.mode("append").parquet(folder)


def to_all(*targets: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """The list of delta targets as one: a batch goes to each in turn, and is noted as delivered once all have it."""
    def deliver(df: DataFrame, batch: int) -> None:
        for target in targets:
            target(df, batch)

    return deliver


def folder_target(folder: str, size: int = 1000) -> Callable[[DataFrame, int], None]:
    """A target that keeps JSON change sets as files, a folder for each batch, so that a batch that is repeated replaces itself."""
    return lambda df, batch: change_sets(df, size).write.mode("overwrite").json(f"{folder}/batch={batch}")


def subscribe(spark: SparkSession, folder: str, deliver: Callable[[DataFrame, int], None], checkpoint: str):
    """A running stream that hands each batch of change rows to deliver, once for each batch that the checkpoint has noted."""
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since(spark: SparkSession, folder: str, seq: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder).where(F.col("seq") > seq)
