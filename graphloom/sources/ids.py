"""Quads by numbers: a dictionary of terms, and triples of 8-byte ids in buckets by subject.

A term's id is a hash of it. Terms whose hashes are equal are found when the dictionary is made: one of them keeps the hash, the others get
ids by further hashes until no two terms share one, and are listed as exceptions, which are few. So ids are made without a look-up, joins
move and compare numbers, and terms come back at the end.

Triples are sorted and bucketed by subject, and the dictionary by id: patterns that share a subject meet without an exchange, and what is decoded
is shuffled, not the dictionary. A bucket is read by one task, so a subject of very many quads makes a long task; sources/store.py
splits its parts. Null terms (an unbound o) there are none; repeated quads are one; an empty table has no terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.terms import IRI
from ..operators.patterns import Solutions, term_columns
from ..shared import cut, delete, drop, fresh
from .store import BROADCAST_BYTES, bytes_of

FIELDS = ["kind", "lex", "dt", "lang"]


def hashed(term: Column, turn: int) -> Column:
    """The turn-th hash of a term."""
    return F.xxhash64(*(term[x] for x in FIELDS), F.lit(turn))


@dataclass
class Ids:
    spark: SparkSession
    triples: DataFrame
    terms: DataFrame
    exceptions: DataFrame
    names: list[str]
    folders: list[str]
    hash: Callable[[Column, int], Column]

    def drop(self) -> None:
        for n in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        for f in self.folders:
            delete(self.spark, f)
        drop(self.exceptions)

    def id_of(self, term: Column) -> Column:
        """The id of a constant term; NULL if no quad has it. What the dictionary holds under its hash, a bucket's file, is compared."""
        same = F.struct(*FIELDS).eqNullSafe(F.struct(*(term[x].alias(x) for x in FIELDS)))
        found = self.exceptions.where(same).select("id").first() or self.terms.where((F.col("id") == self.hash(term, 0)) & same).select("id").first()
        return F.lit(found[0] if found else None).cast("long")

    def match(self, s: str | Column, p: str, o: str | Column, g: str | None = None) -> Solutions:
        """A triple pattern with a known predicate; variables are ids."""
        df, names = self.triples.where(F.col("p") == p), {}
        if g is not None:
            df = df.where(F.col("g") == g)
        for place, value in (("s", s), ("o", o)):
            if isinstance(value, str) and value.startswith("?"):
                if (n := value[1:]) in names:
                    df = df.where(F.col(place) == F.col(names[n]))
                names.setdefault(n, place)
            else:
                df = df.where(F.col(place) == self.id_of(iri(value) if isinstance(value, str) else value))
        return Solutions(df.select(*(F.col(place).alias(n) for n, place in names.items())))

    def decoded(self, a: Solutions, *names: str) -> Solutions:
        """a, with the terms of these variables (all by default) in place of their ids."""
        df = a.df
        for n in names or a.names:
            terms = self.terms.select(F.col("id").alias("id__"), F.struct(*FIELDS).alias("term__"))
            df = df.join(terms, F.col(n) == F.col("id__"), "left").drop("id__", n).withColumnRenamed("term__", n)
        return Solutions(df.select(*a.names), a.maybe)


def iri(text: str) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(IRI).cast("tinyint").alias("kind"), F.lit(text).alias("lex"), null.alias("dt"), null.alias("lang"))


def _bucketed(df: DataFrame, by: str, order: list[str], buckets: int) -> tuple[DataFrame, str, str]:
    """df as a table of the session's catalog, over files in the shared folder: a file for each bucket."""
    name, folder = f"ids_{uuid.uuid4().hex}", fresh(df.sparkSession, "ids")
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, *order).option("path", folder).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name), name, folder


def _assigned(terms: DataFrame, hash_: Callable[[Column, int], Column]) -> tuple[DataFrame, DataFrame]:
    """(id, term) of each of these distinct terms, and the exceptions among them: those whose id is not their first hash."""
    fixed, todo, turn = None, cut(terms.select(hash_(F.col("term"), 0).alias("id"), "term")), 0
    while True:
        place = F.row_number().over(Window.partitionBy("id").orderBy("term"))
        many = todo.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        taken = todo.join(F.broadcast(many) if bytes_of(many) <= BROADCAST_BYTES else many, "id", "left_semi").withColumn("place", place).where("place > 1").select("id", "term")
        if fixed is not None:
            taken = taken.unionByName(todo.join(fixed.select("id"), "id", "left_semi")).distinct()
        again = cut(taken)
        if again.isEmpty():
            drop(again)
            break
        kept = todo.join(again.select("term"), "term", "left_anti").select("id", "term", F.lit(turn > 0).alias("other"))
        before, fixed = fixed, cut(kept if fixed is None else fixed.unionByName(kept))
        turn += 1
        new = cut(again.select(hash_(F.col("term"), turn).alias("id"), "term"))
        drop(todo, again, *([before] if before is not None else []))
        todo = new
    last = todo.select("id", "term", F.lit(turn > 0).alias("other"))
    out = cut(last if fixed is None else fixed.unionByName(last))
    drop(todo, *([fixed] if fixed is not None else []))
    return out, cut(out.where("other").select("id", "term.*"))


def encode(quads: DataFrame, buckets: int = 16, hash_: Callable[[Column, int], Column] = hashed) -> Ids:
    """The ids of quads, written. drop() deletes them."""
    terms = quads.select(F.explode(F.array(term_columns("s"), term_columns("o"))).alias("term")).distinct()
    assigned, exceptions = _assigned(terms, hash_)
    few = bytes_of(exceptions) <= BROADCAST_BYTES
    rows = quads.select("g", term_columns("s").alias("s"), "p", term_columns("o").alias("o"))
    none = exceptions.isEmpty()
    for place in ("s", "o"):
        own = hash_(F.col(place), 0)
        if none:
            rows = rows.withColumn(place, own)
            continue
        other = exceptions.select(F.col("id").alias("id__"), F.struct(*FIELDS).alias("t__"))
        rows = rows.join(F.broadcast(other) if few else other, F.col(place).eqNullSafe(F.col("t__")), "left").withColumn(place, F.coalesce("id__", own)).drop("id__", "t__")
    triples, t_name, t_folder = _bucketed(rows.select("g", "s", "p", "o").distinct(), "s", ["p"], buckets)
    words, w_name, w_folder = _bucketed(assigned.select("id", "term.*"), "id", [], buckets)
    drop(assigned)
    return Ids(quads.sparkSession, triples, words, exceptions, [t_name, w_name], [t_folder, w_folder], hash_)
