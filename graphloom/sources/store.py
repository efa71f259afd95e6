"""A store of quads in versions, in any folder that Spark writes to.

Rows lie in parts by graph and subject: a part is a slot of graphs by a bucket of subjects, so a pattern with a known graph or
subject reads its parts only, and a large graph is many parts. A version is a manifest: for each part, the version that last wrote
it whole, and those that have added changes since. So a commit writes what it touches and nothing else, and older versions stay readable.

    rewrite   the touched parts are read, changed and written again (copy on write)
    append    the changes alone are written; a read folds them over the part (merge on read) until compact() writes it again

Beside the quads, in the same versions, lie the types of resources, in parts by resource: what routing asks for. They are
written from the changes to rdf:type, so that no update reads the store to know types.

The manifest is the last thing that a commit writes, under a name that only one writer can take: a commit that fails, or comes second,
leaves files that no version names, and raises. Null terms: a quad's language and datatype may be null, its graph, subject, predicate and
object not. Repeated quads are one. An empty store has no parts. Other columns of what is committed are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import IRI, RDF_TYPE
from ..shared import cut, drop, names, publish, size, spread, write
from .quads import IDENTITY, SCHEMA

#: Changes of up to so many bytes are sent to the tasks that read what they change; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def bytes_of(df: DataFrame) -> int:
    """What the rows of df take in memory, about: each text with 24 bytes besides its own, 8 for other fields."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) + 24 if kind == "string" else F.lit(8) for c, kind in df.dtypes]
    return df.agg(F.sum(reduce(Column.__add__, sizes).cast("long"))).first()[0] or 0


def last_of(changes: DataFrame, identity: list[str], by: str) -> DataFrame:
    """The last operation on each row, with what the row carries besides."""
    rest = [c for c in changes.columns if c not in (*identity, by)]
    return spread(changes, *[c for c in identity if c != "g"]).groupBy(*identity).agg(F.max_by(F.struct(*rest), by).alias("last__")).select(*identity, "last__.*")


def overlay(rows: DataFrame, folded: DataFrame, identity: list[str], small: bool) -> DataFrame:
    """rows, a set, without those that `folded` names, and with those that it inserts. small: folded is sent to the tasks that read
    rows, which are not shuffled then; else never, however few bytes its files have, since rows are far larger in memory. Equal hashes are
    looked at field by field. Dealt rows meet by their hash alone, in an outer join; the fields are made a struct (null equals null in it)
    after the dealing and are no key. For other keys, bare rows or an anti-join, Spark would deal anew to all of the session's parts, and
    beyond MOST_PARTS the task that reads a file keeps all rows that it makes in memory."""
    columns = rows.columns
    keys = folded.select(F.xxhash64(*identity).alias("h__r"), *(F.col(c).alias(f"{c}__r") for c in identity))
    rows = rows.withColumn("h__", F.xxhash64(*identity))
    met = F.col("h__") == F.col("h__r")
    if small:
        kept = rows.join(F.broadcast(keys), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in identity], met), "left_anti")
    else:
        mine = spread(rows, "h__").select(F.struct(*identity).alias("k__"), "h__", *(c for c in columns if c not in identity))
        theirs = spread(keys, "h__r").select(F.struct(*(F.col(f"{c}__r").alias(c) for c in identity)).alias("k__r"), "h__r")
        kept = mine.join(theirs.hint("merge"), met & F.col("k__").between(F.col("k__r"), F.col("k__r")), "left").where("h__r is null")
        kept = kept.select("k__.*", *(c for c in columns if c not in identity))
    return kept.select(*columns).unionByName(folded.where("op = 'insert'").select(*columns))


@dataclass(frozen=True)
class Table:
    """How one of the store's tables lies in parts."""

    name: str
    schema: str
    identity: list[str]
    order: list[str]
    parts: int
    part: Column

    @property
    def columns(self) -> list[str]:
        return [x.split()[0] for x in self.schema.split(", ")]


@dataclass
class Part:
    """The version that wrote a part whole (None: it is empty), and its changes since: (version, bytes)."""

    at: int | None = None
    changes: list[tuple[int, int]] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, folder: str, slots: int = 8, buckets: int = 32):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.slot = lambda g: F.pmod(F.xxhash64(g), F.lit(slots))
        self.bucket = lambda s: F.pmod(F.xxhash64(s), F.lit(buckets))
        self.quads = Table("quads", SCHEMA, IDENTITY, ["p", "s"], slots * buckets, (self.slot(F.col("g")) * buckets + self.bucket(F.col("s"))).cast("int"))
        kept = ["g", "resource", "type"]
        self.typed = Table("types", "g string, resource string, type string", kept, ["resource"], buckets, self.bucket(F.col("resource")).cast("int"))

    # versions

    def versions(self) -> list[int]:
        return sorted(int(x[2:-5]) for x in names(self.spark, f"{self.folder}/manifest") if x.startswith("v=") and x.endswith(".json"))

    def latest(self) -> int:
        return self.versions()[-1]

    def manifest(self, version: int) -> dict[str, dict[int, Part]]:
        """An entry for each part, whose number is fixed."""
        text = self.spark.read.text(f"{self.folder}/manifest/v={version}.json", wholetext=True).first()[0]
        return {name: {int(p): Part(at, [(v, n) for v, n in changes]) for p, (at, changes) in parts.items()} for name, parts in json.loads(text).items()}

    def _publish(self, version: int, manifest: dict[str, dict[int, Part]]) -> int:
        publish(self.spark, f"{self.folder}/manifest/v={version}.json", json.dumps({name: {p: (x.at, x.changes) for p, x in parts.items()} for name, parts in manifest.items()}))
        return version

    # reading

    def _rows(self, table: Table, parts: dict[int, Part], also: Column | None = None) -> DataFrame:
        """The rows of these parts, with their part; also: a condition on the part's number."""
        columns = [*table.columns, "part"]

        def at(kind: str, found: Iterable[tuple[int, int]], more: str = "") -> DataFrame:
            paths = [f"{self.folder}/{table.name}/{kind}/at={v}/part={p}" for p, v in found]
            full = f"{table.schema}{more}, at int, part int"
            df = self.spark.read.schema(full).option("basePath", f"{self.folder}/{table.name}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], full)
            return df if also is None else df.where(also)

        base = at("whole", [(p, x.at) for p, x in parts.items() if x.at is not None])
        changed = [(p, v) for p, x in parts.items() for v, _ in x.changes]
        if not changed:
            return base.select(*columns)
        folded = last_of(at("changes", changed, ", op string"), table.identity, "at")
        return overlay(base.select(*columns), folded, table.identity, sum(n for x in parts.values() for _, n in x.changes) <= BROADCAST_BYTES)

    def read(self, version: int | None = None, graphs: list[str] | None = None, subjects: list[str] | None = None) -> DataFrame:
        """The quads of a version; of these graphs or subjects only, which are parts that are not read."""
        also, rows = F.lit(True), []
        if graphs is not None:
            also &= F.floor(F.col("part") / self.buckets).isin([self.slot(F.lit(g)) for g in graphs]) if graphs else F.lit(False)
            rows.append(F.col("g").isin(graphs))
        if subjects is not None:
            also &= F.pmod("part", F.lit(self.buckets)).isin([self.bucket(F.lit(s)) for s in subjects]) if subjects else F.lit(False)
            rows.append(F.col("s").isin(subjects))
        df = self._rows(self.quads, self.manifest(self.latest() if version is None else version)["quads"], also)
        return reduce(DataFrame.where, rows, df).select(*self.quads.columns)

    def types(self, resources: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """(resource, type), from any graph. resources: a table with the column resource, written already; then their parts only,
        by a join that shuffles nothing of the store while the resources are few."""
        parts = self.manifest(self.latest() if version is None else version)["types"]
        if resources is None:
            return self._rows(self.typed, parts).select("resource", "type").distinct()
        asked = {r[0] for r in resources.select(self.typed.part.alias("part")).distinct().collect()}  # numbers of parts
        rows = self._rows(self.typed, {p: x for p, x in parts.items() if p in asked})
        wanted = resources.select("resource").distinct()
        return rows.join(F.broadcast(wanted) if bytes_of(wanted) <= BROADCAST_BYTES else wanted.hint("merge"), "resource", "left_semi").select("resource", "type").distinct()

    # writing

    def _write(self, table: Table, rows: DataFrame, version: int, kind: str) -> set[int]:
        """The parts that have rows now. A part of very many rows is written by several tasks."""
        folder = f"{self.folder}/{table.name}/{kind}/at={version}"
        write(rows.hint("rebalance", "part").sortWithinPartitions("part", *table.order), folder, "part")
        return {int(x.removeprefix("part=")) for x in names(self.spark, folder) if x.startswith("part=")}

    def _apply(self, table: Table, parts: dict[int, Part], changes: DataFrame, version: int, how: str) -> None:
        """changes: folded, written, with their part."""
        sizes = [F.coalesce(F.octet_length(c), F.lit(0)) + 24 for c in table.identity]
        touched = dict(changes.groupBy("part").agg(F.sum(reduce(Column.__add__, sizes).cast("long"))).collect())  # a row for each part
        if not touched:
            return
        if how == "append":
            self._write(table, changes, version, "changes")
            for p, n in touched.items():
                old = parts.get(p, Part())
                parts[p] = Part(old.at, [*old.changes, (version, n)])
            return
        before = self._rows(table, {p: parts[p] for p in touched if p in parts})
        after = overlay(before, changes.select(*table.columns, "part", "op"), [*table.identity, "part"], sum(touched.values()) <= BROADCAST_BYTES)
        left = self._write(table, after, version, "whole")
        for p in touched:
            if p in left:
                parts[p] = Part(version)
            else:
                parts.pop(p, None)

    def create(self, quads: DataFrame) -> int:
        """Version 0."""
        return self._commit(spread(quads.select(*self.quads.columns), "s", "p", "o").dropDuplicates(IDENTITY).withColumn("op", F.lit("insert")), 0, {"quads": {}, "types": {}}, "rewrite")

    def commit(self, changes: DataFrame, how: str = "rewrite") -> int:
        """changes: folded ones, a last operation (op) for each quad. Gives the new version."""
        if how not in ("rewrite", "append"):
            raise ValueError(how)
        last = self.latest()
        return self._commit(changes, last + 1, self.manifest(last), how)

    def _commit(self, changes: DataFrame, version: int, manifest: dict[str, dict[int, Part]], how: str) -> int:
        written = cut(changes.select(*self.quads.columns, "op", self.quads.part.alias("part")))
        typed = written.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == IRI) & (F.col("s_kind") == IRI))
        typed = typed.select("g", F.col("s").alias("resource"), F.col("o").alias("type"), "op").withColumn("part", self.typed.part)
        self._apply(self.quads, manifest["quads"], written, version, how)
        self._apply(self.typed, manifest["types"], typed, version, how)
        drop(written)
        return self._publish(version, manifest)

    def compact(self, share: float = 0.1) -> int:
        """A version in which parts whose changes take at least this share of the bytes of all parts' mean are written whole again; if
        there are none, the latest one as it is."""
        last = self.latest()
        manifest, done = self.manifest(last), False
        for table in (self.quads, self.typed):
            parts = manifest[table.name]
            mean = sum(self._bytes(table, p, x) for p, x in parts.items()) / max(1, len(parts))
            due = {p: x for p, x in parts.items() if x.changes and sum(n for _, n in x.changes) >= share * mean}
            if due:
                left = self._write(table, self._rows(table, due), last + 1, "whole")
                for p in due:
                    if p in left:
                        parts[p] = Part(last + 1)
                    else:
                        parts.pop(p)
                done = True
        return self._publish(last + 1, manifest) if done else last

    def _bytes(self, table: Table, p: int, x: Part) -> int:
        return 0 if x.at is None else size(self.spark, f"{self.folder}/{table.name}/whole/at={x.at}/part={p}")
