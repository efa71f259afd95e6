"""Access by groups: which named graphs a caller reads, and to which graphs a change is written.

Reads are restricted where the scan is built: what a caller queries is read_view(), so no pattern can reach past it. Without an
active group the view is empty (fail closed). Names are compared as data, never put into query text.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import IRI, RDF_TYPE
from ..shared import cut, once, spread
from ..sources.quads import IDENTITY, NS
from ..sources.store import BROADCAST_BYTES, Store, bytes_of

APPLICATION_GRAPH = NS + "graphs/application"
READ, WRITE, READ_FOR_WRITE = "read", "write", "read_for_write"


@dataclass(frozen=True)
class Predicates:
    """A rule on predicates: those named, or all others."""

    names: frozenset
    others: bool

    def __call__(self, p: Column) -> Column:
        named = p.isin(*sorted(self.names)) if self.names else F.lit(False)
        return ~named if self.others else named

    def allows(self, predicate: str) -> bool:
        return (predicate in self.names) != self.others


def all_except(*predicates: str) -> Predicates:
    return Predicates(frozenset(predicates), True)


def none_except(*predicates: str) -> Predicates:
    return Predicates(frozenset(predicates), False)


@dataclass(frozen=True)
class ByType:
    """Quads whose subject (for inverse predicates: whose object) has one of the types; None: any type, but some type."""

    types: tuple[str, ...] | None = None
    without: tuple[str, ...] = ()
    source: str = APPLICATION_GRAPH
    predicates: Predicates = field(default_factory=all_except)
    inverse: Predicates = field(default_factory=none_except)

    def _fits(self, types: Column) -> Column:
        own = F.filter(types, lambda t: ~t.isin(*self.without)) if self.without else types
        return F.coalesce(F.size(own) > 0 if self.types is None else F.arrays_overlap(own, F.array(*map(F.lit, self.types))), F.lit(False))

    def matching(self, s_types: Column, o_types: Column) -> Column:
        """Of a quad with the types of its subject and of its object."""
        return (self.predicates(F.col("p")) & self._fits(s_types)) | (self.inverse(F.col("p")) & (F.col("o_kind") == IRI) & self._fits(o_types))


@dataclass(frozen=True)
class ByPrefix:
    """Quads whose subject (for inverse predicates: object) begins with the prefix."""

    prefix: str
    source: str = APPLICATION_GRAPH
    predicates: Predicates = field(default_factory=all_except)
    inverse: Predicates = field(default_factory=none_except)

    def matching(self, s_types: Column, o_types: Column) -> Column:
        return (F.col("s").startswith(self.prefix) & self.predicates(F.col("p"))) | (F.col("o").startswith(self.prefix) & (F.col("o_kind") == IRI) & self.inverse(F.col("p")))


@dataclass(frozen=True)
class GraphSpec:
    graph: str
    constraint: ByType | ByPrefix = field(default_factory=ByType)

    def name(self, variables: tuple[str, ...]) -> str:
        return self.graph + "/".join(variables)


@dataclass(frozen=True)
class Group:
    """access: None for everyone, else a function of a session that gives a DataFrame with a row of variables for each
    instance of the group; rows with a null are skipped."""

    name: str
    graphs: tuple[GraphSpec, ...]
    usage: frozenset = frozenset({READ, WRITE, READ_FOR_WRITE})
    access: Callable[[str | None], DataFrame] | None = None


@dataclass(frozen=True)
class Cleanup:
    """When active, by its name, quads that stay in the originating graph are dropped from what is written."""

    name: str
    graph: str = APPLICATION_GRAPH
    usage: frozenset = frozenset({WRITE})


Allowed = list[tuple[str, tuple[str, ...]]]


def allowed_groups(specs: list, session: str | None = None) -> Allowed:
    """The groups of a session, with their variables, in the order of specs: a few rows for a caller come to the driver. For callers
    with very many instances of a group there is graph_names(), which stays a table."""
    out: Allowed = []
    for spec in specs:
        if getattr(spec, "access", None) is None:
            out.append((spec.name, ()))
        else:
            rows = spec.access(session).dropna().distinct().collect()
            out += [(spec.name, tuple(map(str, r))) for r in rows]
    return [*dict.fromkeys(out)]


def encode_groups(allowed: Allowed) -> str:
    """Groups as JSON, as they are handed from call to call."""
    return json.dumps([{"name": n, "variables": list(v)} for n, v in allowed])


def decode_groups(text: str | None) -> Allowed | None:
    """None, for no groups stated, stays None: they are then worked out anew."""
    return None if text is None else [*dict.fromkeys((x["name"], tuple(x.get("variables", ()))) for x in json.loads(text))]


def used_groups(specs: list, allowed: Allowed, usage: str) -> Allowed:
    """Those allowed groups that a call of this usage makes use of; they are reported with its result."""
    return [*dict.fromkeys((spec.name, variables) for spec, variables in active(specs, allowed, usage))]


def resolve(specs: list, session: str | None = None, stated: str | None = None, sudo: bool = False) -> Allowed | None:
    """The groups of a request: None for sudo, those stated with it, else those of its session."""
    if sudo:
        return None
    return allowed_groups(specs, session) if stated is None else decode_groups(stated)


def graph_names(spark, specs: list, session: str | None = None, usage: str = READ) -> DataFrame:
    """(g): names of the graphs that a session may use, as a table for read_view(); nothing comes to the driver."""
    out = spark.createDataFrame([(g.name(()),) for s in specs if isinstance(s, Group) and usage in s.usage and s.access is None for g in s.graphs], "g string")
    for spec in specs:
        if isinstance(spec, Group) and usage in spec.usage and spec.access is not None:
            rows = spec.access(session).dropna()
            for g in spec.graphs:
                out = out.unionByName(rows.select(F.concat(F.lit(g.graph), F.concat_ws("/", *(F.col(c).cast("string") for c in rows.columns))).alias("g")))
    return out.distinct()


def active(specs: list, allowed: Allowed, usage: str) -> list[tuple]:
    return [(spec, variables) for spec in specs if usage in spec.usage for name, variables in allowed if name == spec.name]


def readable_graphs(specs: list, allowed: Allowed, usage: str = READ) -> list[str]:
    return [*dict.fromkeys(g.name(v) for spec, v in active(specs, allowed, usage) if isinstance(spec, Group) for g in spec.graphs)]


def read_view(quads: DataFrame, graphs: list[str] | DataFrame | None) -> DataFrame:
    """The merged default graph of the graphs: each triple once, without its graph. None: sudo, all graphs as they are. A table of
    names is joined."""
    if graphs is None:
        return quads
    triples = [c for c in IDENTITY if c != "g"]
    if isinstance(graphs, DataFrame):
        return quads.join(graphs.select("g"), "g", "left_semi").drop("g").dropDuplicates(triples)
    here = quads.where(F.col("g").isin(*graphs)) if graphs else quads.where(F.lit(False))
    return here.drop("g") if len(graphs) == 1 else here.drop("g").dropDuplicates(triples)


def dataset(quads: DataFrame, default: list[str] = (), named: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """FROM and FROM NAMED: the default graph, merged, and the quads that GRAPH patterns see. Only with sudo: read_view() has no
    graphs to choose from."""
    return read_view(quads, [*default]), quads.where(F.col("g").isin(*named)) if named else quads.where(F.lit(False))


#: An object of more rows than this is a hot one: its types are sent to all tasks, and its rows meet in none.
HOT = 10_000


def resource_types(changes: DataFrame, stored: DataFrame | Store) -> tuple[DataFrame, DataFrame]:
    """(resource, types) of the changes' subjects and objects: the last type that the update itself gives a resource, else all stored
    ones, from any graph; and the hot objects with theirs, [] if they have none. Only these resources are looked for: in the store's own
    table of types, or by a semi-join with the quads, which are not shuffled while the resources are few. Resources are added up in tasks
    before they meet, and no row of the changes is joined, so a type or a country of very many rows makes no long task."""
    given = (F.col("p") == RDF_TYPE) & (F.col("o_kind") == IRI) & (F.col("op") == "insert")
    null = F.lit(None)
    mine = F.struct(F.col("s").alias("resource"), F.when(given, F.col("o")).alias("type"), F.when(given, F.col("seq")).alias("at"), F.lit(0).alias("met"))
    other = F.struct(F.col("o").alias("resource"), null.cast("string").alias("type"), null.cast(changes.schema["seq"].dataType).alias("at"), F.lit(1).alias("met"))
    each = changes.select(F.explode(F.array_compact(F.array(mine, F.when(F.col("o_kind") == IRI, other)))).alias("r")).select("r.*")
    each = cut(each.groupBy("resource").agg(F.max_by("type", "at").alias("type"), F.sum("met").alias("met")))
    new = each.where("type is not null").select("resource", F.array("type").alias("types"))
    asked = each.where("type is null").select("resource")
    if isinstance(stored, Store):
        found = stored.types(asked)
    else:
        quads = stored.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == IRI)).select(F.col("s").alias("resource"), F.col("o").alias("type"))
        found = quads.join(F.broadcast(asked) if bytes_of(asked) <= BROADCAST_BYTES else asked.hint("merge"), "resource", "left_semi")
    types = new.unionByName(found.groupBy("resource").agg(F.collect_set("type").alias("types")))
    hot = F.broadcast(each.where(F.col("met") > HOT).select("resource"))
    return types, types.join(hot, "resource", "left_semi").unionByName(hot.withColumn("types", F.array().cast("array<string>"))).groupBy("resource").agg(F.flatten(F.collect_list("types")).alias("types"))


def route(changes: DataFrame, stored: DataFrame | Store, specs: list, allowed: Allowed | None) -> DataFrame:
    """changes (seq, op, quads) with copies in the graph of each matching spec. The caller's graph is replaced by the
    application graph first; each spec sees what those before it have written. allowed None: sudo, unchanged. The types of
    subject and object are looked up once; all specs are then conditions of one row, whose graphs are an array."""
    if allowed is None:
        return changes
    chosen = active(specs, allowed, WRITE)
    by_type = [g.constraint for spec, _ in chosen if isinstance(spec, Group) for g in spec.graphs if isinstance(g.constraint, ByType)]
    changes = once(changes) if by_type else changes
    now = spread(changes.drop("g"), "s", "p", "o").distinct()
    none = F.array().cast("array<string>")
    types, hot = resource_types(changes, stored) if by_type else (None, None)
    now = now.join(types.select(F.col("resource").alias("s"), F.col("types").alias("s_types")).hint("merge"), "s", "left") if by_type else now.withColumn("s_types", none)
    if any(c.inverse.names or c.inverse.others for c in by_type):
        now = now.join(F.broadcast(hot.select(F.col("resource").alias("o"), F.col("types").alias("hot_types"))), "o", "left")
        # only IRIs under an inverse rule are looked up; all other rows are dealt by keys that no resource has
        asked = reduce(Column.__or__, [c.inverse(F.col("p")) for c in by_type]) & (F.col("o_kind") == IRI) & F.col("hot_types").isNull()
        now = now.withColumn("key__", F.when(asked, F.col("o")).otherwise(F.concat(F.lit(" "), F.xxhash64("s", "p", "o").cast("string"))))
        now = now.join(types.select(F.col("resource").alias("key__"), F.col("types").alias("cold_types")).hint("merge"), "key__", "left")
        now = now.withColumn("o_types", F.coalesce("hot_types", "cold_types"))
    else:
        now = now.withColumn("o_types", none)
    graphs = F.array(F.lit(APPLICATION_GRAPH))
    for spec, variables in chosen:
        if isinstance(spec, Cleanup):
            graphs = F.array_remove(graphs, spec.graph)
            continue
        copies = [F.when(F.array_contains(graphs, g.constraint.source) & g.constraint.matching(F.col("s_types"), F.col("o_types")), F.lit(g.name(variables))) for g in spec.graphs]
        graphs = F.array_distinct(F.concat(graphs, F.array_compact(F.array(*copies))))
    return now.select(*(c for c in changes.columns if c != "g"), F.explode(graphs).alias("g")).select(*changes.columns)


def unwritten(changes: DataFrame, routed: DataFrame, allowed: Allowed | None = ()) -> DataFrame:
    """Triples that were asked for and that no group writes; not empty: access is denied. allowed None: sudo, to which nothing is denied."""
    if allowed is None:
        return changes.select(*(c for c in IDENTITY if c != "g")).where(F.lit(False))
    triple = [c for c in IDENTITY if c != "g"]
    kept = routed.where(F.col("g") != APPLICATION_GRAPH).select(*(F.col(c).alias(f"{c}__r") for c in triple))
    kept = spread(kept, "s__r", "p__r", "o__r").distinct()
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in triple])
    return spread(changes.select(*triple), "s", "p", "o").distinct().join(kept, on, "left_anti")
