"""Updates: templates to changes, folding, commit.

A change is (seq, op, quad). All statements of an update are solved against one state of the store, before any is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import IRI
from ..operators.patterns import Solutions, blank, has_blanks, numbered
from ..shared import cut, drop, once, spread
from ..sources.quads import IDENTITY
from ..sources.store import BROADCAST_BYTES, Store, bytes_of, last_of, overlay
from .access import APPLICATION_GRAPH, READ_FOR_WRITE, read_view, readable_graphs, route, unwritten

COLUMNS = [*IDENTITY, "o_num"]


def _term(value: str | Column, a: Solutions, salt: str) -> Column:
    if isinstance(value, str) and value.startswith("_:"):
        return blank(a, value[2:], salt)
    if isinstance(value, str) and value.startswith("?"):
        return F.col(value[1:])
    null = F.lit(None).cast("string")
    return F.struct(F.lit(IRI).cast("tinyint").alias("kind"), F.lit(value).alias("lex"), null.alias("dt"), null.alias("lang")) if isinstance(value, str) else value


def instantiate(solutions: Solutions, templates: list[tuple], op: str, seq: int, graph: str = APPLICATION_GRAPH, salt: str | None = None) -> DataFrame:
    """(g, s, p, o) templates, or (s, p, o) ones in `graph`, which WITH sets, filled from each solution, in one pass; incomplete and
    illegal quads go; each quad once. "_:x" is a new blank node for each solution, which is the same one whenever this is worked
    out again; salt, by default another one for each call, tells updates apart."""
    salt = uuid.uuid4().hex if salt is None else salt
    if op == "delete" and has_blanks(templates):
        raise ValueError("what is deleted can't be a new blank node")

    def quad(t: tuple) -> Column:
        g, s, p, o = (_term(x, solutions, salt) for x in ((graph, *t) if len(t) == 3 else t))
        legal = g.isNotNull() & s.isNotNull() & p.isNotNull() & o.isNotNull() & (s["kind"] != 3) & (p["kind"] == IRI)
        return F.when(legal, F.struct(g["lex"].alias("g"), s["lex"].alias("s"), s["kind"].alias("s_kind"), p["lex"].alias("p"), o["lex"].alias("o"), o["kind"].alias("o_kind"), o["dt"].alias("o_dt"), o["lang"].alias("o_lang"), o["lex"].try_cast("double").alias("o_num")))

    rows = numbered(solutions) if has_blanks(templates) else solutions.df
    quads = rows.select(F.explode(F.array(*map(quad, templates))).alias("q")).where("q is not null").select("q.*")
    quads = spread(quads, "s", "p", "o").distinct()
    return quads.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), *COLUMNS)


def modify(solutions: Solutions, delete: list[tuple], insert: list[tuple], seq: int = 0, graph: str = APPLICATION_GRAPH) -> DataFrame:
    """DELETE / INSERT / WHERE: deletions first. graph: that of templates which name none (WITH)."""
    parts = [instantiate(solutions, t, op, seq + i, graph) for i, (op, t) in enumerate((("delete", delete), ("insert", insert))) if t]
    return reduce(DataFrame.unionByName, parts)


def data(quads: DataFrame, op: str, seq: int) -> DataFrame:
    return spread(quads, "s", "p", "o").select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), *COLUMNS).distinct()


def add_graph(quads: DataFrame, a: str, b: str, seq: int = 0) -> DataFrame:
    """ADD a TO b: copies; onto itself, nothing."""
    here = quads.where(F.col("g") == a).withColumn("g", F.lit(b))
    return data(here if a != b else here.where(F.lit(False)), "insert", seq)


def fold(changes: DataFrame) -> DataFrame:
    """The last operation on each quad."""
    return spread(changes, "s", "p", "o").groupBy(*IDENTITY).agg(F.max_by("op", "seq").alias("op"), F.first("o_num").alias("o_num"))


def commit(quads: DataFrame, folded: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The next state. The folded changes are written once and measured. Up to `broadcast_bytes`, they are sent to the tasks that read
    the store, which is not shuffled then; beyond, both sides are shuffled by a hash of the quad. The store is a set of quads."""
    changes = once(folded)
    return overlay(quads.select(*COLUMNS), changes, IDENTITY, bytes_of(changes) <= broadcast_bytes)


def _changes(view: DataFrame, solve: Callable[[DataFrame], Solutions], delete: list[tuple], insert: list[tuple], seq: int) -> DataFrame:
    """Written once, so that terms made anew (UUID, BNODE, RAND) are the same in the state, in the feed and in what is denied, whatever is
    run again."""
    return cut(modify(solve(view), delete, insert, seq))


def update(quads: DataFrame, specs: list, allowed: list | None, solve: Callable[[DataFrame], Solutions], delete: list[tuple], insert: list[tuple], seq: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DELETE / INSERT / WHERE of a caller, end to end: WHERE is solved on what the caller's groups may read for writing, the
    changes are routed to the graphs that they may write. Gives the next state, the routed changes, and the triples that no group
    of theirs writes (not empty: access is denied; with sudo nothing is)."""
    changes = _changes(read_view(quads, None if allowed is None else readable_graphs(specs, allowed, READ_FOR_WRITE)), solve, delete, insert, seq)
    routed = once(route(changes, quads, specs, allowed))
    return commit(quads, fold(routed)), routed, unwritten(changes, routed, allowed)


def update_store(store: Store, specs: list, allowed: list | None, solve: Callable[[DataFrame], Solutions], delete: list[tuple], insert: list[tuple], seq: int = 0, how: str = "rewrite") -> tuple[int, DataFrame, DataFrame]:
    """update() of a stored version: the caller's graphs name the parts that WHERE reads, the types come from the store's own table,
    and the new version holds the parts that the changes touch. Gives its number in place of the state."""
    graphs = None if allowed is None else readable_graphs(specs, allowed, READ_FOR_WRITE)
    changes = _changes(read_view(store.read(graphs=graphs), graphs), solve, delete, insert, seq)
    routed = once(route(changes, store, specs, allowed))
    return store.commit(fold(routed), how), routed, unwritten(changes, routed, allowed)


def sequential(quads: DataFrame, statements: list) -> DataFrame:
    """The other reading of an update of several statements: each sees what the one before has written. A statement is a
    function of the quads that gives changes. The store is never copied: a state is the store with the changes up to then folded over
    it, and these are all that is written."""
    changed = None
    for turn, statement in enumerate(statements):
        new = fold(statement(quads if changed is None else commit(quads, changed))).withColumn("turn", F.lit(turn))
        both = new if changed is None else new.unionByName(changed.withColumn("turn", F.lit(-1)))
        before, changed = changed, cut(last_of(both, IDENTITY, "turn").select(*COLUMNS, "op"))
        if before is not None:
            drop(before)
    return quads if changed is None else commit(quads, changed)
