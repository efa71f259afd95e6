"""Graph patterns as DataFrames of solutions: a term column for each variable, NULL where unbound.

Solutions know which variables may be unbound. A join on variables that are always bound is an equi-join. Where one may be
unbound, a row has a key for each set of variables that the other side may have bound: the join is one equi-join still, and no
nested loop is needed. Rows that share no bound variable at all meet under one key, as they are all compatible.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.terms import BNODE, IRI, RDF_NS, truth
from ..sources.quads import Mapped, subject, table_terms

TERM = "struct<kind:tinyint,lex:string,dt:string,lang:string>"


@dataclass(frozen=True)
class Solutions:
    df: DataFrame
    maybe: frozenset = frozenset()

    @property
    def names(self) -> list[str]:
        return self.df.columns

    def where(self, condition: Column) -> Solutions:
        """FILTER: a condition or a term, of which the effective boolean value counts; an error (NULL) drops the row."""
        if isinstance(self.df.select(condition).schema[0].dataType, StructType):
            condition = truth(condition)
        return Solutions(self.df.where(condition), self.maybe)

    def bind(self, name: str, value: Column) -> Solutions:
        if name in self.names:
            raise ValueError(f"{name} is bound already")
        return Solutions(self.df.withColumn(name, value), self.maybe | {name})

    def select(self, *names: str) -> Solutions:
        null = F.lit(None).cast(TERM)
        return Solutions(self.df.select(*(F.col(n) if n in self.names else null.alias(n) for n in names)), (self.maybe | ({*names} - {*self.names})) & {*names})

    def distinct(self) -> Solutions:
        return Solutions(self.df.distinct(), self.maybe)


def term_columns(prefix: str) -> Column:
    null = F.lit(None).cast("string")
    if prefix == "o":
        return F.struct(F.col("o_kind").alias("kind"), F.col("o").alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    kind = F.col("s_kind") if prefix == "s" else F.lit(IRI).cast("tinyint")
    return F.struct(kind.alias("kind"), F.col(prefix).alias("lex"), null.alias("dt"), null.alias("lang"))


def match(quads: DataFrame | Mapped, s: str | Column, p: str | Column, o: str | Column, g: str | None = None) -> Solutions:
    """A triple pattern. "?x" is a variable, other text an IRI, a column a term. Constants reach the scan as plain filters. On a
    view without graphs (read_view() of a caller without sudo), GRAPH is stripped: g narrows nothing, and a variable stays unbound."""
    if isinstance(quads, Mapped):
        quads = quads.quads(p if isinstance(p, str) and not p.startswith("?") else None)
    unbound = None
    if g is not None and "g" not in quads.columns:
        unbound, g = g[1:] if g.startswith("?") else None, None
    names: dict[str, Column] = {}
    conditions: list[Column] = []
    for place, value in (("s", s), ("p", p), ("o", o), ("g", g)):
        if value is None:
            continue
        term = term_columns(place)
        if isinstance(value, str) and value.startswith("?"):
            if (name := value[1:]) in names:
                conditions.append(names[name] == term)
            names.setdefault(name, term)
        elif isinstance(value, str):
            conditions.append(F.col(place) == value)
            if place in ("s", "o"):
                conditions.append(F.col(f"{place}_kind") == IRI)
        else:
            conditions += [F.col(place) == value["lex"], term.eqNullSafe(value)]
    df = reduce(lambda d, c: d.where(c), conditions, quads).select(*(c.alias(n) for n, c in names.items()))
    if unbound and unbound not in names:
        return Solutions(df.withColumn(unbound, F.lit(None).cast(TERM)), frozenset({unbound}))
    return Solutions(df)


def star(source: Mapped, s: str, patterns: list[tuple[str, str | Column]]) -> Solutions | None:
    """Patterns (p, o) on one subject variable, each a known predicate with a variable of its own or a constant: one projection of
    each table that has all the predicates. None: not of this kind."""
    own = [o for _, o in patterns if isinstance(o, str) and o.startswith("?")]
    if len({*own}) < len(own) or s in own or any(p.startswith("?") for p, _ in patterns):
        return None
    parts = []
    for table, df in source.frames.items():
        terms = table_terms(df, table)
        if not {p for p, _ in patterns} <= {*terms}:
            continue
        null, columns, conditions = F.lit(None).cast("string"), {}, []
        for p, o in patterns:
            text, kind, dt, lang, _ = terms[p]
            term = F.struct(F.lit(kind).cast("tinyint").alias("kind"), text.cast("string").alias("lex"), F.lit(dt).cast("string").alias("dt"), lang.alias("lang"))
            conditions.append(text.isNotNull())
            if not isinstance(o, str):
                conditions += [text.cast("string") == o["lex"], term.eqNullSafe(o)]
            elif o.startswith("?"):
                columns[o[1:]] = term
            else:
                conditions += [text.cast("string") == o, F.lit(kind == IRI)]
        me = F.struct(F.lit(IRI).cast("tinyint").alias("kind"), subject(df, table).alias("lex"), null.alias("dt"), null.alias("lang"))
        parts.append(reduce(lambda d, c: d.where(c), conditions, df).select(me.alias(s[1:]), *(c.alias(n) for n, c in columns.items())))
    return Solutions(reduce(DataFrame.unionByName, parts)) if parts else None


def bgp(source: DataFrame | Mapped, *patterns: tuple) -> Solutions:
    """Triple patterns (s, p, o) joined; those that share a subject variable of a mapped table cost no join."""
    parts, by_subject = [], {}
    for s, p, o in patterns:
        fuse = isinstance(source, Mapped) and isinstance(s, str) and s.startswith("?") and isinstance(p, str)
        if fuse:
            by_subject.setdefault(s, []).append((p, o))
        else:
            parts.append(match(source, s, p, o))
    for s, own in by_subject.items():
        one = star(source, s, own)
        parts += [match(source, s, p, o) for p, o in own] if one is None else [one]
    done, rest = parts[0], parts[1:]
    while rest:  # what shares a variable goes first, so that no cross product is made without need
        k = next((i for i, x in enumerate(rest) if {*x.names} & {*done.names}), 0)
        done = join(done, rest.pop(k))
    return done


def collection(source: DataFrame | Mapped, head: str, *items: str | Column) -> Solutions:
    """The pattern of a list ( item ... ) that head stands for: rdf:first and rdf:rest, cell by cell."""
    if not items:
        raise ValueError("the empty list is the IRI rdf:nil, no pattern")
    cells = [head, *(f"?{head[1:]}__{i}" for i in range(1, len(items)))]
    patterns = [(c, RDF_NS + "first", x) for c, x in zip(cells, items, strict=True)]
    patterns += [(c, RDF_NS + "rest", n) for c, n in zip(cells, [*cells[1:], RDF_NS + "nil"], strict=True)]
    found = bgp(source, *patterns)
    return found.select(*(n for n in found.names if n not in {c[1:] for c in cells[1:]}))


def _masks(names: list[str], maybe: frozenset) -> list[int]:
    """Which of names can be bound together: a bit for each; those that can't be unbound always are."""
    sure = sum(1 << i for i, n in enumerate(names) if n not in maybe)
    return reduce(lambda out, i: out + [m | 1 << i for m in out], [i for i, n in enumerate(names) if n in maybe], [sure])


def _keys(side: Solutions, names: list[str], others: list[int], first: bool, least: int = 0) -> Column:
    """For each set of variables that a row of the other side may have bound: the two sets, and the values of what both have. Two
    rows are compatible exactly if one of their keys is equal, and just one can be. least: how many variables both have at least."""
    bits = lambda n: F.col(n).isNotNull().cast("int")
    mine = reduce(Column.__add__, [bits(n) * (1 << i) if n in side.maybe else F.lit(1 << i) for i, n in enumerate(names)])

    def key(other: int) -> Column:
        pair = (mine, F.lit(other)) if first else (F.lit(other), mine)
        values = [(F.col(n) if other >> i & 1 else F.lit(None).cast(TERM)).alias(f"v{i}") for i, n in enumerate(names)]
        out = F.struct(pair[0].alias("a"), pair[1].alias("b"), *values)
        return F.when(F.bit_count(mine.bitwiseAND(other)) >= least, out) if least else out

    return F.array_compact(F.array(*map(key, others))) if least else F.array(*map(key, others))


def _keyed(a: Solutions, b: Solutions, least: int = 0) -> tuple[list[str], Column, Column]:
    """The shared variables, and the keys of either side's rows."""
    shared = [n for n in a.names if n in b.names]
    return shared, _keys(a, shared, _masks(shared, b.maybe), True, least), _keys(b, shared, _masks(shared, a.maybe), False, least)


def join(a: Solutions, b: Solutions) -> Solutions:
    """All compatible pairs. Where a shared variable may be unbound on a side, a row has a key for each set of variables that the
    other side may have bound, so this is one equi-join, which scans each side once."""
    shared = [n for n in a.names if n in b.names]
    if not {*shared} & (a.maybe | b.maybe):
        df = a.df.join(b.df, shared) if shared else a.df.crossJoin(b.df)
        return Solutions(df, a.maybe | b.maybe)
    rest = [n for n in b.names if n not in shared]
    _, of_a, of_b = _keyed(a, b)
    y = b.df.select(F.explode(of_b).alias("k__"), *(F.col(n).alias(f"{n}__r") if n in shared else F.col(n) for n in b.names))
    both = a.df.select("*", F.explode(of_a).alias("k__")).join(y, "k__")
    df = both.select(*(F.coalesce(n, f"{n}__r").alias(n) if n in shared else F.col(n) for n in a.names), *rest)
    return Solutions(df, frozenset(n for n in {*a.names, *b.names} if n in a.maybe and n in b.maybe or n in (a.maybe | b.maybe) and not (n in a.names and n in b.names)))


def _met(a: Solutions, b: Solutions, least: int = 0) -> tuple[list[str], DataFrame]:
    """The shared variables, and their values in those rows of a that are compatible with a row of b (and share at least `least` bound
    variables with it), each once."""
    shared, of_a, of_b = _keyed(a, b, least)
    asked = a.df.select(*shared).distinct().select("*", F.explode(of_a).alias("k__"))
    return shared, asked.join(b.df.select(F.explode(of_b).alias("k__")).distinct(), "k__", "left_semi").select(*shared).distinct()


def _same(names: list[str], mark: str = "__r") -> Column:
    return reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{n}{mark}")) for n in names])


def _beside(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(n).alias(f"{n}__r") for n in names))


def optional(a: Solutions, b: Solutions, condition: Column | None = None) -> Solutions:
    """OPTIONAL; filters directly inside are the condition, which may use variables of both sides."""
    shared = [n for n in a.names if n in b.names]
    rest = [n for n in b.names if n not in shared]
    if not {*shared} & (a.maybe | b.maybe) and shared:
        y = b.df.select(*(F.col(n).alias(f"{n}__r") if n in shared else F.col(n) for n in b.names))
        on = reduce(Column.__and__, [F.col(n) == F.col(f"{n}__r") for n in shared])
        df = a.df.join(y, on if condition is None else on & condition, "left").select(*a.names, *rest)
        return Solutions(df, a.maybe | {*rest})
    # an unbound variable may be filled by b, so rows are told apart by what a had
    tagged = Solutions(a.df.withColumn("a__", F.struct(*a.names)), a.maybe)
    kept = join(tagged, b) if condition is None else join(tagged, b).where(condition)
    matched = kept.df.select(F.col("a__").alias("r__")).distinct()
    alone = a.df.join(matched, F.struct(*a.names).eqNullSafe(F.col("r__")), "left_anti")
    return union(Solutions(kept.df.drop("a__"), kept.maybe), Solutions(alone, a.maybe))


def union(*parts: Solutions) -> Solutions:
    names = [*dict.fromkeys(n for p in parts for n in p.names)]
    maybe = frozenset(n for n in names if any(n in p.maybe or n not in p.names for p in parts))
    return Solutions(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.df for p in parts]).select(*names), maybe)


def minus(a: Solutions, b: Solutions) -> Solutions:
    """MINUS: drops what is compatible with a row of b and shares a bound variable with it; without shared variables, nothing."""
    shared = [n for n in a.names if n in b.names]
    if not shared:
        return a
    if not {*shared} & (a.maybe | b.maybe):
        return Solutions(a.df.join(b.df.select(*shared), shared, "left_anti"), a.maybe)
    shared, met = _met(a, b, least=1)
    return Solutions(a.df.join(_beside(met, shared), _same(shared), "left_anti"), a.maybe)


def _correlated(a: Solutions, b: Solutions, condition: Column, how: str) -> DataFrame:
    """Rows of a with (left_semi) or without (left_anti) a compatible row of b for which the condition, over variables of both, holds; a
    shared variable is a's where it is bound there. What both sides always bind are the join's keys."""
    shared = [n for n in a.names if n in b.names]
    y = b.df.select(*(F.col(n).alias(f"{n}__r") if n in shared else F.col(n) for n in b.names))
    if not {*shared} & (a.maybe | b.maybe):
        return a.df.join(y, reduce(Column.__and__, [F.col(n) == F.col(f"{n}__r") for n in shared], condition), how)
    # one equi-join on the keys of compatible rows; rows of a are told apart by all their values
    found = join(Solutions(a.df.select("*", F.struct(*a.names).alias("a__")).distinct(), a.maybe), b).where(condition).df.select("a__").distinct()
    return a.df.join(found, F.struct(*a.names).eqNullSafe(F.col("a__")), how)


def with_exists(a: Solutions, b: Solutions, name: str, condition: Column | None = None) -> Solutions:
    """a with a boolean column that says whether b has a compatible solution, for use inside expressions. What is unbound in a row
    of either side is compatible with anything. condition: a filter inside, which may use variables of a."""
    shared = [n for n in a.names if n in b.names]
    if condition is not None:
        own = a.df.distinct()
        met = _beside(_correlated(Solutions(own, a.maybe), b, condition, "left_semi"), a.names).withColumn(name, F.lit(True))
        df = a.df.join(met, _same(a.names), "left")
    elif not shared:
        df = a.df.join(F.broadcast(b.df.limit(1).select(F.lit(True).alias(name))), F.lit(True), "left")
    else:
        shared, met = _met(a, b) if {*shared} & (a.maybe | b.maybe) else (shared, b.df.select(*shared).distinct())
        df = a.df.join(_beside(met, shared).withColumn(name, F.lit(True)), _same(shared), "left")
    return Solutions(df.select(*a.names, F.coalesce(F.col(name), F.lit(False)).alias(name)), a.maybe)


def exists(a: Solutions, b: Solutions, negated: bool = False, condition: Column | None = None) -> Solutions:
    """(NOT) EXISTS on the shared variables. condition: a filter inside, which may use variables of a."""
    shared, how = [n for n in a.names if n in b.names], "left_anti" if negated else "left_semi"
    if condition is not None:
        return Solutions(_correlated(a, b, condition, how), a.maybe)
    if not shared:
        there = b.df.limit(1).select(F.lit(1).alias("there__"))
        return Solutions(a.df.join(F.broadcast(there), F.lit(True), how), a.maybe)
    if {*shared} & (a.maybe | b.maybe):
        shared, met = _met(a, b)
        return Solutions(a.df.join(_beside(met, shared), _same(shared), how), a.maybe)
    return Solutions(a.df.join(b.df.select(*shared), shared, how), a.maybe)


def values(spark, names: list[str], rows: list[tuple]) -> Solutions:
    """VALUES: a column or None (UNDEF) for each place."""
    null = F.lit(None).cast(TERM)
    one = spark.range(1)
    row = lambda r: F.struct(*((null if v is None else v).alias(n) for n, v in zip(names, r, strict=True)))
    df = one.select(F.inline(F.array(*map(row, rows)))).select(*names)
    return Solutions(df, frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows)))


def numbered(a: Solutions) -> DataFrame:
    """Each solution with a number (nth__) among those that are equal to it, so that every one has an identity that is the same
    whenever it is worked out again."""
    counts = a.df.groupBy(*a.names).agg(F.count("*").alias("n__"))
    return counts.select(*a.names, F.explode(F.sequence(F.lit(1), F.col("n__").cast("int"))).alias("nth__"))


def blank(a: Solutions, label: str, salt: str) -> Column:
    """The blank node that a template's label stands for in a solution of numbered()."""
    own = F.to_json(F.struct(*sorted(a.names))) if a.names else F.lit("")
    name = F.concat(F.lit("b"), F.substring(F.sha2(F.concat_ws(" ", F.lit(f"{salt} {label}"), F.col("nth__").cast("string"), own).cast("binary"), 256), 1, 32))
    return F.struct(F.lit(BNODE).cast("tinyint").alias("kind"), name.alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))


def has_blanks(templates) -> bool:
    return any(isinstance(x, str) and x.startswith("_:") for t in templates for x in t)


def construct(a: Solutions, *templates: tuple, salt: str = "") -> DataFrame:
    """Triples (s, p, o terms) of each template, as a set; incomplete and illegal ones (a literal subject, no IRI predicate) go. "_:x" is a
    blank node of its own for each solution, the same one in all templates."""
    value = lambda v: blank(a, v[2:], salt) if isinstance(v, str) and v.startswith("_:") else F.col(v[1:]) if isinstance(v, str) else v
    df = numbered(a) if has_blanks(templates) else a.df
    triples = F.array(*(F.struct(*(value(v).alias(n) for n, v in zip("spo", t, strict=True))) for t in templates))
    return df.select(F.inline(triples)).where("s is not null and p is not null and o is not null and s.kind <> 3 and p.kind = 2").distinct()


def ask(a: Solutions) -> DataFrame:
    return a.df.limit(1).agg((F.count("*") > 0).alias("answer"))
