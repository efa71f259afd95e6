"""N-Triples and N-Quads files, read and written line by line.

A line is read term by term, and its state says which terms may come next, so blanks between terms are needed nowhere, and a comment may
follow. Escapes are decoded in one pass. Blank nodes are scoped by their file: one label in two files is two nodes. Lines that are no
statement, but for empty ones and comments, are in bad_lines(). Null lines there are none; a line of any length is one row; repeated
statements are repeated rows; no files: an error of Spark's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import BNODE, IRI, LANG_STRING, LITERAL, NUMBERS, XSD
from .quads import BASE_GRAPH, SCHEMA

_UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_IRI = rf"<((?:[^\x00-\x20<>\"{{}}|^`\\]|{_UCHAR})*)>"
#: A term, the final dot, a comment or the line's end, with blanks before it.
_NEXT = re.compile(
    rf"[ \t]*(?:(?P<iri>{_IRI})|_:(?P<blank>[\w:](?:[\w:.\-\u00b7]*[\w:\-\u00b7])?)"
    rf"|(?P<text>\"((?:[^\"\\]|\\[tbnrf\"'\\]|{_UCHAR})*)\"(?:\^\^{_IRI}|@(?P<tag>[A-Za-z]+(?:-[A-Za-z0-9]+)*))?)|(?P<dot>\.)|(?P<end>(?:\#.*)?\Z))",
    re.DOTALL,
)
#: What may come after so many terms, and what that leads to; a graph may be left out.
_AFTER = {0: {"iri": 1, "blank": 1, "end": "none"}, 1: {"iri": 2}, 2: {"iri": 3, "blank": 3, "tag": 3, "text": 3}, 3: {"iri": 4, "blank": 4, "dot": 5}, 4: {"dot": 5}, 5: {"end": "all"}}
_ESCAPE = re.compile(r"\\(?:u(.{4})|U(.{8})|(.))")
_ONE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def decode(text: str) -> str:
    """Escapes in one pass; a ValueError for what is no character."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[3]:
            return _ONE[m[3]]
        code = int(m[1] or m[2], 16)
        if 0xD800 <= code < 0xE000:
            raise ValueError(f"no character: {m[0]}")
        return chr(code)

    return _ESCAPE.sub(one, text)


def statement(line: str, scope: str = "") -> list[tuple] | None:
    """(kind, text, datatype, tag) of each term; [] for an empty line or a comment, None for what is no statement."""
    at, state, terms = 0, 0, []
    while True:
        m = _NEXT.match(line, at)
        if m is None or (to := _AFTER[state].get(kind := "text" if m.lastgroup == "tag" else m.lastgroup)) is None:
            return None
        at, state = m.end(), to
        if kind == "end":
            return terms
        if kind == "dot":
            continue
        try:
            if kind == "iri":
                terms.append((IRI, decode(m[2]), None, None))
            elif kind == "blank":
                terms.append((BNODE, scope + m["blank"], None, None))
            else:
                terms.append((LITERAL, decode(m[5]), LANG_STRING if m["tag"] else decode(m[6]) if m[6] is not None else XSD + "string", m["tag"]))
        except (ValueError, OverflowError):
            return None


def scope_of(file: str) -> str:
    return sha256(file.encode()).hexdigest()[:12] + "-"


def _lines(spark: SparkSession, path: str, out: Callable[[str, str], tuple | None], schema: str) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for b in it:
            scopes = {f: scope_of(f) for f in b.column(1).unique().to_pylist()}
            rows = [r for line, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (r := out(line, scopes[f])) is not None]
            columns = [*zip(*rows, strict=True)] or [()] * len(names)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, ARROW[t]) for n, t, c in zip(names, (x.split()[1] for x in schema.split(", ")), columns, strict=True)})

    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).mapInArrow(run, schema)


ARROW = {"string": pa.string(), "tinyint": pa.int8()}


def read_nquads(spark: SparkSession, path: str, graph: str = BASE_GRAPH) -> DataFrame:
    """Quads; statements without a graph are in `graph`. A graph that is a blank node has its name with _: before it."""

    def quad(line: str, scope: str) -> tuple | None:
        terms = statement(line, scope)
        if not terms:
            return None
        (s_kind, s, _, _), (_, p, _, _), (o_kind, o, dt, tag), *rest = terms
        g = graph if not rest else rest[0][1] if rest[0][0] == IRI else "_:" + rest[0][1]
        return g, s, s_kind, p, o, o_kind, dt, tag

    rows = _lines(spark, path, quad, ", ".join(SCHEMA.split(", ")[:-1]))
    return rows.withColumn("o_num", F.when(F.col("o_dt").isin(*NUMBERS), F.col("o").try_cast("double")))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of these files that read_nquads() can't take."""
    return _lines(spark, path, lambda line, scope: (line,) if statement(line) is None else None, "value string")


_PLAIN_IRI = re.compile(r"[\x00-\x20<>\"{}|^`\\]")
_PLAIN_TEXT = re.compile(r"[\"\\\n\r]")
_SHOWN = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r"}


def written(g: str | None, s: str, s_kind: int, p: str, o: str, o_kind: int, dt: str | None, tag: str | None) -> str:
    """A quad as a line."""
    iri = lambda x: "<" + _PLAIN_IRI.sub(lambda m: f"\\u{ord(m[0]):04X}", x) + ">"
    node = lambda x, kind: iri(x) if kind == IRI else "_:" + x
    if o_kind == LITERAL:
        shown = '"' + _PLAIN_TEXT.sub(lambda m: _SHOWN[m[0]], o) + '"' + (f"@{tag}" if tag else "" if dt in (None, XSD + "string") else "^^" + iri(dt))
    else:
        shown = node(o, o_kind)
    return " ".join([node(s, s_kind), iri(p), shown, *([] if g is None else [g if g.startswith("_:") else iri(g)]), "."])


def nquads(quads: DataFrame) -> DataFrame:
    """value: a line for each quad, to be written as text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([written(*r.values()) for r in b.to_pylist()], pa.string())], names=["value"])

    return quads.select("g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang").mapInArrow(run, "value string")
