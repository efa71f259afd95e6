"""Lines of N-Quads beside a reader that goes character by character, and blank nodes of templates."""

import random

from graphloom.functions import terms as T
from graphloom.operators.patterns import Solutions, construct
from graphloom.plans import updates as U
from graphloom.sources import nquads as N
from graphloom.sources.quads import SCHEMA
from pyspark.sql import functions as F

R = random.Random(8)
HEX = "0123456789abcdefABCDEF"
ONE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class Bad(Exception):
    pass


def plain(line):
    """The terms of a line, or None: by hand, a character at a time."""
    i = 0

    def at(k=0):
        return line[i + k] if i + k < len(line) else ""

    def escape(chars):
        nonlocal i
        i += 1
        c = at()
        if c in ("u", "U"):
            n = 4 if c == "u" else 8
            digits = line[i + 1 : i + 1 + n]
            if len(digits) < n or any(x not in HEX for x in digits):
                raise Bad
            code = int(digits, 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                raise Bad
            i += n + 1
            return chr(code)
        if not chars or c not in ONE or not c:
            raise Bad
        i += 1
        return ONE[c]

    def blanks():
        nonlocal i
        while at() and at() in " \t":
            i += 1

    def iri():
        nonlocal i
        i += 1
        out = ""
        while at() != ">":
            if not at() or at() in '<"{}|^`' or at() <= " ":
                raise Bad
            if at() == "\\":
                out += escape(False)
            else:
                out += at()
                i += 1
        i += 1
        return out

    def name(c):
        return c != "" and (c.isalnum() or c in "_:")

    def term(kinds):
        nonlocal i
        blanks()
        if at() == "<":
            return (T.IRI, iri(), None, None)
        if at() == "_" and at(1) == ":" and "b" in kinds:
            i += 2
            if not name(at()):
                raise Bad
            out = ""
            while name(at()) or at() in ("-", "·") or at() == ".":
                if at() == ".":
                    k = 1
                    while at(k) == ".":
                        k += 1
                    if not (name(at(k)) or at(k) in ("-", "·") and at(k)):
                        break
                out += at()
                i += 1
            return (T.BNODE, out, None, None)
        if at() == '"' and "l" in kinds:
            i += 1
            out = ""
            while at() != '"':
                if not at():
                    raise Bad
                if at() == "\\":
                    out += escape(True)
                else:
                    out += at()
                    i += 1
            i += 1
            if at() == "^" and at(1) == "^":
                i += 2
                if at() != "<":
                    raise Bad
                return (T.LITERAL, out, iri(), None)
            if at() == "@":
                i += 1
                tag, first = "", True
                while at().isascii() and (at().isalpha() or not first and at().isalnum() or at() == "-" and tag and tag[-1] != "-" and name(at(1)) and at(1) not in "_:"):
                    first = first and at() != "-"
                    tag += at()
                    i += 1
                if not tag:
                    raise Bad
                return (T.LITERAL, out, T.LANG_STRING, tag)
            return (T.LITERAL, out, T.XSD + "string", None)
        raise Bad

    try:
        blanks()
        if not at() or at() == "#":
            return []
        out = [term("b"), term(""), term("bl")]
        blanks()
        if at() != ".":
            out.append(term("b"))
            blanks()
        if at() != ".":
            raise Bad
        i += 1
        blanks()
        if at() and at() != "#":
            raise Bad
        return out
    except Bad:
        return None


PIECES = ["<http://x/a>", "<http://x/\\u00e9>", "<http://x/ b>", "<>", "_:b1", "_:b.2.", "_:é-x", "_:", '"text"', '"é\\u00E9\\U0001F600"', '"a\\\\n\\n\\t\\"\\\'"', '"\\x"', '"\\uD800"', '"\\U00110000"', '"\\u12"', '"t"@en', '"t"@en-GB', '"t"@', '"t"@e1', '"1"^^<http://x/t>', '"1"^^', '"open', ".", "..", "#", "# c . <a>", " ", "\t", "  ", '""', "x"]


def test_lines_equal_the_reader_by_hand():
    for _ in range(20_000):
        n = R.randrange(1, 7)
        parts = [R.choice(PIECES) for _ in range(n)]
        if R.random() < 0.7:
            parts = [R.choice(PIECES[:8]), R.choice(PIECES[:3]), R.choice(PIECES[:22]), *([R.choice(PIECES[:8])] if R.random() < 0.4 else []), ".", *([" # c"] if R.random() < 0.2 else [])]
        line = R.choice(["", " ", "  "]).join(parts)
        if R.random() < 0.3:
            k = R.randrange(len(line) + 1)
            line = line[:k] + R.choice(list('<>"\\._:@^# é')) + line[k + R.randrange(2) :]
        assert N.statement(line) == plain(line), line


def any_text():
    return "".join(R.choice(['"', "\\", "\n", "\r", "\t", "\\n", "\\u0041", "é", "👍", "a", " ", "<", ">", "#", ".", "\x00", "\x85", " ", "^^", "@en", "\x7f"]) for _ in range(R.randrange(12)))


def test_round_trip_through_files(spark, tmp_path):
    iri = lambda: "http://x/" + "".join(R.choice(["a", "é", "%20", "#", "<", " ", '"', "\\", "{", "^", "`", "|"]) for _ in range(5))
    rows = []
    for k in range(300):
        dt, tag = R.choice([(T.XSD + "string", None), (T.LANG_STRING, "en-GB"), (T.XSD + "integer", None), (iri(), None)])
        o = (any_text(), T.LITERAL, dt, tag) if k % 3 else (iri(), T.IRI, None, None)
        rows.append((R.choice([iri(), "http://x/g"]), iri(), T.IRI, iri(), *o, None))
    quads = spark.createDataFrame(rows, SCHEMA).repartition(3)
    N.nquads(quads).write.text(str(tmp_path / "q"))
    back = N.read_nquads(spark, str(tmp_path / "q"))
    shown = lambda df: sorted(map(repr, map(tuple, df.drop("o_num").collect())))
    assert shown(back) == shown(quads) and N.bad_lines(spark, str(tmp_path / "q")).count() == 0


def test_blank_nodes_are_scoped_by_file(spark, tmp_path):
    (tmp_path / "a.nq").write_text('_:x <http://x/p> "1" _:g .\n_:x <http://x/q> _:y.\n# comment\n\nnonsense\n<a> <b> .\n')
    (tmp_path / "b.nq").write_text('_:x<http://x/p>"2"^^<http://www.w3.org/2001/XMLSchema#integer>.# end\n')
    got = N.read_nquads(spark, str(tmp_path)).collect()
    assert len(got) == 3 and len({r["s"] for r in got}) == 2 and sorted(r["s"].split("-")[1] for r in got) == ["x"] * 3
    assert {r["o_num"] for r in got} == {None, 2.0} and sum(r["g"].startswith("_:") for r in got) == 1
    assert sorted(r[0] for r in N.bad_lines(spark, str(tmp_path)).collect()) == ["<a> <b> .", "nonsense"]
    assert {r["s"] for r in N.read_nquads(spark, str(tmp_path)).collect()} == {r["s"] for r in got}


def test_template_blank_nodes_are_stable_and_own(spark):
    X = "http://x/"
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string").select(F.when(F.col("v").isNotNull(), T.iri(F.concat(F.lit(X), "v"))).alias("s")).repartition(3)
    s = Solutions(rows, frozenset({"s"}))
    made = construct(s, ("?s", T.iri(X + "p"), "_:n"), ("_:n", T.iri(X + "q"), "_:m"))
    first, again = (sorted(map(repr, made.collect())) for _ in range(2))
    assert first == again == sorted(map(repr, construct(Solutions(rows.coalesce(1), s.maybe), ("?s", T.iri(X + "p"), "_:n"), ("_:n", T.iri(X + "q"), "_:m")).collect()))
    named = made.where(F.col("p")["lex"] == X + "p")
    assert named.count() == 3 and named.select("o").distinct().count() == 3  # equal solutions have nodes of their own
    assert made.where(F.col("p")["lex"] == X + "q").select("s", "o").distinct().count() == 4
    insert = [("?s", X + "p", "_:n"), ("_:n", X + "q", T.literal(1))]
    one, two = (U.instantiate(s, insert, "insert", 0, graph=X + "with") for _ in range(2))
    nodes = lambda df: {r["o"] for r in df.where(F.col("p") == X + "p").collect()}
    assert nodes(one) == nodes(one) <= {r["s"] for r in one.where(F.col("p") == X + "q").collect()}
    assert not nodes(one) & nodes(two) and {r["g"] for r in one.collect()} == {X + "with"}
    try:
        U.instantiate(s, insert, "delete", 0)
    except ValueError:
        return
    raise AssertionError("a blank node was to be deleted")
