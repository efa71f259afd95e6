"""RDF terms as Spark columns, and the functions on them.

A term is struct<kind, lex, dt, lang>: kind 1 blank node, 2 IRI, 3 literal. An unbound variable is NULL, and so is an
expression error: Spark's three-valued logic then gives the error rules of the query language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
BNODE, IRI, LITERAL = 1, 2, 3
INTEGERS = tuple(XSD + t for t in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte"))
NUMBERS = (*INTEGERS, XSD + "decimal", XSD + "double", XSD + "float")


def make(kind: int, lex: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    lex = lex.cast("string")
    term = F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), (null if dt is None else dt).alias("dt"), (null if lang is None else lang).alias("lang"))
    return F.when(lex.isNotNull(), term)


def iri(value: str | Column) -> Column:
    return make(IRI, F.lit(value) if isinstance(value, str) else value)


def literal(value, dt: str | None = None, lang: str | None = None) -> Column:
    """A literal of a Python value or a column; dt is taken from a Python value's type."""
    if not isinstance(value, Column):
        dt = dt or {bool: XSD + "boolean", int: XSD + "integer", float: XSD + "double"}.get(type(value))
        value = F.lit(str(value).lower() if isinstance(value, bool) else str(value))
    return make(LITERAL, value, F.lit(LANG_STRING if lang else dt or XSD + "string"), F.lit(lang) if lang else None)


def is_iri(t: Column) -> Column:
    return t["kind"] == IRI


def is_blank(t: Column) -> Column:
    return t["kind"] == BNODE


def is_literal(t: Column) -> Column:
    return t["kind"] == LITERAL


def _numeric_type(t: Column) -> Column:
    return is_literal(t) & t["dt"].isin(*NUMBERS)


def number(t: Column) -> Column:
    """The value of a numeric literal as a double; NULL for anything else, ill-formed ones too."""
    return F.when(_numeric_type(t), t["lex"].try_cast("double"))


def _whole(t: Column) -> Column:
    return is_literal(t) & t["dt"].isin(*INTEGERS)


def _exact_type(t: Column) -> Column:
    return is_literal(t) & t["dt"].isin(*INTEGERS, XSD + "decimal")


def _double_type(t: Column) -> Column:
    return is_literal(t) & t["dt"].isin(XSD + "double", XSD + "float")


def integer(t: Column) -> Column:
    """The value of an integer, exact to 37 digits."""
    return F.when(_whole(t) & t["lex"].rlike(r"^[+-]?[0-9]+$"), t["lex"].try_cast("decimal(37,0)"))


def exact(t: Column) -> Column:
    """The value of an integer or a decimal, exact to 18 digits on either side of the point; NULL beyond."""
    return F.when(_exact_type(t), t["lex"].try_cast("decimal(36,18)"))


def plain(value: Column) -> Column:
    """A decimal's text without zeros at its end."""
    lex = value.cast("string")
    return F.when(lex.contains("."), F.regexp_replace(lex, r"\.?0+$", "")).otherwise(lex)


def _double_text(value: Column) -> Column:
    return F.when(value == float("inf"), "INF").when(value == float("-inf"), "-INF").otherwise(value.cast("string"))


def is_numeric(t: Column) -> Column:
    return F.when(t.isNotNull(), number(t).isNotNull())


def string(t: Column) -> Column:
    """STR: an error for blank nodes."""
    return F.when(t["kind"] != BNODE, t["lex"])


def text(t: Column) -> Column:
    """The value of a simple or language-tagged string."""
    return F.when(is_literal(t) & t["dt"].isin(XSD + "string", LANG_STRING), t["lex"])


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.coalesce(t["lang"], F.lit("")))


def lang_matches(tag: Column, range_: Column) -> Column:
    tag, range_ = F.lower(tag), F.lower(range_)
    return F.when(range_ == "*", tag != "").otherwise((tag == range_) | tag.startswith(F.concat(range_, F.lit("-"))))


def datatype(t: Column) -> Column:
    return F.when(is_literal(t), iri(t["dt"]))


def truth(t: Column) -> Column:
    """The effective boolean value."""
    boolean = t["dt"] == XSD + "boolean"
    n = number(t)
    return (
        F.when(~is_literal(t), None)
        .when(boolean, F.coalesce(t["lex"].isin("true", "1"), F.lit(False)))
        .when(_numeric_type(t), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))
        .when(t["dt"].isin(XSD + "string", LANG_STRING), t["lex"] != "")
    )


def same_term(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a.eqNullSafe(b))


def moment(t: Column) -> Column:
    return F.when(is_literal(t) & t["dt"].isin(XSD + "dateTime", XSD + "date"), F.try_to_timestamp(t["lex"]))


def _digits(sign: Column, whole: Column, fraction: Column, shift: Column) -> Column:
    """A text in the order of the numbers that sign, digits before and after the point, and a power of ten denote: the sign, the place of
    the first digit, the digits; below zero in reverse."""
    lead = F.regexp_replace(whole, "^0+", "")
    zeros = F.length(fraction) - F.length(F.regexp_replace(fraction, "^0+", ""))
    place = F.when(lead != "", F.length(lead)).otherwise(-zeros) + shift + 500_000_000
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+|0+$", "")
    up = F.concat(F.lpad(place.cast("string"), 9, "0"), digits)
    down = F.concat(F.lpad((999_999_999 - place).cast("string"), 9, "0"), F.translate(digits, "0123456789", "9876543210"), F.lit("~"))
    return F.when(digits == "", F.lit("3")).when(sign == "-", F.concat(F.lit("2"), down)).otherwise(F.concat(F.lit("4"), up))


_PLAIN = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?$"
_SHORTEST = r"^(-?)([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"


def number_key(t: Column) -> Column:
    """A text in the order of numbers of any type: integers and decimals of any length by their digits, doubles and floats by the shortest
    digits that denote them, -INF before and INF after all, then NaN. Equal numbers have equal keys. NULL for what is no number."""
    part = lambda p, x, i: F.regexp_extract(x, p, i)
    plain_ = F.when(t["lex"].rlike(r"^[+-]?(?:[0-9]+\.?|[0-9]*\.[0-9]+)$"), _digits(part(_PLAIN, t["lex"], 1), part(_PLAIN, t["lex"], 2), part(_PLAIN, t["lex"], 3), F.lit(0)))
    value = F.when(t["dt"] == XSD + "float", t["lex"].try_cast("float").cast("string")).otherwise(t["lex"].try_cast("double").cast("string"))
    shown = _digits(part(_SHORTEST, value, 1), part(_SHORTEST, value, 2), part(_SHORTEST, value, 3), F.coalesce(part(_SHORTEST, value, 4).try_cast("int"), F.lit(0)))
    rough = F.when(value == "NaN", F.lit("6")).when(value == "Infinity", F.lit("5")).when(value == "-Infinity", F.lit("1")).otherwise(shown)
    return F.when(number(t).isNotNull(), F.when(_double_type(t), rough).otherwise(plain_))


def _size(t: Column) -> Column:
    """In the order of the absolute values of integers and decimals of any length."""
    whole = F.regexp_extract(t["lex"], r"^[+-]?0*([0-9]*)", 1)
    return F.struct(F.length(whole), whole, F.regexp_extract(t["lex"], r"\.([0-9]*?)0*$", 1))


def _numbers(a: Column, b: Column, compare: Callable[[Column, Column], Column]) -> Column:
    """compare on two numbers: as doubles, and by their digits where these are equal and both numbers are integers or decimals. Nothing
    holds of NaN."""
    x, y = number(a), number(b)
    fine = F.when(x < 0, compare(_size(b), _size(a))).otherwise(compare(_size(a), _size(b)))
    return F.when((x == y) & _exact_type(a) & _exact_type(b), fine).otherwise(compare(x, y) & ~F.isnan(x) & ~F.isnan(y))


def _moments(a: Column, b: Column, compare: Callable[[Column, Column], Column]) -> Column:
    """compare on two times of one type; a date is no dateTime."""
    return F.when(a["dt"] == b["dt"], compare(moment(a), moment(b)))


def _known(t: Column) -> Column:
    return t["dt"].isin(*NUMBERS, XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date", LANG_STRING)


def _ill_formed(t: Column) -> Column:
    """A literal whose text is not of its type, for types that have values here."""
    numeric = _numeric_type(t) & number(t).isNull()
    times = t["dt"].isin(XSD + "dateTime", XSD + "date") & moment(t).isNull()
    return F.coalesce(numeric | times | ((t["dt"] == XSD + "boolean") & ~t["lex"].isin("true", "false", "1", "0")), F.lit(False))


def equal(a: Column, b: Column) -> Column:
    """`=`: by value where both have one; unlike literals of unknown types, of unlike types of time, and ill-formed ones are an error."""
    boolean = (a["dt"] == XSD + "boolean") & (b["dt"] == XSD + "boolean")
    times = moment(a).isNotNull() & moment(b).isNotNull()
    return (
        F.when(number(a).isNotNull() & number(b).isNotNull(), _numbers(a, b, lambda x, y: x == y))
        .when(times, _moments(a, b, lambda x, y: x == y))
        .when(boolean & ~_ill_formed(a) & ~_ill_formed(b), truth(a) == truth(b))
        .when(same_term(a, b), F.lit(True))
        .when(is_literal(a) & is_literal(b) & (~(_known(a) & _known(b)) | _ill_formed(a) | _ill_formed(b)), F.lit(None).cast("boolean"))
        .when(a.isNotNull() & b.isNotNull(), F.lit(False))
    )


def _ordered(a: Column, b: Column, compare: Callable[[Column, Column], Column]) -> Column:
    """compare on two numbers, strings, times of one type or booleans; an error otherwise."""
    simple = (a["dt"] == XSD + "string") & (b["dt"] == XSD + "string")
    boolean = (a["dt"] == XSD + "boolean") & (b["dt"] == XSD + "boolean") & ~_ill_formed(a) & ~_ill_formed(b)
    return (
        F.when(number(a).isNotNull() & number(b).isNotNull(), _numbers(a, b, compare))
        .when(moment(a).isNotNull() & moment(b).isNotNull(), _moments(a, b, compare))
        .when(simple, compare(a["lex"], b["lex"]))
        .when(boolean, compare(truth(a).cast("int"), truth(b).cast("int")))
    )


def unequal(a: Column, b: Column) -> Column:
    """`!=`."""
    return ~equal(a, b)


def less(a: Column, b: Column) -> Column:
    """`<`."""
    return _ordered(a, b, lambda x, y: x < y)


def greater(a: Column, b: Column) -> Column:
    """`>`."""
    return _ordered(a, b, lambda x, y: x > y)


def at_most(a: Column, b: Column) -> Column:
    """`<=`: not the negation of `>`, as neither holds of NaN."""
    return _ordered(a, b, lambda x, y: x <= y)


def at_least(a: Column, b: Column) -> Column:
    """`>=`."""
    return _ordered(a, b, lambda x, y: x >= y)


def in_(t: Column, *terms: Column) -> Column:
    """IN: true if one is equal; else an error if one comparison is. NOT IN is its negation."""
    out = F.lit(False)
    for x in terms:
        out = out | equal(t, x)
    return out


def sort_key(t: Column) -> Column:
    """Unbound, blank nodes, IRIs, literals; numbers by value, exactly, then times, then text."""
    return F.struct(F.coalesce(t["kind"], F.lit(0).cast("tinyint")).alias("rank"), number_key(t).alias("n"), moment(t).alias("d"), t["lex"].alias("lex"), t["dt"].alias("dt"), t["lang"].alias("lang"))


def wrap(value: Column, like: Column) -> Column:
    """value with the type and tag of a string term."""
    return make(LITERAL, value, like["dt"], like["lang"])


_OPS = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """`+ - * /`. The result's type: double over decimal over integer; integers divide to a decimal. Integers are exact to 37 digits,
    decimals to 18 around the point (9 for products and quotients); what is beyond is reckoned in doubles. Division of exact
    numbers by zero is an error."""
    apply, double, whole = _OPS[op], _double_type(a) | _double_type(b), _whole(a) & _whole(b) & F.lit(op != "/")
    x, y = number(a), number(b)
    if op == "/":
        rough = F.when(y != 0, F.try_divide(x, y)).when(double & (x != 0), F.when(x > 0, float("inf")).otherwise(float("-inf"))).when(double, float("nan"))
    else:
        rough = apply(x, y)
    narrow = (lambda t: exact(t).try_cast("decimal(19,9)")) if op in "*/" else exact
    fine = F.when(_exact_type(a) & _exact_type(b), apply(narrow(a), narrow(b)))
    lex = F.when(double, _double_text(rough)).when(whole, F.coalesce(apply(integer(a), integer(b)).cast("string"), F.format_string("%.0f", rough))).otherwise(F.coalesce(plain(fine), plain(rough.try_cast("decimal(38,9)"))))
    return make(LITERAL, F.when(x.isNotNull() & y.isNotNull(), lex), _numeric_result(double, whole))


def _numeric_result(double: Column, whole: Column) -> Column:
    return F.when(double, F.lit(XSD + "double")).when(whole, F.lit(XSD + "integer")).otherwise(F.lit(XSD + "decimal"))


def negative(t: Column) -> Column:
    """Unary minus."""
    return arithmetic("-", literal(0), t)


def positive(t: Column) -> Column:
    """Unary plus: an error for what is no number."""
    return F.when(number(t).isNotNull(), t)


def _of_number(t: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, in the argument's type."""
    lex = F.when(_double_type(t), _double_text(f(number(t)).cast("double"))).when(_whole(t), f(integer(t)).cast("string")).otherwise(plain(f(exact(t))))
    return make(LITERAL, lex, t["dt"])


def abs_(t: Column) -> Column:
    return _of_number(t, F.abs)


def ceil(t: Column) -> Column:
    return _of_number(t, F.ceil)


def floor(t: Column) -> Column:
    return _of_number(t, F.floor)


def round_(t: Column) -> Column:
    """ROUND: halves go up, also below zero."""
    return _of_number(t, lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")))


def rounded(x: Column) -> Column:
    """round_() of a bare number."""
    return F.floor(x + 0.5)


def if_(condition: Column, yes: Column, no: Column) -> Column:
    """IF: an error in the condition is an error, not `no`."""
    return F.when(condition, yes).when(~condition, no)


def before(s: Column, mark: Column) -> Column:
    at = F.position(mark, s)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.when(at.isNotNull(), F.lit("")))


def after(s: Column, mark: Column) -> Column:
    at = F.position(mark, s)
    return F.when(at > 0, F.substring(s, at + F.length(mark), F.length(s))).otherwise(F.when(at.isNotNull(), F.lit("")))


def upper(t: Column) -> Column:
    return wrap(F.upper(text(t)), t)


def lower(t: Column) -> Column:
    return wrap(F.lower(text(t)), t)


def substr(t: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """SUBSTR: places count from 1; those before the text are skipped. The tag stays."""
    s, start = text(t), F.lit(start) if isinstance(start, int) else start
    size = F.length(s) if length is None else F.lit(length) if isinstance(length, int) else length
    first, end = F.greatest(start, F.lit(1)), start + size
    return wrap(F.substring(s, first, F.greatest(end - first, F.lit(0))), t)


def strlen(t: Column) -> Column:
    return literal(F.length(text(t)), XSD + "integer")


def compatible(a: Column, b: Column) -> Column:
    """Whether b may be looked for in a: a simple text, or one of a's language."""
    return text(a).isNotNull() & text(b).isNotNull() & ((b["dt"] == XSD + "string") | a["lang"].eqNullSafe(b["lang"]))


def contains(a: Column, b: Column) -> Column:
    return F.when(compatible(a, b), F.contains(text(a), text(b)))


def starts(a: Column, b: Column) -> Column:
    return F.when(compatible(a, b), F.startswith(text(a), text(b)))


def ends(a: Column, b: Column) -> Column:
    return F.when(compatible(a, b), F.endswith(text(a), text(b)))


def strbefore(a: Column, b: Column) -> Column:
    """STRBEFORE: what stands before b, with a's type and tag; a simple empty text where b is not in a; an error if they don't fit."""
    at = F.position(text(b), text(a))
    return F.when(compatible(a, b), F.when(at > 0, wrap(F.substring(text(a), F.lit(1), at - 1), a)).otherwise(literal("")))


def strafter(a: Column, b: Column) -> Column:
    """STRAFTER: what stands after b; else as strbefore()."""
    at, found = F.position(text(b), text(a)), wrap(F.substring(text(a), F.position(text(b), text(a)) + F.length(text(b)), F.length(text(a))), a)
    return F.when(compatible(a, b), F.when(at > 0, found).otherwise(literal("")))


def hashed(t: Column, how: str) -> Column:
    """MD5, SHA1, SHA256, SHA384 and SHA512 of a simple text; an error for other terms."""
    s = F.when(is_literal(t) & (t["dt"] == XSD + "string"), t["lex"]).cast("binary")
    return literal({"md5": lambda: F.md5(s), "sha1": lambda: F.sha1(s)}.get(how, lambda: F.sha2(s, int(how[3:])))())


def strlang(s: Column, tag: Column | str) -> Column:
    """STRLANG: of a simple text."""
    simple = F.when(is_literal(s) & (s["dt"] == XSD + "string"), s["lex"])
    return make(LITERAL, simple, F.lit(LANG_STRING), F.lit(tag) if isinstance(tag, str) else text(tag))


def strdt(s: Column, dt: Column | str) -> Column:
    """STRDT: of a simple text and an IRI."""
    simple = F.when(is_literal(s) & (s["dt"] == XSD + "string"), s["lex"])
    return make(LITERAL, simple, F.lit(dt)) if isinstance(dt, str) else F.when(is_iri(dt), make(LITERAL, simple, dt["lex"]))


def bnode(label: Column | None = None, solution: Column | None = None) -> Column:
    """BNODE: a fresh one for each solution; with a label, the same one for the same label in a solution. solution: what tells
    solutions apart, else each row is one."""
    if label is None:
        return make(BNODE, F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    return make(BNODE, F.when(text(label).isNotNull(), F.concat(F.lit("b"), F.sha2(F.concat_ws(" ", (F.monotonically_increasing_id() if solution is None else solution).cast("string"), text(label)), 256))))


def now() -> Column:
    """The same time all through a query."""
    return literal(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), XSD + "dateTime")


def uuid() -> Column:
    return iri(F.concat(F.lit("urn:uuid:"), F.uuid()))


def struuid() -> Column:
    return literal(F.uuid())


def rand() -> Column:
    return literal(F.rand(), XSD + "double")


def resolved(t: Column, base: str) -> Column:
    """IRI() of a text or an IRI under BASE: what has no scheme is set behind the base's scheme (//...), host (/...), text up to the fragment
    (#...), path (?...), or folder; steps . and .. are taken."""
    import re

    scheme, host, path, query = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)?([^?#]*)(\?[^#]*)?", base).groups(default="")
    folder = path[: path.rfind("/") + 1] or ("/" if host else "")
    s = F.coalesce(F.when(is_iri(t), t["lex"]), text(t))
    absolute = s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    full = (
        F.when(absolute, s)
        .when(s.startswith("//"), F.concat(F.lit(scheme), s))
        .when(s.startswith("/"), F.concat(F.lit(scheme + host), s))
        .when(s.startswith("#") | (s == ""), F.concat(F.lit(scheme + host + path + query), s))
        .when(s.startswith("?"), F.concat(F.lit(scheme + host + path), s))
        .otherwise(F.concat(F.lit(scheme + host + folder), s))
    )
    head, tail = F.regexp_extract(full, r"^([^?#]*)", 1), F.regexp_extract(full, r"^[^?#]*(.*)$", 1)
    root, steps = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)", 1), F.split(F.regexp_extract(head, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(.*)$", 1), "/")
    # a step back takes the one before, never the empty one that the path begins with
    back = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))
    taken = F.aggregate(steps, F.array().cast("array<string>"), lambda out, x: F.when(x == ".", out).when(x == "..", back(out)).otherwise(F.concat(out, F.array(x))))
    whole = F.concat(root, F.array_join(taken, "/"), F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")), tail)
    return iri(F.when(~absolute & head.rlike(r"/\.\.?(/|$)"), whole).otherwise(full))


def encode_for_uri(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def replace(s: Column, pattern: str, by: str, flags: str = "") -> Column:
    import re

    if re.match(pattern, ""):
        raise ValueError("the pattern matches the empty string")
    return F.regexp_replace(s, F.lit(f"(?{flags})" * bool(flags) + pattern), F.lit(by))


def regex(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(f"(?{flags})" * bool(flags) + pattern)


_DATE_TIME = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def date_part(t: Column, part: str) -> Column:
    """YEAR to SECONDS of the lexical value, whatever the session's time zone; seconds are a double."""
    at = {"year": 1, "month": 2, "day": 3, "hours": 4, "minutes": 5, "seconds": 6}[part]
    return F.regexp_extract(F.when(is_literal(t), t["lex"]), _DATE_TIME, at).try_cast("double" if part == "seconds" else "int")


def tz(t: Column) -> Column:
    return F.when(is_literal(t) & t["lex"].rlike(_DATE_TIME), F.regexp_extract(t["lex"], _DATE_TIME, 7))


def timezone(t: Column) -> Column:
    """The offset as an xsd:dayTimeDuration's text; an error without one."""
    z = tz(t)
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    lex = F.concat(F.when(z.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    return F.when(z == "Z", F.lit("PT0S")).when(z == "", None).when((hours == 0) & (minutes == 0), F.lit("PT0S")).otherwise(lex)


def cast(t: Column, to: str) -> Column:
    """The xsd constructors; an error where the text is not of the type."""
    lex = string(t)
    if to == "integer":
        whole = F.when(_numeric_type(t), F.regexp_replace(F.coalesce(integer(t).cast("string"), exact(t).cast("string"), F.format_string("%.0f", _cut(number(t)))), r"\..*$", ""))
        shown = F.coalesce(whole, F.when(lex.rlike(r"^\s*[+-]?[0-9]+\s*$"), lex.try_cast("decimal(38,0)").cast("string")), F.when(t["dt"] == XSD + "boolean", truth(t).cast("int").cast("string")))
    elif to == "decimal":
        shown = plain(F.coalesce(exact(t), lex.try_cast("decimal(38,18)")))
    else:
        spark_type = {"double": "double", "float": "float", "boolean": "boolean", "dateTime": "timestamp", "string": "string"}[to]
        value = lex.try_cast(spark_type)
        shown = F.when(value.isNotNull(), lex) if to == "dateTime" else _double_text(value) if to in ("double", "float") else value.cast("string")
    return F.when(shown.isNotNull(), make(LITERAL, shown, F.lit(XSD + to)))


def _cut(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def concat(*terms: Column) -> Column:
    """CONCAT: the tag stays only if all have the same."""
    first = terms[0]
    alike = F.lit(True)
    for t in terms[1:]:
        alike = alike & t["dt"].eqNullSafe(first["dt"]) & t["lang"].eqNullSafe(first["lang"])
    return make(LITERAL, F.concat(*map(text, terms)), F.when(alike, first["dt"]).otherwise(F.lit(XSD + "string")), F.when(alike, first["lang"]))


#: Extension functions: IRI -> a function of columns.
REGISTRY: dict[str, Callable[..., Column]] = {XSD + t: (lambda c, t=t: cast(c, t)) for t in ("integer", "decimal", "double", "float", "boolean", "dateTime", "string")}


def register(name: str, fn: Callable[..., Column]) -> None:
    REGISTRY[name] = fn


def call(name: str, *args: Column) -> Column:
    if name not in REGISTRY:
        raise ValueError(f"no function is registered as {name}")
    return REGISTRY[name](*args)
