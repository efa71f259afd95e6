"""Aggregates of terms, as terms: an error in a group makes its SUM, AVG or GROUP_CONCAT an error; an empty group gives 0 or ""."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.terms import XSD, exact, integer, literal, number, plain, sort_key, string
from ..functions.terms import _double_text as double_text
from ..functions.terms import _double_type as is_double


def count(t: Column, distinct: bool = False) -> Column:
    return F.count_distinct(t) if distinct else F.count(t)


def count_solutions(*names: str, distinct: bool = False) -> Column:
    """COUNT(*), or COUNT(DISTINCT *) over the variables."""
    return F.count_distinct(F.struct(*names)) if distinct else F.count(F.lit(1))


def total(t: Column, distinct: bool = False) -> Column:
    """SUM: exact for integers and decimals, a double as soon as one is."""
    plus = (lambda x: F.sum_distinct(x)) if distinct else F.try_sum
    n, double = number(t), F.coalesce(F.max(is_double(t).cast("int")), F.lit(0)) > 0
    whole = F.count(integer(t)) == F.count(n)
    value = (
        F.when(F.count(n) == 0, literal(0))
        .when(double, literal(double_text(plus(n)), XSD + "double"))
        .when(whole, literal(plus(integer(t).cast("decimal(28,0)")).cast("string"), XSD + "integer"))
        .otherwise(literal(plain(plus(exact(t).cast("decimal(28,9)"))), XSD + "decimal"))
    )
    return F.when(F.count(n) == F.count(F.lit(1)), value)


def average(t: Column, distinct: bool = False) -> Column:
    """AVG: a decimal for integers and decimals, a double as soon as one is."""
    n, double = number(t), F.coalesce(F.max(is_double(t).cast("int")), F.lit(0)) > 0
    mean = lambda x: F.try_divide(F.sum_distinct(x), F.count_distinct(x)) if distinct else F.try_avg(x)
    value = F.when(F.count(n) == 0, literal(0)).when(double, literal(double_text(mean(n)), XSD + "double")).otherwise(literal(plain(mean(exact(t).cast("decimal(24,9)"))), XSD + "decimal"))
    return F.when(F.count(n) == F.count(F.lit(1)), value)


def least(t: Column) -> Column:
    return F.min_by(t, sort_key(t))


def greatest(t: Column) -> Column:
    return F.max_by(t, sort_key(t))


def sample(t: Column) -> Column:
    """Any value; the least, so that runs agree."""
    return least(t)


def group_concat(t: Column, separator: str = " ", distinct: bool = False) -> Column:
    """In the order of the texts, so that runs agree. The text of a group is one value of the result, so it has to fit in a row."""
    s = string(t)
    return F.when(F.count(s) == F.count(F.lit(1)), F.array_join(F.array_sort(F.collect_set(s) if distinct else F.collect_list(s)), separator))
