"""Stated quantities: readings, entailment of bounds, exact products and quotients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.arithmetic import reduced

#: Words of the comparisons; a plain number states at least that many.
COMPARISONS = {"eq": "", "exactly": "exactly ", "geq": "at least ", "greater": "more than ", "leq": "at most ", "less": "less than ", "about": "about "}
#: Units of time in seconds; month and year by the civil average.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2629746, "year": 31556952}


def _mapped(x: Column, table: dict) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(table.values()))))
    for k, v in table.items():
        out = out.when(x == k, F.lit(v))
    return out


def bound_text(comparison: Column, count: Column) -> Column:
    return F.concat(_mapped(comparison, COMPARISONS), count.cast("string"))


def plural(unit: Column, count: Column) -> Column:
    return F.when(count == 1, unit).otherwise(F.concat(unit, F.lit("s")))


def reading(comparison: Column, count: Column, unit: Column) -> Column:
    return F.concat(bound_text(comparison, count), F.lit(" "), plural(unit, count))


def range_reading(low: Column, high: Column, unit: Column) -> Column:
    return F.concat(low.cast("string"), F.lit(" to "), high.cast("string"), F.lit(" "), plural(unit, high))


def satisfies(comparison: Column, count: Column, bound: Column, limit: Column) -> Column:
    """Whether what is stated, (comparison, count), entails (bound, limit).

    The stated interval must lie in the bound's: from count on for eq and geq, above it for greater, count alone for exactly, and so on;
    about entails nothing.
    """
    at_least = comparison.isin("eq", "geq", "exactly", "greater")
    at_most = comparison.isin("leq", "less", "exactly")
    return (
        F.when(comparison == "about", F.lit(False))
        .when(bound.isin("geq", "eq"), at_least & (count >= limit))
        .when(bound == "greater", at_least & ((count > limit) | ((comparison == "greater") & (count >= limit))))
        .when(bound == "leq", at_most & (count <= limit))
        .when(bound == "less", at_most & ((count < limit) | ((comparison == "less") & (count <= limit))))
        .when(bound == "exactly", (comparison == "exactly") & (count == limit))
        .otherwise(F.lit(False))
    )


def satisfies_in_units(comparison: Column, count: Column, unit: Column, bound: Column, limit: Column, limit_unit: Column) -> Column:
    """The same after both sides are turned into seconds; equal units that are not of time compare as they are, others never."""
    a, b = _mapped(unit, SECONDS), _mapped(limit_unit, SECONDS)
    return F.when(unit == limit_unit, satisfies(comparison, count, bound, limit)).when(a.isNull() | b.isNull(), F.lit(False)).otherwise(satisfies(comparison, count * a, bound, limit * b))


def product(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """Exact product of two fractions in lowest terms."""
    return reduced(n1 * n2, d1 * d2)


def quotient(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """Exact quotient of two fractions in lowest terms; null where the divisor is zero."""
    return F.when(n2 != 0, reduced(n1 * d2, d1 * n2))
