"""Exact and bounded integer arithmetic as Spark expressions. Integers are held to 62 bits; beyond that is an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest magnitude of a bounded integer (62 bits).
LIMIT = 4611686018427387903
EPSILON = 2.220446049250313e-16
#: Named constants.
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045, "inf": float("inf"), "nan": float("nan"), "epsilon": EPSILON}


def bounded(x: Column) -> Column:
    """x, or an error where its magnitude is past LIMIT."""
    return F.when(F.abs(x) > F.lit(LIMIT), F.raise_error(F.lit("integer out of bounds")).cast("bigint")).otherwise(x)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return ((a % b) + b) % b


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b


def truncated(a: Column, b: Column) -> Column:
    """Quotient toward zero."""
    return F.call_function("div", a, b)


def floored(a: Column, b: Column) -> Column:
    """Quotient toward minus infinity."""
    return F.call_function("div", a - modulo(a, b), b)


def greatest_divisor(a: Column, b: Column) -> Column:
    """Euclid's algorithm in a fold; 92 steps are enough for 63 bits."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def top_bit(x: Column) -> Column:
    """Position of the highest set bit of a positive integer."""
    return F.length(F.bin(x)) - 1


def integer_power(base: Column, exponent: Column) -> Column:
    """base ** exponent for exponents from 0 on, refused before it could pass the bound."""
    fits = power_fits(base, exponent)
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(exponent, F.lit(1)).cast("int")), F.lit(1).cast("bigint"), lambda p, _: p * base)
    return F.when(~fits, F.raise_error(F.lit("power out of bounds")).cast("bigint")).when(exponent == 0, F.lit(1).cast("bigint")).otherwise(folded)


def power_fits(base: Column, exponent: Column) -> Column:
    """Whether base ** exponent stays within the bound, without taking it."""
    grows = exponent * F.ln(F.greatest(F.abs(base), F.lit(1)).cast("double"))
    return (exponent >= 0) & (grows <= F.lit(62) * F.ln(F.lit(2.0)))


def shifted_left(x: Column, n: int) -> Column:
    return F.when(F.abs(x) > F.lit(LIMIT >> n), F.raise_error(F.lit("shift out of bounds")).cast("bigint")).otherwise(F.shiftleft(x, n))


def reduced(numerator: Column, denominator: Column) -> Column:
    """A fraction in lowest terms with a positive denominator: struct(n, d)."""
    g = F.greatest(greatest_divisor(numerator, denominator), F.lit(1)) * F.when(denominator < 0, -1).otherwise(1)
    return F.struct(truncated(numerator, g).alias("n"), truncated(denominator, g).alias("d"))


def constant(name: str) -> Column:
    return F.lit(CONSTANTS[name])


def divided(a: Column, b: Column) -> Column:
    """a / b of integers: struct(whole, fraction), whole where b divides a and fraction, a double, where it does not."""
    even = a % b == 0
    return F.struct(F.when(even, truncated(a, b)).alias("whole"), F.when(~even, a.cast("double") / b).alias("fraction"))


def to_integer(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(x).cast("bigint")


def toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def raised(x: Column) -> Column:
    return F.ceil(x).cast("bigint")


def lowered(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def to_float(x: Column) -> Column:
    return x.cast("double")


def exponential(x: Column) -> Column:
    return F.exp(x)


def negated(x: Column) -> Column:
    return bounded(-x)


def shifted_right(x: Column, n: int) -> Column:
    """x / 2 ** n, rounded down."""
    return F.shiftright(x, n)


def successor(x: Column | None = None, y: Column | None = None) -> Column:
    """The unknown one of x and y = x + 1, both natural numbers; null where y is 0, which no natural number precedes."""
    if x is not None:
        return F.when(x < 0, F.raise_error(F.lit("not a natural number")).cast("bigint")).otherwise(bounded(x + 1))
    return F.when(y > 0, y - 1)


def added(x: Column, y: Column, z: Column) -> Column:
    """struct(x, y, z) with x + y = z, the one of the three that is null found from the others; null where the three do not agree."""
    full = F.struct(F.coalesce(x, z - y).alias("x"), F.coalesce(y, z - x).alias("y"), F.coalesce(z, x + y).alias("z"))
    return F.when(full["x"] + full["y"] == full["z"], full)


def between(low: Column, high: Column) -> Column:
    """The integers from low to high, none where high is less, for explode."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
