"""Column expressions for missing values, safe division, interpolation and tail probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def sanitize(c: Column, limit: float = 1e12) -> Column:
    """NaN, infinities and magnitudes above ``limit`` count as missing."""
    return F.when(~F.isnan(c) & (F.abs(c) <= F.lit(limit)), c)


def finite(c: Column) -> Column:
    """NaN and infinities count as missing."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def all_present(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols), F.lit(True))


def at_least(c: Column, bound: Column, tol: float = 1e-9) -> Column:
    """``c >= bound`` up to a relative tolerance, so an interpolated bound keeps its own value."""
    return c >= bound - F.lit(tol) * F.abs(bound)


def at_most(c: Column, bound: Column, tol: float = 1e-9) -> Column:
    return c <= bound + F.lit(tol) * F.abs(bound)


def natural_log(c: Column) -> Column:
    """ln with ln(0) = -Infinity; Spark's own ln(0) is NULL."""
    return F.when(c > 0, F.ln(c)).when(c.isNotNull(), F.lit(float("-inf")))


def order_image(v: Column) -> Column:
    """A whole number per double with the same order: its IEEE bits without the sign, negated below 0.

    Scaling by powers of two is exact, so distinct values have distinct images; -0.0 and 0.0 share one. Not for NaN.
    """
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("double")
    # The logarithm can be off by one next to a power of two.
    exponent = guess - (size < F.pow(F.lit(2.0), guess)).cast("int") + (size >= F.pow(F.lit(2.0), guess + 1)).cast("int")
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)
    normal = (exponent.cast("long") + 1023) * (1 << 52) + fraction.cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    infinite = F.lit(2047 << 52).cast("long")
    bits = F.when(size < 2.0**-1022, tiny).when(size > 1.7976931348623157e308, infinite).otherwise(normal)
    return F.when(v < 0, -bits).otherwise(bits)


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0: a series of positive terms, beyond 2.5 a continued fraction."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(90)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * 2 * x * x / (2 * i + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * x * x / (2 * i + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    near = F.lit(1.0) - F.lit(2.0) / F.sqrt(F.pi()) * F.exp(-x * x) * series
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / F.lit(2.0) / acc)
    return F.when(x < 2.5, near).otherwise(F.exp(-x * x) / F.sqrt(F.pi()) / fraction)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X > x) of the chi-squared distribution with a whole number of degrees of freedom.

    The finite closed sums of the survival side, term by term from logarithms: no term overflows, and small tails
    keep their relative precision.
    """
    y = x / 2
    odd = F.pmod(F.round(df).cast("long"), F.lit(2)) == 1
    half = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    terms = F.floor(df / 2).cast("int")
    # ln of y^(k + half) exp(-y) / Gamma(k + half + 1) for k = 0; each next one adds ln(y / (k + half)).
    first = -y + half * F.ln(y) - F.when(odd, F.ln(F.sqrt(F.pi()) / 2)).otherwise(F.lit(0.0))
    total = F.aggregate(
        F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("log"), F.when(terms > 0, F.exp(first)).otherwise(F.lit(0.0)).alias("total")),
        lambda acc, k: F.struct(
            (acc["log"] + F.ln(y / (k + half))).alias("log"),
            (acc["total"] + F.exp(acc["log"] + F.ln(y / (k + half)))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    tail = F.least(F.lit(1.0), total + F.when(odd, erfc(F.sqrt(y))).otherwise(F.lit(0.0)))
    return F.when(x.isNotNull() & df.isNotNull(), F.when(x <= 0, F.lit(1.0)).otherwise(tail))
