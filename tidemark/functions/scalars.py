"""Scalar expressions: missing values, the normal tail, intervals and text formats."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
Z95_FULL = 1.959964
Z80_POWER = 0.8416212


def finite(x: Column) -> Column:
    """NaN and infinities become null, so ordinary aggregates skip the unmeasurable."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(x) | (F.abs(x) == inf), F.lit(None)).otherwise(x)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null unless the denominator is positive."""
    return F.when(den > 0, num / den)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def rounded(x: Column, digits: int = 6) -> Column:
    """Round for reporting, with negative zero folded into zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def normal_two_sided(z: Column) -> Column:
    """2·(1 − Φ(|z|)) from the series near zero and a continued fraction in the tail."""
    a = F.abs(z.cast("double"))
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.alias("term"), a.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * a * a / (2 * k + 1)).alias("term"),
            (acc["total"] + acc["term"] * a * a / (2 * k + 1)).alias("total"),
        ),
        lambda acc: F.greatest(1 - 2 * density * acc["total"], F.lit(0.0)),
    )
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc,
        lambda acc: 2 * density / acc,
    )
    return F.when(a.isNull(), F.lit(None)).when(a < 3, series).otherwise(fraction)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson 95 % interval for k of n; null when n is 0."""
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, Z95 * Z95
    den = 1 + z2 / n
    centre = p + z2 / (2 * n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    ok = n > 0
    return F.when(ok, (centre - half) / den), F.when(ok, (centre + half) / den)


def substitution_ratio(total: Column, matched: Column) -> Column:
    """Share of above-chance discrimination lost; null when there is no lift to share."""
    lift = total - 0.5
    return F.when(lift > 1e-9, (total - matched) / lift)


def events_per_variable(smaller: Column, n_features: Column) -> Column:
    return smaller.cast("double") / F.greatest(n_features, F.lit(1))


MISSING = "MISSING"


def text3(x: Column) -> Column:
    return F.when(x.isNull(), F.lit(MISSING)).otherwise(F.format_string("%.3f", x.cast("double")))


def text_signed(x: Column) -> Column:
    return F.when(x.isNull(), F.lit(MISSING)).otherwise(F.format_string("%+.3f", x.cast("double")))


def text_percent(x: Column) -> Column:
    return F.when(x.isNull(), F.lit(MISSING)).otherwise(
        F.format_string("%.0f%%", x.cast("double") * 100))


def text_p(p: Column) -> Column:
    """p-value as journals print it; never ``P=0``."""
    return (F.when(p.isNull(), F.lit(MISSING))
            .when(p < 1e-4, F.lit("P<0.0001"))
            .when(p < 1e-3, F.format_string("P=%.4f", p))
            .otherwise(F.format_string("P=%.3f", p)))


def text_ci(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull() | hi.isNull(), F.lit(MISSING)).otherwise(
        F.format_string("[%+.3f, %+.3f]", lo.cast("double"), hi.cast("double")))
