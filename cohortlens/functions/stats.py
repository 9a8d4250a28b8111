"""Distribution tails as column expressions.

Spark has no error function among its built-ins. All series below are evaluated from the innermost term outwards with
``aggregate`` over a short sequence, so they need no Python worker. They are meant for contrast tables (levels x scores),
not for record-level data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_TERMS = 48      # exact to rounding below SERIES_LIMIT
FRACTION_TERMS = 64    # exact to rounding from SERIES_LIMIT on
SERIES_LIMIT = 3.0
TUKEY_STEP = 0.25      # the trapezoid rule converges faster than any power of the step for this integrand
TUKEY_RANGE = 8.5


def _nested(first: Column | int, step) -> Column:
    """Fold ``step(acc, i)`` over i = first, first-1, ..., 1, starting from 1.0; 1.0 when first is below 1."""
    count = F.lit(first) if isinstance(first, int) else first
    folded = F.aggregate(F.sequence(F.greatest(count, F.lit(1)), F.lit(1), F.lit(-1)), F.lit(1.0), step)
    return F.when(count < 1, F.lit(1.0)).otherwise(folded)


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_upper(x: Column) -> Column:
    """Upper tail of the standard normal distribution, accurate in relative terms far out."""
    size = F.abs(x)
    density = normal_density(size)
    # one half minus phi(x) * (x + x^3/3 + x^5/15 + ...)
    near = F.lit(0.5) - density * size * _nested(SERIES_TERMS, lambda acc, i: 1 + size * size / (2 * i + 1) * acc)
    # phi(x) / (x + 1/(x + 2/(x + ...)))
    far = density / F.aggregate(
        F.sequence(F.lit(FRACTION_TERMS), F.lit(1), F.lit(-1)), size, lambda acc, i: size + i / acc
    )
    tail = F.when(size < SERIES_LIMIT, near).otherwise(far)
    return F.when(x < 0, 1 - tail).otherwise(tail)


def normal_lower(x: Column) -> Column:
    return normal_upper(-x)


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_upper(F.abs(z)))


def tukey_upper(q: Column, groups: Column) -> Column:
    """P(range of ``groups`` independent standard normals > q): the studentized range with infinite error df.

    1 - k * integral of phi(x) * (Phi(x) - Phi(x - q))^(k-1) dx, on a fixed grid of x.
    """
    steps = int(round(2 * TUKEY_RANGE / TUKEY_STEP))
    nodes = [-TUKEY_RANGE + TUKEY_STEP * i for i in range(steps + 1)]
    grid = F.array(*[
        F.struct(
            F.lit(x).alias("x"),
            F.lit(math.exp(-x * x / 2) / math.sqrt(2 * math.pi) * TUKEY_STEP).alias("weight"),
            F.lit(math.erfc(-x / math.sqrt(2)) / 2).alias("below"),
        )
        for x in nodes
    ])
    inside = F.aggregate(
        grid,
        F.lit(0.0),
        lambda acc, node: acc + node["weight"] * F.pow(node["below"] - normal_lower(node["x"] - q), groups - 1),
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - groups * inside))


def chi_square_upper(x: Column, df: Column) -> Column:
    """Upper tail of chi-square with whole df >= 1, by the finite sums for even and odd df."""
    half = x / 2
    terms = (F.floor(df / 2)).cast("int")
    even = F.exp(-half) * _nested(terms - 1, lambda acc, i: 1 + half / i * acc)
    odd_sum = F.exp(-half) * F.sqrt(2 * x / math.pi) * _nested(terms - 1, lambda acc, i: 1 + half / (i + 0.5) * acc)
    odd = 2 * normal_upper(F.sqrt(x)) + F.when(terms >= 1, odd_sum).otherwise(0.0)
    return F.when(x <= 0, F.lit(1.0)).when(df % 2 == 0, even).otherwise(odd)


def mixture_upper(x: Column, free: Column, edges: Column, most_edges: int) -> Column:
    """Upper tail of the mixture of chi-squares that holds on the edge of the space of variances.

    ``free`` parameters are free on both sides of their values under the smaller model, ``edges`` (at most ``most_edges``)
    are variances that are zero there and cannot be negative: each of those counts with probability one half. Chi-square
    with no degrees of freedom is a point at zero.
    """
    total = F.lit(0.0)
    for j in range(most_edges + 1):
        # binomial weight, zero beyond the number of edges
        ways = F.lit(1.0)
        for i in range(j):
            ways = ways * (edges - i) / (i + 1)
        df = free + j
        tail = F.when(df == 0, F.when(x > 0, F.lit(0.0)).otherwise(1.0)).otherwise(chi_square_upper(x, F.greatest(df, F.lit(1))))
        total = total + F.when(edges >= j, ways * F.pow(F.lit(2.0), -edges) * tail).otherwise(0.0)
    return total
