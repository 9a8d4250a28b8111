"""Profile of the Laplace criterion over candidate variances of the unit effects.

Candidates are models of one batch: the counted cells meet a small table of candidates, and every candidate carries its own
solution of fixed and unit effects from pass to pass. So a grid costs the passes of one fit, not one fit per point. Besides
the height of the criterion every candidate knows its derivative, which tells on which side the optimum lies and lets the next
grid close in on it from both sides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortlens.operators.cells import merge_cells
from cohortlens.operators.mixed import FitSet, ModelFit, fit_mixed_logit, require_finished
from cohortlens.session import checkpoint_dir, small_table

GRID = (1e-3, 1e-2, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
PROFILE_DDL = "variance double, log_lik double, slope double, passes int, converged boolean"


@dataclass
class Profile:
    """All candidates tried, the best of them with its fit, and whether the optimum was enclosed to the tolerance."""

    table: DataFrame
    variance: float
    best: ModelFit
    fit: FitSet
    enclosed: bool


def fit_candidates(
    cells: DataFrame, variances: Sequence[float], fixed: str = "interaction", random: str = "intercept", **options
) -> FitSet:
    """One model per candidate, named by its place; unit effects independent with the candidate's variance."""
    names = [f"v{i:03d}" for i in range(len(variances))]
    return fit_mixed_logit(
        cells, designs={name: (fixed, random) for name in names}, variance=dict(zip(names, map(float, variances))), **options
    )


def _rows(fit: FitSet, variances: Sequence[float]) -> list[tuple[float, ModelFit]]:
    return [(float(v), fit.models[f"v{i:03d}"]) for i, v in enumerate(variances)]


def variance_profile(
    cells: DataFrame, variances: Sequence[float] = GRID, fixed: str = "interaction", random: str = "intercept",
    allow_unfinished: bool = False, **options,
) -> DataFrame:
    """``variance, log_lik, slope, passes, converged`` per candidate. ``slope`` is the derivative of the log-likelihood in the
    logarithm of the variance."""
    fit = fit_candidates(cells, variances, fixed, random, **options)
    require_finished(fit, allow_unfinished)
    return small_table(
        fit.spark, [(v, m.log_lik, m.slope, m.passes, m.converged) for v, m in _rows(fit, variances)], PROFILE_DDL
    )


def search_profile(
    cells: DataFrame, fixed: str = "interaction", random: str = "intercept", grid: Sequence[float] = GRID,
    tol: float = 1e-7, points: int = 5, max_rounds: int = 8, **options,
) -> Profile:
    """The best common variance of independent unit effects by grids that close in on the root of the slope.

    A round takes the two neighbouring candidates between which the slope changes sign, estimates the root on the cubic
    through their slopes and heights, and lays the next candidates around it, closer every time. An optimum at the lower
    end of the grid is followed down to zero, where all unit effects vanish; one above the upper end is followed upwards.
    """
    if len(grid) < 2 or min(grid) <= 0:
        raise ValueError("a grid needs two positive variances")
    checkpoint_dir(cells.sparkSession)
    counted = merge_cells(cells).checkpoint()
    seen: dict[float, ModelFit] = {}
    variances, fit, enclosed = sorted(map(float, grid)), None, False
    fits: dict[float, FitSet] = {}
    for _ in range(max_rounds):
        fit = fit_candidates(counted, variances, fixed, random, **options)
        require_finished(fit)
        for v, model in _rows(fit, variances):
            seen[v], fits[v] = model, fit
        known = sorted(seen)
        rising = [v for v in known if v > 0 and seen[v].slope > 0]
        falling = [v for v in known if v > 0 and seen[v].slope <= 0]
        if not falling:
            variances = [known[-1] * 4, known[-1] * 16]
        elif not rising or min(falling) < max(rising):
            # downhill from the lowest candidate on: smaller ones, and none at all
            if 0.0 in seen:
                if not rising:
                    enclosed = True
                break
            low = min(falling)
            variances = [0.0, low / 100, low / 10]
        else:
            a, b = math.log(max(rising)), math.log(min(falling))
            if b - a < tol:
                enclosed = True
                break
            root = _root(a, b, seen[max(rising)], seen[min(falling)])
            near = max(tol / 4, (b - a) ** 2 / 50)
            steps = [near * 8**k for k in range(points // 2)]
            laid = {root, *(root - d for d in steps), *(root + d for d in steps)}
            variances = sorted(math.exp(x) for x in laid if a < x < b) or [math.exp((a + b) / 2)]
    best = max(seen, key=lambda v: (seen[v].log_lik, v))
    if enclosed and rising:
        # heights no longer tell neighbours apart; the smaller slope does
        best = min((max(rising), min(falling)), key=lambda v: abs(seen[v].slope))
    table = small_table(
        fit.spark, [(v, seen[v].log_lik, seen[v].slope, seen[v].passes, seen[v].converged) for v in sorted(seen)], PROFILE_DDL
    )
    return Profile(table, best, seen[best], fits[best], enclosed)


def _root(a: float, b: float, left: ModelFit, right: ModelFit) -> float:
    """Where the slope vanishes between a and b: the cubic through both heights and slopes, else the straight line."""
    width = b - a
    linear = a + width * left.slope / (left.slope - right.slope)
    rise = (right.log_lik - left.log_lik) / width
    # derivative of the Hermite cubic as a quadratic in t, from 0 at a to 1 at b
    q2 = 3 * (left.slope + right.slope - 2 * rise)
    q1 = 2 * (3 * rise - 2 * left.slope - right.slope)
    disc = q1 * q1 - 4 * q2 * left.slope
    # near the optimum heights differ by less than their rounding
    trusted = abs(right.log_lik - left.log_lik) > 1e-9 * abs(left.log_lik)
    if trusted and disc >= 0:
        for t in ((-q1 + sign * math.sqrt(disc)) / (2 * q2) for sign in (1, -1) if q2):
            if 0 < t < 1:
                return a + width * t
    return min(max(linear, a + width * 1e-3), b - width * 1e-3)
