"""Mixed logistic regression as iterated Spark aggregations over cells.

Model for level g of unit j at score s: log odds = a_g + c_g s + (N u_j)_g, with u_j normal. The fit maximizes the
penalized likelihood over fixed and unit effects for a given covariance, and takes the covariance that minimizes the
Laplace criterion built on that solution (no adaptive quadrature over the fixed effects).

One pass:

1. unit effects are updated from the sums of the last pass (batched algebra per unit, ``mapInArrow``);
2. cells are joined with them and summed per model, unit and level by built-in expressions. Models of the same records share
   one set of cells: a cell row meets the effects of each of them. Cells are cached hash-partitioned by set and unit (one
   number, the node), so neither this join nor the sums move them: only the effects, one row per model and unit, are
   exchanged, with models as numbers; what is equal for all units of a model (its slopes) is a constant of the pass;
3. the sums, again one row per unit, are checkpointed, which keeps the plan flat and survives the loss of executors;
4. what units add to the equations of the fixed effects is added up within tasks and then by Spark. The driver sees only
   these totals, whose size depends on the number of levels and models.

A unit whose cells are too many for one task (possible only if the score is continuous) is split by salt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.cohort import level_table
from cohortlens.operators.unit_algebra import (
    SUMS, Design, Search, Step, contribution_shapes, unit_contributions, updated_effects,
)
from cohortlens.session import checkpoint_dir, ship_package, small_table, stored

CELLS_PER_TASK = 1_000_000
UNITS_PER_TASK = 4_000    # in the batched algebra, where a unit costs about levels^3 operations
UNITS_PER_JOIN = 200_000   # in the hash table that cells are joined with
EFFECT_COLUMNS = ["m", "node", "salts", "v", "previous", "off"]
EFFECTS_SCHEMA = "m int, node bigint, salts int, v array<double>, previous array<double>, off array<double>"
START_TOL = 1e-2           # for a fit that only serves as a start; the search moves all parameters on
MAX_ALGEBRA = 20_000_000   # numbers held on the driver for the models fitted together: levels^4 / 4 each with vector effects
BATCH_VALUES = 4_000_000   # bound on the numbers held at once by the batched algebra


@dataclass
class ModelFit:
    """Estimates of one model, in level parameters on the original score scale."""

    name: str
    design: Design
    levels: list[str]
    level_coef: np.ndarray      # intercepts of all levels, then slopes
    level_cov: np.ndarray
    covariance: np.ndarray      # of the random effects, per level or of the one intercept
    log_lik: float
    n_obs: int
    n_units: int
    passes: int
    converged: bool
    runaway: tuple[str, ...] = ()   # levels without deaths or survivors, whose log odds have no finite estimate
    given: bool = False             # whether the covariance was given rather than searched for
    slope: float | None = None      # derivative of the log-likelihood in the logarithm of a common variance
    fisher: np.ndarray | None = None   # information of the log-likelihood in the covariance's lower triangle

    @property
    def n_par(self) -> int:
        return self.design.n_fixed + self.design.n_variance


@dataclass
class FitSet:
    """Fits made together. ``cells`` has the counted cells of every model and ``unit_effects`` the log-odds offset and slope of
    every unit and level; both are by ``model``, ``unit`` and ``node``, a number for the unit."""

    spark: SparkSession
    models: dict[str, ModelFit]
    level_names: list[str]
    cells: DataFrame
    unit_effects: DataFrame
    center: float
    spread: float


def require_finished(fit: FitSet, allow_unfinished: bool = False) -> None:
    """Refuse fits that stopped before their equations were solved.

    A level without deaths or survivors moves on for ever, but its information vanishes and the other equations get solved
    all the same, so such a level is no excuse.
    """
    unfinished = [name for name, model in fit.models.items() if not model.converged]
    if unfinished and not allow_unfinished:
        raise ValueError(f"not converged: {', '.join(unfinished)}")


def stack_models(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same cells for several models that are fitted together."""
    return df.withColumn("model", F.explode(F.array(*[F.lit(name) for name in names])))


# ---------------------------------------------------------------------------------------------------------------------
# Arrow batches <-> arrays


def _list_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _matrix_list(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def _model_batches(batch: pa.RecordBatch, designs: Mapping[int, Design]) -> Iterator[tuple[int, pa.RecordBatch, dict]]:
    """Rows of each model in bounded pieces, with the sums as units x levels matrices of the levels it has."""
    numbers = batch.column("m").to_numpy(zero_copy_only=False)
    for m in sorted(set(numbers.tolist())):
        design = designs[m]
        rows_at_once = max(1, BATCH_VALUES // max(1, design.n_fixed * design.n_random))
        place = np.full(max(design.levels) + 1, -1)
        place[list(design.levels)] = np.arange(len(design.levels))
        of_model = batch.filter(pa.array(numbers == m))
        for start in range(0, of_model.num_rows, rows_at_once):
            part = of_model.slice(start, rows_at_once)
            column = part.column("sums")
            row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            entries = column.flatten()
            level = place[entries.field("lev").to_numpy(zero_copy_only=False)]
            sums = {}
            for key in SUMS:
                sums[key] = np.zeros((len(column), len(design.levels)))
                sums[key][row, level] = entries.field(key).to_numpy(zero_copy_only=False)
            yield m, part, sums


def _contribution_task(designs: Mapping[int, Design], factors: Mapping[int, np.ndarray]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, part, sums in _model_batches(batch, designs):
                v = _list_matrix(part.column("v"), designs[m].n_random)
                added = unit_contributions(sums, v, factors[m], designs[m])
                totals[m] = totals[m] + added if m in totals else added
        for m, vector in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), _matrix_list(vector[None, :])], ["m", "parts"])

    return task


def _effect_columns(
    part: pa.RecordBatch, v: np.ndarray, previous: np.ndarray, beta: np.ndarray, factor: np.ndarray, design: Design,
    n_levels: int,
) -> pa.RecordBatch:
    g, at = len(design.levels), list(design.levels)
    fixed = design.fixed_map @ beta
    off = np.zeros((len(v), n_levels))
    off[:, at] = fixed[:g] + v @ factor.T @ design.random_map.T
    return pa.RecordBatch.from_arrays(
        [*(part.column(name) for name in EFFECT_COLUMNS[:3]), *map(_matrix_list, (v, previous, off))], EFFECT_COLUMNS
    )


def _update_task(
    designs: Mapping[int, Design], factors: Mapping[int, np.ndarray], steps: Mapping[int, Step], n_levels: int
):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, part, sums in _model_batches(batch, designs):
                design, step = designs[m], steps[m]
                v = _list_matrix(part.column("v"), design.n_random)
                previous = _list_matrix(part.column("previous"), design.n_random)
                new = updated_effects(sums, v, previous, factors[m], step, design)
                kept = v if step.backtrack is None else previous
                yield _effect_columns(part, new, kept, step.beta, step.factor, design, n_levels)

    return task


# ---------------------------------------------------------------------------------------------------------------------
# Spark passes


def _with_sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What every cell contributes, given its linear predictor ``eta``; one exponential, safe for any size of eta."""
    n, k, eta, e, mu = (F.col(c) for c in ("n", "k", "eta", "e", "mu"))
    kept = [*keys, "s", "n", "k", "eta"]
    shrunk = df.select(*kept, F.exp(-F.abs(eta)).alias("e"))
    weighted = shrunk.select(
        *kept, "e", (F.when(eta < 0, e).otherwise(1.0) / (1 + e)).alias("mu"), (n * e / ((1 + e) * (1 + e))).alias("w")
    )
    return weighted.select(
        *keys, "s", "w",
        (k - n * mu).alias("r"),
        (F.col("w") * (1 - 2 * mu)).alias("t"),
        (k * eta - n * (F.greatest(eta, F.lit(0.0)) + F.log1p(e))).alias("likelihood"),
    )


def _sum_columns():
    s = F.col("s")
    values = [F.col("w"), F.col("w") * s, F.col("w") * s * s, F.col("r"), F.col("r") * s, F.col("t"), F.col("t") * s,
              F.col("likelihood")]
    return [F.sum(value).alias(name) for name, value in zip(SUMS, values)]


def _level_slopes(design: Design, beta: np.ndarray, n_levels: int) -> list[float]:
    """Slope of every level of the common list; zero where the model lacks it."""
    slope = np.zeros(n_levels)
    slope[list(design.levels)] = (design.fixed_map @ beta)[len(design.levels) :]
    return slope.tolist()


def unit_sums(
    packed: DataFrame, effects: DataFrame, slopes: Mapping[int, list[float]], keys: Sequence[str], partitions: int
) -> DataFrame:
    """One row per model and unit: its effects and the sums of its cells per level. Effects come partitioned by node.

    With ``keys`` = (node) the cells stay where they are cached. With a salt among the keys each piece of a split unit is
    summed in its own task first, and only these sums are exchanged.
    """
    sides = effects.select("m", "node", "salts", "off")
    if "salt" in keys:
        sides = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).repartition(
            partitions, *keys
        )
    joined = packed.join(sides.hint("shuffle_hash"), list(keys))
    # a constant array per model; models that are not in this pass have no effects here either
    none = [0.0] * max(map(len, slopes.values()))
    slope = F.lit([slopes.get(m, none) for m in range(max(slopes) + 1)])
    with_eta = joined.withColumn(
        "eta", F.get("off", F.col("lev")) + F.get(F.get(slope, F.col("m")), F.col("lev")) * F.col("s")
    )
    summed = _with_sums(with_eta, ["m", "node", "lev"]).groupBy("node", "m", "lev").agg(*_sum_columns())
    per_unit = summed.groupBy("node", "m").agg(F.collect_list(F.struct("lev", *SUMS)).alias("sums"))
    # both sides lie by node; as a second key the model would ask for an exchange
    same_model = (F.col("summed_m") - F.col("m")) == 0
    return per_unit.withColumnRenamed("m", "summed_m").join(effects.hint("shuffle_hash"), "node").where(same_model).drop("summed_m")


def total_contributions(
    state: DataFrame, designs: Mapping[int, Design], factors: Mapping[int, np.ndarray], tasks: int
) -> dict[int, np.ndarray]:
    """Sums over units per model. Tasks pre-add their units; several tasks are added up by Spark, entry by entry."""
    parts = state.select("m", "sums", "v").coalesce(tasks).mapInArrow(
        _contribution_task(designs, factors), "m int, parts array<double>"
    )
    entries = parts.select("m", F.posexplode("parts").alias("pos", "part"))
    totals = {m: np.zeros(algebra_size(design)) for m, design in designs.items()}
    for row in entries.groupBy("m", "pos").agg(F.sum("part").alias("part")).collect():
        totals[row["m"]][row["pos"]] = row["part"]
    return totals


def fit_fixed(
    pooled: DataFrame, designs: Mapping[str, Design], cell_sets: Mapping[str, str], tol: float = 1e-20, max_passes: int = 100,
    odds: Mapping[tuple[str, int], float] | None = None, runaway: Mapping[str, Sequence[int]] | None = None,
) -> dict[str, dict]:
    """Logistic fits without unit effects, by Newton steps; every pass is one aggregation to model x level rows. They start
    from the odds per model and level, without slopes. ``runaway`` names levels by model whose own parameters move on for ever
    and are not waited for."""
    spark = pooled.sparkSession
    found = {name: {"beta": np.zeros(d.n_fixed), "ll": -np.inf, "move": None} for name, d in designs.items()}
    for name, design in designs.items() if odds else ():
        found[name]["beta"][: len(design.levels)] = [math.log(odds[name, lev]) for lev in design.levels]
    active = set(designs)
    for passes in range(1, max_passes + 1):
        rows = []
        for name in sorted(active):
            design, g = designs[name], len(designs[name].levels)
            fixed = design.fixed_map @ found[name]["beta"]
            rows += [
                (name, cell_sets[name], lev, float(fixed[i]), float(fixed[g + i])) for i, lev in enumerate(design.levels)
            ]
        params = small_table(spark, rows, "model string, cell_set string, lev int, a double, c double")
        summed = _with_sums(
            pooled.join(F.broadcast(params), ["cell_set", "lev"]).withColumn("eta", F.col("a") + F.col("c") * F.col("s")),
            ["model", "lev"],
        ).groupBy("model", "lev").agg(*_sum_columns()).collect()
        for name in sorted(active):
            design, fit = designs[name], found[name]
            place = {lev: i for i, lev in enumerate(design.levels)}
            sums = {key: np.zeros(len(place)) for key in SUMS}
            for row in summed:
                if row["model"] == name:
                    for key in SUMS:
                        sums[key][place[row["lev"]]] = row[key]
            ll = sums["ll"].sum()
            if fit["move"] is not None and ll < fit["ll"] - 1e-9 * abs(fit["ll"]):
                fit["move"] = fit["move"] / 2
                fit["beta"] = fit["beta"] - fit["move"]
                continue
            m, g = design.fixed_map, len(place)
            m0, m1 = m[:g], m[g:]
            w0, w1, w2 = (sums[key][:, None] for key in ("w0", "w1", "w2"))
            info = m0.T @ (w0 * m0) + m0.T @ (w1 * m1) + m1.T @ (w1 * m0) + m1.T @ (w2 * m1)
            score = m0.T @ sums["r0"] + m1.T @ sums["r1"]
            move = Search._solve(info, score)
            enough = tol * max(1.0, abs(ll)) if design.random == "none" else START_TOL
            lost = [place[lev] for lev in (runaway or {}).get(name, ())]
            waited = (np.delete(m, [*lost, *(g + i for i in lost)], axis=0) != 0).any(axis=0)
            fit.update(ll=ll, info=info, passes=passes, converged=bool(score[waited] @ move[waited] < enough))
            if fit["converged"]:
                active.discard(name)
            else:
                fit["move"] = move
                fit["beta"] = fit["beta"] + move
        if not active:
            break
    return found


def fit_mixed_logit(
    cells: DataFrame,
    fixed: str = "interaction",
    random: str = "level",
    designs: Mapping[str, tuple[str, str]] | None = None,
    levels: Sequence[str] | None = None,
    tol: float = 1e-8,
    max_passes: int = 100,
    max_algebra: int = MAX_ALGEBRA,
    variance: float | Mapping[str, float] | None = None,
    covariance: np.ndarray | Mapping[str, np.ndarray] | None = None,
) -> FitSet:
    """Fit several models in one loop.

    With a column ``model`` in ``cells``, one model per value of it. Without, all models named in ``designs`` on one and the same
    set of cells, or a single one. ``fixed``: ``interaction`` (score x level) or ``additive`` (score + level). ``random``:
    ``level`` (a vector of level effects per unit with free covariance), ``intercept`` (one effect per unit) or ``none``.
    ``designs`` gives (fixed, random) by model name. ``levels`` fixes the order of the levels; cells of other levels are
    left out. A level without cells in a model is left out of that model; one whose cells all have the same score takes the
    slope of the first level that has its own. A model stops by itself once converged: the expected gain in the criterion
    is below ``tol`` and the fixed and unit effects solve their equations.

    The totals of a pass hold about levels^4 / 4 numbers for a model with a vector of level effects. Models are fitted in
    groups whose totals stay within ``max_algebra`` numbers; a single model beyond it is refused.

    With ``variance`` the unit effects are taken as independent with that variance, with ``covariance`` (rows and columns in
    the order of the levels; one by one for ``intercept``) as jointly normal with that covariance, which may be singular,
    and only the rest is fitted. Either is one value for all models or one by model name; models that a mapping leaves out
    search for theirs in the same loop.
    """
    if variance is not None and covariance is not None:
        raise ValueError("give a variance or a covariance, not both")
    spark = cells.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    keyed = "model" in cells.columns
    cell_set = F.col("model") if keyed else F.lit("all")
    # from here on the source is not read again; in columns the cells take a fraction of a checkpoint's size and reading time
    counted = stored(cells.select(
        cell_set.alias("cell_set"), "unit", "level", F.col("saps").cast("double").alias("saps"), "n", "k"
    ), "cells")

    if levels is not None:
        counted = counted.where(F.col("level").isin(list(levels)))
    # counts over all units, of which margins and the fits without unit effects are made
    pooled = stored(counted.groupBy("cell_set", "level", "saps").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), F.sum("k").alias("k")
    ), "pooled")
    margins = pooled.groupBy("cell_set", "level").agg(
        F.sum("cells").alias("cells"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("saps")).alias("ns"), F.sum(F.col("n") * F.col("saps") * F.col("saps")).alias("nss"),
        F.min("saps").alias("low"), F.max("saps").alias("high"), F.sum("k").alias("k"),
    )
    # a level costs hundreds of numbers at the least
    margins = margins.limit(max_algebra // 100 + 1).collect()
    if not margins:
        raise ValueError("no cells to fit")
    if len(margins) > max_algebra // 100:
        raise ValueError("more levels than max_algebra allows")
    # which cells each model is fitted to
    cell_sets = {row["cell_set"]: row["cell_set"] for row in margins} if keyed else {m: "all" for m in designs or ["model"]}
    margins_of = lambda name: [row for row in margins if row["cell_set"] == cell_sets[name]]
    level_names = list(levels) if levels is not None else sorted({row["level"] for row in margins})
    place = {level: i for i, level in enumerate(level_names)}
    positions = level_table(spark, level_names).select("level", (F.col("idx") - 1).alias("lev"))
    coded, pooled = (df.join(F.broadcast(positions), "level").drop("level") for df in (counted, pooled))

    total = sum(row["n"] for row in margins)
    center = sum(row["ns"] for row in margins) / total
    spread = math.sqrt(max(sum(row["nss"] for row in margins) / total - center * center, 0.0)) or 1.0
    names = sorted(cell_sets)
    plans: dict[str, Design] = {}
    for name in names:
        f, r = (designs or {}).get(name, (fixed, random))
        mine = sorted((place[row["level"]], row["low"] == row["high"]) for row in margins_of(name))
        plans[name] = Design(f, r, tuple(at for at, _ in mine), tuple(i for i, (_, one) in enumerate(mine) if one))
    n_obs = {name: sum(row["n"] for row in margins_of(name)) for name in names}

    coded, pooled = (df.withColumn("s", (F.col("saps") - center) / spread) for df in (coded, pooled))
    runaway = {
        name: tuple(row["level"] for row in margins_of(name) if row["k"] in (0, row["n"])) for name in names
    }
    odds = {
        (name, place[row["level"]]): (row["k"] + 0.5) / (row["n"] - row["k"] + 0.5) for name in names for row in margins_of(name)
    }
    given = {name: _given_factor(name, design, len(level_names), variance, covariance) for name, design in plans.items()}
    models, final_cells, final_effects = {}, [], []
    for group in _groups(plans, max_algebra):
        sets = sorted({cell_sets[name] for name in group})
        own = coded.where(F.col("cell_set").isin(sets)) if keyed and len(group) < len(plans) else coded
        made, own, effects = _fit_group(
            spark, own, pooled, {name: plans[name] for name in group}, cell_sets, odds, level_names, n_obs,
            sum(row["cells"] for row in margins if row["cell_set"] in sets), center, spread, tol, max_passes, runaway, given,
        )
        models |= made
        of_model = small_table(spark, [(name, cell_sets[name]) for name in group], "model string, cell_set string")
        final_cells.append(
            own.join(F.broadcast(of_model), "cell_set").select("model", "unit", "node", "lev", "s", "saps", "n", "k")
        )
        final_effects.append(effects.select("model", "unit", "node", "off", "slope"))
    return FitSet(
        spark, models, level_names, reduce(DataFrame.unionByName, final_cells), reduce(DataFrame.unionByName, final_effects),
        center, spread,
    )


def _given_factor(name: str, design: Design, n_levels: int, variance, covariance) -> np.ndarray | None:
    """Any factor of the covariance given for a model, or None where it is to be searched for."""
    q = design.n_random
    value = variance.get(name) if isinstance(variance, Mapping) else variance
    if value is not None:
        if not value >= 0:
            raise ValueError(f"{name}: a variance cannot be {value}")
        return math.sqrt(value) * np.eye(q)
    matrix = covariance.get(name) if isinstance(covariance, Mapping) else covariance
    if matrix is None or q == 0:
        return None
    matrix = np.asarray(matrix, float)
    size = n_levels if design.random == "level" else 1
    if matrix.shape != (size, size) or not np.allclose(matrix, matrix.T):
        raise ValueError(f"{name}: the covariance must be symmetric, {size} x {size}")
    if design.random == "level":
        # levels without cells in this model take no part
        matrix = matrix[np.ix_(design.levels, design.levels)]
    values, vectors = np.linalg.eigh(matrix)
    if values.min() < -1e-10 * max(1.0, values.max()):
        raise ValueError(f"{name}: the covariance has a negative direction")
    return vectors * np.sqrt(np.maximum(values, 0.0))


def algebra_size(design: Design) -> int:
    return sum(int(np.prod(shape)) for shape in contribution_shapes(design).values())


def _groups(plans: Mapping[str, Design], max_algebra: int) -> list[list[str]]:
    """Models in groups whose totals stay within the bound."""
    groups, held = [[]], 0
    for name, design in plans.items():
        size = algebra_size(design)
        if size > max_algebra:
            raise ValueError(f"{name}: {len(design.levels)} levels need {size} numbers, more than max_algebra = {max_algebra}")
        if groups[-1] and held + size > max_algebra:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += size
    return groups


def _fit_group(
    spark, coded, pooled, plans, cell_sets, odds, level_names, n_obs, n_cells, center, spread, tol, max_passes, runaway, given
) -> tuple[dict[str, ModelFit], DataFrame, DataFrame]:
    """Fit some models together: their results, the cells with nodes, the unit effects."""
    names = list(plans)
    at = {level: i for i, level in enumerate(level_names)}
    lost = {name: [at[level] for level in runaway[name]] for name in names}
    simple = fit_fixed(pooled, plans, cell_sets, odds=odds, runaway=lost)

    coded, per_unit, sizes = _with_nodes(coded)
    n_units = {name: row["units"] for row in sizes for name in names if cell_sets[name] == row["cell_set"]}
    largest = max(row["largest"] for row in sizes)

    number = {name: m for m, name in enumerate(names)}
    mixed = {name: design for name, design in plans.items() if design.random != "none"}
    searches = {name: Search(design, simple[name]["beta"], tol, given[name]) for name, design in mixed.items()}
    # models without unit effects take part in the table of unit effects with their fixed part only
    effects = _start_effects(spark, per_unit, plans, number, cell_sets, simple, len(level_names))
    finished = [effects.where(F.col("m").isin([number[n] for n in names if n not in mixed]))]
    if mixed:
        finished.append(_run_search(
            coded, effects.where(F.col("m").isin([number[n] for n in mixed])), {number[n]: d for n, d in mixed.items()},
            {number[n]: search for n, search in searches.items()}, len(level_names), n_cells, largest,
            sum(n_units[name] for name in mixed), max_passes,
        ))

    models = {}
    betas = {}
    for name, design in plans.items():
        search = searches.get(name)
        if search is None:
            fit = simple[name]
            beta, info, log_lik = fit["beta"], fit["info"], fit["ll"]
            covariance, passes, converged = np.zeros((0, 0)), fit["passes"], fit["converged"]
            slope = fisher = None
        else:
            parts = search.parts
            beta, info = search.solution, (parts["info"] + parts["info"].T) / 2
            log_lik = -0.5 * (-2 * parts["ll"] + parts["penalty"] + parts["logdet"])
            covariance = search.factor @ search.factor.T
            passes, converged = search.passes, search.converged
            slope, fisher = search.log_variance_slope(), search.variance_information()
        betas[name] = beta
        g = len(design.levels)
        back = np.eye(2 * g)                  # from the centred and scaled score to the original one
        back[:g, g:] = -np.eye(g) * center / spread
        back[g:, g:] = np.eye(g) / spread
        to_level = back @ design.fixed_map
        models[name] = ModelFit(
            name, design, [level_names[i] for i in design.levels], to_level @ beta,
            to_level @ Search._solve(info, np.eye(design.n_fixed)) @ to_level.T, covariance, float(log_lik),
            int(n_obs[name]), int(n_units[name]), passes, converged, runaway[name], given[name] is not None, slope, fisher,
        )
    effects = finished[0] if len(finished) == 1 else finished[0].unionByName(finished[1])
    # back from numbers to names, and the slopes, which are the same for all units of a model
    rows = [(number[n], n, cell_sets[n], _level_slopes(d, betas[n], len(level_names))) for n, d in plans.items()]
    named = small_table(spark, rows, "m int, model string, cell_set string, slope array<double>")
    units = per_unit.select("cell_set", "unit", "node")
    effects = effects.join(F.broadcast(named), "m").join(units, ["cell_set", "node"])
    return models, coded, effects.select("model", "unit", "node", "off", "slope")


def _with_nodes(coded: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """Cells and units with a ``node``, one number per set of cells and unit, so that passes join and group on a plain long;
    and per set the number of units and the most cells in one.

    A hash needs no shuffle of the cells; should two units ever share one, another seed is taken. Units are counted once and
    stored, since the start of the search and the table of effects need them again.
    """
    counted = stored(coded.groupBy("cell_set", "unit").agg(F.count(F.lit(1)).alias("cells")), "units")
    for seed in range(10):
        node = F.xxhash64(F.lit(seed), "cell_set", "unit").alias("node")
        units = counted.select("*", node)
        by_node = units.groupBy("node").agg(
            F.count(F.lit(1)).alias("sharing"), F.min("cell_set").alias("cell_set"), F.max("cells").alias("cells")
        )
        sizes = by_node.groupBy("cell_set").agg(
            F.count(F.lit(1)).alias("units"), F.max("cells").alias("largest"), F.max("sharing").alias("sharing")
        ).collect()
        if max(row["sharing"] for row in sizes) == 1:
            return coded.select("*", node), units, sizes
    raise RuntimeError("no seed without collisions")


def _start_effects(spark, per_unit, plans, number, cell_sets, simple, n_levels) -> DataFrame:
    """Every unit of every model with zero effects on top of the fit without unit effects."""
    rows = []
    for name, design in plans.items():
        off = np.zeros(n_levels)
        off[list(design.levels)] = (design.fixed_map @ simple[name]["beta"])[: len(design.levels)]
        zero = [0.0] * design.n_random
        rows.append((number[name], cell_sets[name], zero, zero, off.tolist()))
    start = small_table(spark, rows, "m int, cell_set string, v array<double>, previous array<double>, off array<double>")
    salts = F.ceil(F.col("cells") / CELLS_PER_TASK).cast("int").alias("salts")
    return per_unit.select("cell_set", "node", salts).join(F.broadcast(start), "cell_set").select(EFFECT_COLUMNS)


def _run_search(coded, effects, designs, searches, n_levels, n_cells, largest, n_units, max_passes) -> DataFrame:
    """Iterate until every model has converged; returns the final unit effects."""
    spark = coded.sparkSession
    slots = spark.sparkContext.defaultParallelism
    # at least two: the planner does not keep a single partition in place
    partitions = max(
        2, min(slots, math.ceil(n_cells / 20_000)), math.ceil(n_cells / CELLS_PER_TASK), math.ceil(n_units / UNITS_PER_JOIN)
    )
    # a unit costs about levels^3 operations; the constant counts units of ten levels
    cost = max(len(design.levels) for design in designs.values()) ** 3 / 1000
    tasks = max(1, min(math.ceil(n_units * max(cost, 0.25) / UNITS_PER_TASK), n_units))
    keys = ["node"]
    if largest > CELLS_PER_TASK:
        keys.append("salt")
        # every split unit has more than CELLS_PER_TASK cells, so there are at most n_cells / CELLS_PER_TASK of them
        split = F.broadcast(effects.where("salts > 1").select("node", "salts").distinct())
        salts = F.coalesce(F.col("salts"), F.lit(1))
        coded = coded.join(split, "node", "left").withColumn(
            "salt", F.pmod(F.xxhash64("lev", "s"), salts).cast("int")
        )
    counts = [F.col(c).cast("double").alias(c) for c in ("n", "k")]
    packed = coded.select(*keys, "lev", "s", *counts).repartition(partitions, *keys).persist(
        StorageLevel.MEMORY_AND_DISK
    )

    def visit_cells(changed: DataFrame, models: Sequence[int]) -> DataFrame:
        # read twice: to give cells their linear predictor, and to go along with the new sums
        placed = changed.repartition(partitions, "node").persist(StorageLevel.MEMORY_AND_DISK)
        slopes = {m: _level_slopes(designs[m], searches[m].beta, n_levels) for m in models}
        reached = unit_sums(packed, placed, slopes, keys, partitions).checkpoint()
        placed.unpersist()
        for m in models:
            searches[m].solution = searches[m].beta
        return reached

    state = visit_cells(effects, list(designs))
    final, active = [], dict(designs)
    for last in range(max_passes, 0, -1):
        factors = {m: searches[m].factor for m in active}
        totals = total_contributions(state, active, factors, tasks)
        steps = {m: searches[m].advance(totals[m]) for m in sorted(active)}
        stopped = [m for m, step in steps.items() if step is None]
        if last == 1:
            stopped = list(active)
        if stopped:
            final.append(state.where(F.col("m").isin(stopped)))
            active = {m: design for m, design in active.items() if m not in stopped}
        if not active:
            break
        moved = state.where(F.col("m").isin(list(active))).select(
            "m", "node", "salts", "sums", "v", "previous"
        ).coalesce(tasks).mapInArrow(_update_task(active, factors, steps, n_levels), EFFECTS_SCHEMA)
        state = visit_cells(moved, list(active))
    packed.unpersist()
    result = final[0].select(EFFECT_COLUMNS)
    for more in final[1:]:
        result = result.unionByName(more.select(EFFECT_COLUMNS))
    return result


def with_linear_predictor(fit: FitSet) -> DataFrame:
    """The cells of every model with ``eta``, the fitted log odds, unit effects included.

    Cells and effects are joined by the hash of model and unit. Effects are one row per unit, and adaptive execution splits
    a unit that holds very many cells.
    """
    eta = F.get("off", F.col("lev")) + F.get("slope", F.col("lev")) * F.col("s")
    effects = fit.unit_effects.select("model", "node", "off", "slope")
    return fit.cells.join(effects, ["model", "node"]).select("model", "unit", "lev", "saps", "n", "k", eta.alias("eta"))


def fitted_totals(fit: FitSet, allow_unfinished: bool = False) -> DataFrame:
    """Observed and fitted deaths per model and level, plain and weighted by score, unit effects included."""
    require_finished(fit, allow_unfinished)
    names = level_table(fit.spark, fit.level_names).select("level", (F.col("idx") - 1).alias("lev"))
    joined = with_linear_predictor(fit).withColumn("fit", F.col("n") / (1 + F.exp(-F.col("eta"))))
    return joined.groupBy("model", "lev").agg(
        F.sum("k").alias("observed"), F.sum("fit").alias("fitted"),
        F.sum(F.col("saps") * F.col("k")).alias("observed_saps"), F.sum(F.col("saps") * F.col("fit")).alias("fitted_saps"),
    ).join(F.broadcast(names), "lev").select(
        "model", "level", "observed", "fitted", "observed_saps", "fitted_saps"
    )
