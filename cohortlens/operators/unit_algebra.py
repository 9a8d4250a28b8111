"""Small dense algebra of the mixed fit: per unit inside Spark tasks, per model on the driver.

Notation (G levels, p fixed coefficients, q random effects per unit)::

    a, c   intercept and slope per level;   (a; c) = M beta,   M is 2G x p
    u      random effects of a unit;        u = L v, v ~ N(0, I);   level effects = N u,   N is G x q
    W0 W1 W2   sums of w, w s, w s^2        w = n mu (1 - mu), per unit and level
    R0 R1      sums of r, r s               r = k - n mu
    T0 T1      sums of t, t s               t = n mu (1 - mu) (1 - 2 mu), how w reacts to the linear predictor

Records enter only through these sums, which Spark computes. L is any factor of the covariance L L' of the random effects
and may be singular, so variances can go to zero without a floor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SUMS = ["w0", "w1", "w2", "r0", "r1", "t0", "t1", "ll"]


@dataclass(frozen=True)
class Design:
    """Which level parameters a model has. ``levels`` are positions in the common level list; ``flat`` are those among them
    (by place in ``levels``) whose records all have one score."""

    fixed: str
    random: str
    levels: tuple[int, ...]
    flat: tuple[int, ...] = ()

    def __post_init__(self):
        if self.fixed not in ("interaction", "additive"):
            raise ValueError("fixed must be 'interaction' or 'additive'")
        if self.random not in ("none", "intercept", "level"):
            raise ValueError("random must be 'none', 'intercept' or 'level'")

    @property
    def slope_columns(self) -> list[int | None]:
        """Number of the slope parameter of each level.

        A level with one score has no slope of its own to estimate and takes that of the first level that has one. Without
        any such level there is no slope at all.
        """
        sloped = [i for i in range(len(self.levels)) if i not in self.flat]
        if not sloped:
            return [None] * len(self.levels)
        if self.fixed == "additive":
            return [0] * len(self.levels)
        return [sloped.index(i) if i in sloped else 0 for i in range(len(self.levels))]

    @property
    def fixed_map(self) -> np.ndarray:
        g, columns = len(self.levels), self.slope_columns
        m = np.zeros((2 * g, g + len(set(columns) - {None})))
        m[:g, :g] = np.eye(g)
        for i, column in enumerate(columns):
            if column is not None:
                m[g + i, g + column] = 1.0
        return m

    @property
    def random_map(self) -> np.ndarray:
        g = len(self.levels)
        return np.eye(g) if self.random == "level" else np.ones((g, 1))

    @property
    def n_fixed(self) -> int:
        return self.fixed_map.shape[1]

    @property
    def n_random(self) -> int:
        return {"none": 0, "intercept": 1, "level": len(self.levels)}[self.random]

    @property
    def n_variance(self) -> int:
        return self.n_random * (self.n_random + 1) // 2


def lower_pairs(q: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(q) for j in range(i + 1)]


def symmetric_basis(q: int) -> np.ndarray:
    """Columns of the map from the lower triangle of a symmetric matrix to all its q*q entries."""
    pairs = lower_pairs(q)
    basis = np.zeros((q * q, len(pairs)))
    for col, (i, j) in enumerate(pairs):
        basis[i * q + j, col] = 1.0
        basis[j * q + i, col] = 1.0
    return basis


def contribution_shapes(design: Design) -> dict[str, tuple[int, ...]]:
    """What a set of units adds to the sums over units; the order is that of the packed vector."""
    p, q, m = design.n_fixed, design.n_random, design.n_variance
    return {
        "units": (), "ll": (), "penalty": (), "logdet": (), "gain": (), "drift": (),
        "info": (p, p), "score": (p,), "drift_fixed": (p,),
        "grad": (q, q), "cross": (p, q, q), "scale": (q, q), "fisher": (m, m),
    }


def pack(parts: dict[str, np.ndarray], design: Design) -> np.ndarray:
    return np.concatenate([np.ravel(parts[name]) for name in contribution_shapes(design)])


def unpack(vector: np.ndarray, design: Design) -> dict[str, np.ndarray]:
    parts, at = {}, 0
    for name, shape in contribution_shapes(design).items():
        size = int(np.prod(shape))
        parts[name] = vector[at:at + size].reshape(shape) if shape else float(vector[at])
        at += size
    return parts


def unit_contributions(sums: dict[str, np.ndarray], v: np.ndarray, factor: np.ndarray, design: Design) -> np.ndarray:
    """Packed sums over a batch of units: joint Newton system for (beta, v) with v eliminated, the Laplace criterion and
    its derivative in L, and the Fisher information of the covariance."""
    m, nmap, ell = design.fixed_map, design.random_map, factor
    g = nmap.shape[0]
    m0, m1 = m[:g], m[g:]
    w0, w1, w2, r0, r1, t0, t1 = (sums[name] for name in SUMS[:-1])
    p, q = m.shape[1], nmap.shape[1]

    wt = np.einsum("gq,jg,gr->jqr", nmap, w0, nmap, optimize=True)
    wl = wt @ ell
    system = ell.T @ wl + np.eye(q)
    inverse = np.linalg.inv(system)
    rt = r0 @ nmap
    coupling = np.einsum("gp,jg,gq->jpq", m0, w0, nmap, optimize=True)
    coupling += np.einsum("gp,jg,gq->jpq", m1, w1, nmap, optimize=True)
    scaled = coupling @ ell
    scaled_inv = scaled @ inverse
    slack = rt @ ell - v

    s0, s1, s2 = (x.sum(0)[:, None] for x in (w0, w1, w2))
    info = m0.T @ (s0 * m0) + m0.T @ (s1 * m1) + m1.T @ (s1 * m0) + m1.T @ (s2 * m1)
    info -= np.einsum("jpq,jrq->pr", scaled_inv, scaled, optimize=True)
    score = m0.T @ r0.sum(0) + m1.T @ r1.sum(0) - np.einsum("jpq,jq->p", scaled_inv, slack)

    # log-determinant: its derivative through the weights needs the variance of each level effect
    spread = nmap @ ell
    leverage = np.einsum("gq,jqr,gr->jg", spread, inverse, spread, optimize=True)
    h0, h1 = leverage * t0, leverage * t1
    e = h0 @ nmap
    alpha = np.einsum("jqr,jr->jq", inverse, e @ ell)
    drift_fixed = m0.T @ h0.sum(0) + m1.T @ h1.sum(0) - np.einsum("jpq,jq->p", scaled, alpha)

    grad = (e - 2 * rt).T @ v + 2 * (wl @ inverse).sum(0) + rt.T @ alpha
    grad -= np.einsum("jq,jr->qr", np.einsum("jqr,jr->jq", wl, alpha), v)
    cross = np.einsum("jpq,jr->pqr", coupling, v, optimize=True)
    cross += np.einsum("jq,jpr->pqr", rt, scaled_inv, optimize=True)
    cross -= np.einsum("jqs,jps,jr->pqr", wl, scaled_inv, v, optimize=True)

    precision = wt - wl @ inverse @ np.swapaxes(wl, 1, 2)
    settled = rt - np.einsum("jqr,jr->jq", wl @ inverse, slack)      # residual sums after the pending step
    scale = precision.sum(0) - settled.T @ settled
    flat = precision.reshape(len(v), q * q)
    kron = (flat.T @ flat).reshape(q, q, q, q).transpose(0, 2, 1, 3).reshape(q * q, q * q)
    basis = symmetric_basis(q)

    return pack({
        "units": len(v), "ll": sums["ll"].sum(), "penalty": (v * v).sum(),
        "logdet": np.linalg.slogdet(system)[1].sum(),
        "gain": np.einsum("jq,jqr,jr->", slack, inverse, slack, optimize=True),
        "drift": (alpha * slack).sum(),
        "info": info, "score": score, "drift_fixed": drift_fixed, "grad": grad, "cross": cross,
        "scale": scale, "fisher": basis.T @ kron @ basis,
    }, design)


@dataclass
class Step:
    """What to do with the current unit effects: new parameters and how the effects follow.

    ``shift`` is the change of beta seen by the units. With ``backtrack`` the units return that fraction of the way to
    their previous effects instead.
    """

    beta: np.ndarray
    factor: np.ndarray
    shift: np.ndarray
    backtrack: float | None = None


def updated_effects(
    sums: dict[str, np.ndarray], v: np.ndarray, previous: np.ndarray, old_factor: np.ndarray, step: Step, design: Design
) -> np.ndarray:
    """Unit effects v under new parameters: one Newton step, exact in the new covariance for the given weights."""
    if step.backtrack is not None:
        return previous + step.backtrack * (v - previous)
    m, nmap, ell = design.fixed_map, design.random_map, step.factor
    g = nmap.shape[0]
    w0, w1, r0 = sums["w0"], sums["w1"], sums["r0"]
    wt = np.einsum("gq,jg,gr->jqr", nmap, w0, nmap, optimize=True)
    moved = m @ step.shift
    pull = (w0 * moved[:g] + w1 * moved[g:]) @ nmap
    target = r0 @ nmap + np.einsum("jqr,jr->jq", wt, v @ old_factor.T) - pull
    system = ell.T @ wt @ ell + np.eye(nmap.shape[1])
    return np.linalg.solve(system, (target @ ell)[:, :, None])[:, :, 0]


class Search:
    """Driver-side state of one model: what the sums over units say, and the next parameters.

    Every call of ``advance`` takes the sums at the current parameters. Fixed and unit effects take Newton steps. The
    covariance factor takes damped Newton steps on the Laplace criterion: its exact derivative, with the Fisher
    information for the curvature.
    """

    FIRST_VARIANCE = 0.1    # on the log-odds scale; keeps a few huge units from deciding the first estimate alone
    SETTLED = 1e-3
    POLISHED = 1e-20
    MAX_HALVINGS = 12

    def __init__(self, design: Design, beta: np.ndarray, tol: float, given: np.ndarray | None = None):
        q = design.n_random
        self.design, self.tol = design, tol
        self.beta, self.factor = np.asarray(beta, float), np.sqrt(self.FIRST_VARIANCE) * np.eye(q)
        self.solution = self.beta    # what the current sums were taken at
        self.damping, self.best, self.predicted = 1e-3, None, np.inf
        self.phase, self.converged, self.passes = "start", False, 0
        self.trail, self.before, self.halvings = None, np.inf, 0
        self.parts = None
        if given is not None:
            # the covariance is given: only fixed and unit effects are left to solve for
            self.factor, self.phase = np.asarray(given, float), "polish"

    # the criterion at the point the pending Newton step would reach
    def _criterion(self, parts, move) -> float:
        penalized = -2 * parts["ll"] + parts["penalty"]
        drop = parts["gain"] + parts["score"] @ move
        return penalized - drop + parts["logdet"] + parts["drift"] + parts["drift_fixed"] @ move

    @staticmethod
    def _solve(info, rhs):
        try:
            return np.linalg.solve(info, rhs)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(info, rhs, rcond=None)[0]

    def _first_factor(self, parts) -> np.ndarray:
        """Scoring step for the covariance from the first guess, kept inside the positive definite cone."""
        q = self.design.n_random
        pairs = lower_pairs(q)
        slope = np.array([parts["scale"][i, j] * (1 if i == j else 2) for i, j in pairs])
        fisher = parts["fisher"] + 1e-8 * np.eye(len(pairs)) * max(np.trace(parts["fisher"]) / len(pairs), 1e-300)
        sigma = self.factor @ self.factor.T
        for value, (i, j) in zip(-self._solve(fisher, slope), pairs):
            sigma[i, j] += value
            if i != j:
                sigma[j, i] += value
        values, vectors = np.linalg.eigh(sigma)
        floor = max(1e-3, 0.05 * values.max(initial=0.0))
        return (vectors * np.sqrt(np.maximum(values, floor))) @ vectors.T

    def _covariance_model(self, parts, info):
        """Gradient and curvature of the criterion in all entries of L.

        L is not held triangular: rotations of its columns change nothing, and a fixed triangle makes slow progress where
        the covariance is singular in a direction that mixes levels.
        """
        q, ell = self.design.n_random, self.factor
        adjoint = self._solve(info, parts["drift_fixed"])
        gradient = (parts["grad"] - np.einsum("p,pqr->qr", adjoint, parts["cross"])).ravel()
        change = np.einsum("ai,bj->abij", np.eye(q), ell)
        change = change + change.transpose(1, 0, 2, 3)
        rows, cols = np.array(lower_pairs(q)).T
        jac = change[rows, cols].reshape(len(rows), q * q)
        values, vectors = np.linalg.eigh((parts["scale"] + parts["scale"].T) / 2)
        bend = (vectors * np.maximum(values, 0)) @ vectors.T
        return gradient, jac.T @ parts["fisher"] @ jac + 2 * np.kron(bend, np.eye(q))

    def log_variance_slope(self) -> float:
        """Derivative of the log-likelihood when all of the covariance grows in proportion, by the logarithm of the factor
        of growth. At a solution only."""
        gradient, _ = self._covariance_model(self.parts, (self.parts["info"] + self.parts["info"].T) / 2)
        # the factor grows half as fast as the covariance, and the criterion is minus twice the log-likelihood
        return float(-0.25 * gradient @ self.factor.ravel())

    def variance_information(self) -> np.ndarray:
        """Fisher information of the log-likelihood in the lower triangle of the covariance; the criterion's is twice that."""
        return self.parts["fisher"] / 2

    def _covariance_step(self) -> np.ndarray:
        q = self.design.n_random
        gradient, curvature = self.best["gradient"], self.best["curvature"]
        diagonal = np.diag(curvature)
        values, vectors = np.linalg.eigh(curvature + self.damping * np.diag(diagonal))
        # rotations have neither slope nor curvature
        used = values > 1e-10 * max(values.max(), 1e-300)
        move = -vectors[:, used] @ ((vectors[:, used].T @ gradient) / values[used])
        self.predicted = float(-(gradient @ move + 0.5 * move @ curvature @ move))
        return move.reshape(q, q)

    def _go(self, beta, factor, backtrack=None) -> Step:
        step = Step(beta, factor, beta - self.beta, backtrack)
        self.beta, self.factor = beta, factor
        return step

    def _newton(self, move, penalized) -> Step:
        """Newton step for fixed and unit effects, remembered so that it can be shortened."""
        self.trail, self.before, self.halvings = move, penalized, 0
        return self._go(self.beta + move, self.factor)

    def _jump(self, beta, factor) -> Step:
        """Step that also changes the covariance; there is nothing to compare the next penalized deviance with."""
        self.trail, self.before = None, np.inf
        return self._go(beta, factor)

    def advance(self, vector: np.ndarray) -> Step | None:
        """Next step, or None when finished."""
        self.passes += 1
        self.parts = parts = unpack(vector, self.design)
        info = (parts["info"] + parts["info"].T) / 2
        move = self._solve(info, parts["score"])
        decrement = parts["gain"] + parts["score"] @ move
        penalized = -2 * parts["ll"] + parts["penalty"]

        if self.phase == "start":
            self.phase = "settle"
            return self._jump(self.beta + move, self._first_factor(parts))

        too_far = self.trail is not None and penalized > self.before + 1e-9 * abs(self.before)
        if too_far and self.halvings < self.MAX_HALVINGS:
            self.halvings += 1
            self.trail = self.trail / 2
            return self._go(self.beta - self.trail, self.factor, backtrack=0.5)

        solved = bool(decrement < self.POLISHED * max(1.0, abs(penalized)))
        if self.phase == "polish":
            self.converged = solved
            return None if solved else self._newton(move, penalized)

        if decrement > max(1e-10, min(self.SETTLED, 0.02 * self.predicted)):
            return self._newton(move, penalized)

        value = self._criterion(parts, move)
        if self.best is None or value <= self.best["value"] + 1e-12 * abs(value):
            gradient, curvature = self._covariance_model(parts, info)
            self.best = {
                "value": value, "beta": self.beta + move, "factor": self.factor,
                "follow": -self._solve(info, parts["cross"].reshape(len(move), -1)),
                "gradient": gradient, "curvature": curvature,
            }
            self.damping = max(self.damping / 10, 1e-9)
            change = self._covariance_step()
            if self.predicted < self.tol:
                self.phase, self.converged = "polish", solved
                return None if solved else self._newton(move, penalized)
        else:
            if self.predicted < 10 * self.tol or self.damping > 1e6:
                self.phase = "polish"
                return self._jump(self.best["beta"], self.best["factor"])
            self.damping = max(self.damping * 10, 1e-4)
            change = self._covariance_step()
        follow = self.best["follow"] @ change.ravel()
        return self._jump(self.best["beta"] + follow, self.best["factor"] + change)
