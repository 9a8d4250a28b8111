"""Dense single-machine solution of small mixed logistic models, written independently of the package."""

import numpy as np


def simulate(units=60, levels=4, rows=40_000, seed=11, cov=None):
    rng = np.random.default_rng(seed)
    if cov is None:
        cov = 0.25 * np.ones((levels, levels)) + 0.15 * np.eye(levels)
    b = rng.multivariate_normal(np.zeros(levels), cov, size=units)
    unit, level = rng.integers(0, units, rows), rng.integers(0, levels, rows)
    saps = rng.integers(20, 101, rows)
    eta = -1 + 0.2 * level + (1 + 0.1 * level) * (saps - 60) / 20 + b[unit, level]
    y = (rng.random(rows) < 1 / (1 + np.exp(-eta))).astype(int)
    return unit, level, saps, y


def design(unit, level, score, units, levels, fixed, random):
    """Row-level design matrices X and Z (Z before the covariance factor), levels as baseline-coded dummies."""
    dummies = np.eye(levels)[level]
    base = np.concatenate([np.ones((len(level), 1)), dummies[:, 1:]], axis=1)
    if fixed == "interaction":
        x = np.concatenate([base, base * score[:, None]], axis=1)
    else:
        x = np.concatenate([base, score[:, None]], axis=1)
    effect = base if random == "level" else np.ones((len(level), 1))
    q = effect.shape[1]
    z = np.zeros((len(level), units * q))
    for j in range(q):
        z[np.arange(len(level)), unit * q + j] = effect[:, j]
    return x, z, q


def solve(x, z, n, k, factor, units):
    """Penalized iteratively reweighted least squares to convergence; returns the Laplace deviance and the solution."""
    lam = np.kron(np.eye(units), factor)
    zl = z @ lam
    p, m = x.shape[1], zl.shape[1]
    both = np.concatenate([x, zl], axis=1)
    penalty = np.diag(np.concatenate([np.zeros(p), np.ones(m)]))
    theta = np.zeros(p + m)
    for _ in range(60):
        eta = both @ theta
        mu = 1 / (1 + np.exp(-eta))
        w = n * mu * (1 - mu)
        hessian = both.T @ (w[:, None] * both) + penalty
        step = np.linalg.solve(hessian, both.T @ (k - n * mu) - penalty @ theta)
        theta = theta + step
        if np.abs(step).max() < 1e-11:
            break
    eta = both @ theta
    mu = 1 / (1 + np.exp(-eta))
    w = n * mu * (1 - mu)
    ll = (k * eta - n * np.logaddexp(0, eta)).sum()
    v = theta[p:]
    deviance = -2 * ll + v @ v + np.linalg.slogdet(zl.T @ (w[:, None] * zl) + np.eye(m))[1]
    full = both.T @ (w[:, None] * both) + penalty
    return deviance, theta[:p], np.linalg.inv(full)[:p, :p], lam @ v


def lower(values, q):
    out = np.zeros((q, q))
    out[np.tril_indices(q)] = values
    return out


def minimize(function, start, rounds=60):
    """Quasi-Newton with central differences; enough for a handful of parameters."""
    x, inverse = np.array(start, float), None
    grad = lambda x: np.array([
        (function(x + h) - function(x - h)) / 2e-4 for h in np.eye(len(x)) * 1e-4
    ])
    value, g = function(x), grad(x)
    inverse = np.eye(len(x)) / max(np.linalg.norm(g), 1.0)
    for _ in range(rounds):
        direction, scale = -inverse @ g, 1.0
        while function(x + scale * direction) > value + 1e-4 * scale * (g @ direction) and scale > 1e-8:
            scale /= 2
        new = x + scale * direction
        new_g = grad(new)
        s, y = new - x, new_g - g
        if s @ y > 1e-14:
            rho = 1 / (s @ y)
            left = np.eye(len(x)) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        gain = value - function(new)
        x, g, value = new, new_g, function(new)
        if gain < 1e-11:
            break
    return x, value
