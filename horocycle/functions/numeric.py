"""numpy twins of the geometry, for operators that work on whole groups of points."""

from __future__ import annotations

import math

import numpy as np

from horocycle.functions.constants import BOUNDARY_EPS, KAPPA


def clamp(x: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    n = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-15)
    return x * np.minimum(1.0, (1 / math.sqrt(kappa) - BOUNDARY_EPS) / n)


def distance_from(sq: np.ndarray, nu: np.ndarray, nv: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    s = math.sqrt(kappa)
    room = np.maximum((1 - kappa * nu) * (1 - kappa * nv), 1e-8)
    return (2 / s) * np.arcsinh(s * np.sqrt(np.maximum(sq, 1e-15)) / np.sqrt(room))


def distance(u: np.ndarray, v: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    return distance_from(((u - v) ** 2).sum(-1), (u * u).sum(-1), (v * v).sum(-1), kappa)


def pairwise(u: np.ndarray, v: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    """All distances between two sets of points, by one matrix product."""
    nu, nv = (u * u).sum(1), (v * v).sum(1)
    sq = np.maximum(nu[:, None] + nv[None, :] - 2 * (u @ v.T), 0)
    return distance_from(sq, nu[:, None], nv[None, :], kappa)


def origin_distance(x: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    s = math.sqrt(kappa)
    return (2 / s) * np.arctanh(s * np.clip(np.linalg.norm(x, axis=-1), 1e-15, 1 / s - 1e-7))


def mobius_add(u: np.ndarray, v: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    uv = (u * v).sum(-1, keepdims=True)
    uu, vv = (u * u).sum(-1, keepdims=True), (v * v).sum(-1, keepdims=True)
    below = np.maximum(1 + 2 * kappa * uv + kappa**2 * uu * vv, 1e-15)
    return clamp(((1 + 2 * kappa * uv + kappa * vv) * u + (1 - kappa * uu) * v) / below, kappa)


def log0(y: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    s = math.sqrt(kappa)
    n = np.maximum(np.linalg.norm(y, axis=-1, keepdims=True), 1e-15)
    return np.arctanh(s * np.minimum(n, 1 / s - 1e-7)) / (s * n) * y


def exp0(v: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    s = math.sqrt(kappa)
    n = np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-15)
    return clamp(np.tanh(s * n) / (s * n) * v, kappa)


def log_map(x: np.ndarray, y: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    return np.maximum(1 - kappa * (x * x).sum(-1, keepdims=True), 1e-15) * log0(mobius_add(-x, y, kappa), kappa)


def exp_map(x: np.ndarray, v: np.ndarray, kappa: float = KAPPA) -> np.ndarray:
    factor = 1 / np.maximum(1 - kappa * (x * x).sum(-1, keepdims=True), 1e-15)
    return mobius_add(x, exp0(v * factor, kappa), kappa)


def interpolate(x: np.ndarray, y: np.ndarray, t: float, kappa: float = KAPPA) -> np.ndarray:
    return exp_map(x, t * log_map(x, y, kappa), kappa)


def karcher_mean(points: np.ndarray, kappa: float = KAPPA, steps: int = 50, tol: float = 1e-8, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(mean, weighted mean of squared distances to it) of points on the ball."""
    points = np.asarray(points, float)
    w = np.full(len(points), 1 / len(points)) if weights is None else np.asarray(weights, float) / np.sum(weights)
    mean = clamp((w[:, None] * points).sum(0), kappa)
    for _ in range(steps):
        step = (w[:, None] * log_map(mean[None, :], points, kappa)).sum(0)
        if np.linalg.norm(step) < tol:
            break
        mean = clamp(exp_map(mean, step, kappa), kappa)
    return mean, float((w * distance(mean[None, :], points, kappa) ** 2).sum())


def karcher_means(points: np.ndarray, first: np.ndarray, kappa: float = KAPPA, steps: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """``karcher_mean`` without weights of each run of rows that begins at ``first``, all runs stepping together until each has settled."""
    count = np.diff([*first, len(points)])
    w = np.repeat(1 / count, count)
    mean = clamp(np.add.reduceat(w[:, None] * points, first), kappa)
    todo = np.arange(len(first))
    rows, at, owner = points, first, np.repeat(todo, count)
    for _ in range(steps):
        step = np.add.reduceat((1 / count[owner])[:, None] * log_map(mean[owner], rows, kappa), at)
        far = ~(np.linalg.norm(step, axis=1) < tol)
        if not far.any():
            break
        mean[todo[far]] = clamp(exp_map(mean[todo[far]], step[far], kappa), kappa)
        if not far.all():
            rows = rows[np.repeat(far, count[todo])]
            todo = todo[far]
            owner, at = np.repeat(todo, count[todo]), np.cumsum(count[todo]) - count[todo]
    owner = np.repeat(np.arange(len(first)), count)
    return mean, np.add.reduceat(w * distance(mean[owner], points, kappa) ** 2, first)
