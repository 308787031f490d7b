"""Hyperbolic geometry of the Poincaré ball of curvature -kappa, as column expressions over ``array<double>``.

All are built-in expressions; kappa is a number that becomes a DOUBLE literal.  Points with norm below 1/sqrt(kappa).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from horocycle.functions.constants import BOUNDARY_EPS, KAPPA


def ball_radius(kappa: float = KAPPA) -> float:
    return 1.0 / math.sqrt(kappa)


def lit(x: float) -> Column:
    return F.lit(float(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: composed expressions would otherwise repeat their arguments at every level."""
    return F.transform(F.array(value), body)[0]


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), lit(0), lambda s, x: s + x)


def norm2(x: Column) -> Column:
    return F.aggregate(x, lit(0), lambda s, v: s + v * v)


def norm(x: Column) -> Column:
    return F.sqrt(norm2(x))


def scaled(x: Column, factor: Column) -> Column:
    return let(factor, lambda by: F.transform(x, lambda v: v * by))


def added(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a + b)


def clamp_to_ball(x: Column, kappa: float = KAPPA) -> Column:
    """Pull points outside back to just within the ball."""
    most = ball_radius(kappa) - BOUNDARY_EPS
    return let(x, lambda p: scaled(p, F.least(lit(1), lit(most) / F.greatest(norm(p), lit(1e-15)))))


def distance_from(sq: Column, nu: Column, nv: Column, kappa: float = KAPPA) -> Column:
    """Geodesic distance from the squared Euclidean distance and both squared norms."""
    s = math.sqrt(kappa)
    room = F.greatest((1 - lit(kappa) * nu) * (1 - lit(kappa) * nv), lit(1e-8))
    return lit(2 / s) * F.asinh(lit(s) * F.sqrt(F.greatest(sq, lit(1e-15))) / F.sqrt(room))


def poincare_distance(u: Column, v: Column, kappa: float = KAPPA) -> Column:

    def between(p: Column) -> Column:
        sq = F.aggregate(F.zip_with(p["u"], p["v"], lambda a, b: (a - b) * (a - b)), lit(0), lambda s, x: s + x)
        return distance_from(sq, norm2(p["u"]), norm2(p["v"]), kappa)

    return let(F.struct(u.alias("u"), v.alias("v")), between)


def dist_from_origin(x: Column, kappa: float = KAPPA) -> Column:
    s = math.sqrt(kappa)
    inside = F.least(F.greatest(norm(x), lit(1e-15)), lit(ball_radius(kappa) - 1e-7))
    return lit(2 / s) * F.atanh(lit(s) * inside)


def mobius_addition(u: Column, v: Column, kappa: float = KAPPA) -> Column:
    k = lit(kappa)

    def weights(p: Column) -> Column:
        uv, uu, vv = dot(p["u"], p["v"]), norm2(p["u"]), norm2(p["v"])
        return let(F.struct(uv.alias("uv"), uu.alias("uu"), vv.alias("vv")), lambda n: combined(p, n))

    def combined(p: Column, n: Column) -> Column:
        below = F.greatest(1 + 2 * k * n["uv"] + k * k * n["uu"] * n["vv"], lit(1e-15))
        both = F.struct(((1 + 2 * k * n["uv"] + k * n["vv"]) / below).alias("a"), ((1 - k * n["uu"]) / below).alias("b"))
        return let(both, lambda w: F.zip_with(p["u"], p["v"], lambda x, y: w["a"] * x + w["b"] * y))

    return clamp_to_ball(let(F.struct(u.alias("u"), v.alias("v")), weights), kappa)


def log_map_0(y: Column, kappa: float = KAPPA) -> Column:
    s = math.sqrt(kappa)
    factor = lambda n: F.atanh(lit(s) * F.least(n, lit(ball_radius(kappa) - 1e-7))) / (lit(s) * n)
    return let(y, lambda p: scaled(p, let(F.greatest(norm(p), lit(1e-15)), factor)))


def exp_map_0(v: Column, kappa: float = KAPPA) -> Column:
    s = math.sqrt(kappa)
    factor = lambda n: F.tanh(lit(s) * n) / (lit(s) * n)
    return clamp_to_ball(let(v, lambda p: scaled(p, let(F.greatest(norm(p), lit(1e-15)), factor))), kappa)


def negated(x: Column) -> Column:
    return F.transform(x, lambda v: -v)


def log_map(x: Column, y: Column, kappa: float = KAPPA) -> Column:
    room = lambda p: F.greatest(1 - lit(kappa) * norm2(p), lit(1e-15))
    return let(x, lambda p: scaled(log_map_0(mobius_addition(negated(p), y, kappa), kappa), room(p)))


def conformal_factor(x: Column, kappa: float = KAPPA) -> Column:
    return 2 / F.greatest(1 - lit(kappa) * norm2(x), lit(1e-15))


def exp_map(x: Column, v: Column, kappa: float = KAPPA) -> Column:
    return let(x, lambda p: mobius_addition(p, exp_map_0(scaled(v, conformal_factor(p, kappa) / 2), kappa), kappa))


def geodesic_interpolation(x: Column, y: Column, t: Column, kappa: float = KAPPA) -> Column:
    return let(x, lambda p: exp_map(p, scaled(log_map(p, y, kappa), t), kappa))


def angle(x: Column) -> Column:
    """The angle of the first two coordinates in [0, 2 pi); 0 for points of one dimension."""
    return F.when(F.size(x) < 2, lit(0)).otherwise(F.pmod(F.atan2(F.get(x, F.lit(1)), F.get(x, F.lit(0))), lit(2 * math.pi)))


def coordinate(x: Column, kappa: float = KAPPA) -> Column:
    """struct(r, theta, r_euclidean, theta_degrees): geodesic radius and angle."""
    return F.struct(
        dist_from_origin(x, kappa).alias("r"), angle(x).alias("theta"), norm(x).alias("r_euclidean"), F.round(F.degrees(angle(x)), 2).alias("theta_degrees")
    )


def radial_v1(x: Column, kappa: float = KAPPA) -> Column:
    """Geodesic radius of the datum version 1; null where the point lies outside the ball."""
    s = math.sqrt(kappa)
    return F.when(norm(x) < lit(ball_radius(kappa)), lit(2 / s) * F.atanh(lit(s) * norm(x)))


def angular_v1(x: Column, plane: list[list[float]], grand: list[float], anchor: float, kappa: float = KAPPA) -> Column:
    """Degrees from the anchor in the datum's plane, after the tangent vector is centred on the grand mean."""
    row = lambda p: F.array(*(lit(v) for v in p))
    centred = F.zip_with(log_map_0(x, kappa), row(grand), lambda a, b: a - b)
    theta = F.pmod(F.degrees(F.atan2(dot(centred, row(plane[1])), dot(centred, row(plane[0])))) - lit(anchor), lit(360))
    return F.when(theta > lit(360 - 1e-6), lit(0)).otherwise(theta)


def uncertainty_v1(r: Column, theta: Column, centroids: list[tuple[float, float]]) -> Column:
    """struct(sigma_r, sigma_theta) from the nearest radius and the nearest angle among the centroids, independently."""
    if not centroids:
        return F.struct(lit(0.05).alias("sigma_r"), lit(5.0).alias("sigma_theta"))
    near = lambda cs: F.least(*cs) if len(cs) > 1 else cs[0]
    dr = near([F.abs(r - lit(c[0])) for c in centroids])
    arcs = [F.pmod(F.abs(theta - lit(c[1])), lit(360)) for c in centroids]
    dt = near([F.least(a, 360 - a) for a in arcs])
    return F.struct(F.greatest(lit(0.01), 0.1 * dr + 0.02).alias("sigma_r"), F.greatest(lit(1), 0.5 * dt + 2).alias("sigma_theta"))


def valid_v1(x: Column, dim: int, kappa: float = KAPPA) -> Column:
    """Whether a point has the datum's dimension, is finite and lies in the ball."""
    finite = F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < lit(math.inf)))
    return (F.size(x) == dim) & finite & (norm(x) < lit(ball_radius(kappa)))


# Isometries of the disc as SU(1,1) structs (a_re, a_im, b_re, b_im); a point is struct(x, y).


def mobius(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> Column:
    return F.struct(a_re.alias("a_re"), a_im.alias("a_im"), b_re.alias("b_re"), b_im.alias("b_im"))


def mobius_identity() -> Column:
    return mobius(lit(1), lit(0), lit(0), lit(0))


def mobius_rotation(theta: Column) -> Column:
    return mobius(F.cos(theta / 2), F.sin(theta / 2), lit(0), lit(0))


def mobius_translate_to_origin(x: Column, y: Column, kappa: float = KAPPA) -> Column:
    """The isometry that takes (x, y) to the centre; points beyond 0.99 of the radius (squared) are taken at 0.99."""
    R = lit(ball_radius(kappa))
    px, py = x / R, y / R
    n2 = px * px + py * py
    shrink = F.when(n2 > 0.99, lit(0.99) / F.sqrt(n2)).otherwise(lit(1))
    px, py = px * shrink, py * shrink
    a = 1 / F.sqrt(1 - (px * px + py * py))
    return mobius(a, lit(0), -px * a, -py * a)


def mobius_compose(f: Column, g: Column) -> Column:
    """First ``g``, then ``f``."""
    ar = f["a_re"] * g["a_re"] - f["a_im"] * g["a_im"] + f["b_re"] * g["b_re"] + f["b_im"] * g["b_im"]
    ai = f["a_re"] * g["a_im"] + f["a_im"] * g["a_re"] + f["b_im"] * g["b_re"] - f["b_re"] * g["b_im"]
    br = f["a_re"] * g["b_re"] - f["a_im"] * g["b_im"] + f["b_re"] * g["a_re"] + f["b_im"] * g["a_im"]
    bi = f["a_re"] * g["b_im"] + f["a_im"] * g["b_re"] + f["b_im"] * g["a_re"] - f["b_re"] * g["a_im"]
    return mobius(ar, ai, br, bi)


def mobius_inverse(f: Column) -> Column:
    return mobius(f["a_re"], -f["a_im"], -f["b_re"], -f["b_im"])


def mobius_apply(f: Column, x: Column, y: Column, kappa: float = KAPPA) -> Column:
    """struct(x, y): (a z + b) / (conj(b) z + conj(a)) on the unit disc, scaled to the ball."""
    R = lit(ball_radius(kappa))
    zx, zy = x / R, y / R
    nr = f["a_re"] * zx - f["a_im"] * zy + f["b_re"]
    ni = f["a_re"] * zy + f["a_im"] * zx + f["b_im"]
    dr = f["b_re"] * zx + f["b_im"] * zy + f["a_re"]
    di = f["b_re"] * zy - f["b_im"] * zx - f["a_im"]
    below = F.greatest(dr * dr + di * di, lit(1e-15))
    return F.struct(((nr * dr + ni * di) / below * R).alias("x"), ((ni * dr - nr * di) / below * R).alias("y"))


def mobius_interpolate(f: Column, g: Column, t: Column) -> Column:
    """Between two isometries by a smooth step, scaled back to determinant 1."""
    s = t * t * (3 - 2 * t)
    mid = {k: f[k] + (g[k] - f[k]) * s for k in ("a_re", "a_im", "b_re", "b_im")}
    det = mid["a_re"] ** 2 + mid["a_im"] ** 2 - mid["b_re"] ** 2 - mid["b_im"] ** 2
    by = F.when(det > 1e-10, 1 / F.sqrt(F.greatest(det, lit(1e-10)))).otherwise(lit(1))
    return mobius(*(mid[k] * by for k in ("a_re", "a_im", "b_re", "b_im")))


def band_radius(r: Column, kappa: float = KAPPA) -> Column:
    """Euclidean radius of the circle at geodesic radius r."""
    s = math.sqrt(kappa)
    return F.tanh(lit(s) * r / 2) / lit(s)
