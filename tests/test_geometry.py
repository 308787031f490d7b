"""Column expressions against their numpy twins, and the metric's properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions import numeric as N


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(42)

    def point():
        v = rng.standard_normal(8)
        return v / np.linalg.norm(v) * rng.random() * 0.85

    rows = [(i, point().tolist(), point().tolist()) for i in range(40)]
    return spark.createDataFrame(rows, "id int, x array<double>, y array<double>"), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def col(df, c):
    return np.array([r[0] for r in df.orderBy("id").select(c).collect()], float)


def test_expressions_equal_numpy(pairs):
    df, x, y = pairs
    cx, cy = F.col("x"), F.col("y")
    for got, want in [
        (G.poincare_distance(cx, cy), N.distance(x, y)), (G.dist_from_origin(cx), N.origin_distance(x)), (G.mobius_addition(cx, cy), N.mobius_add(x, y)), (G.log_map_0(cx), N.log0(x)),
        (G.exp_map_0(cx), N.exp0(x)), (G.log_map(cx, cy), N.log_map(x, y)), (G.exp_map(cx, cy), N.exp_map(x, y)), (G.clamp_to_ball(G.scaled(cx, F.lit(3.0))), N.clamp(3 * x)),
        (G.geodesic_interpolation(cx, cy, F.lit(0.3)), N.interpolate(x, y, 0.3)),
    ]:
        np.testing.assert_allclose(col(df, got), want, atol=1e-9)


def test_metric_properties(pairs):
    _, x, y = pairs
    d = N.pairwise(x, x)
    np.testing.assert_allclose(d, d.T, atol=1e-9)
    for i in range(20):
        assert N.distance(x[i], y[i]) <= N.distance(x[i], x[i + 1]) + N.distance(x[i + 1], y[i]) + 1e-9
    np.testing.assert_allclose(N.exp_map(x, N.log_map(x, y)), y, atol=1e-6)
    assert (np.linalg.norm(N.mobius_add(x, y), axis=1) < G.ball_radius()).all()


def test_karcher_of_two_points_lies_on_the_geodesic(pairs):
    _, x, y = pairs
    mean, _ = N.karcher_mean(np.array([x[0], y[0]]), weights=np.array([3.0, 1.0]))
    np.testing.assert_allclose(mean, N.interpolate(x[0], y[0], 0.25), atol=1e-7)


def test_isometries(spark):
    df = spark.createDataFrame([(0, 0.3, 0.4), (1, -0.2, 0.1)], "id int, x double, y double")
    m = G.mobius_translate_to_origin(F.col("x"), F.col("y"))
    there = df.withColumn("m", m).withColumn("o", G.mobius_apply(F.col("m"), F.col("x"), F.col("y")))
    assert np.allclose(col(there, "o.x"), 0) and np.allclose(col(there, "o.y"), 0)
    back = there.withColumn("b", G.mobius_apply(G.mobius_inverse(F.col("m")), F.lit(0.0), F.lit(0.0)))
    assert np.allclose(col(back, "b.x"), [0.3, -0.2])
    mid = df.withColumn("m", G.mobius_interpolate(G.mobius_identity(), m, F.lit(1.0))).select("id", "m.*")
    assert np.allclose(col(mid, F.col("a_re") ** 2 + F.col("a_im") ** 2 - F.col("b_re") ** 2 - F.col("b_im") ** 2), 1)


def test_ball_radius():
    assert math.isclose(G.ball_radius(), 0.894427191)
