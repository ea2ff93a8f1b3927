"""Legendre transforms of straight and of nearly touching points."""

from curvelake.operators import curves  # noqa: F401
from curvelake.plans.tree import Context
from curvelake.sources.frames import declare, field_of


def curve(spark, rows, digits=10):
    return field_of(Context(spark), "y", spark.createDataFrame(rows, "k long, x double, y double"), declare(["k", "x"], ["y"], "x", dtypes={"k": "int"}), "unique", digits=digits)


def test_straight_curves_keep_their_points(spark):
    f = curve(spark, [(1, 0.5, 2.0), (1, 1.5, 5.0), (2, 1.0, 1.0), (2, 2.0, 4.0), (2, 4.0, 16.0)])
    got = sorted((r.k, r.p, r.G) for r in f.legendre(branches="split", method="linear").df.collect())
    assert got == [(1, 3.0, -0.5), (1, 3.0, -0.5), (2, 3.0, 2.0), (2, 6.0, 8.0), (2, 6.0, 8.0)]


def test_points_nearer_than_the_digits_of_inputs_stay_apart(spark):
    x = [1.0, 1.0 + 3e-12, 1.5, 2.5]
    rows = [(1, v, v * v) for v in x]
    got = curve(spark, rows, None).legendre(branches="split", digits=None).df
    assert got.where("p is not null").count() == 4
    got = sorted(r.p for r in curve(spark, [(1, v, v / 3) for v in x[::3]], None).legendre(branches="split", digits=None).df.collect())
    assert got == [(2.5 / 3 - 1 / 3) / 1.5] * 2  # as calculated, not rounded to ten decimals
