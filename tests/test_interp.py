"""Slopes of cubics against a dense solve of each curve's conditions."""

import numpy as np

from curvelake.operators import interp


def by_dense_solve(x, y):
    """Slopes by the conditions themselves: equal second derivatives inside, equal third ones at the second and last but one point."""
    n, h, d = len(x), np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        # The second derivative at the end of one segment and at the start of the next.
        a[i, i - 1], a[i, i], a[i, i + 1] = 2 / h[i - 1], 4 / h[i - 1] + 4 / h[i], 2 / h[i]
        b[i] = 6 * d[i - 1] / h[i - 1] + 6 * d[i] / h[i]
    for row, i in ((0, 0), (n - 1, n - 3)):
        a[row, i] += 1 / h[i] ** 2
        a[row, i + 1] += 1 / h[i] ** 2 - 1 / h[i + 1] ** 2
        a[row, i + 2] -= 1 / h[i + 1] ** 2
        b[row] = 2 * d[i] / h[i] ** 2 - 2 * d[i + 1] / h[i + 1] ** 2
    return np.linalg.solve(a, b)


def test_cubic_slopes_of_many_curves():
    rng = np.random.default_rng(0)
    for lens in ([4], [4, 5], [9] * 20, [4, 4, 700, 5, 30, 300], list(rng.integers(4, 60, 40)) + [500, 4], []):
        lens = np.array(lens, int)
        gaps = rng.integers(0, 3, len(lens))  # rows of curves too short for a cubic lie between
        starts = np.cumsum(lens + gaps) - lens
        ends = starts + lens
        n = int(ends[-1]) + 2 if len(ends) else 3
        x, y = rng.uniform(size=n), rng.normal(size=n)
        want = np.full(n, np.nan)
        for a, b in zip(starts, ends, strict=True):
            x[a:b] = np.cumsum(rng.uniform(0.1, 1, b - a))
            want[a:b] = by_dense_solve(x[a:b], y[a:b])
        got = interp.cubic_slopes(x, y, starts, ends)
        assert np.allclose(got, want, rtol=1e-7, atol=1e-7, equal_nan=True)


def by_dense_smoothing(x, y, p):
    """Natural cubics of weight ``p`` by the whole matrices."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    return y - p * (q @ np.linalg.solve(r + p * q.T @ q, q.T @ y))


def test_smoothing_of_many_curves():
    rng = np.random.default_rng(2)
    lens = np.array([4, 9, 5, 60, 4, 17])
    starts = np.cumsum(lens + 1) - lens
    x, y = np.sort(rng.uniform(0, 50, starts[-1] + 20)), rng.normal(size=starts[-1] + 20)
    for s in (1e-4, 0.5, 1e6):
        got = interp.smooth_values(x, y, starts, starts + lens, s)
        free = np.ones(len(x), bool)
        for a, z in zip(starts, starts + lens, strict=True):
            free[a:z] = False
            left = ((got[a:z] - y[a:z]) ** 2).sum()
            line = np.polyval(np.polyfit(x[a:z], y[a:z], 1), x[a:z])
            if ((line - y[a:z]) ** 2).sum() <= s:
                assert np.allclose(got[a:z], line, atol=1e-5)
                continue
            assert abs(left / s - 1) < 1e-8
            low, high = -9.0, 12.0
            for _ in range(80):
                t = (low + high) / 2
                low, high = (t, high) if ((by_dense_smoothing(x[a:z], y[a:z], 10**t) - y[a:z]) ** 2).sum() <= s else (low, t)
            assert np.allclose(got[a:z], by_dense_smoothing(x[a:z], y[a:z], 10**low), atol=1e-6)
        assert np.array_equal(got[free], y[free])


def test_smoothing_grows_with_points_only():
    import tracemalloc

    rng = np.random.default_rng(3)
    n = 1500
    x = np.cumsum(rng.uniform(0.5, 1.5, n))
    y = np.sin(x / 300) + rng.normal(0, 0.1, n)
    tracemalloc.start()
    got = interp.smooth_values(x, y, np.array([0]), np.array([n]), n * 0.01)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
    assert abs(((got - y) ** 2).sum() / (n * 0.01) - 1) < 1e-8
