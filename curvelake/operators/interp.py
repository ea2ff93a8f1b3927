"""Curves as segments.

Every method but ``linear`` is a choice of slopes at a curve's points; between
two points the curve is the cubic with the points' values and slopes.  The
slopes of ``linear``, ``pchip`` and ``akima`` need a few neighbours, so they
are window expressions.  ``cubic`` and ``smooth`` solve a system for a whole
curve in a grouped Python step, and then are segments like the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.operators.percurve import per_curve
from curvelake.plans.tree import Context, c

#: Points that a method needs.
NEEDS = {"linear": 2, "pchip": 2, "akima": 5, "cubic": 4, "smooth": 4}


def method_name(method: str) -> tuple[str, float]:
    """A method and its parameter: ``smooth(0.1)`` or ``smooth:0.1``."""
    name, _, rest = method.replace("(", ":").rstrip(")").partition(":")
    if name not in NEEDS:
        raise FieldError(f"method is one of {', '.join(NEEDS)}, not {method}")
    return name, float(rest) if rest else 0.0


def _pchip(x: str, y: str, w: Window) -> list[tuple[str, Column]]:
    d, h = F.col("__d"), F.col("__h")
    d0, h0 = F.lag(d).over(w), F.lag(h).over(w)
    w1, w2 = 2 * h + h0, h + 2 * h0
    inner = F.when(d0 * d <= 0, F.lit(0.0)).otherwise(F.try_divide(w1 + w2, F.try_divide(w1, d0) + F.try_divide(w2, d)))

    def end(ha: Column, hb: Column, da: Column, db: Column) -> Column:
        e = F.try_divide((2 * ha + hb) * da - ha * db, ha + hb)
        return F.when(db.isNull(), da).when(F.signum(e) != F.signum(da), F.lit(0.0)).when((F.signum(da) != F.signum(db)) & (F.abs(e) > 3 * F.abs(da)), 3 * da).otherwise(e)

    left = end(h, F.lead(h).over(w), d, F.lead(d).over(w))
    right = end(h0, F.lag(h, 2).over(w), d0, F.lag(d, 2).over(w))
    return [("__m", F.when(d0.isNull(), left).when(d.isNull(), right).otherwise(inner))]


def _akima(x: str, y: str, w: Window) -> list[tuple[str, Column]]:
    d = F.col("__d")
    back = [F.lag(d, k).over(w) for k in (1, 2, 3)]
    fore = [F.lead(d, k).over(w) for k in (1, 2)]
    # Slopes beyond the ends continue the last two in a straight line.
    m1 = F.coalesce(back[0], 2 * d - fore[0])  # of the segment before the point
    after = F.coalesce(d, 2 * back[0] - back[1])
    m0 = F.when(back[0].isNull(), 3 * d - 2 * fore[0]).otherwise(F.coalesce(back[1], 2 * back[0] - d))
    m3 = F.when(d.isNull(), 3 * back[0] - 2 * back[1]).otherwise(F.coalesce(fore[0], 2 * d - back[0]))
    return [("__s0", m0), ("__s1", m1), ("__s2", after), ("__s3", m3)]


def _akima_slope(key: list[Column]) -> Column:
    s0, s1, s2, s3 = (F.col(f"__s{i}") for i in range(4))
    a, b = F.abs(s3 - s2), F.abs(s1 - s0)
    top = F.max(a + b).over(Window.partitionBy(*key))
    return F.when(a + b > 1e-9 * top, F.try_divide(a * s1 + b * s2, a + b)).otherwise((s1 + s2) / 2)


#: Curves that are worked on together; what is left of fewer goes point by point.
TOGETHER = 8


def cubic_slopes(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Slopes of the twice smooth cubics whose outer two pairs of segments are one cubic each; rows of no curve get none.

    Each curve's system has three diagonals.  It is eliminated one point of
    all curves at a time, the longest curves first, so those that go on are
    always the first ones.
    """
    by_length = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[by_length], ends[by_length]
    lens = ends - starts
    out = np.full(len(x), np.nan)
    if not len(lens):
        return out
    first, last = starts, ends - 1
    h = np.diff(x, append=np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.diff(y, append=np.nan) / h
    before = np.concatenate([h[:1], h[:-1]])
    low, mid, up = h.copy(), 2 * (before + h), before.copy()
    rhs = 3 * (h * np.concatenate([d[:1], d[:-1]]) + before * d)
    mid[first], up[first] = h[first + 1], h[first] + h[first + 1]
    rhs[first] = ((h[first] + 2 * up[first]) * h[first + 1] * d[first] + h[first] ** 2 * d[first + 1]) / up[first]
    mid[last], low[last] = h[last - 2], h[last - 1] + h[last - 2]
    rhs[last] = (h[last - 1] ** 2 * d[last - 2] + (2 * low[last] + h[last - 1]) * h[last - 2] * d[last - 1]) / low[last]
    # How many curves have more than k points, for each k; a few long ones end in steps of one curve.
    more = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0] + 1), side="right")
    shared = int(np.searchsorted(-more, -TOGETHER, side="right"))
    rest = [(a, z) for a, z, n in zip(starts.tolist(), ends.tolist(), lens.tolist(), strict=True) if n > max(shared, 1)]

    for k in range(1, shared):
        i = first[: more[k]] + k
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    for a, z in rest:
        at = a + max(shared, 1) - 1
        lo, mi, u, r = (v[at:z].tolist() for v in (low, mid, up, rhs))
        for i in range(1, len(lo)):
            f = lo[i] / mi[i - 1]
            mi[i] -= f * u[i - 1]
            r[i] -= f * r[i - 1]
        mid[at:z], rhs[at:z] = mi, r
    out[last] = rhs[last] / mid[last]
    for k in range(1, shared):
        i = last[: more[k]] - k
        out[i] = (rhs[i] - up[i] * out[i + 1]) / mid[i]
    for a, z in rest:
        to = z - max(shared, 1)  # the points after it have their slopes
        mi, u, r, m = (v[a : to + 1].tolist() for v in (mid, up, rhs, out))
        for i in range(len(m) - 2, -1, -1):
            m[i] = (r[i] - u[i] * m[i + 1]) / mi[i]
        out[a : to + 1] = m
    return out


#: Decades of the weight of smoothness that are searched, and how near to its bound the search goes.
DECADES, NEAR = 30.0, 1e-12


class _Smoother:
    """Natural cubics through many curves' points, smoothed with a weight for each curve.

    A curve's system has five diagonals, one row for each inner point.  All
    curves are eliminated together, the longest first.  Rows are kept by their
    place in the curve, so that a step works on slices and memory is in
    proportion to points.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        by_length = np.argsort(starts - ends, kind="stable")
        starts, inner = starts[by_length], (ends - starts - 2)[by_length]
        self.order, self.y = by_length, y
        # How many curves have more than k inner points; rows of place k are offs[k] to offs[k] + more[k].
        more = len(inner) - np.searchsorted(inner[::-1], np.arange(inner[0] + 1), side="right")
        self.more, self.offs = more.tolist(), np.concatenate([[0], np.cumsum(more)]).tolist()
        place = np.repeat(np.arange(len(more)), more)
        self.curve = np.arange(len(place)) - np.asarray(self.offs)[place]
        self.at = at = starts[self.curve] + place  # the point before each inner one
        self.points = np.concatenate([np.arange(b, b + n + 2) for b, n in zip(starts.tolist(), inner.tolist(), strict=True)])
        self.owner = np.repeat(np.arange(len(inner)), inner + 2)
        h0, h1 = x[at + 1] - x[at], x[at + 2] - x[at + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.a, self.b, self.c = 1 / h0, -1 / h0 - 1 / h1, 1 / h1
            self.qy = self.a * y[at] + self.b * y[at + 1] + self.c * y[at + 2]
            self.r = (h0 + h1) / 3, h1 / 6
            one, two = self._later(1), self._later(2)
            self.qq = self.a**2 + self.b**2 + self.c**2, self.b * self.a[one] + self.c * self.b[one], self.c * self.a[two]

    def _later(self, k: int) -> np.ndarray:
        """Each row's row ``k`` places on; rows without one get themselves, and what they read is not used."""
        out = np.arange(len(self.at))
        for i in range(len(self.more) - k):
            n = self.more[i + k]
            out[self.offs[i] : self.offs[i] + n] = self.offs[i + k] + np.arange(n)
        return out

    def residuals(self, p: np.ndarray) -> np.ndarray:
        """What smoothing takes from each value, at ``points``; ``p`` has a weight for each curve, longest first."""
        w = p[self.curve]
        d, e = self.r[0] + w * self.qq[0], self.r[1] + w * self.qq[1]
        g, z = w * self.qq[2], self.qy.copy()
        l1, l2 = np.empty_like(d), np.empty_like(d)
        offs, more = self.offs, self.more
        for k in range(len(more)):
            i, n = offs[k], more[k]
            here = slice(i, i + n)
            if k:
                b = slice(offs[k - 1], offs[k - 1] + n)
                d[here] -= l1[b] * e[b]
                z[here] -= l1[b] * z[b]
                e[here] -= l1[b] * g[b]
            if k > 1:
                b = slice(offs[k - 2], offs[k - 2] + n)
                d[here] -= l2[b] * g[b]
                z[here] -= l2[b] * z[b]
            l1[here] = e[here] / d[here]
            l2[here] = g[here] / d[here]
        u = z / d
        for k in range(len(more) - 2, -1, -1):
            i = offs[k]
            n = more[k + 1]
            u[i : i + n] -= l1[i : i + n] * u[offs[k + 1] : offs[k + 1] + n]
            if k + 2 < len(more):
                n = more[k + 2]
                u[i : i + n] -= l2[i : i + n] * u[offs[k + 2] : offs[k + 2] + n]
        u *= w
        out = np.zeros(len(self.y))
        out[self.at] += self.a * u
        out[self.at + 1] += self.b * u
        out[self.at + 2] += self.c * u
        return out[self.points]


def smooth_values(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray, s: float) -> np.ndarray:
    """Values of the smoothest natural cubics whose squared residuals sum to ``s`` at most; rows of no curve keep theirs."""
    out = y.copy()
    if not len(starts):
        return out
    m = _Smoother(x, y, starts, ends)
    bound = np.log(max(s, 1e-300))

    def over(t: np.ndarray) -> np.ndarray:
        """By how much the logarithm of the squares passes the bound."""
        return np.log(np.maximum(np.bincount(m.owner, m.residuals(10.0**t) ** 2, len(t)), 1e-300)) - bound

    with np.errstate(all="ignore"):
        # Chandrupatla's search: a and b hold the weight between them, c is the point left behind.
        a, b = np.full(len(starts), -DECADES), np.full(len(starts), DECADES)
        fa, fb = over(a), over(b)
        whole, none = fb <= 0, fa > 0  # bounds that all weights keep, and that none keeps
        step = np.full(len(starts), 0.5)
        c, fc = a.copy(), fa.copy()
        for _ in range(100):
            t = a + step * (b - a)
            f = over(t)
            same = (f > 0) == (fa > 0)
            c, fc = np.where(same, a, b), np.where(same, fa, fb)
            b, fb = np.where(same, b, a), np.where(same, fb, fa)
            a, fa = t, f
            least = NEAR / np.abs(b - a)
            if np.all((least > 0.5) | whole | none | np.isnan(f)):
                break
            xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
            bent = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
            step = np.where((phi**2 < xi) & ((1 - phi) ** 2 < 1 - xi), bent, 0.5)
            step = np.clip(step, np.minimum(least, 0.5), np.maximum(1 - least, 0.5))
        best = np.where(whole, DECADES, np.where(none, -DECADES, np.where(fa <= 0, a, b)))
        out[m.points] -= m.residuals(10.0**best)
    return out


def _solved(df: DataFrame, key: list[str], x: str, y: str, name: str, s: float) -> DataFrame:
    """Points with ``__m`` (and smoothed y) by a solve for each curve, the count of its points, and what the next point has; short curves get no slopes."""
    need = NEEDS[name]

    def solve(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        xs, ys = rows[x].to_numpy(float), rows[y].to_numpy(float).copy()
        enough = ends - starts >= need
        if name == "smooth":
            ys = smooth_values(xs, ys, starts[enough], ends[enough], s)
        m = cubic_slopes(xs, ys, starts[enough], ends[enough])
        after = {}
        for n, v in (("__x1", xs), ("__y1", ys), ("__m1", m)):
            v = np.append(v[1:], np.nan)
            v[ends - 1] = np.nan
            after[n] = v
        return rows.assign(**{y: ys, "__m": m, "__n": np.repeat(ends - starts, ends - starts)}, **after)

    added = ("__m", "__x1", "__y1", "__m1")
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", __m double, __n long, __x1 double, __y1 double, __m1 double"
    solved = per_curve(df, key, x, solve, schema)
    return solved.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in added})


def _neighbours(df: DataFrame, keys: list[Column], x: str, y: str, name: str) -> DataFrame:
    """Points with their slopes from a few neighbours, and what the next point has."""
    w = Window.partitionBy(*keys).orderBy(c(x))
    nx, ny = F.lead(c(x)).over(w), F.lead(c(y)).over(w)
    df = df.withColumns({"__n": F.count("*").over(Window.partitionBy(*keys)), "__h": (nx - c(x)).cast("double"), "__d": F.try_divide(ny - c(y), nx - c(x))})
    if name == "pchip":
        df = df.withColumns(dict(_pchip(x, y, w)))
    elif name == "akima":
        df = df.withColumns(dict(_akima(x, y, w))).withColumn("__m", _akima_slope(keys)).drop("__s0", "__s1", "__s2", "__s3")
    else:
        df = df.withColumn("__m", F.lit(None).cast("double"))
    return df.withColumns({"__x1": nx, "__y1": ny, "__m1": F.lead("__m").over(w)})


def segments(df: DataFrame, key: list[str], x: str, y: str, method: str, few: str, ctx: Context | None = None) -> DataFrame:
    """A curve's valid points with ``__n`` (points), ``__d``, ``__h`` (to the next point), ``__m`` and ``__seg``.

    ``__seg`` is the segment that starts at the point: (x0, y0, x1, y1, a, b)
    with the slopes a and b at its ends; the last point has none.  With fewer
    points than the method needs, ``few`` has it: ``linear`` takes straight
    segments, ``drop`` leaves the curve out, ``error`` refuses.
    """
    name, s = method_name(method)
    if few not in ("linear", "drop", "error"):
        raise FieldError(f"fewpoints is linear, drop or error, not {few}")
    keys = [c(n) for n in key]
    df = df.select(*keys, c(x), c(y)).where(c(y).isNotNull() & c(x).isNotNull())
    if name in ("cubic", "smooth"):
        # The step over whole curves knows each point's next one, so the rows need not be dealt again.
        df = _solved(df, key, x, y, name, s)
        df = df.withColumns({"__h": F.col("__x1") - c(x), "__d": F.try_divide(F.col("__y1") - c(y), F.col("__x1") - c(x))})
    else:
        df = _neighbours(df, keys, x, y, name)
    enough = F.col("__n") >= NEEDS[name]
    if few == "error" and ctx is not None:
        ctx.check(f"curves with fewer than {NEEDS[name]} points", df.where(~enough).select(*keys).distinct())
    straight = F.lit(True) if name == "linear" else ~enough
    seg = F.struct(
        c(x).cast("double").alias("x0"), c(y).alias("y0"), F.col("__x1").cast("double").alias("x1"), F.col("__y1").alias("y1"),
        F.when(straight, F.col("__d")).otherwise(F.col("__m")).alias("a"), F.when(straight, F.col("__d")).otherwise(F.col("__m1")).alias("b"),
    )
    usable = F.col("__x1").isNotNull() & (enough if few == "drop" else F.lit(True))
    return df.withColumn("__seg", F.when(usable, seg)).withColumn("__straight", straight).drop("__x1", "__y1", "__m1")


def value(seg: Column, q: Column) -> Column:
    """The segment's cubic at q."""
    h = seg["x1"] - seg["x0"]
    t = (q - seg["x0"]) / h
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * seg["y0"] + (t3 - 2 * t2 + t) * h * seg["a"] + (3 * t2 - 2 * t3) * seg["y1"] + (t3 - t2) * h * seg["b"]


def area(seg: Column) -> Column:
    """The segment's integral."""
    h = seg["x1"] - seg["x0"]
    return h * (seg["y0"] + seg["y1"]) / 2 + h * h * (seg["a"] - seg["b"]) / 12


def derivative(seg: Column, order: int, right: bool) -> Column:
    """A derivative of the segment at its left or right end."""
    h = seg["x1"] - seg["x0"]
    d = (seg["y1"] - seg["y0"]) / h
    if order == 1:
        return seg["b"] if right else seg["a"]
    if order == 2:
        return (2 * seg["a"] + 4 * seg["b"] - 6 * d) / h if right else (6 * d - 4 * seg["a"] - 2 * seg["b"]) / h
    return 6 * (seg["a"] + seg["b"] - 2 * d) / (h * h)
