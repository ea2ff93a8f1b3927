"""Operators along an input: reductions, derivatives, integrals, resampling, change of variables."""

from __future__ import annotations

from functools import reduce as fold
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.functions import formula
from curvelake.operators import interp
from curvelake.plans import lang
from curvelake.plans.tree import OPS, Field, c, operator
from curvelake.types import Schema, given, made, schema

REDUCTIONS = ("max", "min", "mean", "sum", "count", "first", "last", "argmax", "argmin", "integral")


def _picks(op: str, x: Column, y: Column) -> Column:
    has = y.isNotNull()
    x = x.cast("double")
    return {
        "max": lambda: F.max(y), "min": lambda: F.min(y), "mean": lambda: F.avg(y), "sum": lambda: F.sum(y), "count": lambda: F.count(y).cast("double"),
        "first": lambda: F.min_by(y, F.when(has, x)), "last": lambda: F.max_by(y, F.when(has, x)),
        # Ties go to the smallest x; a curve without values has none.
        "argmax": lambda: -F.max(F.when(has, F.struct(y.alias("y"), (-x).alias("x"))))["x"], "argmin": lambda: F.min(F.when(has, F.struct(y.alias("y"), x.alias("x"))))["x"],
    }[op]()


@operator("reduce")
def reduce_(f: Field, op: str, along: str | None = None, method: str = "trapz"):
    """One value for each curve: of its points, or of their integral."""
    if op not in REDUCTIONS:
        raise FieldError(f"no reduction {op}")
    x = f.type.along(along)
    f.type.number(x)
    key = f.type.key(x)
    keys = [c(n) for n in key]
    outs = f.type.outputs
    unit = {"count": lambda o: None, "argmax": lambda o: f.type.input(x).unit, "argmin": lambda o: f.type.input(x).unit, "integral": lambda o: None}.get(op, lambda o: o.unit)
    new = f.type.drop(x).but(outputs=tuple(made(o.name, unit(o)) for o in outs))
    if op != "integral":
        aggs = [_picks(op, c(x), c(o.name)).alias(o.name) for o in outs]
        df = f.df.groupBy(*keys).agg(F.count("*").alias("__rows"), *aggs)
        return df.where("__rows > 0"), new
    df = None
    for o in outs:
        if method == "trapz":
            one = _valid(f.df, key, x, o.name)
            w = Window.partitionBy(*keys, F.col("__ok")).orderBy(c(x))
            step = F.when(F.col("__ok"), (c(o.name) + F.lag(c(o.name)).over(w)) / 2 * (c(x) - F.lag(c(x)).over(w)))
            one = one.withColumn("__a", step).groupBy(*keys).agg(F.sum("__a").alias(o.name))
        else:
            seg = interp.segments(f.df, key, x, o.name, method, "linear").withColumn("__a", interp.area(F.col("__seg")))
            one = seg.groupBy(*keys).agg(F.sum("__a").alias(o.name))
            one = _all_keys(f.df, keys, key, one)
        df = one if df is None else df.join(one, key) if key else df.join(one)
    return df, new


def _all_keys(df: DataFrame, keys: list[Column], key: list[str], one: DataFrame) -> DataFrame:
    """Curves without a valid point keep a row, too."""
    return df.select(*keys).distinct().join(one, key, "left") if key else one


def _valid(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Points with ``__ok``: windows over it see only valid points, each output having its own."""
    return df.withColumn("__ok", c(y).isNotNull() & c(x).isNotNull())


@operator("range")
def range_(f: Field, along: str | None = None):
    """The least and greatest x of each curve, as ``lo`` and ``hi``."""
    x = f.type.along(along)
    f.type.number(x)
    unit = f.type.input(x).unit
    df = f.df.groupBy(*[c(n) for n in f.type.key(x)]).agg(F.min(c(x)).cast("double").alias("lo"), F.max(c(x)).cast("double").alias("hi")).where(F.col("lo").isNotNull())
    return df, f.type.drop(x).but(outputs=(made("lo", unit), made("hi", unit)))


def _gradient(x: Column, y: Column, w: Window) -> Column:
    """Second-order differences on uneven steps, one-sided at the ends."""
    xa, xb, ya, yb = F.lag(x).over(w), F.lead(x).over(w), F.lag(y).over(w), F.lead(y).over(w)
    hs, hd = x - xa, xb - x
    inner = F.try_divide(hs * hs * yb + (hd * hd - hs * hs) * y - hd * hd * ya, hs * hd * (hs + hd))
    return F.when(xa.isNull() & xb.isNull(), None).when(xa.isNull(), F.try_divide(yb - y, hd)).when(xb.isNull(), F.try_divide(y - ya, hs)).otherwise(inner)


@operator(same_points=True)
def deriv(f: Field, along: str | None = None, order: int = 1, method: str = "pchip", fewpoints: str = "linear"):
    """A derivative along x at a curve's own points: of the interpolant, or by differences (``fd``)."""
    x = f.type.along(along)
    f.type.number(x)
    if order not in (1, 2, 3):
        raise FieldError("order is 1, 2 or 3")
    key = f.type.key(x)
    keys = [c(n) for n in key]
    df = f.df
    rest = list(f.type.outs)
    for y in rest:
        if method == "fd":
            df = _valid(df, key, x, y)
            w = Window.partitionBy(*keys, F.col("__ok")).orderBy(c(x))
            for _ in range(order):
                df = df.withColumn(y, F.when(F.col("__ok"), _gradient(c(x).cast("double"), c(y), w)))
            continue
        one = Field(df.select(*keys, c(x), c(y)), f.type.but(outputs=(f.type.output(y),)), f.node, f.ctx)
        seg = interp.segments(one.df, key, x, y, method, fewpoints, f.ctx)
        w = Window.partitionBy(*keys).orderBy(c(x))
        last = F.lag("__seg").over(w)
        flat = F.col("__straight")
        here = F.when(F.col("__seg").isNotNull(), interp.derivative(F.col("__seg"), order, False)).otherwise(interp.derivative(last, order, True))
        got = F.when(F.lit(order > 1) & flat & (F.col("__n") >= 2), F.lit(0.0)).otherwise(here)
        seg = seg.withColumn("__v", formula.clean(got)).select(*keys, c(x), F.col("__v").alias(y))
        others = [n for n in rest if n != y]
        if not others and method.split("(")[0] not in ("smooth",):
            # One output: rows that are missing come back by a union, which moves nothing.
            df = seg.unionByName(df.where(c(y).isNull() | c(x).isNull()).select(*keys, c(x), F.lit(None).cast("double").alias(y)))
        else:
            df = df.drop(y).join(seg, [*key, x], "left")
    return df, f.type.but(outputs=tuple(made(o.name) for o in f.type.outputs))


@operator(same_points=True)
def cumint(f: Field, along: str | None = None, method: str = "trapz"):
    """The running integral from a curve's smallest x, where it is 0."""
    x = f.type.along(along)
    f.type.number(x)
    key = f.type.key(x)
    keys = [c(n) for n in key]
    df = f.df
    for y in f.type.outs:
        if method == "trapz":
            df = _valid(df, key, x, y)
            w = Window.partitionBy(*keys, F.col("__ok")).orderBy(c(x))
            step = F.coalesce((c(y) + F.lag(c(y)).over(w)) / 2 * (c(x) - F.lag(c(x)).over(w)), F.lit(0.0))
            df = df.withColumn("__a", step).withColumn(y, F.when(F.col("__ok"), F.sum("__a").over(w.rowsBetween(Window.unboundedPreceding, 0))))
        else:
            seg = interp.segments(df.select(*keys, c(x), c(y)), key, x, y, method, "linear")
            w = Window.partitionBy(*keys).orderBy(c(x))
            run = F.coalesce(F.sum(interp.area(F.col("__seg"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            df = df.drop(y).join(seg.withColumn("__v", run).select(*keys, c(x), F.col("__v").alias(y)), [*key, x], "left")
    return df, f.type.but(outputs=tuple(made(o.name) for o in f.type.outputs))


@operator()
def swap(f: Field, along: str | None = None, branches: str = "error", flat_tol: float = 1e-9):
    """Exchanges x and the output.

    Points all of whose steps are flat are dropped.  A curve that turns is an
    error, or with ``split`` gets a ``branch`` input that counts its monotone
    runs; a turning point belongs to the run before it.
    """
    return _swapped(f, along, branches, flat_tol, formula.DIGITS)


def _swapped(f: Field, along: str | None, branches: str, flat_tol: float | None, digits: int | None) -> tuple[DataFrame, Schema]:
    """``swap``; without a tolerance flat points stay, and ``digits`` are those of the new input."""
    x, o = f.type.along(along), f.type.only()
    f.type.number(x)
    if branches not in ("error", "split"):
        raise FieldError(f"branches is error or split, not {branches}")
    key = f.type.key(x)
    keys = [c(n) for n in key]
    y = o.name
    df = f.df.where(c(y).isNotNull())
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(c(x))
    if flat_tol is not None:
        small = F.lit(flat_tol) * (F.max(c(y)).over(whole) - F.min(c(y)).over(whole))
        df = df.withColumn("__before", c(y) - F.lag(c(y)).over(w)).withColumn("__after", F.lead(c(y)).over(w) - c(y)).withColumn("__small", small)
        flat = (F.col("__before").isNull() | (F.abs("__before") <= F.col("__small"))) & (F.col("__after").isNull() | (F.abs("__after") <= F.col("__small")))
        alone = F.col("__before").isNull() & F.col("__after").isNull()
        f.ctx.note("flat points dropped", df.where(flat & ~alone).select(*keys, c(x)))
        df = df.where(~flat | alone)
    df = df.withColumn("__s", F.signum(c(y) - F.lag(c(y)).over(w)))
    df = df.withColumn("__turn", (F.col("__s") != F.lag("__s").over(w)) | (F.col("__s") == 0))
    v = f.type.input(x)
    ins = tuple(given(y, "float", False, o.unit) if i.name == x else i for i in f.type.inputs)
    if branches == "error":
        f.ctx.check(f"{y} is not monotone along {x}", df.where(F.coalesce("__turn", F.lit(False))).select(*keys, c(x)))
    else:
        turns = F.sum(F.when(F.col("__turn"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("branch", turns.cast("bigint"))
        ins = (*[i for i in ins if i.name != y], given("branch", "int"), *[i for i in ins if i.name == y])
    df = df.select(*keys, *([F.col("branch")] if branches == "split" else []), formula.norm(c(y), digits).alias("__y"), c(x).cast("double").alias("__x"))
    df = df.withColumnsRenamed({"__y": y, "__x": x})
    return df, schema(ins, (made(x, v.unit),), y)


def _on_grid(f: Field, grid: Field, x: str, method: str, extrapolate: str, fewpoints: str) -> tuple[DataFrame, Schema]:
    if extrapolate not in ("nan", "error", "extend", "clamp"):
        raise FieldError(f"extrapolate is nan, error, extend or clamp, not {extrapolate}")
    key = f.type.key(x)
    keys = [c(n) for n in key]
    outs = f.type.outs
    rows = None
    for i, y in enumerate(outs):
        seg = interp.segments(f.df, key, x, y, method, fewpoints, f.ctx).where(F.col("__seg").isNotNull())
        none = F.lit(None).cast(dict(seg.dtypes)["__seg"])
        part = seg.select(*keys, c(x).cast("double").alias("__x"), *[(F.col("__seg") if j == i else none).alias(f"__seg{j}") for j in range(len(outs))])
        rows = part if rows is None else rows.unionByName(part)
    # The curves' keys come from their points, which costs no second pass over segments, and the grid points that agree with each key.
    curves = f.df.select(*keys).distinct()
    common = [n for n in grid.type.ins if n in key]
    more = [n for n in grid.type.ins if n not in key and n != x]
    g = grid.df.select(*[c(n) for n in common + more], c(x).cast("double").alias("__x"))
    asked = curves.join(g, common) if common else curves.join(F.broadcast(g) if grid.node.op == "axis" else g)
    segs = [F.lit(None).cast(dict(rows.dtypes)[f"__seg{j}"]).alias(f"__seg{j}") for j in range(len(outs))]
    if more:
        # Further grid inputs: each of their values has a lookup of its own in the curve.
        rows = rows.join(g.select(*[c(n) for n in common + more]).distinct(), common) if common else rows.join(g.select(*[c(n) for n in more]).distinct())
    names = key + more
    cols = [c(n) for n in names]
    both = rows.select(*cols, "__x", F.lit(0).alias("__g"), *[F.col(f"__seg{j}") for j in range(len(outs))]).unionByName(asked.select(*cols, "__x", F.lit(1).alias("__g"), *segs))
    w = Window.partitionBy(*cols).orderBy("__x", "__g")
    sofar, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The last segment before each grid point, and each curve's range and first segment; curves without a segment have none.
    found = {f"__s{j}": F.last(f"__seg{j}", ignorenulls=True).over(sofar) for j in range(len(outs))}
    for j in range(len(outs)):
        first, last = F.first(f"__seg{j}", ignorenulls=True).over(whole), F.last(f"__seg{j}", ignorenulls=True).over(whole)
        found[f"__r{j}"] = F.struct(first["x0"].alias("lo"), last["x1"].alias("hi"), first.alias("seg"))
    both = both.withColumns(found).where(F.col("__g") == 1)
    both = both.where(fold(or_, [F.col(f"__r{j}.seg").isNotNull() for j in range(len(outs))]))
    got = []
    for j, y in enumerate(outs):
        r, q = F.col(f"__r{j}"), F.col("__x")
        seg = F.coalesce(F.col(f"__s{j}"), r["seg"])
        outside = (q < r["lo"]) | (q > r["hi"])
        if extrapolate == "clamp":
            v = interp.value(seg, F.greatest(r["lo"], F.least(r["hi"], q)))
        elif extrapolate == "extend":
            v = interp.value(seg, q)
        else:
            v = F.when(~outside, interp.value(seg, q))
            if extrapolate == "error":
                f.ctx.check(f"grid points outside a curve of {y}", both.where(outside).select(*cols, "__x"))
        got.append(v.alias(y))
    v = grid.type.input(x)
    ins = [i.but(exact=v.exact, dtype="float") if i.name == x else i for i in f.type.inputs] + [grid.type.input(n) for n in more]
    out = both.select(*cols, F.col("__x").alias(x), *got)
    return out, schema(tuple(ins), f.type.outputs, x)


@operator()
def resample(f: Field, grid: Field, along: str | None = None, method: str = "pchip", extrapolate: str = "nan", fewpoints: str = "linear"):
    """Each curve's values on a grid; a grid without a curve's inputs serves all curves."""
    x = f.type.along(along)
    f.type.number(x)
    if x not in grid.type.ins:
        raise FieldError(f"the grid has no {x}")
    return _on_grid(f, grid, x, method, extrapolate, fewpoints)


@operator("eval")
def eval_(f: Field, value: float, along: str | None = None, method: str = "pchip", extrapolate: str = "nan", fewpoints: str = "linear"):
    """Each curve's value at one x, without a grid: the segment that holds it is found by an aggregate."""
    x = f.type.along(along)
    f.type.number(x)
    key = f.type.key(x)
    keys = [c(n) for n in key]
    v = formula.norm_value(value)
    df = None
    for y in f.type.outs:
        seg = interp.segments(f.df, key, x, y, method, fewpoints, f.ctx).where(F.col("__seg").isNotNull())
        s, q = F.col("__seg"), F.lit(v)
        # The last segment that starts at or before x; the first one for an x before all.
        one = seg.groupBy(*keys).agg(
            F.max_by(s, F.when(F.col("__seg.x0") <= q, F.col("__seg.x0"))).alias("__at"), F.min_by(s, F.col("__seg.x0")).alias("__first"),
            F.min("__seg.x0").alias("__lo"), F.max("__seg.x1").alias("__hi"),
        )
        one = one.where(F.col("__lo").isNotNull())
        at = F.coalesce("__at", "__first")
        outside = (q < F.col("__lo")) | (q > F.col("__hi"))
        if extrapolate == "clamp":
            got = interp.value(at, F.greatest(F.col("__lo"), F.least(F.col("__hi"), q)))
        else:
            got = interp.value(at, q) if extrapolate == "extend" else F.when(~outside, interp.value(at, q))
            if extrapolate == "error":
                f.ctx.check(f"{x}={v} is outside a curve", one.where(outside).select(*keys))
        one = one.select(*keys, got.alias(y))
        df = one if df is None else df.join(one, key, "full") if key else df.join(one)
    return df, f.type.drop(x)


@operator()
def align(fields: list[Field], grid: Field, labels: list, along: str, method: str = "pchip", extrapolate: str = "nan", fewpoints: str = "linear", unmatched: str = "drop"):
    """Interpolates all operands that have x onto one grid and joins them there."""
    for i, f in enumerate(fields):
        for g in fields[:i] + fields[i + 1 :]:
            on = [n for n in f.type.key(along) if n in g.type.ins and n != along]
            if on and along in f.type.ins:
                lost = f.df.select(*[c(n) for n in f.type.key(along)]).distinct().join(g.df.select(*[c(n) for n in on]).distinct(), on, "left_anti")
                (f.ctx.check if unmatched == "error" else f.ctx.note)(f"curves of {labels[i]} without a match", lost)
    on = [OPS["resample"](f, grid, along=along, method=method, extrapolate=extrapolate, fewpoints=fewpoints) if along in f.type.ins else f for f in fields]
    got = OPS["join"](on, labels=labels, unmatched=unmatched)
    return got.df, got.type


@operator()
def legendre(f: Field, along: str | None = None, slope: str = "p", result: str = "G", method: str = "pchip", branches: str = "error", flat_tol: float = 1e-9, fewpoints: str = "linear", digits: int | None = formula.DIGITS):
    """``p = dy/dx`` and ``G = p x - y``, as G over p.

    Where y is straight, p and G are the same at all its points.  ``split``
    keeps such points, each as a branch: without them a straight curve would
    have no transform.
    """
    x, o = f.type.along(along), f.type.only()
    p = OPS["deriv"](f, along=x, method=method, fewpoints=fewpoints)
    both = OPS["join"]([f, p], labels=["y", "p"])
    got = OPS["map"](both, new={"__p": f"p.{o.name}", "__g": f"p.{o.name}*{x}-y.{o.name}"})
    # Change of variables: p takes the place of x, G rides along as x does in swap.
    df, turned = _swapped(OPS["select"](got, ["__p"]), x, branches, None if branches == "split" else flat_tol, digits)
    key = f.type.key(x)
    back = df.join(got.df.select(*[c(n) for n in key], c(x).cast("double").alias(x), F.col("__g")), [*key, x])
    ins = tuple(i.but(name=slope) if i.name == "__p" else i for i in turned.inputs)
    df = back.select(*[c(i.name) for i in turned.inputs if i.name != "__p"], F.col("__p").alias(slope), F.col("__g").alias(result))
    return df, schema(ins, (made(result),), slope)


__all__ = ["REDUCTIONS", "align", "cumint", "deriv", "eval_", "lang", "legendre", "range_", "reduce_", "resample", "swap"]
