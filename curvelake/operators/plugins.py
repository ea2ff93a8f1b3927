"""User functions on points and curves."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

from curvelake.errors import FieldError
from curvelake.functions import formula
from curvelake.operators.percurve import per_curve
from curvelake.plans.tree import Field, c, operator
from curvelake.types import made

REGISTRY: dict[str, "Plugin"] = {}


@dataclass
class Plugin:
    fn: Callable
    kind: str  # pointwise, reduce or curve
    version: int
    name: str

    @property
    def ref(self) -> str:
        return f"{self.fn.__module__}:{self.fn.__qualname__}@{self.version}"


def op(kind: str, version: int = 1, name: str | None = None):
    """Registers a function: ``f(y)`` for points, ``f(x, y)`` to a number or to new (x, y) for curves."""
    kind = "pointwise" if kind == "elementwise" else kind
    if kind not in ("pointwise", "reduce", "curve"):
        raise FieldError(f"kind is pointwise, reduce or curve, not {kind}")

    def deco(fn: Callable) -> Callable:
        p = Plugin(fn, kind, version, name or fn.__name__)
        REGISTRY[p.name] = REGISTRY[p.ref] = p
        return fn

    return deco


def resolve(ref: str) -> Plugin:
    """A plugin by its name, by ``module:function@version``, or by the older ``module.function``."""
    if ref in REGISTRY:
        return REGISTRY[ref]
    base = ref.split("@")[0]
    module, _, fn = base.partition(":") if ":" in base else base.rpartition(".")[::1]
    try:
        importlib.import_module(module)
    except ImportError as e:
        raise FieldError(f"no plugin {ref}") from e
    for p in REGISTRY.values():
        if p.ref == ref or (p.fn.__module__ == module and p.fn.__qualname__ == fn):
            return p
    raise FieldError(f"no plugin {ref}")


@operator()
def apply(f: Field, fn: str, along: str | None = None, options: dict | None = None):
    """A plugin applied to each output: to all points, to each curve, or to each curve for a new one."""
    p = resolve(fn)
    opts = options or {}
    if any(not isinstance(v, (int, float, str)) for v in opts.values()):
        raise FieldError("options are numbers or texts")
    run = p.fn
    if p.kind == "pointwise":

        @pandas_udf("double")
        def each(y: pd.Series) -> pd.Series:
            return pd.Series(run(y.to_numpy(float), **opts)).astype(float)

        outs = [formula.clean(each(c(n))).alias(n) for n in f.type.outs]
        return f.df.select(*[c(n) for n in f.type.ins], *outs), f.type
    x = f.type.along(along)
    key = f.type.key(x)
    kinds = dict(f.df.dtypes)
    key_schema = "".join(f"`{n}` {kinds[n]}, " for n in key)
    outs = f.type.outs
    rows_in = f.df.select(*[c(n) for n in key], c(x), *[c(o) for o in outs])
    if p.kind == "reduce":

        def one(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
            out = {n: rows[n].to_numpy()[starts] for n in key}
            xs = rows[x].to_numpy(float)
            for o in outs:
                ys, got = rows[o].to_numpy(float), []
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    ok = ~np.isnan(ys[a:b])
                    got.append(float(run(xs[a:b][ok], ys[a:b][ok], **opts)) if ok.any() else float("nan"))
                out[o] = got
            return pd.DataFrame(out, columns=[*key, *outs])

        df = per_curve(rows_in, key, x, one, key_schema + ", ".join(f"`{o}` double" for o in outs))
        return df.select(*[c(n) for n in key], *[formula.clean(c(o)).alias(o) for o in outs]), f.type.drop(x).but(outputs=tuple(made(o) for o in outs))
    o = f.type.only().name

    def curve(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        xs, ys = rows[x].to_numpy(float), rows[o].to_numpy(float)
        new_x, new_y, which = [], [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            ok = ~np.isnan(ys[a:b])
            nx, ny = run(xs[a:b][ok], ys[a:b][ok], **opts)
            new_x.append(np.asarray(nx, float))
            new_y.append(np.asarray(ny, float))
            which.append(np.full(len(new_x[-1]), a))
        at = np.concatenate(which) if which else np.zeros(0, int)
        out = {n: rows[n].to_numpy()[at] for n in key}
        return pd.DataFrame(out | {x: np.concatenate(new_x), o: np.concatenate(new_y)}, columns=[*key, x, o])

    df = per_curve(rows_in, key, x, curve, key_schema + f"`{x}` double, `{o}` double")
    df = df.select(*[c(n) for n in key], formula.norm(c(x)).alias(x), formula.clean(c(o)).alias(o))
    f.ctx.check(f"{p.name} made points of equal {x}", df.groupBy(*[c(n) for n in [*key, x]]).count().where("count > 1"))
    ins = tuple(v.but(exact=False, dtype="float") if v.name == x else v for v in f.type.inputs)
    return df, f.type.but(inputs=ins, outputs=(made(o),))


