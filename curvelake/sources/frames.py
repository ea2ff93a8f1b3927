"""Tables that are DataFrames already: registered ones and Parquet files with declared inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.functions import formula
from curvelake.operators.relational import SQL, duplicates
from curvelake.plans.tree import Context, Field, c
from curvelake.types import Schema, given, made, schema


def normalized(df: DataFrame, ftype: Schema, digits: int | None, ctx: Context, nan_rows: str = "drop") -> DataFrame:
    """Declared types; float inputs rounded, NaN as NULL, and points with a missing input left out."""
    cols = []
    for v in ftype.inputs:
        x = c(v.name).cast(SQL[v.dtype])
        cols.append((formula.norm(formula.clean(x), digits) if v.dtype == "float" else x).alias(v.name))
    cols += [formula.clean(c(o.name).cast("double")).alias(o.name) for o in ftype.outputs]
    out = df.select(*cols, *[c(n) for n in df.columns if n.startswith("__")])
    gone = F.lit(False)
    for v in ftype.inputs:
        gone = gone | c(v.name).isNull()
    if nan_rows == "error":
        bad = gone
        for o in ftype.outputs:
            bad = bad | c(o.name).isNull()
        ctx.check("rows with missing values", out.where(bad))
    ctx.note("rows with a missing input dropped", out.where(gone))
    return out.where(~gone)


@dataclass
class Frame:
    """A DataFrame with declared inputs.  ``order`` names columns that place a row among its repeats."""

    make: Callable[[Context], DataFrame]
    type: Schema
    repeats: str = "error"
    order: tuple[str, ...] = ()
    digits: int | None = formula.DIGITS
    nan_rows: str = "drop"

    def read(self, ctx: Context, tests=(), repeats: str = "", nan_rows: str = "") -> tuple[DataFrame, Schema]:
        df = self.make(ctx)
        place = [f"__{n}" for n in self.order]
        df = df.withColumns({p: c(n) for p, n in zip(place, self.order, strict=True)}) if place else df
        names = self.type.ins + self.type.outs
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise FieldError(f"no column {', '.join(missing)}; columns are {', '.join(df.columns)}")
        df = normalized(df.select(*[c(n) for n in names], *[c(p) for p in place]), self.type, self.digits, ctx, nan_rows or self.nan_rows)
        for t in tests:
            if t.name == "*":
                df = df.where(F.lit(False))
            elif t.name in self.type.ins and not t.column:
                df = df.where(formula.compile_test(t, c(t.name), self.type.input(t.name).dtype))
        policy = self.repeats if self.repeats == "unique" else repeats or self.repeats
        if policy in ("first", "last") and not place:
            raise FieldError(f"duplicates {policy} needs an order, which registered data do not have")
        if policy != "unique":
            df = duplicates(df, self.type.ins, policy, place, ctx)
        return df, self.type


def declare(inputs: list[str], outputs: list[str], axis: str | None = None, exact: list[str] | None = None, dtypes: dict[str, str] | None = None, units: dict[str, str] | None = None) -> Schema:
    """A type from names: inputs are exact but for the axis, and floats, unless said otherwise."""
    dtypes, units = dtypes or {}, units or {}
    exact = [n for n in inputs if n != axis] if exact is None else exact
    return schema(tuple(given(n, dtypes.get(n, "float"), n in exact, units.get(n)) for n in inputs), tuple(made(n, units.get(n)) for n in outputs), axis)


def field_of(ctx: Context, name: str, df: DataFrame, ftype: Schema, repeats: str = "error", order: tuple[str, ...] = (), digits: int | None = formula.DIGITS) -> Field:
    """A field over a DataFrame, under a name that its tree uses."""
    from curvelake.plans.tree import OPS

    ctx.tables[name] = Frame(lambda _: df, ftype, repeats, order, digits)
    return OPS["source"](ctx=ctx, name=name)
