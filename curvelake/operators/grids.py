"""Grids: points on which curves are compared."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.functions import formula
from curvelake.plans.tree import Field, c, operator
from curvelake.types import Column, Schema, given, schema


def spread(lo: Column, hi: Column, n: int | None, step: float | None, scale: str) -> Column:
    """An array of points from lo to hi: n of them, or one each step."""
    if step is not None:
        count = F.floor((hi - lo) / F.lit(float(step)) + F.lit(1e-9)).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda i: lo + i * F.lit(float(step)))
    if n is None or n < 1:
        raise FieldError("a grid needs n or step")
    if n == 1:
        return F.array(lo)
    last = F.lit(float(n - 1))
    if scale == "log":
        # The ends are taken as they are: a power may miss them by a rounding.
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == 0, lo).when(i == n - 1, hi).otherwise(lo * F.pow(hi / lo, i / last)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, hi).otherwise(lo + i * ((hi - lo) / last)))


def _spanned(df: DataFrame, ftype: Schema, x: str, n, step, scale: str, ctx) -> tuple[DataFrame, Schema]:
    ok = (F.col("lo") < F.col("hi")) & F.col("lo").isNotNull() & (F.abs("lo") < float("inf")) & (F.abs("hi") < float("inf"))
    if scale == "log":
        ok = ok & (F.col("lo") > 0)
    ctx.note("ranges without points dropped", df.where(~F.coalesce(ok, F.lit(False))))
    df = df.where(ok).withColumn(x, F.explode(spread(F.col("lo"), F.col("hi"), n, step, scale))).withColumn(x, formula.norm(c(x)))
    return df.dropDuplicates([*ftype.ins, x]) if step is None and n and n > 10**6 else df, schema((*ftype.inputs, given(x, "float", False)), (), x)


@operator()
def span(f: Field, name: str, n: int | None = None, step: float | None = None, scale: str = "lin", lo: str = "lo", hi: str = "hi"):
    """Points of a new input between two outputs, for each key."""
    f.type.output(lo), f.type.output(hi)
    df = f.df.select(*[c(k) for k in f.type.ins], c(lo).alias("lo"), c(hi).alias("hi"))
    return _spanned(df, f.type, name, n, step, scale, f.ctx)


def shared_range(fields: list[Field], x: str) -> tuple[DataFrame, Schema]:
    """For each key the x that all operands cover: the greatest lo to the least hi."""
    from curvelake.operators.curves import range_

    df, ftype = None, None
    for f in fields:
        r = range_(f, x)
        if df is None:
            df, ftype = r.df, r.type
            continue
        on = [n for n in r.type.ins if n in ftype.ins]
        right = r.df.withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
        df = df.join(right, on) if on else df.join(right)
        df = df.withColumn("lo", F.greatest("lo", "__lo")).withColumn("hi", F.least("hi", "__hi")).drop("__lo", "__hi")
        more = tuple(v for v in r.type.inputs if v.name not in ftype.ins)
        ftype = ftype.but(inputs=ftype.inputs + more)
    return df, ftype


@operator()
def overlap(fields: list[Field], along: str, n: int | None = None, step: float | None = None, scale: str = "lin"):
    """Points between the ends that all operands share."""
    df, ftype = shared_range(fields, along)
    return _spanned(df, ftype.but(outputs=()), along, n, step, scale, fields[0].ctx)


@operator()
def merge_points(fields: list[Field], along: str):
    """All operands' own x inside of the range that they share."""
    head = fields[0].type
    for f in fields[1:]:
        if set(f.type.ins) != set(head.ins):
            raise FieldError(f"merged points need equal inputs: {head} and {f.type}")
    rng, _ = shared_range(fields, along)
    pts = None
    for f in fields:
        p = f.df.select(*[c(n) for n in head.ins])
        pts = p if pts is None else pts.unionByName(p)
    key = head.key(along)
    pts = pts.distinct()
    df = (pts.join(rng, key) if key else pts.join(F.broadcast(rng))).where((c(along) >= F.col("lo")) & (c(along) <= F.col("hi")))
    ins = tuple(v.but(exact=v.exact and v.name != along) for v in head.inputs)
    return df, schema(ins, (), along)
