"""Operators on rows and columns: projections, filters, joins, unions."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.functions import formula
from curvelake.plans import lang
from curvelake.plans.tree import Context, Field, c, operator
from curvelake.types import Column, given, made, schema

SQL = {"float": "double", "int": "bigint", "str": "string"}


def columns(f: Field) -> dict[str, Column]:
    return {n: c(n) for n in f.type.ins + f.type.outs}


@operator()
def const(ctx: Context, value: float, unit: str | None = None):
    """One value without inputs."""
    return ctx.spark.range(1).select(F.lit(float(value)).alias("value")), schema((), (made("value", unit),))


@operator()
def axis(ctx: Context, name: str, values: str, dtype: str = "float"):
    """A fixed list of values of one input: ``list:a,b``, ``lin:a:b:n`` or ``log:a:b:n``."""
    import numpy as np

    kind, _, rest = values.partition(":")
    if kind == "list":
        v = np.array([float(x) for x in rest.split(",") if x])
    elif kind in ("lin", "log"):
        a, b, n = rest.split(":")
        v = (np.linspace if kind == "lin" else np.geomspace)(float(a), float(b), int(n))
    else:
        raise FieldError(f"not an axis: {values}")
    v = np.unique([formula.norm_value(x) for x in v])
    return ctx.spark.createDataFrame([(float(x),) for x in v], f"`{name}` double").select(c(name).cast(SQL[dtype])), schema((given(name, dtype),), (), name)


@operator(same_points=True)
def select(f: Field, outputs: list):
    """Only the outputs listed, none of them for a set of points."""
    return f.df, f.type.but(outputs=tuple(f.type.output(o) for o in outputs))


@operator(same_points=lambda p, kids: not set(p["names"]) & set(kids[0].type.ins))
def rename(f: Field, names: dict):
    """Other names for inputs or outputs."""
    unknown = [n for n in names if n not in f.type.ins + f.type.outs]
    if unknown:
        raise FieldError(f"no column {', '.join(unknown)}")
    new = schema(
        tuple(v.but(name=names.get(v.name, v.name)) for v in f.type.inputs), tuple(o.but(name=names.get(o.name, o.name), error=names.get(o.error, o.error)) for o in f.type.outputs),
        names.get(f.type.axis, f.type.axis),
    )
    return f.df.select(*[c(n).alias(names.get(n, n)) for n in f.type.ins + f.type.outs]), new


@operator("map", same_points=True)
def map_(f: Field, new: dict, keep: list | None = None, units: dict | None = None):
    """New outputs by formulas over all columns; ``keep`` names outputs that stay."""
    keep = keep or []
    cols = columns(f)
    for n in new:
        if n in f.type.ins:
            raise FieldError(f"{n} is an input")
    text = [v.name for v in f.type.inputs if v.dtype == "str"]
    for e in new.values():
        used = formula.names(lang.parse(e)) & set(text)
        if used:
            raise FieldError(f"{', '.join(sorted(used))} is text and cannot be calculated with")
    outs = [o for o in f.type.outputs if o.name in keep and o.name not in new] + [made(n, (units or {}).get(n)) for n in new]
    exprs = [formula.compile_formula(e, cols).alias(n) for n, e in new.items()]
    return f.df.select(*[c(n) for n in f.type.ins], *[c(o.name) for o in outs if o.name not in new], *exprs), f.type.but(outputs=tuple(outs))


def condition(f: Field, tests: list[lang.Test]) -> Column:
    cols = columns(f)
    kinds = {v.name: v.dtype for v in f.type.inputs}
    out = F.lit(True)
    for t in tests:
        if t.name not in cols:
            raise FieldError(f"no column {t.name}; columns are {', '.join(cols)}")
        if t.column and t.value not in cols:
            if t.op == "=" or kinds.get(t.name) == "str":
                t = lang.Test(t.name, t.op, t.value, False)
            else:
                raise FieldError(f"no column {t.value}; columns are {', '.join(cols)}")
        out = out & formula.compile_test(t, cols[t.name], kinds.get(t.name, "float"), cols.get(t.value) if t.column else None)
    return out


@operator()
def filter(f: Field, tests: str):  # noqa: A001
    """The points for which all comparisons hold."""
    return f.df.where(condition(f, lang.parse_tests(tests))), f.type


@operator()
def slice(f: Field, name: str, value):  # noqa: A001
    """The points at one value of an input, which is dropped."""
    f.type.input(name)
    return f.df.where(condition(f, [lang.Test(name, "=", value)])), f.type.drop(name)


@operator(same_points=True)
def points(f: Field):
    """The inputs alone."""
    return f.df, f.type.but(outputs=())


@operator()
def transform(f: Field, name: str, to: str, formula_: str, digits: int | None = formula.DIGITS, check: bool = False):
    """Replaces an input by a function of the columns; exact if it uses exact inputs only.

    Points whose new value is missing are dropped.  ``check`` refuses points
    that the change makes one.
    """
    f.type.input(name)
    tree = lang.parse(formula_)
    used = formula.names(tree)
    exact = all(n in f.type.ins and f.type.input(n).exact for n in used)
    value = formula.norm(formula.compile_formula(tree, columns(f)), digits)
    new = f.type.but(
        inputs=tuple(given(to, "float", exact) if v.name == name else v for v in f.type.inputs),
        axis=to if f.type.axis == name else f.type.axis, outputs=tuple(o for o in f.type.outputs if o.name != to),
    )
    df = f.df.select(*[value.alias(to) if v.name == name else c(v.name) for v in f.type.inputs], *[c(o.name) for o in new.outputs])
    f.ctx.note(f"points without a value of {to} dropped", df.where(c(to).isNull()))
    df = df.where(c(to).isNotNull())
    if check:
        keys = [c(n) for n in new.ins]
        f.ctx.check(f"the new {to} makes points one", df.groupBy(*keys).count().where("count > 1"))
    return df, new


def _merge(a: Var, b: Var) -> Var:
    if (a.dtype == "str") != (b.dtype == "str"):
        raise FieldError(f"{a.name} is text on one side and a number on the other")
    return a.but(exact=a.exact and b.exact, dtype=a.dtype if a.dtype == b.dtype else "float")


#: Parts of either side of a product; their pairs are what tasks share.
SIDES = 4


def _products(a: DataFrame, b: DataFrame, shared: list[str], mine: list[str], yours: list[str]) -> DataFrame:
    """Joins sides that both have further inputs: all pairs of rows alike in the shared ones.

    A shared value may have many pairs, and all values may lie in few rows.
    So rows of either side are dealt into parts by their inputs, and each pair
    of parts meets by itself: what a task makes and holds is bounded by pairs
    of parts, not by values or by how the tables were stored.
    """
    spark = a.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    every = F.explode(F.array(*[F.lit(i) for i in range(SIDES)]))

    def part(names: list[str]) -> Column:
        return F.pmod(F.xxhash64(*[c(x) for x in names]), F.lit(SIDES)).cast("int")

    on = [*shared, "__a", "__b"]
    a = a.withColumn("__a", part(mine)).withColumn("__b", every).repartition(n, *[c(x) for x in on])
    b = b.withColumn("__b", part(yours)).withColumn("__a", every).repartition(n, *[c(x) for x in on])
    return a.join(b, on, "inner").drop("__a", "__b")


@operator(same_points=lambda p, kids: len({k.pid for k in kids}) == 1)
def join(fields: list[Field], labels: list, unmatched: str = "drop"):
    """Natural inner join on all shared inputs; outputs are prefixed by their operand's label.

    Operands on the same points are joined on them; an operand with fewer
    inputs serves all values of the others.
    """
    if unmatched not in ("drop", "error"):
        raise FieldError(f"unmatched is drop or error, not {unmatched}")
    ctx = fields[0].ctx

    def prefixed(f: Field, label: str) -> DataFrame:
        return f.df.select(*[c(n) for n in f.type.ins], *[c(o).alias(f"{label}.{o}") for o in f.type.outs])

    df, ins = prefixed(fields[0], labels[0]), list(fields[0].type.inputs)
    outs = [o.but(name=f"{labels[0]}.{o.name}", error=None) for o in fields[0].type.outputs]
    for f, label in zip(fields[1:], labels[1:], strict=True):
        right = prefixed(f, label)
        mine = [v.name for v in ins]
        shared = [n for n in f.type.ins if n in mine]
        merged = {v.name: _merge(v, f.type.input(v.name)) for v in ins if v.name in shared}
        if unmatched == "error" or shared:
            for who, a, b in ((label, right, df), (labels[0], df, right)):
                lost = a.join(b.select(*[c(n) for n in shared]).distinct(), shared, "left_anti") if shared else None
                if lost is not None:
                    (ctx.check if unmatched == "error" else ctx.note)(f"points of {who} without a match", lost)
        if shared and len(shared) < min(len(mine), len(f.type.ins)):
            df = _products(df, right, shared, mine, f.type.ins)
        else:
            df = df.join(right, shared, "inner") if shared else df.join(right)
        ins = [merged.get(v.name, v) for v in ins] + [v for v in f.type.inputs if v.name not in mine]
        outs += [o.but(name=f"{label}.{o.name}", error=None) for o in f.type.outputs]
    first = next((f.type.axis for f in fields if f.type.axis), None)
    return df, schema(tuple(ins), tuple(outs), fields[0].type.axis or first)


@operator()
def stack(fields: list[Field], labels: list, tag: str = "source"):
    """All points of fields of like type, told apart by a text input."""
    head = fields[0].type
    for f in fields[1:]:
        if set(f.type.ins) != set(head.ins) or set(f.type.outs) != set(head.outs):
            raise FieldError(f"stack needs equal inputs and outputs: {head} and {f.type}")
    if tag in head.ins + head.outs:
        raise FieldError(f"{tag} is taken")
    names = [*head.ins, *head.outs]
    parts = [f.df.select(F.lit(label).alias(tag), *[c(n) for n in names]) for f, label in zip(fields, labels, strict=True)]
    ins = tuple(fold(_merge, [f.type.input(v.name) for f in fields]) for v in head.inputs)
    return fold(DataFrame.unionByName, parts), schema((given(tag, "str"), *ins), head.outputs, head.axis)


@operator()
def union(fields: list[Field]):
    """The distinct points of several sets of points."""
    head = fields[0].type
    for f in fields:
        if set(f.type.ins) != set(head.ins):
            raise FieldError(f"union needs equal inputs: {head} and {f.type}")
    parts = [f.df.select(*[c(n) for n in head.ins]) for f in fields]
    ins = tuple(fold(_merge, [f.type.input(v.name) for f in fields]) for v in head.inputs)
    return fold(DataFrame.unionByName, parts).distinct(), schema(ins, (), head.axis)


@operator(same_points=True)
def column(f: Field, name: str):
    """An output alone; or an input's values at each point, as the output ``value``."""
    if name in f.type.outs:
        return f.df, f.type.but(outputs=(f.type.output(name),))
    f.type.number(name)
    return f.df.select(*[c(n) for n in f.type.ins], c(name).cast("double").alias("value")), f.type.but(outputs=(made("value", f.type.input(name).unit),))


def values_of(f: Field, name: str) -> DataFrame:
    """The distinct values of an input."""
    f.type.input(name)
    return f.df.select(c(name)).distinct()


def duplicates(df: DataFrame, inputs: list[str], policy: str, order: list[str], ctx: Context) -> DataFrame:
    """One row for each tuple of inputs: ``error``, ``mean``, ``first``, ``last`` or ``drop``.

    ``first`` and ``last`` go by the file and the place in it (``order``);
    ``mean`` averages numbers and keeps the first of other columns.
    """
    from pyspark.sql import Window

    keys = [c(n) for n in inputs]
    rest = [n for n in df.columns if n not in inputs and n not in order]
    if policy == "error":
        ctx.check("repeated inputs", df.groupBy(*keys).count().where("count > 1"))
        return df.select(*keys, *[c(n) for n in rest])
    repeated = df.groupBy(*keys).count().where("count > 1")
    ctx.note(f"repeated inputs ({policy})", repeated)
    if policy == "mean":
        kinds = dict(df.dtypes)
        place = F.struct(*[c(n) for n in order]) if order else F.lit(0)
        return df.groupBy(*keys).agg(*[(F.avg(c(n)) if kinds[n] != "string" else F.min_by(c(n), place)).alias(n) for n in rest])
    if policy == "drop":
        w = Window.partitionBy(*keys)
        return df.withColumn("__n", F.count("*").over(w)).where("__n = 1").select(*keys, *[c(n) for n in rest])
    if policy in ("first", "last"):
        # One aggregation with partial results, not a sort of each key's rows.
        place = F.struct(*[c(n) for n in order])
        row = F.struct(*[c(n) for n in rest])
        pick = F.min_by(row, place) if policy == "first" else F.max_by(row, place)
        return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, *[F.col(f"__row.`{n}`").alias(n) for n in rest])
    raise FieldError(f"duplicates is error, mean, first, last or drop, not {policy}")


@operator()
def source(ctx: Context, name: str, identity: str = "", duplicates: str = "", nan_rows: str = ""):
    """A table: its chunks that can matter, read, converted, and cleared of repeated inputs."""
    tests, ctx.pushing = getattr(ctx, "pushing", ()), ()
    return ctx.tables[name].read(ctx, tests, duplicates, nan_rows)
