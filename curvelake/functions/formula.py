"""Formulas and comparisons as native column expressions.

A missing value is NULL.  Arithmetic follows IEEE: division by zero and
logarithms of zero are infinite, what is not a number is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.plans import lang

DIGITS = 10
INF = float("inf")


def norm(c: Column, digits: int | None = DIGITS) -> Column:
    """The identity of a float input: rounded to ``digits`` decimals by the nearest even, without a negative zero; None rounds nothing."""
    if digits is None:
        return c + F.lit(0.0)
    return F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits) + F.lit(0.0)


def norm_value(v: float, digits: int = DIGITS) -> float:
    import numpy as np

    return float(np.rint(v * 10.0**digits) / 10.0**digits + 0.0)


def clean(c: Column) -> Column:
    """NaN as NULL.  The column occurs once, so that nested formulas do not grow by powers of two."""
    return F.nanvl(c, F.lit(None).cast("double"))


def _log(f):
    return lambda c: F.when(c == 0, F.lit(-INF)).otherwise(f(c))


ONE = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": _log(F.ln), "log10": _log(F.log10), "sin": F.sin, "cos": F.cos,
    "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
}
TWO = {"min": F.least, "max": F.greatest}


def divide(a: Column, b: Column) -> Column:
    """a / b; by zero as IEEE has it (NULL for 0/0)."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def names(e) -> set[str]:
    """Columns that a formula uses, dotted ones by their whole name."""
    if isinstance(e, lang.Name):
        return {e.id}
    if isinstance(e, lang.Attr):
        return {lang.show(e)}
    if isinstance(e, lang.Neg):
        return names(e.arg)
    if isinstance(e, lang.Bin):
        return names(e.left) | names(e.right)
    if isinstance(e, lang.Call):
        return set().union(*map(names, e.args))
    return set()


def compile_formula(e, columns: dict[str, Column]) -> Column:
    """A formula (text or tree) over named columns, as a double."""

    def go(e) -> Column:
        if isinstance(e, lang.Num):
            return F.lit(float(e.value))
        if isinstance(e, (lang.Name, lang.Attr)):
            name = lang.show(e)
            if name not in columns:
                raise FieldError(f"no column {name}; columns are {', '.join(columns) or 'none'}")
            return columns[name].cast("double")
        if isinstance(e, lang.Neg):
            return -go(e.arg)
        if isinstance(e, lang.Bin):
            a, b = go(e.left), go(e.right)
            return clean({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b if constant(e.right) else divide(a, b), "^": lambda: F.pow(a, b)}[e.op]())
        if isinstance(e, lang.Call) and not e.options:
            args = [go(x) for x in e.args]
            if e.fn in ONE and len(args) == 1:
                return clean(ONE[e.fn](args[0]))
            if e.fn in TWO and len(args) == 2:
                return F.when(args[0].isNull() | args[1].isNull(), None).otherwise(TWO[e.fn](*args))
        raise FieldError(f"not a formula: {lang.show(e)}")

    return go(lang.parse(e) if isinstance(e, str) else e)


def constant(e) -> float | None:
    """The value of a formula without columns, or None."""
    import numpy as np

    try:
        with np.errstate(all="ignore"):
            return _value(e)
    except FieldError:
        return None


def _value(e) -> float:
    import numpy as np

    if isinstance(e, lang.Num):
        return float(e.value)
    if isinstance(e, lang.Neg):
        return -_value(e.arg)
    if isinstance(e, lang.Bin):
        a, b = np.float64(_value(e.left)), np.float64(_value(e.right))
        return float({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: a**b}[e.op]())
    if isinstance(e, lang.Call) and e.fn in ONE and len(e.args) == 1 and not e.options:
        return float(getattr(np, e.fn)(_value(e.args[0])))
    if isinstance(e, lang.Call) and e.fn in TWO and len(e.args) == 2 and not e.options:
        return float({"min": np.minimum, "max": np.maximum}[e.fn](_value(e.args[0]), _value(e.args[1])))
    raise FieldError("not a constant")


def compile_test(t: lang.Test, column: Column, dtype: str, other: Column | None = None) -> Column:
    """One comparison.  Literals are rounded as inputs are, bounds of a range are not; ``!=`` keeps missing values."""
    if t.column:
        return {"=": column == other, "!=": column != other, "<": column < other, "<=": column <= other, ">": column > other, ">=": column >= other}[t.op]
    if dtype == "str":
        values = t.value if isinstance(t.value, tuple) else (t.value,)
        if t.op == "range":
            raise FieldError(f"{t.name} is text, which has no range")
        values = [lang.number(v) if isinstance(v, float) else v for v in values]
        if t.op in ("=", "!="):
            found = column.isin(*values)
            return found if t.op == "=" else ~F.coalesce(found, F.lit(False))
        return compile_test(lang.Test(t.name, t.op, "", True), column, dtype, F.lit(values[0]))
    values = t.value if isinstance(t.value, tuple) else (t.value,)
    if any(isinstance(v, str) for v in values):
        raise FieldError(f"{t.name} is a number and is compared with text")
    if t.op == "range":
        low, high = t.value
        test = F.lit(True)
        if low is not None:
            test = test & (column >= F.lit(float(low)))
        if high is not None:
            test = test & (column <= F.lit(float(high)))
        return test
    lits = [int(norm_value(v)) if dtype == "int" and norm_value(v).is_integer() else norm_value(v) for v in values]
    if t.op in ("=", "!="):
        found = column.isin(*lits)
        return found if t.op == "=" else ~F.coalesce(found, F.lit(False))
    one = F.lit(lits[0])
    return {"<": column < one, "<=": column <= one, ">": column > one, ">=": column >= one}[t.op]


def test_value(t: lang.Test, v) -> bool:
    """The same comparison of one Python value, for pruning on the driver."""
    if t.column:
        return True
    values = t.value if isinstance(t.value, tuple) else (t.value,)
    if t.op == "range":
        low, high = t.value
        return (low is None or v >= low) and (high is None or v <= high)
    if isinstance(v, str):
        values = [lang.number(x) if isinstance(x, float) else x for x in values]
    else:
        values = [norm_value(x) for x in values]
        v = norm_value(float(v))
    return {
        "=": lambda: v in values, "!=": lambda: v not in values, "<": lambda: v < values[0], "<=": lambda: v <= values[0],
        ">": lambda: v > values[0], ">=": lambda: v >= values[0],
    }[t.op]()
