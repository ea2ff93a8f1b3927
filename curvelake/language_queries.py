"""The language over the test tables: expressions that a session parses, places and lowers, each with the SQL that gives the same rows.

Where an expression comes to an operator that ``queries`` registers by itself,
the SQL is that operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from curvelake.queries import EV, EVU, QUERIES, SQL, Tables, _align_sql, _running, query, rs, shown
from curvelake.session import Session

_POINTS = ", ".join(str(200000 + 100000 * i) for i in range(16))


def session(d: Tables) -> Session:
    """A session in which the test tables have names."""
    s = Session(d.spark)
    evu = d.evu.df
    s.register("ev", d.ev.df, ["event_type"], "t")
    s.register("evu", evu, ["user_id", "event_type"], "t")
    for kind in ("view", "click"):
        s.register(kind, evu.where(F.col("event_type") == kind).drop("event_type"), ["user_id"], "t")
    s.register("customer", d.customer.df, ["c_nationkey", "c_custkey"])
    s.register("supplier", d.supplier.df, ["c_nationkey", "s_suppkey"])
    s.register("nation", d.nation.df, ["c_nationkey"])
    s.register("running", _running(d).df, ["user_id", "event_type"], "t")
    return s


def expression(name: str, text: str, sql: str, where: str = "", digits: dict[str, int] | None = None, before: Callable[[Session], object] | None = None, **settings) -> None:
    """Registers an expression; ``before`` prepares the session, and ``digits`` are those that the SQL rounds to."""

    def run(d: Tables):
        s = session(d)
        if before:
            before(s)
        return shown(s.eval(text, where, **settings).field, **(digits or {}))

    query(sql, name)(run)


_E = f"event_type, {rs('t', 5)} AS t"
_U = f"user_id, event_type, {rs('t', 5)} AS t"
_V = f"user_id, {rs('t', 5)} AS t"
_C = "c_nationkey::BIGINT AS c_nationkey, c_custkey"
_VIEW = "FROM evu WHERE event_type = 'view'"

# --- names, columns and comparisons ------------------------------------------------------------

expression("lang_where", "evu", f"WITH {EVU} SELECT {_U}, {rs('value')} AS value FROM evu WHERE event_type = 'view' AND t <= 900000", where="event_type='view', t<=900000")
expression("lang_where_below_map", "2*evu.value+1", f"WITH {EVU} SELECT {_U}, {rs('2 * value + 1')} AS value FROM evu WHERE event_type IN ('view', 'click')", where="event_type=['view','click']")
expression("lang_where_above_derivative", "d(evu, t, method=fd)", SQL["deriv_fd1"] + " WHERE t BETWEEN 300000 AND 900000", where="t=300000:900000")
expression("lang_column_of_input", "ev.t", SQL["column_of_input"])
expression("lang_select", "customer[c_nationkey=3:7, c_acctbal>100]", f"SELECT {_C}, {rs('c_acctbal')} AS c_acctbal FROM customer WHERE c_nationkey BETWEEN 3 AND 7 AND c_acctbal > 100")
expression(
    "lang_select_by_field", "customer[c_acctbal>=limit.value]", f"SELECT {_C}, {rs('c_acctbal')} AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= n_regionkey * 1000",
    before=lambda s: s.define("limit", "1000*nation.region"),
)

# --- arithmetic and how operands meet ----------------------------------------------------------

expression("lang_join_on_shared", "customer.c_acctbal + nation.region", f"SELECT {_C}, {rs('c_acctbal + n_regionkey')} AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
expression("lang_product_of_unshared", "customer.c_acctbal * supplier.s_acctbal / 1000", f"SELECT {_C}, s_suppkey, {rs('c_acctbal * s_acctbal / 1000', 4)} AS value FROM customer JOIN supplier ON c_nationkey = s_nationkey", digits={"value": 4})
expression("lang_constants", "(2*3 - 1)*customer.c_acctbal + 1/4", f"SELECT {_C}, {rs('5 * c_acctbal + 0.25')} AS value FROM customer")
expression("lang_constant_alone", "2^3 - 1/4", "SELECT 7.75::DOUBLE AS value")
expression("lang_bare_input", "ev.value + t/100000", f"WITH {EV} SELECT {_E}, {rs('value + t / 100000')} AS value FROM ev")
expression("lang_min_of_two", "min(ev.value, 20)", f"WITH {EV} SELECT {_E}, {rs('least(value, 20)')} AS value FROM ev")
expression("lang_min_along", "min(evu.value, t)", SQL["reduce_min"], digits={"value": 5})
expression("lang_same_operand_once", "view.value/2 + view.value/2 - view.value*2", f"WITH {EVU} SELECT {_V}, {rs('-value')} AS value {_VIEW}")
expression("lang_sign_keeps_name", "-abs(customer.c_acctbal)", f"SELECT {_C}, {rs('-abs(c_acctbal)')} AS c_acctbal FROM customer")
expression("lang_functions", "sqrt(abs(ev.value)) + exp(ev.value/100) - log(1+abs(ev.value))", f"WITH {EV} SELECT {_E}, {rs('sqrt(abs(value)) + exp(value / 100) - ln(1 + abs(value))')} AS value FROM ev")
expression("lang_against_reduction", "evu.value - max(evu.value)", f"WITH {EVU} SELECT {_U}, {rs('value - max(value) OVER (PARTITION BY user_id, event_type)')} AS value FROM evu")
for _m in ("linear", "pchip"):
    expression(f"lang_align_{_m}", "view.value - click.value", SQL[f"align_sub_{_m}"], digits={"t": 4, "value": 4}, grid="overlap(n=10)", method=_m)
# Only one operand has t, so the grid is its range.
_ASKED = SQL["align_broadcast"].replace("rg AS (SELECT user_id, greatest(ra.lo, rb.lo) AS lo, least(ra.hi, rb.hi) AS hi FROM ra JOIN rb USING (user_id))", "rg AS (SELECT * FROM ra)")
expression("lang_align_asked", "view.value - max(click.value)", _ASKED, digits={"t": 4, "value": 4}, grid="overlap(n=10)", method="linear", align="t")

# --- grids -------------------------------------------------------------------------------------


def _on_points(points: str) -> str:
    """Two linear curves' difference on a grid of given points."""
    text = _align_sql("linear")
    a = text.index("g AS (SELECT user_id, CASE")
    return text[:a] + f"g AS ({points}),\n" + text[text.index("p0va AS") :]


expression("like_grid", "view.value - click.value", _on_points("SELECT user_id, t AS q FROM a"), digits={"t": 4, "value": 4}, grid="like(view)", method="linear")
expression(
    "lang_grid_union", "view.value - click.value", _on_points("SELECT user_id, t AS q FROM (SELECT user_id, t FROM a UNION SELECT user_id, t FROM b) p JOIN rg USING (user_id) WHERE t >= lo AND t <= hi"),
    digits={"t": 4, "value": 4}, grid="union()", method="linear",
)
_FIXED = {"value": 4}
expression("lang_grid_linspace", "resample(evu, t, grid=linspace(200000, 1700000, 16), method=pchip)", SQL["resample_pchip_fixed"], digits=_FIXED)
expression("lang_grid_points", f"resample(evu, t, grid=points([{_POINTS}]), method=linear)", SQL["resample_linear_fixed"], digits=_FIXED)
expression("lang_resample_options", "resample(evu, t, grid=linspace(200000, 1700000, 16), method=linear, extrapolate=extend)", SQL["extrap_extend"], digits=_FIXED)

# --- functions ---------------------------------------------------------------------------------

expression("lang_at_value", "evu @ t=1000000", SQL["eval_linear"], method="linear")
expression("lang_at_call", "at(evu, t=1000000)", SQL["eval_pchip"], method="pchip")
expression("lang_at_list", f"evu @ t=[{_POINTS}]", SQL["at_list"], digits=_FIXED, method="pchip")
expression("lang_at_exact", "customer @ c_nationkey=3", f"SELECT c_custkey, {rs('c_acctbal')} AS c_acctbal FROM customer WHERE c_nationkey = 3")
expression("lang_using", "using(evu @ t=1000000, method=akima)", SQL["eval_akima"], method="linear")
expression("lang_stack", "stack(view=view, click=click, tag=kind)", SQL["stack_tag"])
expression("lang_rename", "rename(customer, c_nationkey=nation_key, c_acctbal=balance)", SQL["rename_io"].replace("AS nation,", "AS nation_key,"))
expression("lang_transform", "transform(ev, t, hour=t/3600)", SQL["transform_rescale"])
expression(
    "transform_with_field", "transform(customer, c_custkey, z=c_custkey+nation.region/8)",
    f"SELECT c_nationkey::BIGINT AS c_nationkey, {rs('c_custkey + n_regionkey / 8.0::DOUBLE')} AS z, {rs('c_acctbal')} AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
expression("lang_swap", "swap(running, t)", SQL["swap_monotone"], digits={"y": 4})
expression("lang_swap_branches", "swap(evu, t, branches=split)", SQL["swap_branches"])
expression("lang_derivative", "d(evu, t, method=pchip)", SQL["deriv_pchip"])
expression("lang_derivative_order", "d(evu, t, order=2, method=fd)", SQL["deriv_fd2"], digits={"value": 8})
expression("lang_running_integral", "int(evu, t, method=pchip)", SQL["cumint_pchip"], digits={"value": 2})
expression("lang_integral", "integral(evu, t)", SQL["integral_trapz"], digits={"value": 2})
expression("lang_integral_method", "integral(evu, t, method=akima)", SQL["integral_akima"], digits={"value": 2})
for _op in ("max", "mean", "sum", "count", "first", "last", "argmax", "argmin"):
    expression(f"lang_{_op}", f"{_op}(evu, t)", SQL[f"reduce_{_op}"], digits={"value": 5})
expression("lang_range", "range(evu, t)", SQL["axis_range"], digits={"lo": 5, "hi": 5})
expression("lang_points", "points(customer)", SQL["points_distinct"])
expression("lang_plugin_pointwise", "halved(ev)", SQL["plugin_pointwise"])
expression("lang_plugin_reduce", "spread_of(evu)", SQL["plugin_reduce"])
expression("lang_plugin_curve", "every_other(evu)", SQL["plugin_curve"])

# --- variables and views -----------------------------------------------------------------------

expression("lang_variable", "gain/2", f"WITH {EVU} SELECT {_V}, {rs('(value + 1) / 2')} AS value {_VIEW}", before=lambda s: s.define("gain", "view.value + 1"))
expression(
    "lang_variable_keeps_settings", "half", SQL["eval_akima"], before=lambda s: s.define("half", "evu @ t=1000000", method="akima"), method="linear",
)


def _as_view(s: Session) -> None:
    s.define("hourly", "transform(ev, t, hour=t/3600)")
    s.save("hourly", view=True)


expression("lang_view", "hourly", SQL["transform_rescale"], before=_as_view)


def _python(d: Tables):
    """The Python side of the language: handles."""
    s = session(d)
    return shown((-(s.view.value * 2 - 1) / 4).eval().field)


query(f"WITH {EVU} SELECT {_V}, {rs('-(value * 2 - 1) / 4')} AS value {_VIEW}", "python_handles")(_python)

#: The queries of this module.
NAMES = [n for n in QUERIES if n.startswith("lang_")] + ["like_grid", "transform_with_field", "python_handles"]
