"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from curvelake import language_queries, source_queries
from curvelake import queries as Q

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = [
    "source_norm", "dup_mean", "dup_first", "dup_last", "dup_drop", "slice_key", "map_funcs", "map_div_zero", "map_minmax", "filter_ne_keeps_missing", "filter_col_col", "filter_eq_list",
    "transform_with_output", "join_three_way", "join_product", "stack_tag_filter", "union_points", "reduce_argmax", "reduce_first", "reduce_exact_input", "integral_akima", "integral_trapz",
    "deriv_fd2", "deriv_akima", "deriv_pchip2", "cumint_pchip", "eval_pchip", "resample_akima_fixed", "extrap_extend", "fewpoints_drop", "resample_cubic", "span_log", "span_step",
    "overlap_grid", "merge_points", "align_sub_pchip", "align_broadcast", "swap_branches", "legendre_convex", "plugin_reduce", "plugin_curve",
] + [*language_queries.NAMES, *source_queries.NAMES, "unmatched_report"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, (float, np.floating)) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    got = Q.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_smooth_runs(spark):
    assert Q.QUERIES["resample_smooth"](spark, DATA).count() > 0


def test_all_have_sql():
    assert set(Q.QUERIES) - set(Q.SQL) == {"resample_smooth"}
