"""Python steps over whole curves.

Rows are dealt by the curve's key and sorted, and a task walks through its
curves as slices of Arrow batches.  A grouped Pandas step would build a frame
for each curve, which costs more than most curves' work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from curvelake.plans.tree import c


def per_curve(df: DataFrame, key: list[str], x: str, work: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``work(rows, starts, ends)`` on frames of whole curves, each sorted by x: a curve is ``rows[start:end]``."""
    keys = [c(n) for n in key]
    dealt = (df.repartition(*keys) if key else df.coalesce(1)).sortWithinPartitions(*keys, c(x))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of a curve that may go on in the next batch

        def whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = (pd.concat(parts) if len(parts) > 1 else parts[0]).reset_index(drop=True)
            starts = cuts(rows)
            return work(rows, starts, np.append(starts[1:], len(rows)))

        def cuts(rows: pd.DataFrame) -> np.ndarray:
            new = np.zeros(len(rows), bool)
            new[:1] = True
            for n in key:
                v = rows[n].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(new)

        for pdf in batches:
            if not len(pdf):
                continue
            last = cuts(pdf)[-1]
            goes_on = held and all(held[-1][n].iloc[-1] == pdf[n].iloc[0] for n in key)
            if last == 0 and (goes_on or not held):
                held.append(pdf)
                continue
            yield whole([*held, pdf.iloc[:last]] if last else held)
            held = [pdf.iloc[last:]]
        if held:
            yield whole(held)

    return dealt.mapInPandas(run, schema)
