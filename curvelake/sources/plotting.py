"""Plots as a gnuplot script with its data; ``E by U where n=1 > fig.gp``."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.plans import lang
from curvelake.plans.settings import PLOT
from curvelake.plans.tree import c

CLAUSE = re.compile(r"\s+(by|where|with|vs)\s+|\s*>\s*(?=\S+\.\w+$)")


def parse_plot(text: str) -> dict:
    """``EXPR[, EXPR] [vs X] [by A, B] [where TESTS] [with OPTIONS] [> FILE]``."""
    file = None
    m = re.search(r"\s>\s*(\S+\.\w+)\s*$", text)
    if m:
        file, text = m[1], text[: m.start()]
    parts = re.split(r"\s+(by|where|with|vs)\s+", text)
    out = {"expr": parts[0].strip(), "file": file, "by": [], "where": "", "with": {}, "vs": None}
    for k, v in zip(parts[1::2], parts[2::2], strict=True):
        if k == "by":
            out["by"] = [x.strip() for x in v.split(",")]
        elif k == "with":
            out["with"] = dict(x.split("=", 1) for x in re.split(r",\s*(?=\w+=)", v))
        else:
            out[k] = v.strip()
    return out


def plot(session, text: str) -> str:
    """Writes the data and the script, and returns the script's path."""
    spec = parse_plot(text)
    look = {**PLOT, **session.plot_own}
    own = {k: v for k, v in spec["with"].items() if k not in PLOT}
    look |= {k: v for k, v in spec["with"].items() if k in PLOT}
    f = session.field(spec["expr"], spec["where"], **own)
    x = spec["vs"] or f.type.axis
    if x is None:
        raise FieldError("there is no axis to plot along: say vs X")
    o = f.type.only() if len(f.type.outputs) == 1 else f.type.outputs[0]
    fixed = {t.name for t in lang.parse_tests(spec["where"]) if t.op == "=" and not isinstance(t.value, tuple)} if spec["where"] else set()
    free = [n for n in f.type.key(x) if n not in spec["by"] and n not in fixed]
    for n in free:
        if f.df.select(c(n)).distinct().limit(2).count() > 1:
            raise FieldError(f"input {n} is not fixed: curves of different values would overlap; add it to by, or fix it in where")
    base = os.path.splitext(spec["file"] or os.path.join(".curvelake", "last_plot.gp"))[0]
    base = os.path.join(session.folder, base)
    os.makedirs(os.path.dirname(base) or ".", exist_ok=True)
    rows = f.df
    if o.error and o.error in f.type.outs:
        rows = rows.withColumn("__e", c(o.error))
    keys = f.type.key(x)
    cols = [c(k) for k in keys] + [c(x), c(o.name)] + ([F.col("__e")] if "__e" in rows.columns else [])
    titles, last, n = [], object(), -1
    with open(base + ".data", "w") as out:
        for r in rows.select(*cols).orderBy(*[c(k) for k in keys], c(x)).toLocalIterator():
            at = tuple(r[: len(keys)])
            if at != last:
                n, last = n + 1, at
                out.write("\n\n" if n else "")
                titles.append(", ".join(f"{k}={v}" for k, v in zip(keys, at, strict=True) if k in spec["by"]) or spec["expr"])
            out.write(" ".join("nan" if v is None else str(v) for v in r[len(keys) :]) + "\n")
    style = "yerrorlines" if "__e" in rows.columns else {"points": "points", "both": "linespoints"}.get(look["style"], "lines")
    unit = f.type.input(x).unit
    lines = [
        f"set terminal pngcairo size {look['size']}", f"set output '{base}.png'", f"set xlabel '{x}{f' [{unit}]' if unit else ''}'", f"set ylabel '{o.name}{f' [{o.unit}]' if o.unit else ''}'",
        "plot " + ", ".join(f"'{base}.data' index {i} with {style} title '{t}'" for i, t in enumerate(titles)),
    ]
    with open(base + ".gp", "w") as out:
        out.write("\n".join(lines) + "\n")
    return base + ".gp"
