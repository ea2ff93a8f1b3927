"""Results as files that other programs read."""

from __future__ import annotations

import os

from curvelake.errors import FieldError
from curvelake.plans.tree import Field


def export(f: Field, path: str) -> int:
    """Writes ``.csv``, ``.parquet``, or ``.dat``/``.txt`` (a block for each curve under a comment with its key).

    Rows are sorted by their inputs.  The text forms are one file that the
    driver writes as rows arrive, so a result larger than its memory is fine.
    """
    kind = os.path.splitext(path)[1]
    rows = f.rows()
    if kind == ".parquet":
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.parquet(path).count()
    if kind not in (".csv", ".dat", ".txt"):
        raise FieldError(f"export writes .csv, .parquet, .dat or .txt, not {kind or path}")
    names = f.type.ins + f.type.outs
    key = f.type.key()
    order = [*key, *([f.type.axis] if f.type.axis else [])]
    if kind != ".csv" and order:
        rows = f.df.orderBy(*[f"`{n}`" for n in order])
    n, last = 0, None
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as out:
        if kind == ".csv":
            out.write(",".join(names) + "\n")
        else:
            body = [x for x in names if x not in key or not f.type.axis]
            out.write("# " + " ".join(body) + "\n")
        for r in rows.toLocalIterator():
            if kind == ".csv":
                out.write(",".join("" if r[x] is None else str(r[x]) for x in names) + "\n")
            else:
                at = tuple(r[k] for k in key) if f.type.axis else None
                if f.type.axis and at != last:
                    out.write(("\n\n" if last is not None else "") + "# " + " ".join(f"{k}={v}" for k, v in zip(key, at, strict=True)) + "\n")
                    last = at
                out.write(" ".join("nan" if r[x] is None else str(r[x]) for x in body) + "\n")
            n += 1
    return n
