"""A table's declaration from a folder of files."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import SparkSession

from curvelake.errors import FieldError
from curvelake.sources.index import Store

SEGMENT = re.compile(r"([A-Za-z]+)_?([-+]?\d+\.?\d*)")


def guess(spark: SparkSession, root: str) -> dict:
    """Pattern and columns: ``name_number`` parts of paths are inputs, a comment on top names the columns."""
    store = Store(spark, root)
    files = [p for p, _, _ in store.files() if not any(x.startswith((".", "_")) for x in p.split("/"))]
    if not files:
        raise FieldError(f"{root} has no files")

    def shape(path: str) -> str:
        stem, dot, end = path.rpartition(".")
        parts = []
        for seg in (stem if dot and "/" not in end else path).split("/"):
            parts.append(SEGMENT.sub(lambda m: f"{m[1]}{'_' if '_' in m[0] else ''}{{{m[1]}}}", seg))
        return "/".join(parts) + (dot + end if dot and "/" not in end else "")

    pattern, _ = Counter(map(shape, files)).most_common(1)[0]
    first = next(f for f in files if shape(f) == pattern)
    lines = store.read(first).decode(errors="replace").splitlines()
    head = next((x.lstrip("# ").split() for x in lines if x.startswith("#")), None)
    body = next((x for x in lines if x.strip() and not x.startswith("#")), "")
    csv = "," in body
    width = len(body.split(",") if csv else body.split())
    reader: dict = {"format": "csv" if csv else "text"}
    if csv and re.search(r"[A-Za-z]", body):
        names = [x.strip() for x in body.split(",")]
    else:
        names = head if head and len(head) == width else [f"c{i}" for i in range(width)]
        reader["columns"] = names
    inputs = re.findall(r"\{(\w+)\}", pattern)
    return {"source": {"locator": "glob", "root": root, "pattern": pattern, "reader": reader}, "field": {"inputs": [*inputs, names[0]], "axis": names[0], "outputs": names[1:]}}


def to_toml(spec: dict) -> str:
    def value(v) -> str:
        return "[" + ", ".join(map(value, v)) + "]" if isinstance(v, list) else f'"{v}"' if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    out = []
    for section, got in spec.items():
        inner = {k: v for k, v in got.items() if isinstance(v, dict)}
        out.append(f"[{section}]")
        out += [f"{k} = {value(v)}" for k, v in got.items() if not isinstance(v, dict)]
        for k, v in inner.items():
            out.append(f"\n[{section}.{k}]")
            out += [f"{a} = {value(b)}" for a, b in v.items()]
        out.append("")
    return "\n".join(out)
