"""Saved results: data as Parquet, the calculation beside it, and what it was made from.

A saved result knows the fingerprints of the chunks that it read.  When some
of them change, the input values of those chunks are followed through the
tree; where they reach the result's own inputs, only the curves of those
values are computed again, and the rest is kept.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field as slot

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.plans import lang, tree
from curvelake.plans.tree import Context, Field, Node, c
from curvelake.types import Schema, given, made, schema

STATES = ("fresh", "stale", "orphaned", "modified", "invalidated", "no recipe")


def type_record(t: Schema) -> dict:
    return {"inputs": [[v.name, v.dtype, v.exact, v.unit] for v in t.inputs], "outputs": [[o.name, o.unit, o.error] for o in t.outputs], "axis": t.axis}


def type_of(r: dict) -> Schema:
    return schema(tuple(given(*v) for v in r["inputs"]), tuple(made(*o) for o in r["outputs"]), r["axis"])


@dataclass
class Dataset:
    """One saved result."""

    name: str
    path: str  # of the recipe, NAME.json; the data are in a folder beside it
    record: dict = slot(default_factory=dict)

    @property
    def type(self) -> Schema:
        return type_of(self.record["type"])

    @property
    def data(self) -> str:
        return os.path.join(os.path.dirname(self.path), self.record["data"])

    @classmethod
    def load(cls, path: str) -> Dataset:
        with open(path) as f:
            r = json.load(f)
        return cls(r["name"], path, r)

    def store(self) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        part = f"{self.path}.{uuid.uuid4().hex[:6]}"
        with open(part, "w") as f:
            json.dump(self.record, f, indent=1, sort_keys=True)
        os.replace(part, self.path)

    def read(self, ctx: Context, tests=(), repeats: str = "", nan_rows: str = "") -> tuple[DataFrame, Schema]:
        """The saved rows; a dataset is a table to those that use it."""
        from curvelake.functions import formula

        t = self.type
        if self.record.get("format") == "npz":
            import numpy as np

            with np.load(self.data, allow_pickle=False) as z:
                cols = {n: z[n].tolist() for n in t.ins + t.outs}
            kinds = {"float": "double", "int": "bigint", "str": "string"}
            schema = ", ".join([*(f"`{v.name}` {kinds[v.dtype]}" for v in t.inputs), *(f"`{o.name}` double" for o in t.outputs)])
            df = ctx.spark.createDataFrame(list(zip(*cols.values(), strict=True)), schema)
            df = df.select(*[c(n) for n in t.ins], *[formula.clean(c(n)).alias(n) for n in t.outs])
        else:
            df = ctx.spark.read.parquet(self.data)
        for x in tests:
            if not x.column and x.name in t.ins:
                df = df.where(formula.compile_test(x, c(x.name), t.input(x.name).dtype))
        return df, t


def _stamp(path: str) -> list:
    """Sizes and names of the data files, to notice that someone changed them."""
    if os.path.isfile(path):
        return [[os.path.basename(path), os.path.getsize(path)]]
    return sorted([n, os.path.getsize(os.path.join(path, n))] for n in os.listdir(path) if not n.startswith((".", "_"))) if os.path.isdir(path) else []


class Store:
    """Saves, checks and refreshes datasets of one session."""

    def __init__(self, session):
        self.s = session

    def sources(self, node: Node) -> dict[str, object]:
        """The tables and datasets that a tree reads, by name."""
        return {n.params["name"]: self.s.ctx.tables[n.params["name"]] for n in node.walk() if n.op == "source" and n.params["name"] in self.s.ctx.tables}

    def fingerprints(self, node: Node) -> dict[str, dict]:
        mode = self.s.settings["fingerprint"]
        out: dict[str, dict] = {}
        for name, t in self.sources(node).items():
            out[name] = {}
            if hasattr(t, "chunks"):
                from curvelake.sources.index import fingerprint

                for ch in t.chunks(self.s.spark, again=True):
                    salt = self.s.epochs.salt(name, ch.values())
                    print_ = fingerprint(self.s.spark, t.root, ch, mode, salt)
                    out[name][f"{ch.path}::{ch.part}" if ch.part else ch.path] = [print_, dict(ch.coords)]
            elif isinstance(t, Dataset):
                out[name]["*"] = [[t.record["saved"], 0, t.record["root"], self.s.epochs.salt(name, {})], {}]
        return out

    def write(self, ds: Dataset, f: Field, fmt: str) -> int:
        """Data first, under a new name; then the recipe that points to them; old data last."""
        old = ds.record.get("data")
        folder = os.path.dirname(ds.path) or "."
        os.makedirs(folder, exist_ok=True)
        name = f"{ds.name}-{uuid.uuid4().hex[:8]}.{fmt}"
        rows = f.rows()
        if fmt == "npz":
            import numpy as np

            pdf = rows.toPandas()
            np.savez(os.path.join(folder, name), **{n: pdf[n].to_numpy(dtype=str if pdf[n].dtype == object else None) for n in pdf.columns})
            n = len(pdf)
        else:
            # The sort is for readers that prune by ranges; files stay as many as the data need.
            rows.write.parquet(os.path.join(folder, name))
            n = self.s.spark.read.parquet(os.path.join(folder, name)).count()
        ds.record |= {"data": name, "format": fmt, "rows": n, "saved": time.time(), "stamp": _stamp(os.path.join(folder, name)), "type": type_record(f.type)}
        ds.store()
        if old and old != name:
            import shutil

            path = os.path.join(folder, old)
            shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)
        return n

    def save(self, name: str, f: Field, path: str, fmt: str, surface: str) -> Dataset:
        registered = [n for n, t in self.sources(f.node).items() if not hasattr(t, "chunks") and not isinstance(t, Dataset)]
        ds = Dataset(name, path)
        ds.record = {
            "name": name, "surface": surface, "root": f.node.id, "nodes": tree.dump(f.node), "pinned": False, "reproducible": not registered,
            "inputs": {} if registered else self.fingerprints(f.node), "mode": self.s.settings["fingerprint"],
        }
        self.write(ds, f, fmt)
        return ds

    def changes(self, ds: Dataset) -> dict[str, list]:
        """Chunks that changed, were added or removed, with their inputs, by table."""
        node, _ = tree.load(ds.record["nodes"])
        now, was = self.fingerprints(node), ds.record["inputs"]
        out: dict[str, list] = {}
        for name in {*now, *was}:
            a, b = was.get(name, {}), now.get(name, {})
            for path in sorted({*a, *b}):
                if path not in b:
                    out.setdefault(name, []).append(("removed", path, a[path][1]))
                elif path not in a:
                    out.setdefault(name, []).append(("added", path, b[path][1]))
                elif a[path][0] != b[path][0]:
                    out.setdefault(name, []).append(("changed", path, b[path][1]))
        return out

    def status(self, ds: Dataset) -> str:
        if not ds.record.get("reproducible", True):
            return "no recipe"
        if self.s.epochs.named(ds.name) > ds.record["saved"]:
            return "invalidated"
        if _stamp(ds.data) != [list(x) for x in ds.record["stamp"]]:
            return "modified"
        node, _ = tree.load(ds.record["nodes"])
        names = {n.params["name"] for n in node.walk() if n.op == "source"}
        if any(n not in self.s.ctx.tables for n in names):
            return "orphaned"
        for n in names:
            t = self.s.ctx.tables[n]
            if hasattr(t, "chunks") and not t.chunks(self.s.spark, again=True):
                return "orphaned"
            if isinstance(t, Dataset) and self.status(t) not in ("fresh", "no recipe"):
                return "stale"
            want = next((x.params["identity"] for x in node.walk() if x.op == "source" and x.params["name"] == n), "")
            if want and getattr(t, "identity", want) != want:
                return "stale"
        return "stale" if self.changes(ds) else "fresh"

    def followed(self, node: Node, table: str, coords: dict) -> list[lang.Test] | None:
        """Comparisons of the result's inputs that hold for all curves which a chunk of these inputs can change; None: any curve."""
        f = tree.build(node, self.s.ctx)
        types = self.s.ctx.types

        def go(n: Node) -> dict | None:
            """Values of n's inputs that the chunk touches; {} for all of them, None for none."""
            if n.op == "source":
                return {k: v for k, v in coords.items() if k in types[n.id].ins} if n.params["name"] == table else None
            got = [g for g in (go(k) for k in n.kids) if g is not None]
            if not got:
                return None
            names = n.params.get("names", {}) if n.op == "rename" else {}
            got = [{names.get(k, k): v for k, v in g.items()} for g in got]
            lost = {n.params.get("along")} if n.op in ("swap", "legendre", "apply") else set()
            lost |= {n.params["name"]} if n.op == "transform" else set()
            common = {k: v for k, v in got[0].items() if all(g.get(k) == v for g in got[1:])}
            return {k: v for k, v in common.items() if k in types[n.id].ins and k not in lost}

        got = go(node)
        if not got:
            return None if got is None or got == {} else []
        return [lang.Test(k, "=", v if isinstance(v, str) else float(v)) for k, v in got.items() if k in f.type.ins]

    def refresh(self, ds: Dataset, full: bool = False, force: bool = False) -> str:
        state = self.status(ds)
        if state == "no recipe":
            return f"{ds.name}: no recipe"
        if ds.record.get("pinned") and not force:
            return f"{ds.name}: pinned"
        node, changed_ids = tree.load(ds.record["nodes"])
        for t in self.sources(node).values():
            if isinstance(t, Dataset):
                self.refresh(t, False, force)
        state = self.status(ds)
        if state == "orphaned":
            raise FieldError(f"{ds.name}: an input cannot be found")
        if state == "fresh" and not full:
            return f"{ds.name}: fresh"
        # Tables may read something else now: their identity enters the tree anew.
        node = self.current(node)
        sets = None
        if state == "stale" and not full and node.id == ds.record["root"]:
            sets = []
            for table, changes in self.changes(ds).items():
                for _, _, coords in changes:
                    tests = self.followed(node, table, coords) if coords else None
                    sets = None if tests is None or sets is None else [*sets, tests]
        whole = tree.build(node, self.s.ctx)
        key = whole.type.key()
        if sets is None:
            ds.record |= {"root": node.id, "nodes": tree.dump(node), "inputs": self.fingerprints(node)}
            self.write(ds, whole, ds.record["format"])
            n = whole_keys(self.s.spark, ds, key)
            return f"{ds.name}: recomputed all {n} curves"
        from curvelake.functions import formula

        def touched(cols) -> object:
            out = F.lit(False)
            for tests in sets:
                one = F.lit(True)
                for t in tests:
                    one = one & formula.compile_test(t, cols(t.name), whole.type.input(t.name).dtype)
                out = out | one
            return out

        old, _ = ds.read(self.s.ctx)
        parts = []
        for tests in sets:
            f = self.s.under(node, tests)
            parts.append(f.df)
        new = parts[0]
        for p in parts[1:]:
            new = new.unionByName(p)
        new = new.distinct() if len(parts) > 1 else new
        kept = old.where(~F.coalesce(touched(c), F.lit(False)))
        both = Field(kept.unionByName(new), whole.type, node, self.s.ctx)
        before = kept.select(*[c(k) for k in key]).distinct().count() if key else 0
        ds.record |= {"inputs": self.fingerprints(node)}
        self.write(ds, both, ds.record["format"])
        total = whole_keys(self.s.spark, ds, key)
        return f"{ds.name}: recomputed {total - before} of {total} curves, {before} unchanged"

    def current(self, node: Node) -> Node:
        kids = tuple(self.current(k) for k in node.kids)
        params = node.params
        if node.op == "source":
            params = params | {"identity": getattr(self.s.ctx.tables.get(params["name"]), "identity", params["identity"])}
        return Node(node.op, params, kids)


def whole_keys(spark, ds: Dataset, key: list[str]) -> int:
    df, _ = ds.read(Context(spark))
    return df.select(*[c(k) for k in key]).distinct().count() if key else 1


class Epochs:
    """Marks of ``invalidate``: they enter the fingerprints, so what they name is computed again."""

    def __init__(self, path: str | None):
        self.path = path
        self.marks: list[dict] = []
        if path and os.path.exists(path):
            with open(path) as f:
                self.marks = json.load(f)

    def add(self, name: str, tests: list[lang.Test]) -> None:
        self.marks.append({"name": name, "tests": [lang.show_test(t) for t in tests], "at": time.time()})
        if self.path:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            with open(self.path, "w") as f:
                json.dump(self.marks, f)

    def salt(self, table: str, values: dict) -> str:
        from curvelake.functions.formula import test_value

        hits = [m["at"] for m in self.marks if m["name"] == table and all(t.name not in values or test_value(t, values[t.name]) for x in m["tests"] for t in lang.parse_tests(x))]
        return str(max(hits)) if hits else ""

    def named(self, name: str) -> float:
        return max((m["at"] for m in self.marks if m["name"] == name), default=0.0)
