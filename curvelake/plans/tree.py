"""Fields, and the calculation that made each one.

Every operator is a function from fields to a field.  It builds a lazy
DataFrame, so types and errors show before any data is read, and it records
itself in a tree of plain values, from which the field can be built again:
with other data, under pushed filters, or from a saved recipe.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field as slot
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.plans import lang
from curvelake.types import Column, Schema, made

OPS: dict[str, Callable] = {}


def c(name: str) -> Column:
    """A column by its exact name, which may hold a dot."""
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Node:
    """One step: an operator's name, its plain parameters and the steps before it."""

    op: str
    params: dict
    kids: tuple = ()

    @property
    def id(self) -> str:
        text = json.dumps({"op": self.op, "params": self.params, "in": [k.id for k in self.kids]}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()[:12]

    def walk(self):
        for k in self.kids:
            yield from k.walk()
        yield self


@dataclass
class Context:
    """What building fields needs besides their trees."""

    spark: SparkSession
    tables: dict = slot(default_factory=dict)
    plugins: dict = slot(default_factory=dict)
    #: (what must hold, rows that break it) of error policies; run before results are used.
    checks: list = slot(default_factory=list)
    #: (what happened, rows it happened to) of policies that drop or repair; counted on demand.
    notes: list = slot(default_factory=list)
    #: Comparisons pushed to a table's files while a tree is rebuilt, by the node's id.
    pushed: dict = slot(default_factory=dict)
    #: Types by node id, of everything built so far.
    types: dict = slot(default_factory=dict)

    def check(self, what: str, broken: DataFrame) -> None:
        self.checks.append((what, broken))

    def note(self, what: str, rows: DataFrame) -> None:
        self.notes.append((what, rows))

    def run_checks(self) -> None:
        todo, self.checks = self.checks, []
        for what, broken in todo:
            first = broken.limit(1).collect()
            if first:
                raise FieldError(f"{what}: {', '.join(f'{k}={v}' for k, v in first[0].asDict().items())}")

    def report(self) -> list[str]:
        # A table that an expression names twice is noted twice, for the same rows.
        todo, self.notes = dict(reversed(self.notes)), []
        out = []
        for what, rows in reversed(todo.items()):
            n = rows.count()
            if n:
                out.append(f"{n} {what}")
        return out


@dataclass
class Field:
    """A DataFrame whose inputs determine its outputs."""

    df: DataFrame
    type: Schema
    node: Node
    ctx: Context
    pid: str = ""

    def __post_init__(self):
        self.pid = self.pid or self.node.id

    def __getattr__(self, name: str):
        if name in OPS:
            return lambda *a, **k: OPS[name](self, *a, **k)
        raise AttributeError(name)

    def rows(self) -> DataFrame:
        """The points in the order of their inputs, checks first."""
        self.ctx.run_checks()
        return self.df.orderBy(*[c(n) for n in self.type.ins])

    def to_pandas(self):
        return self.rows().toPandas()

    def __repr__(self) -> str:
        return f"Field {self.type}"


def operator(name: str | None = None, same_points: bool = False):
    """Makes a function from fields and plain parameters an operator of the tree.

    The function returns (DataFrame, Schema).  ``same_points`` says that
    the result is on the first operand's points, whose identity it keeps.
    """

    def deco(fn: Callable) -> Callable:
        op = name or fn.__name__.rstrip("_")
        sig = inspect.signature(fn)

        @wraps(fn)
        def call(*args, **kwargs) -> Field:
            bound = sig.bind(*args, **kwargs)
            bound.apply_defaults()
            kids: list[Field] = []
            params: dict = {}
            for key, value in bound.arguments.items():
                if isinstance(value, Field):
                    kids.append(value)
                elif isinstance(value, (list, tuple)) and value and all(isinstance(v, Field) for v in value):
                    kids.extend(value)
                elif key != "ctx":
                    params[key] = value
            ctx = kids[0].ctx if kids else bound.arguments["ctx"]
            df, ftype = fn(**{k: v for k, v in bound.arguments.items()})
            node = Node(op, json.loads(json.dumps(params)), tuple(k.node for k in kids))
            ctx.types[node.id] = ftype
            keeps = same_points(params, kids) if callable(same_points) else same_points
            return Field(df.select(*[c(n) for n in ftype.ins + ftype.outs]), ftype, node, ctx, kids[0].pid if keeps else "")

        OPS[op] = call
        call.signature = sig
        return call

    return deco


def build(node: Node, ctx: Context, made: dict[str, Field] | None = None) -> Field:
    """The field of a tree; equal subtrees are built once."""
    made = {} if made is None else made
    key = node.id + json.dumps([lang.show_test(t) for t in ctx.pushed.get(id(node), ())])
    if key in made:
        return made[key]
    if node.op not in OPS:
        raise FieldError(f"unknown operator {node.op}")
    kids = [build(k, ctx, made) for k in node.kids]
    op = OPS[node.op]
    names = [n for n in op.signature.parameters if n not in node.params and n != "ctx"]
    args: dict = dict(node.params)
    if kids:
        # Operands come first in a signature: one list of them, or single ones, or a list and single ones after it.
        many = [n for n in names if op.signature.parameters[n].annotation == "list[Field]"]
        single = [n for n in names if op.signature.parameters[n].annotation == "Field"]
        if many:
            args[many[0]] = kids[: len(kids) - len(single)]
            kids = kids[len(kids) - len(single) :]
        args |= dict(zip(single, kids, strict=True))
    if "ctx" in op.signature.parameters:
        args["ctx"] = ctx
        if node.op in ("source", "dataset"):
            ctx.pushing = ctx.pushed.get(id(node), ())
    made[key] = op(**args)
    return made[key]


#: Operators through which a comparison of an input passes to all operands that have the input.
THROUGH = {"select", "column", "map", "filter", "points", "join", "stack", "union", "reduce", "range", "deriv", "cumint", "resample", "eval", "align", "legendre", "swap", "span", "overlap", "merge_points", "apply", "rename", "slice"}


def push(node: Node, tests: list[lang.Test], types: dict[str, Schema], ctx: Context) -> None:
    """Hands comparisons of inputs down to the tables that have them; what works along an input stops those of that input.

    A filter that is pushed is also applied where it was written, so pushing
    only ever saves reading.
    """
    if node.op in ("source", "dataset"):
        ctx.pushed[id(node)] = tuple(tests)
        return
    tests = list(tests)
    blocked = {node.params.get("along")} | ({node.params.get("to")} if node.op == "transform" else set())
    if node.op in ("swap", "legendre"):
        blocked |= {node.params.get("slope"), "branch"} | set(types[node.id].ins) - set.intersection(*(set(types[k.id].ins) for k in node.kids))
    if node.op == "rename":
        back = {v: k for k, v in node.params["names"].items()}
        tests = [lang.Test(back.get(t.name, t.name), t.op, t.value, t.column) for t in tests]
    if node.op == "filter":
        tests += [t for t in lang.parse_tests(node.params["tests"]) if not t.column]
    if node.op == "transform":
        tests += _through_transform(node, tests, ctx)
    if node.op == "slice":
        tests.append(lang.Test(node.params["name"], "=", node.params["value"]))
    for i, k in enumerate(node.kids):
        own = [t for t in tests if t.name == "*" or (t.name not in blocked and not t.column and t.name in types[k.id].ins)]
        if node.op == "stack":
            tag = [t for t in tests if t.name == node.params["tag"]]
            own = [t for t in own if t.name != node.params["tag"]]
            label = node.params["labels"][i]
            from curvelake.functions.formula import test_value

            if not all(test_value(t, label) for t in tag):
                own.append(lang.Test("*", "none", None))
        push(k, own if node.op in THROUGH or node.op == "transform" else [], types, ctx)


def _through_transform(node: Node, tests: list[lang.Test], ctx: Context) -> list[lang.Test]:
    """Comparisons of a changed input as comparisons of the input it came from, by the values that the files' places give."""
    from curvelake.functions import formula
    from curvelake.sources.index import derived

    u, to, text = node.params["name"], node.params["to"], node.params["formula_"]
    out = []
    if formula.names(lang.parse(text)) == {u} and to != u:
        known = _path_values(node, u, ctx)
        for t in tests:
            if known is not None and t.name == to and not t.column:
                fit = tuple(v for v in sorted(known) if (d := derived(text, {u: v})) is not None and formula.test_value(t, d))
                out.append(lang.Test(u, "=", tuple(map(float, fit))) if fit else lang.Test("*", "none", None))
    return out


def _path_values(node: Node, u: str, ctx: Context) -> set | None:
    """All values of an input that chunks' places give, if it is one of those in every table below."""
    if node.op == "source":
        t = ctx.tables.get(node.params["name"])
        return {ch.values()[u] for ch in t.chunks(ctx.spark)} if u in getattr(t, "placed", {}) else None
    if node.op in ("rename", "stack") or not node.kids:
        return None
    got = [_path_values(k, u, ctx) for k in node.kids if u in ctx.types[k.id].ins]
    return None if not got or None in got else set().union(*got)


def dump(node: Node) -> list[dict]:
    """The tree as plain records, leaves first."""
    out: dict[str, dict] = {}
    for n in node.walk():
        out.setdefault(n.id, {"id": n.id, "op": n.op, "params": n.params, "in": [k.id for k in n.kids]})
    return list(out.values())


def load(records: list[dict]) -> tuple[Node, list[str]]:
    """The tree of ``dump``'s records, and the ids that no longer agree with what they name."""
    made: dict[str, Node] = {}
    changed = []
    node = None
    for r in records:
        missing = [i for i in r["in"] if i not in made]
        if missing:
            raise FieldError(f"step {r['id']} needs {', '.join(missing)}, which is not before it")
        node = Node(r["op"], r["params"], tuple(made[i] for i in r["in"]))
        if node.id != r["id"]:
            changed.append(r["id"])
        made[r["id"]] = node
    if node is None:
        raise FieldError("the recipe has no steps")
    return node, changed
