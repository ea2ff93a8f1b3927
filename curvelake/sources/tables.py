"""Declared tables: where the chunks are, how they are read, and what the columns mean."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field as slot

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.errors import FieldError
from curvelake.functions import formula
from curvelake.operators.relational import duplicates
from curvelake.plans import lang
from curvelake.plans.tree import Context, c
from curvelake.sources import index, readers
from curvelake.sources.frames import normalized
from curvelake.sources.template import KINDS, Template
from curvelake.types import Schema, given, made, schema

VERSION = "0.2"
LOCATORS = ("glob", "sqlite", "hdf5")
SECTIONS = {
    "source": {"locator", "root", "pattern", "file", "table", "query", "rename", "constants", "reader"},
    "field": {"inputs", "outputs", "axis", "exact", "transform", "map", "duplicates", "digits", "by", "x", "y"},
    "column": {"type", "unit", "label", "description", "digits", "error"},
}


def posix_join(folder: str, path: str) -> str:
    """A path seen from a folder, with ``..`` worked out; whole paths and URIs stay."""
    if path.startswith("/") or "://" in path or not folder:
        return path
    head, _, rest = folder.partition("://")
    scheme, folder = (f"{head}://", rest) if rest else ("", folder)
    parts = folder.rstrip("/").split("/")
    for p in path.split("/"):
        if p == "..":
            parts.pop()
        elif p not in (".", ""):
            parts.append(p)
    return scheme + "/".join(parts)


@dataclass
class Table:
    """One declared table."""

    name: str
    root: str
    spec: dict
    digits: int = formula.DIGITS
    repeats: str = "error"
    nan_rows: str = "drop"
    _chunks: list[index.Chunk] | None = None
    read_paths: list[str] = slot(default_factory=list)

    @classmethod
    def load(cls, name: str, path: str) -> Table:
        """From a TOML file; its paths are relative to its folder."""
        with open(path, "rb") as f:
            return cls.declared(name, tomllib.load(f), path.rpartition("/")[0])

    @classmethod
    def declared(cls, name: str, spec: dict, folder: str) -> Table:
        spec = dict(spec)
        if "curves" in spec and "field" in spec:
            raise FieldError(f"{name}: [curves] is the older form of [field]; a table has one of them")
        if "curves" in spec:
            old = spec.pop("curves")
            holes = list(Template(spec["source"].get("pattern", "")).kinds)
            by = [*old.get("by", []), *[h for h in holes if h not in old.get("by", [])]]
            spec["field"] = {"inputs": [*by, *([old["x"]] if "x" in old else [])], **({"axis": old["x"]} if "x" in old else {}), **({"outputs": [old["y"]] if isinstance(old["y"], str) else old["y"]} if "y" in old else {})}
        version = next((v for v in spec.values() if isinstance(v, str) and re.fullmatch(r"\d+\.\d+", v)), VERSION)
        if version.split(".")[0] != VERSION.split(".")[0]:
            raise FieldError(f"{name}: version {version} cannot be read, this is {VERSION}")
        if "source" not in spec or "field" not in spec:
            raise FieldError(f"{name}: [source] and [field] are needed")
        parts = [("source", spec["source"]), ("field", spec["field"])] + [("column", m) for m in spec.get("columns", {}).values()]
        for section, got in parts:
            unknown = [k for k in got if k not in SECTIONS[section] and not k.startswith("x_")]
            if unknown:
                raise FieldError(f"{name}: unknown key {', '.join(unknown)}; known are {', '.join(sorted(SECTIONS[section]))}")
        t = cls(name, posix_join(folder, spec["source"].get("root", ".")), spec, int(spec["field"].get("digits", formula.DIGITS)), spec["field"].get("duplicates", "error"))
        if t.locator not in LOCATORS:
            raise FieldError(f"{name}: locator is one of {', '.join(LOCATORS)}, not {t.locator}")
        if t.locator != "sqlite":
            readers.check_spec(t.reader)
        _ = t.type
        return t

    @property
    def source(self) -> dict:
        return self.spec["source"]

    @property
    def locator(self) -> str:
        return self.source.get("locator", "glob")

    @property
    def is_sqlite(self) -> bool:
        return self.locator == "sqlite"

    @property
    def reader(self) -> dict:
        return self.source.get("reader", {"format": "text"})

    @property
    def template(self) -> Template:
        return Template(self.source.get("pattern", "") if self.locator == "glob" else self.source.get("file", ""))

    @property
    def placed(self) -> dict[str, str]:
        """Inputs that a chunk's place gives, with their types."""
        inner = Template(self.source["pattern"].lstrip("/")).kinds if self.locator == "hdf5" else {}
        return {**self.template.kinds, **inner}

    @property
    def constants(self) -> dict:
        return self.source.get("constants", {})

    @property
    def transforms(self) -> dict[str, str]:
        return {k: str(v["formula"] if isinstance(v, dict) else v) for k, v in self.spec["field"].get("transform", {}).items()}

    @property
    def maps(self) -> dict[str, str]:
        return {k: str(v) for k, v in self.spec["field"].get("map", {}).items()}

    def _used(self) -> set[str]:
        return set().union(*(formula.names(lang.parse(e)) for e in [*self.transforms.values(), *self.maps.values()]), set())

    @property
    def content_columns(self) -> list[str]:
        names = [n for n in self.reader.get("columns", []) if n != "_"]
        names = [self.reader.get("rename", {}).get(n, n) for n in names]
        return names or [n for n in self.spec.get("columns", {}) if n not in self.placed and n not in self.constants]

    @property
    def type(self) -> Schema:
        f, meta = self.spec["field"], self.spec.get("columns", {})
        inputs = f["inputs"]
        placed = set(self.placed) | set(self.constants)
        content_in = [n for n in inputs if n not in placed and n not in self.maps]
        errors = {m["error"]: n for n, m in meta.items() if "error" in m}
        outs = f.get("outputs")
        if outs is None:
            outs = [n for n in self.content_columns if n not in inputs and n not in self._used() and n not in errors] + [n for n in self.maps if n not in inputs]
        axis = f.get("axis")
        if axis is None and len([n for n in content_in if n not in self.transforms or formula.names(lang.parse(self.transforms[n])) & set(self.content_columns)]) == 1 and not f.get("keyed"):
            axis = content_in[0]
        exact = f.get("exact")

        def kind(n: str) -> str:
            if n in self.placed:
                return self.placed[n]
            if n in self.constants:
                return "str" if isinstance(self.constants[n], str) else "int" if isinstance(self.constants[n], int) else "float"
            return meta.get(n, {}).get("type", "float")

        ins = tuple(given(n, kind(n), n in exact if exact is not None else n != axis, meta.get(n, {}).get("unit")) for n in inputs)
        named = []
        for n in outs:
            e = meta.get(n, {}).get("error")
            named.append(made(n, meta.get(n, {}).get("unit"), e))
            if e and e not in outs:
                named.append(made(e, meta.get(n, {}).get("unit")))
        return schema(ins, tuple(named), axis)

    @property
    def identity(self) -> str:
        """A hash of what is read, not of the table's name."""
        text = json.dumps({k: v for k, v in self.spec.items() if not k.startswith("x_")}, sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()[:12]

    def chunks(self, spark: SparkSession, again: bool = False) -> list[index.Chunk]:
        if self._chunks is None or again:
            if self.is_sqlite:
                folder, _, name = posix_join(self.root, self.source["file"]).rpartition("/")
                self._chunks = [index.Chunk(name, (), s, m) for p, s, m in index.Store(spark, folder).files() if p == name]
            elif self.locator == "hdf5":
                self._chunks = readers.hdf5_chunks(spark, self.root, self.template, Template(self.source["pattern"].lstrip("/")))
            else:
                self._chunks = index.scan(spark, self.root, self.template)
        return self._chunks

    def chosen(self, spark: SparkSession, tests) -> list[index.Chunk]:
        """Chunks left after pruning by path inputs, constants, and what is computed from them alone."""
        for t in tests:
            if t.name == "*" or (t.name in self.constants and not formula.test_value(t, self.constants[t.name])):
                return []
        path_only = {k: e for k, e in self.transforms.items() if formula.names(lang.parse(e)) <= set(self.placed)}
        usable = [t for t in tests if t.name not in self.transforms or t.name in path_only]
        return index.prune(self.chunks(spark), usable, path_only)

    def read(self, ctx: Context, tests=(), repeats: str = "", nan_rows: str = "") -> tuple[DataFrame, Schema]:
        """Rows of the chosen chunks: constants and path inputs added, conventions applied, inputs rounded, repeats settled."""
        spark, ftype, meta = ctx.spark, self.type, self.spec.get("columns", {})
        used = self._used()
        placed = set(self.placed) | set(self.constants)
        wanted = [n for n in [*ftype.ins, *ftype.outs] if n not in placed and n not in self.transforms and n not in self.maps]
        wanted += [n for n in sorted(used) if n not in placed and n not in wanted and n not in self.transforms and (n not in self.maps or n in self.content_columns)]
        kinds = {v.name: v.dtype for v in ftype.inputs}
        content = [(n, kinds.get(n, meta.get(n, {}).get("type", "float"))) for n in dict.fromkeys(wanted)]
        if self.is_sqlite:
            rename = self.source.get("rename", {})
            df = readers.read_sqlite(spark, posix_join(self.root, self.source["file"]), self.source.get("table"), self.source.get("query"), content, rename)
            self.read_paths = [self.source["file"]]
            for t in tests:  # names that the database knows; transformed ones are compared after
                if not t.column and t.name in {n for n, _ in content} and t.name not in self.transforms and t.name != "*":
                    df = df.where(formula.compile_test(t, c(t.name), kinds.get(t.name, "float")) if t.op != "=" or isinstance(t.value, str) else _near(t, c(t.name)))
            df = df.withColumns({"__path": F.lit(self.source["file"]), "__row": F.monotonically_increasing_id()})
        else:
            some = self.chosen(spark, tests)
            self.read_paths = [ch.path for ch in some]
            parts: dict[str, list[str]] = {}
            for ch in some:
                parts.setdefault(ch.path, []).append(ch.part)
            df = readers.read_files(spark, [f"{self.root}/{p}" for p in parts], self.reader, content, {p: v for p, v in parts.items() if v != [""]})
            cols = {}
            for n, kind in self.placed.items():
                # The chunk's place gives the value.
                whole = self.template.regex.pattern + ("::" + Template(self.source["pattern"].lstrip("/")).regex.pattern if self.locator == "hdf5" else "")
                pattern = "(?:.*/)?" + re.sub(r"\(\?P<\w+>", "(", whole)
                group = list(self.placed).index(n) + 1
                cols[n] = F.regexp_extract("__path", pattern + "$", group).cast({"float": "double", "int": "bigint", "str": "string"}[kind])
            df = df.withColumns(cols) if cols else df
        for n, v in self.constants.items():
            df = df.withColumn(n, F.lit(v))
        for section in (self.transforms, self.maps):
            for n, e in section.items():
                df = df.withColumn(n, formula.compile_formula(e, {x: c(x) for x in df.columns}))
        names = ftype.ins + ftype.outs
        df = normalized(df.select(*[c(n) for n in names], "__path", "__row"), ftype, self.digits, ctx, nan_rows or self.nan_rows)
        for t in tests:
            if not t.column and t.name in kinds:
                df = df.where(formula.compile_test(t, c(t.name), kinds[t.name]))
        own = self.spec["field"].get("duplicates")
        return duplicates(df, ftype.ins, own or repeats or self.repeats, ["__path", "__row"], ctx), ftype


def _near(t: lang.Test, column):
    """Equality after rounding lets a little more through to the database's rows; the exact test follows."""
    values = t.value if isinstance(t.value, tuple) else (t.value,)
    test = F.lit(False)
    for v in values:
        test = test | ((column >= F.lit(v - 1e-9)) & (column <= F.lit(v + 1e-9)))
    return test


__all__ = ["KINDS", "Table", "VERSION"]
