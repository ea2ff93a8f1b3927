"""The chunks of a table: files and the inputs that their paths give."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import SparkSession

from curvelake.functions import formula
from curvelake.plans import lang
from curvelake.sources.template import Template


@dataclass(frozen=True)
class Chunk:
    """The smallest readable unit."""

    path: str  # relative to the table's root
    coords: tuple[tuple[str, object], ...]
    size: int
    mtime: int
    part: str = ""  # an object within the file

    def values(self) -> dict:
        return dict(self.coords)


class Store:
    """Listing and reading through Hadoop's file systems, so that a root may be any store Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def files(self, below: str = "") -> list[tuple[str, int, int]]:
        """(relative path, size, mtime) of all files, sorted."""
        top, fs = self._fs(f"{self.root}/{below}" if below else self.root)
        if not fs.exists(top):
            return []
        base = fs.makeQualified(self._fs(self.root)[0]).toString().rstrip("/") + "/"
        out = []
        it = fs.listFiles(top, True)
        while it.hasNext():
            s = it.next()
            path = s.getPath().toString()
            out.append((path.removeprefix(base), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def read(self, path: str) -> bytes:
        p, fs = self._fs(f"{self.root}/{path}")
        with_ = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(with_))
        finally:
            with_.close()


def scan(spark: SparkSession, root: str, template: Template) -> list[Chunk]:
    """All files that match, in path order."""
    out = []
    for path, size, mtime in Store(spark, root).files(template.fixed):
        got = template.match(path)
        if got is not None:
            coords = tuple((k, formula.norm_value(v) if isinstance(v, float) else v) for k, v in got.items())
            out.append(Chunk(path, coords, size, mtime))
    return out


def prune(chunks: list[Chunk], tests, derived: dict[str, str] | None = None) -> list[Chunk]:
    """Chunks that can hold rows for which all comparisons are true.

    ``derived`` are formulas of path inputs, so that a comparison of what a
    table computes from its paths prunes, too.
    """
    out = []
    for ch in chunks:
        values = ch.values()
        for name, text in (derived or {}).items():
            v = derived(text, values)
            if v is not None:
                values[name] = v
        if all(t.name != "*" and (t.name not in values or formula.test_value(t, values[t.name])) for t in tests):
            out.append(ch)
    return out


def derived(text: str, values: dict) -> float | None:
    tree = lang.parse(text)
    if not formula.names(tree) <= {k for k, v in values.items() if not isinstance(v, str)}:
        return None

    def put(e):
        if isinstance(e, lang.Name):
            v = float(values[e.id])
            return lang.Num(v) if v >= 0 else lang.Neg(lang.Num(-v))
        if isinstance(e, lang.Neg):
            return lang.Neg(put(e.arg))
        if isinstance(e, lang.Bin):
            return lang.Bin(e.op, put(e.left), put(e.right))
        if isinstance(e, lang.Call):
            return lang.Call(e.fn, tuple(map(put, e.args)), e.options)
        return e

    v = formula.constant(put(tree))
    return None if v is None else formula.norm_value(v)


def fingerprint(spark: SparkSession, root: str, ch: Chunk, mode: str = "stat", salt: str = "") -> list:
    """What tells whether a chunk has changed: size and time, or size and content."""
    if mode == "hash":
        return [ch.size, 0, hashlib.sha256(Store(spark, root).read(ch.path)).hexdigest()[:16], salt]
    return [ch.size, ch.mtime, "", salt]
