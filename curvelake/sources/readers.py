"""Readers: from chunks of files to rows of named columns.

Parquet is read by Spark.  Text is cut into lines by Spark, which splits large
files, and its lines are parsed in Arrow batches on the executors; where a
file's lines depend on those before them (skipped and counted rows, names from
a header) they are first dealt by file.  Transposed text and binary arrays are
read as whole files: there a file is the unit of parallel work and of memory,
as it is the unit of pruning.
"""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from curvelake.errors import FieldError

FORMATS = ("text", "csv", "npy", "raw", "parquet", "dataset")
OPTIONS = {
    "text": {"columns", "delimiter", "comment", "skip_rows", "max_rows", "transpose", "na"},
    "csv": {"columns", "delimiter", "comment", "skip_rows", "max_rows", "transpose", "na", "header", "rename"},
    "npy": {"columns", "transpose"}, "raw": {"columns", "dtype", "header_bytes", "order", "endian"}, "parquet": {"rename", "columns"},
    "dataset": {"columns", "dataset", "fields", "transpose"},
}


def text_rows(lines: list[str], spec: dict) -> list[list[str]]:
    """The words of lines; comments and empty lines are left out."""
    csv = spec["format"] == "csv"
    sep = spec.get("delimiter") or ("," if csv else None)
    comment = spec.get("comment", None if csv else "#")
    rows = []
    for line in lines:
        line = line.split(comment)[0] if comment else line
        if line.strip():
            rows.append([x.strip() for x in (line.split(sep) if sep else line.split())])
    return rows


def text_columns(rows: list[list[str]], names: list[str] | None, spec: dict, path: str) -> dict[str, list]:
    """Rows of words as named columns."""
    if names is None:
        raise FieldError(f"{path}: columns are not named")
    bad = next((r for r in rows if len(r) != len(names)), None)
    if bad is not None:
        raise FieldError(f"{path}: {len(bad)} columns, {len(names)} were declared")
    na = set(spec.get("na", [])) | {"", "nan", "NaN", "NA"}
    rename = spec.get("rename", {})
    out = {}
    for i, n in enumerate(names):
        if n != "_":
            out[rename.get(n, n)] = [None if r[i] in na else r[i] for r in rows]
    return out


def has_header(spec: dict) -> bool:
    return spec["format"] == "csv" and bool(spec.get("header", True))


def parse_text(data: bytes, spec: dict, path: str = "") -> dict[str, list]:
    """Columns of a delimited text."""
    rows = text_rows(data.decode().splitlines()[int(spec.get("skip_rows", 0)) :], spec)
    header = rows.pop(0) if has_header(spec) and rows else None
    if spec.get("max_rows") is not None:
        rows = rows[: int(spec["max_rows"])]
    if spec.get("transpose"):
        rows = [list(r) for r in zip(*rows, strict=True)]
    return text_columns(rows, spec.get("columns") or header, spec, path)


def by_file(spec: dict) -> bool:
    """Whether a line's meaning depends on how many lines of its file come before it, or on the names in a header."""
    return bool(int(spec.get("skip_rows", 0))) or spec.get("max_rows") is not None or (has_header(spec) and not spec.get("columns"))


def parse_lines(batches: Iterator[pa.RecordBatch], spec: dict) -> Iterator[tuple[str, int, dict[str, list]]]:
    """(path, place, columns) of runs of lines, as ``read_lines`` hands them on; places rise within a file."""
    whole = by_file(spec)
    at, path, count, skip, left, header, pending, part = None, "", 0, 0, None, None, False, False

    def complete() -> None:
        if pending and part:
            raise FieldError(f"{path}: its first block holds no header")

    for b in batches:
        files = b.column(1).dictionary_encode()
        which, starts = files.indices.to_numpy(), b.column(2).to_numpy()
        new = which[1:] != which[:-1] if whole else (which[1:] != which[:-1]) | (starts[1:] != starts[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(which)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            place = (files.dictionary[which[i]].as_py(), 0 if whole else int(starts[i]))
            if place != at:
                complete()
                at, path, count, header = place, unquote(place[0]), 0, None
                skip, left, pending = int(spec.get("skip_rows", 0)), spec.get("max_rows"), has_header(spec) and place[1] == 0
                part = not whole and b.column(3)[i].as_py()
            # Spark ends lines where Hadoop does; Python knows some more ends.
            lines = ("\n".join(b.column(0).slice(i, j - i).to_pylist()) + "\n").splitlines()
            skipped = min(skip, len(lines))
            skip -= skipped
            rows = text_rows(lines[skipped:], spec)
            if pending and rows:
                header, pending = rows.pop(0), False
            if left is not None:
                rows = rows[: int(left)]
                left = int(left) - len(rows)
            if rows:
                # A block's lines start behind its first byte, so a block has no more lines than bytes.
                yield path, place[1] + (place[1] > 0) + count, text_columns(rows, spec.get("columns") or header, spec, path)
                count += len(rows)
    complete()


def read_lines(spark: SparkSession, paths: list[str], spec: dict) -> DataFrame:
    """Lines of files in order, with the file, the block's start, and whether the file has further blocks."""
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", F.expr("_metadata.file_block_length < _metadata.file_size").alias("part"))
    if not by_file(spec):
        return lines
    order = ["file_path", "file_block_start", "__line"]
    return lines.withColumn("__line", F.monotonically_increasing_id()).repartition("file_path").sortWithinPartitions(*order).drop("__line")


#: Byte orders by name (fixed values of the table format).
ORDERS = {"little": "<", "big": ">"}


def raw_columns(data: bytes, spec: dict, path: str) -> list[np.ndarray]:
    """Columns of a file of numbers only: records of one number a column, or one block a column."""
    count, body = len(spec["columns"]), memoryview(data)[int(spec.get("header_bytes", 0)) :]
    number = np.dtype(spec.get("dtype", "float64")).newbyteorder(ORDERS.get(spec.get("endian", "little"), "="))
    rows, rest = divmod(len(body), number.itemsize * count)
    if rest:
        raise FieldError(f"{path}: {rest} bytes are left after {rows} rows of {count} numbers")
    if spec.get("order", "rows") == "rows":
        records = np.frombuffer(body, [(f"c{i}", number) for i in range(count)])
        return [records[f"c{i}"] for i in range(count)]
    return list(np.frombuffer(body, number).reshape(count, rows))


def array_columns(a: np.ndarray, spec: dict, path: str) -> list[np.ndarray]:
    """Columns of an array of one dimension, which is one column, or two."""
    if a.ndim > 2:
        raise FieldError(f"{path}: an array of {a.ndim} dimensions is no table")
    columns = [a] if a.ndim == 1 else list(a) if spec.get("transpose") else list(a.T)
    if len(columns) != len(spec["columns"]):
        raise FieldError(f"{path}: {len(columns)} columns, {len(spec['columns'])} were declared")
    return columns


def parse_array(data: bytes, spec: dict, path: str = "") -> dict[str, list]:
    """Columns of a file of numbers, in NumPy's format or raw; one declared as ``_`` is left out."""
    if spec["format"] == "raw":
        columns = raw_columns(data, spec, path)
    else:
        columns = array_columns(np.load(io.BytesIO(data), allow_pickle=False), spec, path)
    return {n: c.tolist() for n, c in zip(spec["columns"], columns, strict=True) if n != "_"}


def dataset_columns(a: np.ndarray, spec: dict, path: str = "") -> dict[str, list]:
    """Columns of a dataset: a record array's fields under the names that ``fields`` maps to them, or the columns of a plain one."""
    if a.dtype.names:
        fields = spec.get("fields") or list(a.dtype.names)
        named = fields if isinstance(fields, dict) else {n: n for n in fields}
        unknown = [old for old in named.values() if old not in a.dtype.names]
        if unknown:
            raise FieldError(f"{path}: no field {unknown[0]}; there are {', '.join(a.dtype.names)}")
        return {new: a[old].ravel().tolist() for new, old in named.items()}
    return {n: c.tolist() for n, c in zip(spec["columns"], array_columns(a, spec, path), strict=True) if n != "_"}


def parse_hdf5(data: bytes, spec: dict, path: str = "") -> dict[str, list]:
    """Columns of a dataset in an HDF5 file; needs the h5py library."""
    try:
        import h5py
    except ImportError as e:
        raise FieldError("reading HDF5 needs the h5py library") from e
    with h5py.File(io.BytesIO(data), "r") as f:
        return dataset_columns(f[spec["dataset"]][()], spec, path)


def hdf5_chunks(spark: SparkSession, root: str, files, objects) -> list:
    """One chunk for each object whose path in a file matches; needs the h5py library."""
    try:
        import h5py
    except ImportError as e:
        raise FieldError("reading HDF5 needs the h5py library") from e
    from curvelake.sources import index

    out = []
    for ch in index.scan(spark, root, files):
        with h5py.File(io.BytesIO(index.Store(spark, root).read(ch.path)), "r") as f:
            found: list[str] = []
            f.visit(found.append)
        for path in sorted(found):
            got = objects.match(path)
            if got is not None:
                out.append(index.Chunk(ch.path, (*ch.coords, *got.items()), ch.size, ch.mtime, path))
    return out


def parse(data: bytes, spec: dict, path: str = "") -> dict[str, list]:
    return {"text": parse_text, "csv": parse_text, "npy": parse_array, "raw": parse_array, "dataset": parse_hdf5}[spec["format"]](data, spec, path)


def check_spec(spec: dict) -> None:
    kind = spec.get("format")
    if kind not in FORMATS:
        raise FieldError(f"reader format is one of {', '.join(FORMATS)}, not {kind}")
    unknown = [k for k in spec if k != "format" and k not in OPTIONS[kind] and not k.startswith("x_")]
    if unknown:
        raise FieldError(f"reader {kind} has no option {', '.join(unknown)}")


def read_files(spark: SparkSession, paths: list[str], spec: dict, content: list[tuple[str, str]], parts: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of files with ``__path`` and ``__row``; ``parts`` names the objects to read within files; ``content`` lists the columns to keep, with float, int or str."""
    kinds = {"float": "double", "int": "bigint", "str": "string"}
    if not paths:
        return spark.createDataFrame([], ", ".join(f"`{n}` {kinds[k]}" for n, k in content) + ", __path string, __row bigint")
    if spec["format"] == "parquet":
        df = spark.read.parquet(*paths).withColumnsRenamed(spec.get("rename", {}))
        return df.select(*[F.col(f"`{n}`").cast(kinds[k]).alias(n) for n, k in content], F.col("_metadata.file_path").alias("__path"), F.monotonically_increasing_id().alias("__row"))
    names = [n for n, _ in content]

    types = {"float": pa.float64(), "int": pa.int64(), "str": pa.string()}
    casts = {"float": float, "int": lambda v: int(float(v)), "str": str}

    def batch(path: str, first: int, got: dict[str, list]) -> pa.RecordBatch:
        missing = [n for n in names if n not in got]
        if missing:
            raise FieldError(f"{path}: no column {', '.join(missing)}; columns are {', '.join(got)}")
        n = len(next(iter(got.values()))) if got else 0
        cols = [pa.array([None if v is None else casts[k](v) for v in got[c]], types[k]) for c, k in content]
        return pa.RecordBatch.from_arrays([*cols, pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64())], names=[*names, "__path", "__row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                inner = next((v for k, v in (parts or {}).items() if path.endswith("/" + k)), None)
                todo += [(path, data, spec)] if inner is None else [(f"{path}::{o}", data, spec | {"dataset": f"{o}/{spec['dataset']}" if spec.get("dataset") else o}) for o in inner]
            for path, data, how in todo:
                yield batch(path, 0, parse(data, how, path))

    def run_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, first, got in parse_lines(batches, spec):
            yield batch(path, first, got)

    schema = ", ".join([*(f"`{n}` {kinds[k]}" for n, k in content), "__path string", "__row bigint"])
    if spec["format"] in ("text", "csv") and not spec.get("transpose"):
        return read_lines(spark, paths, spec).mapInArrow(run_lines, schema)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, schema)


class SqliteSource(DataSource):
    """A table or query of an SQLite file as a Spark source; comparisons become bound parameters of its WHERE."""

    @classmethod
    def name(cls) -> str:
        return "curvelake_sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, [f.name for f in schema.fields])


class SqliteReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.path, self.query, self.names = options["path"], options["query"], names
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1:
                self.where.append((f'"{f.attribute[0]}" {signs[type(f)]} ?', [f.value]))
            elif isinstance(f, In) and len(f.attribute) == 1:
                self.where.append((f'"{f.attribute[0]}" IN ({", ".join("?" * len(f.value))})', list(f.value)))
            yield f  # Spark compares again: SQLite's types are loose

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        cols = ", ".join(f'"{n}"' for n in self.names)
        text = f"SELECT {cols} FROM ({self.query})" + (" WHERE " + " AND ".join(w for w, _ in self.where) if self.where else "")
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from con.execute(text, [v for _, vs in self.where for v in vs])
        finally:
            con.close()


def read_sqlite(spark: SparkSession, path: str, table: str | None, query: str | None, content: list[tuple[str, str]], rename: dict[str, str] | None = None) -> DataFrame:
    """Rows of one SQLite table or query."""
    kinds = {"float": "double", "int": "bigint", "str": "string"}
    if (table is None) == (query is None):
        raise FieldError("sqlite needs a table or a query")
    back = {v: k for k, v in (rename or {}).items()}
    inner = query or f'SELECT * FROM "{table}"'
    cols = ", ".join(f'CAST("{back.get(n, n)}" AS {"TEXT" if k == "str" else "INTEGER" if k == "int" else "REAL"}) AS "{n}"' for n, k in content)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    schema = ", ".join(f"`{n}` {kinds[k]}" for n, k in content)
    return spark.read.format("curvelake_sqlite").option("path", path).option("query", f"SELECT {cols} FROM ({inner})").option("schema", schema).load()
