"""Sources, saved results and exports over the test tables: each query writes a table's rows as files and reads them back as a declared table.

The files go to a folder of their own under ``spark.checkpoint.dir``; a folder
of this machine is used only where that is unset, as in tests.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.queries import EVU, QUERIES, SQL, Tables, query, rs, shown
from curvelake.session import Session
from curvelake.sources.tables import Table

_BEFORE = set(QUERIES)


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.removeprefix('file://').removeprefix('file:')}/queries-{uuid.uuid4().hex[:12]}" if shared else tempfile.mkdtemp()


def by_kind(d: Tables, fmt: str, **options) -> str:
    """The events as files below a folder for each kind."""
    root = folder(d.spark)
    d.evu.df.select("event_type", "user_id", "t", "value").write.partitionBy("event_type").format(fmt).options(**options).mode("overwrite").save(root)
    return root


def declared(s: Session, name: str, root: str, pattern: str, reader: dict, field: dict, columns: dict | None = None, **source) -> None:
    s.add_table(name, Table.declared(name, {"source": {"root": root, "pattern": pattern, "reader": reader, **source}, "field": field, "columns": columns or {}}, root))


_FIELD = {"inputs": ["event_type", "user_id", "t"], "axis": "t"}
_INT = {"user_id": {"type": "int"}}
_COLUMNS = ["user_id", "t", "value"]
_ALL = f"WITH {EVU} SELECT event_type, user_id, {rs('t', 5)} AS t, {rs('value')} AS value FROM evu"


def _texts(d: Tables, **source) -> Session:
    """Events in files of words."""
    s = Session(d.spark)
    declared(s, "log", by_kind(d, "csv", sep=" "), "event_type={event_type:str}/*.csv", {"format": "text", "columns": _COLUMNS}, _FIELD, _INT, **source)
    return s


@query(_ALL)
def source_text(d):
    return shown(_texts(d).eval("log").field)


@query(f"{_ALL} WHERE event_type IN ('view', 'click') AND t >= 300000")
def source_pruned(d):
    s = _texts(d)
    got = s.eval("log", "event_type=['view','click'], t=300000:").field
    read = s.tables["log"].read_paths
    assert read and all("view" in p or "click" in p for p in read)
    return shown(got)


@query(_ALL)
def source_csv(d):
    s = Session(d.spark)
    reader = {"format": "csv", "header": True, "delimiter": ";", "rename": {"value": "amount"}, "columns": _COLUMNS}
    declared(s, "log", by_kind(d, "csv", sep=";", header="true"), "event_type={event_type:str}/*.csv", reader, _FIELD, _INT)
    return shown(s.eval("rename(log, amount=value)").field)


def _parquet(d: Tables, field: dict, **source) -> Session:
    s = Session(d.spark)
    declared(s, "log", by_kind(d, "parquet"), "event_type={event_type:str}/*.parquet", {"format": "parquet", "columns": _COLUMNS}, field, _INT, **source)
    return s


@query(_ALL)
def source_parquet(d):
    return shown(_parquet(d, _FIELD).eval("log").field)


@query(f"WITH {EVU} SELECT 'north' AS site, event_type, user_id, {rs('t / 3600')} AS hour, {rs('value * 2 + t / 1e5')} AS level FROM evu")
def source_computed_columns(d):
    s = _parquet(d, {"inputs": ["site", "event_type", "user_id", "hour"], "axis": "hour", "outputs": ["level"], "transform": {"hour": "t/3600"}, "map": {"level": "value*2+t/1e5"}}, constants={"site": "north"})
    return shown(s.eval("log").field)


@query(f"WITH {EVU} SELECT event_type, {rs('t', 5)} AS t, {rs('avg(value)', 5)} AS value FROM evu GROUP BY event_type, t")
def source_repeats_averaged(d):
    s = _parquet(d, {"inputs": ["event_type", "t"], "axis": "t", "outputs": ["value"], "duplicates": "mean"})
    return shown(s.eval("log").field, value=5)


_NATION = "SELECT n_nationkey::BIGINT AS nation, n_regionkey::DOUBLE AS region FROM nation"
_NATION_FIELD = {"inputs": ["nation"], "outputs": ["region"]}
_NATION_INT = {"nation": {"type": "int"}}


def _nations(d: Tables) -> np.ndarray:
    """The 25 nations, a table of fixed size."""
    return np.array([(r[0], r[1]) for r in d.raw("nation").select("n_nationkey", "n_regionkey").collect()], np.float64)


def _numbers(d: Tables, file: str, write, reader: dict) -> DataFrame:
    root = folder(d.spark)
    os.makedirs(root, exist_ok=True)
    write(os.path.join(root, file), _nations(d))
    s = Session(d.spark)
    declared(s, "nations", root, file, reader | {"columns": ["nation", "region"]}, _NATION_FIELD, _NATION_INT)
    return shown(s.eval("nations").field)


@query(_NATION)
def source_npy(d):
    return _numbers(d, "nations.npy", np.save, {"format": "npy"})


@query(_NATION)
def source_raw(d):
    return _numbers(d, "nations.bin", lambda path, a: a.astype(">f4").tofile(path), {"format": "raw", "dtype": "float32", "endian": "big"})


@query(f"{_NATION} WHERE n_nationkey >= 10")
def source_sqlite(d):
    root = folder(d.spark)
    os.makedirs(root, exist_ok=True)
    con = sqlite3.connect(os.path.join(root, "nations.db"))
    con.execute("CREATE TABLE nations (nation INTEGER, area REAL)")
    con.executemany("INSERT INTO nations VALUES (?, ?)", _nations(d).tolist())
    con.commit()
    con.close()
    s = Session(d.spark)
    s.add_table("nations", Table.declared("nations", {"source": {"locator": "sqlite", "root": root, "file": "nations.db", "table": "nations", "rename": {"area": "region"}}, "field": _NATION_FIELD, "columns": _NATION_INT}, root))
    return shown(s.eval("nations", "nation=10:").field)


# --- saved results -----------------------------------------------------------------------------


def _saving(d: Tables) -> Session:
    s = Session(d.spark)
    s.folder = folder(d.spark)
    return s


@query(SQL["reduce_max"])
def saved_result(d):
    """A result saved, and read as a dataset by its name."""
    s = _saving(d)
    s.register("evu", d.evu.df, ["user_id", "event_type"], "t")
    s.define("top", "max(evu, t)")
    s.save("top")
    return shown(s.eval("rename(top, top=value)").field, value=5)


def _accounts(d: Tables) -> tuple[Session, str]:
    """Accounts in debit, as files by nation."""
    s, root = _saving(d), folder(d.spark)
    _more_accounts(d, root, F.col("c_acctbal") < 0)
    declared(s, "accounts", root, "nation={nation:int}/*.csv", {"format": "text", "columns": ["custkey", "balance"]}, {"inputs": ["nation", "custkey"], "axis": "custkey"})
    return s, root


def _more_accounts(d: Tables, root: str, which) -> None:
    rows = d.customer.df.where(which).select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"))
    rows.write.partitionBy("nation").option("sep", " ").mode("append").csv(root)


def _by_nation(where: str) -> str:
    return f"SELECT c_nationkey::BIGINT AS nation, {rs('sum(c_acctbal)', 3)} AS total FROM customer WHERE {where} GROUP BY c_nationkey"


@query(_by_nation("c_acctbal < 0 OR c_nationkey < 5"))
def saved_result_refreshed(d):
    """Files are added for five nations; only what they reach is computed again."""
    s, root = _accounts(d)
    s.define("total", "sum(accounts, custkey)")
    s.save("total")
    _more_accounts(d, root, (F.col("c_acctbal") >= 0) & (F.col("c_nationkey") < 5))
    s.refresh("total")
    return shown(s.eval("total").field, total=3)


@query(
    "SELECT 0 AS step, 'total: fresh' AS line UNION ALL SELECT 1, 'total: stale' UNION ALL SELECT 3, 'total: fresh' UNION ALL SELECT 2, 'total: recomputed ' || "
    "count(DISTINCT CASE WHEN c_nationkey < 5 AND c_acctbal >= 0 THEN c_nationkey END) || ' of ' || count(DISTINCT CASE WHEN c_nationkey < 5 OR c_acctbal < 0 THEN c_nationkey END) || ' curves, ' || "
    "(count(DISTINCT CASE WHEN c_nationkey < 5 OR c_acctbal < 0 THEN c_nationkey END) - count(DISTINCT CASE WHEN c_nationkey < 5 AND c_acctbal >= 0 THEN c_nationkey END)) || ' unchanged' FROM customer"
)
def saved_result_states(d):
    """What status and refresh say, before and after files are added."""
    s, root = _accounts(d)
    s.define("total", "sum(accounts, custkey)")
    s.save("total")
    lines = s.status_lines()
    _more_accounts(d, root, (F.col("c_acctbal") >= 0) & (F.col("c_nationkey") < 5))
    lines += s.status_lines()
    lines += s.refresh("total")
    lines += s.status_lines()
    return d.spark.createDataFrame(list(enumerate(lines)), "step int, line string")


# --- exports -----------------------------------------------------------------------------------


@query(_ALL)
def export_parquet(d):
    s, path = Session(d.spark), f"{folder(d.spark)}/out.parquet"
    s.register("evu", d.evu.df, ["user_id", "event_type"], "t")
    s.export("evu", path)
    return shown(d.spark.read.parquet(path))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey::BIGINT AS c_custkey, " + rs("2 * c_acctbal") + " AS value FROM customer")
def export_csv(d):
    s, path = Session(d.spark), f"{folder(d.spark)}/out.csv"
    s.register("customer", d.customer.df, ["c_nationkey", "c_custkey"])
    s.export("2*customer.c_acctbal", path)
    return shown(d.spark.read.csv(path, header=True, schema="c_nationkey long, c_custkey long, value double"))


#: The queries of this module.
NAMES = [n for n in QUERIES if n not in _BEFORE]
