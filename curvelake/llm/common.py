"""Small helpers that the text operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake import ship

#: Rows and bytes of one Arrow batch at most; texts are long, so the default of 10,000 rows could be gigabytes.
ARROW_ROWS = 1024
ARROW_BYTES = 16 << 20
#: Most keys (8 bytes each) that are broadcast; more are joined by a shuffle.
MOST_KEYS = 1_000_000
#: Copies of a row that one task makes.
COPIES = 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch that goes to a Python worker, which must have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one that ``spark.checkpoint.dir`` names, else the context's
    checkpoint folder.  Only a local session that has neither, as in tests,
    gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="curvelake-")
    atexit.register(shutil.rmtree, made, True)
    sc.setCheckpointDir(made)
    return made


class Scratch:
    """Tables written to the shared folder, which cut lineage.

    A lost executor costs only the reading of files again.  ``drop`` removes
    what a loop no longer needs; what a returned frame still reads stays
    until the session's folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/curvelake-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def cut(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """All columns, and ``name``: 0, 1, ... among rows that are alike in all columns.

    Only repeated rows move.  They are counted with partial sums and made
    again from their counts, ``COPIES`` by a task, so a row that a third of
    the table repeats is neither sorted nor gathered.
    """
    columns = docs.columns
    digest, n, part = (free(f"{name}_{c}", columns) for c in ("hash", "n", "part"))
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    many = Scratch(docs.sparkSession, "repeats").cut(docs.groupBy(hashed.alias(digest)).count().where("count > 1").select(digest))
    hint = F.broadcast if many.count() <= MOST_KEYS else (lambda df: df)
    alone = docs.join(hint(many), hashed == F.col(digest), "left_anti").withColumn(name, F.lit(0).cast("long"))
    rest = docs.join(hint(many), hashed == F.col(digest), "left_semi").groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.count("*").alias(n))
    rest = rest.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES)))).repartition(hashed, F.col(part))
    last = F.least(F.col(n), (F.col(part) + 1) * COPIES) - 1
    return alone.unionByName(rest.withColumn(name, F.explode(F.sequence(F.col(part) * COPIES, last))).select(*columns, name))


def free(name: str, columns) -> str:
    """The name with as many ``_`` in front as columns of that name ask for."""
    while name in columns:
        name = "_" + name
    return name


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; an absent id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % k


def crc(value) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered: bytes methods touch ASCII only."""
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


def plain_words(text: str | None) -> list[bytes]:
    """The same words in their own case."""
    return [] if not text else text.encode("utf-8", "surrogatepass").split()


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton's method for a small logistic regression; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-9)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
