"""Steps whose work must be shared among tasks and bounded in memory, on tables small enough for a test."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from curvelake.llm import hmm
from curvelake.operators import relational  # noqa: F401
from curvelake.plans.tree import OPS, Context
from curvelake.session import Session
from curvelake.sources.frames import declare, field_of


def sides(spark, n=120):
    """Two tables of one file each, all of whose rows share one value."""
    a = spark.range(0, n, 1, 1).select(F.lit(3).cast("bigint").alias("k"), F.col("id").alias("a"), F.col("id").cast("double").alias("u"))
    b = spark.range(0, n, 1, 1).select(F.lit(3).cast("bigint").alias("k"), F.col("id").alias("b"), (F.col("id") * 2).cast("double").alias("v"))
    return a, b


def largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    return max(counts) / sum(counts)


def test_pairs_of_one_value_are_shared_among_tasks(spark):
    ctx = Context(spark)
    a, b = sides(spark)
    ints = {"k": "int", "a": "int", "b": "int"}
    f = OPS["join"]([field_of(ctx, "a", a, declare(["k", "a"], ["u"], dtypes=ints), "unique"), field_of(ctx, "b", b, declare(["k", "b"], ["v"], dtypes=ints), "unique")], labels=["a", "b"])
    assert largest_share(f.df) < 0.5
    got = [tuple(r) for r in f.df.select("k", "a", "b", "`a.u`", "`b.v`").collect()]
    assert sorted(got) == [(3, i, j, float(i), float(2 * j)) for i in range(120) for j in range(120)]


def test_expression_of_unshared_inputs_is_shared_among_tasks(spark):
    s = Session(spark)
    a, b = sides(spark)
    s.register("left", a, ["k", "a"])
    s.register("right", b, ["k", "b"])
    df = s.eval("left.u * right.v").field.df
    assert largest_share(df) < 0.5
    assert df.count() == 120 * 120 and df.agg(F.sum("value")).first()[0] == 2 * sum(range(120)) ** 2


def test_long_documents_of_many_batches_share_their_steps():
    """Steps of one Baum-Welch pass are those of the longest document, not of the longest one of each batch; counts are the same."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 40, n).astype("<u2") for n in [6000, 300, 90, 5] * 200]
    batches = [pa.record_batch([pa.array([d.tobytes() for d in docs[i : i + 8]], pa.binary())], ["classes"]) for i in range(0, len(docs), 8)]
    held = list(hmm._together(iter(batches), 0))
    assert sum(len(seqs) for _, seqs in held) == len(docs) and sum(len(b) for b, _ in held) == len(batches)
    assert sum(len(live) for _, seqs in held for _, _, live in hmm._groups(seqs, hmm.GROUP)) < 8000
    model = hmm.first_model(np.ones(40), hmm.STATES)
    together, apart = hmm.Expected(40, hmm.STATES), hmm.Expected(40, hmm.STATES)
    for _, seqs in held:
        together.add(model, seqs)
    for i in range(0, len(docs), 100):
        apart.add(model, docs[i : i + 100])
    assert np.allclose(together.emit, apart.emit, rtol=1e-9) and np.allclose(together.move, apart.move, rtol=1e-9) and np.isclose(together.log, apart.log)
