"""Mixing sources to target weights by Poisson replication, natively.

A source whose share must rise by the factor r gives each of its documents a
Poisson count of copies with mean r, drawn by inverting the distribution at a
uniform number that a keyed hash of the document makes.  The rows are
exploded by their counts and shuffled globally by a second keyed hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common

#: Means above this are split into equal draws, so that the table of the distribution stays short.
MOST_MEAN = 32.0
#: Entries of a table: beyond mean 32 the chance left is below 1e-16.
TABLE = 96
#: Most sources whose rates are sent to all tasks (about 900 bytes each); more are joined in salted parts.
MOST_SOURCES = 4000
SALTS = 64
HEX = 13


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts: 52 bits and a half."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX), 16, 10).cast("long")
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(16**HEX))


def rates(docs: DataFrame, *, source_col: str, weights: dict[str, float] | None, power: float, total: float) -> DataFrame:
    """``_source, n, weight, rate, draws, mean, cdf`` of each source.

    ``weights`` are the target shares; without them a source's share is its
    row count to the power ``power``.  Sources that ``weights`` does not name
    have rate 0.  The mixture has ``total`` times as many rows as ``docs`` on
    average.
    """
    n = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n"))
    if weights is not None:
        # Targets are a parameter of bounded size, so a literal map holds them.
        pairs = [x for k, v in sorted((weights or {}).items()) for x in (F.lit(k), F.lit(float(v)))]
        w = F.coalesce(F.create_map(*pairs)[F.coalesce("_source", F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0)
        n = n.withColumn("w", F.when(F.col("_source").isNull() & F.lit(None not in weights), F.lit(0.0)).otherwise(w))
    else:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    both = n.crossJoin(F.broadcast(n.agg(F.sum("w").alias("_w"), F.sum("n").alias("_n"))))  # one row of sums beside each source
    both = both.withColumn("weight", F.when(F.col("_w") > 0, F.col("w") / F.col("_w")).otherwise(F.lit(0.0)))
    both = both.withColumn("rate", F.col("weight") * F.col("_n") * F.lit(float(total)) / F.col("n"))
    both = both.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int"))
    both = both.withColumn("mean", F.col("rate") / F.col("draws"))
    zero = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)), F.array(zero),
        lambda a, k: F.concat(a, F.array(F.struct(
            (F.element_at(a, -1)["p"] * F.col("mean") / k).alias("p"),
            (F.element_at(a, -1)["c"] + F.element_at(a, -1)["p"] * F.col("mean") / k).alias("c"),
        ))),
    )
    return both.withColumn("cdf", F.transform(steps, lambda s: s["c"])).select("_source", "n", "weight", "rate", "draws", "mean", "cdf")


def mix(
    docs: DataFrame, *, weights: dict[str, float] | None = None, power: float = 0.5, total: float = 1.0, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, copied to the target weights and shuffled.

    All columns of ``docs`` stay; ``mix_copy`` (1 to the row's count) and
    ``mix_key`` (the position in the global order, a number in 0..1) are
    added, under names with ``_`` in front where ``docs`` has them already.
    Rows are hash-dealt by ``mix_key`` and sorted in each partition.  An absent
    source is a source of its own, which only ``power`` serves; absent ids and
    texts are hashed as such.  Rows alike in all columns are numbered and draw
    for themselves; rows alike in id and text only draw alike.  An empty table
    gives an empty result.
    """
    taken, columns = set(docs.columns), docs.columns

    def name(c: str) -> str:
        return common.free(c, taken)

    copy, key = name("mix_copy"), name("mix_key")
    per = rates(docs, source_col=source_col, weights=weights, power=power, total=total)
    src, cdf, draws, body, salt = (name(f"__{c}") for c in ("src", "cdf", "draws", "body", "salt"))
    per = per.select(F.col("_source").alias(src), F.col("cdf").alias(cdf), F.col("draws").alias(draws))
    few = docs.select(source_col).distinct().limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    number = name("__number")
    rows = common.numbered(docs, number)
    again = F.when(F.col(number) > 0, F.col(number).cast("string"))
    rows = rows.withColumn(body, F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.md5(F.col(text_col)), F.lit("-")), again)).drop(number)
    if few:
        rows = rows.join(F.broadcast(per), F.col(source_col).eqNullSafe(F.col(src)), "left")
    else:
        per = per.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt + "r", F.pmod(F.crc32(body), F.lit(SALTS)).cast("int"))
        rows = rows.join(per, F.col(source_col).eqNullSafe(F.col(src)) & (F.col(salt + "r") == F.col(salt)), "left").drop(salt, salt + "r")

    def draw(j: Column) -> Column:
        u = uniform(F.lit(f"n{seed}"), F.col(body), j.cast("string"))
        return F.size(F.filter(F.col(cdf), lambda c: c < u))

    count = F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda a, j: a + draw(j))
    rows = rows.withColumn(copy, F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn(key, uniform(F.lit(f"o{seed}"), F.col(body), F.col(copy).cast("string")))
    rows = rows.select(*columns, copy, key)
    return rows.repartition(F.col(key)).sortWithinPartitions(key)


def mix_sql(power: float = 0.5, total: float = 1.0, seed: int = 7) -> str:
    """The same mixture in DuckDB's SQL."""
    top = float(16**HEX)
    u = "(('0x' || substr(md5({0}), 1, %d))::BIGINT::DOUBLE + 0.5) / %r" % (HEX, top)
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, {power!r}) AS w FROM n),
s AS (SELECT sum(w) AS sw, sum(n) AS sn FROM w),
r AS (SELECT source, (w / sw) * sn::DOUBLE * {total!r} / n AS rate FROM w, s),
d AS (SELECT source, greatest(1, ceil(rate / {MOST_MEAN!r}))::INT AS draws, rate FROM r),
m AS (SELECT source, draws, rate / draws AS mean FROM d),
c AS (SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM m
      UNION ALL SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM c WHERE k < {TABLE}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) - 1 AS number FROM documents),
b AS (SELECT * EXCLUDE (number), coalesce(doc_id::VARCHAR, '-') || '|' || coalesce(md5(text), '-') || CASE WHEN number > 0 THEN '|' || number::VARCHAR ELSE '' END AS body FROM o),
j AS (SELECT b.doc_id, b.source, b.body, m.draws, unnest(range(1, m.draws + 1)) AS j FROM b JOIN m ON b.source IS NOT DISTINCT FROM m.source),
u AS (SELECT *, {u.format(f"'n{seed}|' || body || '|' || j::VARCHAR")} AS u FROM j),
q AS (SELECT u.doc_id, u.body, u.j, count(*) FILTER (WHERE c.c < u.u) AS k FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id, u.body, u.j),
t AS (SELECT doc_id, body, sum(k)::INT AS k FROM q GROUP BY doc_id, body),
e AS (SELECT doc_id, body, unnest(range(1, k + 1))::INT AS mix_copy FROM t WHERE k > 0)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, e.mix_copy, {u.format(f"'o{seed}|' || e.body || '|' || e.mix_copy::VARCHAR")} AS mix_key
FROM e JOIN b AS d ON d.doc_id IS NOT DISTINCT FROM e.doc_id AND d.body = e.body
"""
