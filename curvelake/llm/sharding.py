"""Shards by a keyed permutation.

Rows have global numbers 0..n-1 in the order of their ids.  A Feistel network
over the digits of a two-digit mixed radix permutes a domain just above n;
numbers that leave 0..n-1 walk along their cycle until they are back.  The
permuted number p gives shard ``p mod k`` and slot ``p div k``, so shards
differ by one row at most, slots have no gaps, and any place can be computed
from a row number, or a row number from a place, without data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common

ROUNDS = 6
PRIME = 2147483647
#: Steps of one walk.  The domain exceeds n by less than its side, so a walk this long has a chance below (1/64)**64; it would be an error, never a wrong place.
WALK = 64


def keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an addend below the prime for each round, by a fixed recurrence."""
    out, x = [], (seed * 48271 + 11) % PRIME or 1
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            x = x * 48271 % PRIME
            pair.append(x)
        out.append((pair[0] or 1, pair[1]))
    return out


def sides(n: int) -> tuple[int, int]:
    """The radix of the high and of the low digit: their product is the domain."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _mix(x: int, key: tuple[int, int]) -> int:
    y = (x * key[0] + key[1]) % PRIME
    return y * y % PRIME


def permute(x: int, n: int, seed: int) -> int:
    """The place of row x among n."""
    a, b = sides(n)
    ks = keys(seed)
    while True:
        hi, lo = divmod(x, b)
        for i, k in enumerate(ks):
            if i % 2 == 0:
                hi = (hi + _mix(lo, k)) % a
            else:
                lo = (lo + _mix(hi, k)) % b
        x = hi * b + lo
        if x < n:
            return x


def row_at(place: int, n: int, seed: int) -> int:
    """The row at a place: the inverse of ``permute``."""
    a, b = sides(n)
    ks = keys(seed)
    x = place
    while True:
        hi, lo = divmod(x, b)
        for i in range(ROUNDS - 1, -1, -1):
            if i % 2 == 0:
                hi = (hi - _mix(lo, ks[i])) % a
            else:
                lo = (lo - _mix(hi, ks[i])) % b
        x = hi * b + lo
        if x < n:
            return x


def _network(x: Column, n: int, seed: int) -> Column:
    a, b = sides(n)
    state = F.struct(F.floor(x / F.lit(b)).cast("long").alias("hi"), (x % F.lit(b)).alias("lo"))
    steps = F.array(*[F.struct(F.lit(i % 2).alias("odd"), F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c")) for i, (m, c) in enumerate(keys(seed))])

    def turn(s: Column, k: Column) -> Column:
        y = F.pmod(F.when(k["odd"] == 0, s["lo"]).otherwise(s["hi"]) * k["m"] + k["c"], F.lit(PRIME).cast("long"))
        z = F.pmod(y * y, F.lit(PRIME).cast("long"))
        return F.struct(
            F.when(k["odd"] == 0, F.pmod(s["hi"] + z, F.lit(a).cast("long"))).otherwise(s["hi"]).alias("hi"),
            F.when(k["odd"] == 0, s["lo"]).otherwise(F.pmod(s["lo"] + z, F.lit(b).cast("long"))).alias("lo"),
        )

    return F.aggregate(steps, state, turn, lambda s: s["hi"] * F.lit(b).cast("long") + s["lo"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """``permute`` as a native expression over a long column."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), F.lit(-1).cast("long"),
        lambda s, i: F.when((s >= 0) & (s < n), s).otherwise(_network(F.when(s < 0, x).otherwise(s), n, seed)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, order: list[str], scratch: common.Scratch) -> tuple[DataFrame, int]:
    """Adds ``row_no`` 0..n-1 in a total order; rows that tie in all of it are alike.

    A range shuffle and a sort in each partition; the written table fixes the
    places, and only the partitions' counts reach the driver.
    """
    keys_ = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(*keys_).sortWithinPartitions(*keys_).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.cut(placed)
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    if not starts:
        return placed.withColumn("row_no", F.col("_at")).drop("_at"), 0
    spark = df.sparkSession
    first = spark.createDataFrame(starts, "_p long, _start long")
    out = placed.withColumn("_p", part).join(F.broadcast(first), "_p").withColumn("row_no", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return out.drop("_p", "_start", "_at"), at


def shards(docs: DataFrame, *, n_shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row under the law ``rows``.

    Rows are numbered by id (absent ids first), then by the text's checksum
    and size; only these narrow columns are shuffled.  Rows alike in all of
    them are interchangeable and get places of their own.  An absent text has
    no bytes: size 8, checksum 0.  ``grown_shard`` is null, as it is for this
    law; an empty table gives an empty result; other columns are not carried.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"))
    numbered, n = number_rows(narrow, ["_id", "text_crc32", "size"], common.Scratch(docs.sparkSession, "shards"))
    p = permuted(F.col("row_no"), max(n, 1), seed)
    return numbered.withColumn("_p", p).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_p") % n_shards).cast("int").alias("shard"), F.floor(F.col("_p") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


#: The remainders of the checksum's polynomial for four bits.
NIBBLES = [0]
for _i in range(1, 16):
    _c = _i
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    NIBBLES.append(_c)


def shards_sql(n_shards: int = 24, seed: int = 20) -> str:
    """The same shards in DuckDB's SQL: the checksum by half bytes, the walk by recursion."""
    step = f"xor(({NIBBLES}::BIGINT[])[(xor(c, x) & 15) + 1], c >> 4)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, nib), lambda c, x: {step}), 4294967295::BIGINT)"
    inner = "SELECT r, (CASE WHEN p < 0 THEN r ELSE p END) // b AS hi, (CASE WHEN p < 0 THEN r ELSE p END) % b AS lo, a, b, n FROM walk WHERE p < 0 OR p >= n"
    for i, (m, k) in enumerate(keys(seed)):
        src, dst, mod = ("lo", "hi", "a") if i % 2 == 0 else ("hi", "lo", "b")
        other = "lo" if dst == "hi" else "hi"
        y = f"(({src} * {m} + {k}) % {PRIME})"
        inner = f"SELECT r, ({dst} + ({y} * {y}) % {PRIME}) % {mod} AS {dst}, {other}, a, b, n FROM ({inner})"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
x AS (SELECT doc_id, octet_length(bytes)::BIGINT + 8 AS size, string_split(hex(bytes), '') AS h FROM t),
y AS (SELECT doc_id, size, CASE WHEN size = 8 THEN []::BIGINT[] ELSE list_transform(range(1, len(h) + 1), lambda i: (instr('0123456789ABCDEF', h[i + 2 * (i % 2) - 1]) - 1)::BIGINT) END AS nib FROM x),
z AS (SELECT doc_id, size, {crc} AS text_crc32 FROM y),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS n FROM z),
d AS (SELECT *, floor(sqrt(greatest(n - 1, 0)))::BIGINT + 1 AS a FROM r),
e AS (SELECT *, greatest((n + a - 1) // a, 1) AS b FROM d),
walk AS (SELECT r, -1::BIGINT AS p, a, b, n FROM e UNION ALL SELECT r, hi * b + lo AS p, a, b, n FROM ({inner})),
f AS (SELECT r, p FROM walk WHERE p >= 0 AND p < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {n_shards})::INT AS shard, p // {n_shards} AS slot, NULL::INT AS grown_shard FROM e JOIN f USING (r)
"""
