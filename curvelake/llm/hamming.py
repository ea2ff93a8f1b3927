"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for each dimension: whether it is above zero.
Rows are dealt by a hash of their id into blocks of bounded size, queries
likewise, and each pair of blocks is searched by itself.  A block's codes are
indexed by the values of their m segments.  A query looks up its own segment
values first, then those at distance one, and so on; whatever it meets is
verified by its full distance.  After radius r in all segments every code
within distance m(r+1)-1 has been met, so the search ends once the k-th
verified distance is no more than that.  When a radius has more values than
the block has codes, the codes not yet met are verified directly, which covers
all distances.  The blocks' results are merged by query.

Codes that equal one another within a block are one index entry with the k
smallest of their ids, which is exact, since ties go by id: a code that a
third of all rows share costs one verification a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from curvelake.llm import common

K = 10
SEGMENTS = 4
#: Rows and queries of one block, on average.
BLOCK_ROWS = 16384
BLOCK_QUERIES = 256
#: Every row whose id this divides is a query of the contract.
EVERY = 50
WIDEST = 16


def coder():
    """A Pandas UDF from vector to packed bits; an absent vector has none, an absent element counts as zero."""

    @pandas_udf("binary")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if v is None else np.packbits(np.array(v, dtype=float) > 0).tobytes() for v in s], dtype=object)

    return code


def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` of them set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


class Index:
    """Distinct codes of a block, by the values of their segments."""

    def __init__(self, codes: np.ndarray, bits: int, segments: int):
        self.bits = bits
        m = min(bits, max(segments, -(-bits // WIDEST)))
        self.widths = [bits // m + (i < bits % m) for i in range(m)]
        self.codes, self.tables = codes, []
        for v, w in zip(self.values(codes), self.widths, strict=True):
            order = np.argsort(v, kind="stable")
            self.tables.append((order, np.searchsorted(v[order], np.arange((1 << w) + 1))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def values(self, codes: np.ndarray) -> list[np.ndarray]:
        b = np.unpackbits(codes, axis=1)[:, : self.bits].astype(np.int64)
        out, at = [], 0
        for w in self.widths:
            out.append(b[:, at : at + w] @ (1 << np.arange(w)))
            at += w
        return out

    def search(self, query: np.ndarray, values: list[int], sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Verified codes and their distances, covering the k nearest rows; ``sizes`` counts the rows of each code."""
        n, m = len(self.codes), len(self.widths)
        dist = np.full(n, -1, np.int32)
        for radius in range(max(self.widths) + 1):
            met = []
            for (order, starts), w, v in zip(self.tables, self.widths, values, strict=True):
                if radius > w:
                    continue
                key = (w, radius)
                if key not in self.masks:
                    self.masks[key] = masks(w, radius)
                if len(self.masks[key]) > n:
                    met = None
                    break
                at = v ^ self.masks[key]
                a, b = starts[at], starts[at + 1]
                full = b > a
                met += [order[x:y] for x, y in zip(a[full].tolist(), b[full].tolist(), strict=True)]
            new = np.flatnonzero(dist < 0) if met is None else np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            new = new[dist[new] < 0]
            dist[new] = np.bitwise_count(self.codes[new] ^ query).sum(1)
            got = dist >= 0
            if got.all():
                break
            covered = m * (radius + 1) - 1
            if sizes[got & (dist <= covered)].sum() >= k:
                break
        found = np.flatnonzero(dist >= 0)
        return found, dist[found]


def _distinct(ids: list, codes: list[bytes], k: int) -> tuple[np.ndarray, list[list]]:
    """Distinct codes with the k smallest ids of each."""
    by: dict[bytes, list] = {}
    for i, c in sorted(zip(ids, codes, strict=True), key=lambda x: x[0]):
        got = by.setdefault(c, [])
        if len(got) < k:
            got.append(i)
    return np.array([np.frombuffer(c, np.uint8) for c in by]), list(by.values())


def search_block(q_ids: list, q_codes: list[bytes], ids: list, codes: list[bytes], bits: int, segments: int, k: int) -> list[tuple]:
    """(query id, distance, id) of the k nearest rows of a block for each query."""
    own, members = _distinct(ids, codes, k)
    sizes = np.array([len(x) for x in members])
    index = Index(own, bits, segments)
    out, known = [], {}
    for q, c in zip(q_ids, q_codes, strict=True):
        if c not in known:
            code = np.frombuffer(c, np.uint8)
            found, dist = index.search(code, [int(v[0]) for v in index.values(code[None])], sizes, k)
            # Codes beyond the distance of the k-th row cannot take part.
            order = np.argsort(dist, kind="stable")
            last = dist[order][np.searchsorted(np.cumsum(sizes[found[order]]), k)] if sizes[found].sum() > k else bits
            near = [(int(d), i) for f, d in zip(found, dist, strict=True) if d <= last for i in members[f]]
            known[c] = sorted(near)[:k]
        out += [(q, d, i) for d, i in known[c]]
    return out


def _blocks(coded: DataFrame, n_blocks: int, name: str) -> DataFrame:
    """One row a block: its number and the (id, code) pairs, which a hash of the id deals evenly."""
    dealt = coded.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    return dealt.groupBy(name).agg(F.collect_list(F.struct("id", "code")).alias(f"{name}_rows"))


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = K, segments: int = SEGMENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query by Hamming distance, ties by id: query id, ``rank``, neighbour id, ``distance``.

    Rows without a vector or an id are neither found nor ask.  A query that is
    in ``rows`` is its own neighbour.  A repeated id counts once, with its
    smallest code; fewer than k rows give as many neighbours; empty tables
    give an empty result.  Vectors of different lengths are an error.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "hamming")
    q_name = f"query_{id_col}"
    id_type = dict(rows.dtypes)[id_col]

    def coded(df: DataFrame) -> DataFrame:
        got = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        got = got.select(F.col(id_col).alias("id"), F.size(vector_col).alias("bits"), coder()(F.col(vector_col)).alias("code"))
        return scratch.cut(got.groupBy("id").agg(F.min(F.struct("code", "bits")).alias("c")).select("id", "c.code", "c.bits"))

    everyone, asked = coded(rows), coded(queries)
    n, bits, other = everyone.agg(F.count("*"), F.max("bits"), F.min("bits")).first()
    n_asked, q_bits, q_other = asked.agg(F.count("*"), F.max("bits"), F.min("bits")).first()
    if not n or not n_asked or not bits:
        return spark.createDataFrame([], f"{q_name} {id_type}, rank int, {id_col} {id_type}, distance int")
    if {bits, other, q_bits, q_other} != {bits}:
        raise ValueError("vectors differ in length")
    n_blocks, n_q_blocks = -(-n // BLOCK_ROWS), -(-n_asked // BLOCK_QUERIES)
    left = _blocks(everyone, n_blocks, "block").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q_blocks - 1))))
    pairs = left.join(_blocks(asked, n_q_blocks, "q_block"), "q_block").repartition(n_blocks * n_q_blocks, "block", "q_block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rs, qs in zip(pdf["block_rows"], pdf["q_block_rows"], strict=True):
                got = search_block([x["id"] for x in qs], [bytes(x["code"]) for x in qs], [x["id"] for x in rs], [bytes(x["code"]) for x in rs], bits, segments, k)
                yield pd.DataFrame(got, columns=["q", "distance", "id"])

    found = pairs.select("block_rows", "q_block_rows").mapInPandas(run, f"q {id_type}, distance int, id {id_type}")
    # Each block gives a query k rows at most; their merge is bounded by the number of blocks.
    top = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("top"))
    return top.select(F.col("q").alias(q_name), F.posexplode("top").alias("pos", "t")).select(
        q_name, (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.id").alias(id_col), F.col("t.distance").cast("int").alias("distance")
    )


def every(rows: DataFrame, n: int = EVERY, id_col: str = "vec_id") -> Column:
    return F.col(id_col) % n == 0


def top_k_sql(k: int = K, n: int = EVERY) -> str:
    """The same by comparing every query with every row, in DuckDB's SQL."""
    return f"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_vec_id, r.vec_id, list_sum(list_transform(list_zip(q.b, r.b), lambda z: abs(z[1] - z[2])))::INT AS distance
      FROM c q, c r WHERE q.vec_id % {n} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY distance, vec_id)::INT AS rank FROM d)
SELECT query_vec_id, rank, vec_id, distance FROM r WHERE rank <= {k}
"""
