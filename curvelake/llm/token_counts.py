"""Token counts by a two-tier lookup on the map side.

The first tier is a compact table of frequent pre-tokens and their token
counts, broadcast to all tasks.  The second is each worker's own cache: a
pre-token that the table lacks is encoded once and remembered.  No pre-token
is ever shuffled: to find the frequent ones, each partition keeps a bounded
summary of its counts, and the summaries are merged in a tree.  The table
only saves time; the counts are those of the library either way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from curvelake.llm import bpe, common

#: Entries of a partition's summary, and of the merged one.
SUMMARY = 2048
TABLE = 4096
#: Summaries that one task of the tree merges.
FAN_IN = 32
CACHE = 300_000
LIMIT = 4096


def _shrink(counts: Counter, most: int) -> Counter:
    """The ``most`` largest, less the first that is left out (Misra and Gries)."""
    if len(counts) <= most:
        return counts
    top = counts.most_common(most + 1)
    off = top[-1][1]
    return Counter({k: v - off for k, v in top[:-1] if v > off}) or Counter(dict(top[:-1]))


def _pack(counts: Counter) -> dict:
    items = sorted(counts.items())
    return {"piece": [k for k, _ in items], "n": [v for _, v in items]}


def frequent(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Frequent pre-tokens over all texts: at most ``TABLE``."""
    schema = "part int, piece array<string>, n array<long>"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(bpe.pretokens(t))
                    if len(counts) > 64 * SUMMARY:
                        counts = _shrink(counts, 16 * SUMMARY)
        row = _pack(_shrink(counts, SUMMARY))
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "piece": pa.array([row["piece"]], pa.list_(pa.string())), "n": pa.array([row["n"]], pa.list_(pa.int64()))}
        )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for ks, ns in zip(pdf["piece"], pdf["n"], strict=True):
            counts.update(dict(zip(ks, map(int, ns), strict=True)))
        row = _pack(_shrink(counts, SUMMARY))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], "piece": [row["piece"]], "n": [row["n"]]})

    rows = docs.select(text_col).mapInArrow(summarise, schema)
    parts = docs.rdd.getNumPartitions()
    while parts > FAN_IN:
        rows = rows.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, schema)
        parts = -(-parts // FAN_IN)
    total: Counter = Counter()
    for r in rows.select("piece", "n").collect():  # at most FAN_IN bounded summaries
        total.update(dict(zip(r["piece"], r["n"], strict=True)))
    return [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:TABLE] if len(k) <= bpe.CACHED_CHARS]


def piece_count(sp, piece: str) -> int:
    """Tokens of one pre-token in its place."""
    if piece[0] == bpe.SPACE:
        return len(sp.encode(piece[1:].replace(bpe.SPACE, " "))) if len(piece) > 1 else 1
    if piece == "\n":
        return 1
    # After a line feed there is no space in front: what the feed and the space before it take is known.
    return len(sp.encode("\n" + piece)) - 2


_caches: dict[tuple, bpe.Recent] = {}


def counter(name: str, table):
    """A Pandas UDF from text to its number of tokens; ``table`` is a broadcast of the frequent pre-tokens' counts."""
    key = (name, table._jbroadcast.id())

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = _caches.get(key)
        if cache is None:
            sp = bpe.processor(bpe.model_path(name))
            _caches.clear()
            known = table.value
            cache = _caches[key] = bpe.Recent(lambda p: known.get(p) or piece_count(sp, p), CACHE)
        get = cache.__getitem__
        for s in batches:
            yield pd.Series([sum(map(get, bpe.pretokens(t))) if isinstance(t, str) else 0 for t in s], dtype="int64")

    return count


def token_counts(docs: DataFrame, *, model: str = "piece_bpe_32k.model", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens and ``over_limit`` of every whole text, one row for each row.

    An absent or empty text has no bytes and no tokens.  Control strings such
    as ``<s>`` inside a text are ordinary characters, as the library has it.
    Repeated rows are each counted; an empty table gives an empty result;
    other columns are not carried.
    """
    common.small_batches(docs.sparkSession)
    path = bpe.model_path(model)
    if not bpe.splittable(path):
        raise ValueError(f"{model}: its encoding does not split at spaces and line feeds")
    sp = bpe.processor(path)
    table = docs.sparkSession.sparkContext.broadcast({p: piece_count(sp, p) for p in frequent(docs, text_col)})
    t = F.col(text_col)
    return docs.select(F.col(id_col), F.octet_length(F.coalesce(t, F.lit(""))).cast("long").alias("n_bytes"), counter(model, table)(t).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
