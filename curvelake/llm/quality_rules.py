"""Quality rules by compression bands.

The zstandard ratio (bytes over compressed bytes) of a whole document and of
its fixed chunks must stay in a band that depends on the length: repetitive
text compresses too well, noise too badly.  Plain counting rules come first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from curvelake.llm import common

LEVEL = 3
CHUNK_BYTES = 4096
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: (bytes below, least ratio, greatest ratio); the last row has no upper length.
BANDS = (
    (128, 0.75, 1.55),
    (256, 0.85, 1.75),
    (512, 1.00, 2.00),
    (1024, 1.15, 2.15),
    (2048, 1.30, 2.25),
    (4096, 1.45, 2.35),
    (16384, 1.60, 2.52),
    (65536, 1.75, 2.70),
    (None, 1.80, 2.85),
)
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, chunk_low double, chunk_high double, kept boolean"
)


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a k-word window which occurs at least twice."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(n, bool)
    eq = s[1:] == s[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    if not same.any():
        return 0
    # Equal hashes are only candidates; the words themselves decide.
    at = np.sort(order[same]).tolist()
    seen = Counter(tuple(words[i : i + k]) for i in at)
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + k])] > 1:
            cover[i] += 1
            cover[i + k] -= 1
    return int((np.cumsum(cover) > 0).sum())


def band(n: int) -> tuple[float, float]:
    for most, low, high in BANDS:
        if most is None or n < most:
            return low, high
    raise AssertionError


def judge(text: str | None, pack) -> tuple:
    """All columns of SCHEMA for one text; an absent text has no words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    bare = data.translate(None, SPACE)
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").translate(None, SPACE)]
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    ratio = len(data) / pack(data) if data else 0.0
    low, high = band(len(data))
    fits = low <= ratio <= high
    chunks = []
    if len(data) > CHUNK_BYTES:
        # A short rest joins the chunk before it, whose band then is that of its own length.
        cuts = list(range(0, len(data) - CHUNK_BYTES // 2, CHUNK_BYTES))
        for i, a in enumerate(cuts):
            c = data[a : cuts[i + 1] if i + 1 < len(cuts) else len(data)]
            r = len(c) / pack(c)
            chunks.append((r, len(c)))
            lo, hi = band(len(c))
            fits = fits and lo <= r <= hi
    rs = [r for r, _ in chunks] or [ratio]
    return (
        n, len(text) - (len(data) - len(bare)), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        failed, ratio, min(rs), max(rs), not failed and fits,
    )


def verdict():
    """A Pandas UDF from text to the columns of SCHEMA."""

    @pandas_udf(SCHEMA)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for s in batches:
            rows = [judge(t if isinstance(t, str) else None, lambda b: len(c.compress(b))) for t in s]
            yield pd.DataFrame(rows, columns=names)

    return judged


def rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ratios and the verdict of every whole text, one row for each row.

    An absent or empty text has no words, fails the base rule and is not kept.
    Repeated rows are each judged; an empty table gives an empty result; other
    columns are not carried.
    """
    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), verdict()(F.col(text_col)).alias("v")).select(id_col, "v.*")


def keep(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""
    common.small_batches(docs.sparkSession)
    return docs.where(verdict()(F.col(text_col))["kept"])
