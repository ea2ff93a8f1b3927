"""Toxicity by compression distance.

Two zstandard dictionaries are made: one from ordinary text, one from toxic
text.  A window of words is compressed with either; text that the toxic
dictionary compresses better is toxic.  Limits are calibrated on labelled
documents that took no part in making the dictionaries.

Plain compression of a window cannot tell much: a byte-sized coder saves two
or three bytes on a telling word of five letters, as much as chance matches
vary.  So a window is first spelled out: each letter becomes four bytes that
depend on all the letters before it in its word.  A match then means that two
words begin alike, it saves four bytes a letter, and chance matches inside of
words vanish.  Beginnings that both classes have would fill either dictionary,
so they train a background that stands at the same distance in both; the rest
of each class's windows trains the part that is its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from curvelake.llm import common

WINDOW_WORDS = 16
LEVEL = 3
#: Bytes of a dictionary: the part that both share, and its own; and of the pieces that training picks.
BACKGROUND_BYTES = 24 << 10
CLASS_BYTES = 3 << 10
SEGMENT_BYTES = 16
#: Labelled rows that a fit reads at most, by class.
SAMPLE_ROWS = 2000
#: Words that are spelled at once; a multiple of the window, so that a long text can be taken in parts.
SLICE = WINDOW_WORDS * 4096
LETTER = 4

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)


def spell(data: np.ndarray) -> np.ndarray:
    """For each byte of words with a space before each: 32 bits from its word so far, by a polynomial over its bytes."""
    n = len(data)
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, _BACK))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[:n], dtype=np.uint64)])
    start = np.maximum.accumulate(np.where(data == 32, np.arange(n), 0))
    h = (sums[1:] - sums[start]) * down[start]
    h = (h ^ (h >> U(31))) * U(0x94D049BB133111EB)
    return (h >> U(32)).astype(np.uint32)


def slices(texts: list[str | None]) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The texts' words in groups of about ``SLICE``; a longer text is spread over several."""
    group, size = [], 0
    for i, t in enumerate(texts):
        words = common.lower_words(t)
        for a in range(0, max(1, len(words)), SLICE):
            part = words[a : a + SLICE]
            group.append((i, part))
            size += len(part) + 1
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def windows(words: list[list[bytes]], size: int = WINDOW_WORDS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Spelled windows of lists of words.

    Returns the spelled bytes, an (offset, length) row for each window, and
    the number of windows of each list; one without words has one that is
    empty but for a byte.
    """
    data = np.frombuffer(b"".join(b" " + b" ".join(w) for w in words if w) + b" ", np.uint8)
    coded = spell(data).tobytes()
    starts = np.append(np.flatnonzero(data == 32), len(data) - 1)[: sum(map(len, words)) + 1] * LETTER
    segments, counts, at = [], [], 0
    for w in words:
        n = len(w)
        cuts = np.append(np.arange(0, n, size), n) + at
        edge = starts[cuts] if n else np.array([0, 1])
        segments.append(np.column_stack([edge[:-1], np.diff(edge)]))
        counts.append(len(edge) - 1)
        at += n
    return coded, np.concatenate(segments).astype("<u8"), np.array(counts, np.int64)


def cut(coded: bytes, segments: np.ndarray) -> list[bytes]:
    return [coded[o : o + n] for o, n in segments.tolist()]


class Sizes:
    """Compressed lengths under one dictionary."""

    def __init__(self, content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW_WORDS * 6 * LETTER, dict_size=len(content), hash_log=17, chain_log=17,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        d.precompute_compress(compression_params=p)
        self.c = zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def __call__(self, coded: bytes, segments: np.ndarray) -> np.ndarray:
        b = self.c.multi_compress_to_buffer(zstandard.BufferWithSegments(coded, np.ascontiguousarray(segments).tobytes()), threads=1)
        return np.fromiter((len(b[i]) for i in range(len(b))), np.int64, len(segments))


def _apart(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones, whose private words would look telling."""
    seen: set[int] = set()
    out = []
    for t in texts:
        ws = common.lower_words(t)
        sh = {hash(tuple(ws[i : i + 4])) for i in range(max(1, len(ws) - 3))}
        if len(sh & seen) <= 0.3 * len(sh):
            out.append(t)
        seen |= sh
    return out


def _beginnings(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spelled texts, slice by slice: the number of each beginning of a word, and where windows start."""
    for group in slices(texts):
        coded, segments, _ = windows([w for _, w in group])
        yield np.frombuffer(coded, np.uint32), segments[:, 0].astype(np.int64) // LETTER


def _samples(texts: list[str], other: np.ndarray, shared: bool) -> list[bytes]:
    """Of each spelled window the beginnings that the other class has (``shared``) or has not."""
    out: list[bytes] = []
    for h, starts in _beginnings(texts):
        at = np.minimum(np.searchsorted(other, h), max(0, len(other) - 1))
        keep = (other[at] == h if len(other) else np.zeros(len(h), bool)) == shared
        edge = np.append(np.cumsum(keep) - keep, keep.sum())[np.append(starts, len(h))].tolist()
        kept = h[keep]
        out += [kept[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a zstandard dictionary trained on all samples; too few of them are their own dictionary."""
    samples = [x for x in samples if len(x) >= 8]
    if sum(map(len, samples)) > 4 * size and len(samples) >= 50:
        try:
            return zstandard.train_dictionary(size + 1024, samples, k=SEGMENT_BYTES, d=8, level=LEVEL).as_bytes()[-size:]
        except zstandard.ZstdError:  # samples too much alike to train on
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, of one length.

    Each is trained on the windows of its own texts, in two parts: beginnings
    of words that the other class has, too, train the background that both
    share, and the rest of the windows trains the part before it.
    """
    texts = {1: toxic, 0: ordinary}
    known = {y: np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.unique(h) for h, _ in _beginnings(ts))])) for y, ts in texts.items()}
    background = trained([x for y in texts for x in _samples(texts[y], known[1 - y], True)], BACKGROUND_BYTES)
    own = {y: trained(_samples(texts[y], known[1 - y], False), CLASS_BYTES) for y in texts}
    size = max(8, *map(len, own.values()))
    return tuple(_noise(size - len(own[y])) + own[y] + background for y in (1, 0))


def _noise(n: int) -> bytes:
    """Bytes that match nothing, so that both dictionaries are equally long."""
    return np.random.default_rng(7).bytes(n) if n else b""


class Model:
    """Two dictionaries, the window limit and the weights of the document score."""

    def __init__(self, toxic: bytes, ordinary: bytes, limit: float, weights: list[float]):
        self.toxic, self.ordinary, self.limit, self.weights = toxic, ordinary, limit, weights
        self._sizes = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_sizes"}

    def __setstate__(self, state):
        self.__dict__.update(state, _sizes=None)

    def gains(self, texts: list[str | None]) -> list[np.ndarray]:
        """Bytes that the toxic dictionary saves on each window of each text."""
        if self._sizes is None:
            self._sizes = Sizes(self.ordinary), Sizes(self.toxic)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for group in slices(texts):
            coded, segments, counts = windows([w for _, w in group])
            d = self._sizes[0](coded, segments) - self._sizes[1](coded, segments)
            for (i, _), x in zip(group, np.split(d, np.cumsum(counts)[:-1]), strict=True):
                out[i].append(x)
        return [np.concatenate(x) for x in out]

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 4))
        for i, x in enumerate(self.gains(texts)):
            over = int((x >= self.limit).sum())
            out[i] = min(x.max(), 40) / 10, np.clip(np.sort(x)[-3:], 0, 40).mean() / 10, math.log1p(over), over / math.sqrt(len(x))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        w = np.array(self.weights)
        return common.sigmoid(self.features(texts) @ w[:-1] + w[-1])


def fit(rows: list[tuple[str, int]]) -> Model:
    """From (text, label) rows; either class may be missing.

    Two thirds of the rows make the dictionaries, the others calibrate the
    window limit and the document score.
    """
    rows = [(t or "", int(y)) for t, y in rows]
    by = {y: [t for t, k in rows if k == y] for y in (0, 1)}
    half = {y: ([t for i, t in enumerate(by[y]) if i % 3], by[y][0::3]) for y in (0, 1)}
    model = Model(*dictionaries(_apart(half[1][0]), _apart(half[0][0])), 0.0, [0.0] * 5)
    cal = [(t, y) for y in (0, 1) for t in half[y][1]]
    y = np.array([k for _, k in cal], float)
    if not len(y) or y.min() == y.max():
        share = (sum(by_ for _, by_ in rows) + 0.5) / (len(rows) + 1) if rows else 0.1
        model.weights = [0.0] * 4 + [math.log(share / (1 - share))]
        return model
    best = np.array([g.max() for g in model.gains([t for t, _ in cal])])
    # The window limit: the one whose documents with any window over it part the classes best.
    limits = np.arange(3, 41)
    hit = np.array([(best[y == 1] >= q).mean() - (best[y == 0] >= q).mean() for q in limits])
    model.limit = float(limits[hit.argmax()])
    x = model.features([t for t, _ in cal])
    # Classes count alike, so 0.5 stands between them whatever their shares.
    reps = max(1, round((y == 0).sum() / max(1, (y == 1).sum())))
    xs, ys = np.concatenate([x] + [x[y == 1]] * (reps - 1)), np.concatenate([y] + [y[y == 1]] * (reps - 1))
    model.weights = common.logistic(xs, ys, l2=1.0).tolist()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, fold_of: int, held: int, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` training rows a class, by the order of a hash of the id.

    Rows without text, id or label and ids with both labels teach nothing; of
    an id with several texts the least counts.  The join is on the ids of the
    sample alone, so its size is bounded on both sides.
    """
    ids = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .where((F.crc32(F.col("_id").cast("string")) % fold_of) != held)
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y")
    )
    key = F.struct(F.md5(F.col("_id").cast("string")).alias("h"), "_id")
    picked = [ids.where(F.col("_y") == y).orderBy(key).limit(rows) for y in (0, 1)]
    got = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .where(F.col("_t").isNotNull())
        .join(F.broadcast(picked[0].unionByName(picked[1])), "_id")
        .groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id")
        .collect()
    )
    return [(r["_t"], r["_y"]) for r in got]


def scorer(model: Model):
    """A Pandas UDF from text to score."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.scores([t if isinstance(t, str) else None for t in s]), dtype="float64")

    return score


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample: at most ``sample_rows`` labelled rows of either class."""
    return fit(labelled_sample(docs, labels, label, id_col, text_col, folds, held, sample_rows))


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """Score every whole text.

    One row for each row of ``docs``: id, ``held_out``, ``score`` in 0..1 and
    ``predicted`` (score >= 0.5).  An absent text counts as empty and gets the
    score of an empty one; repeated rows are each scored; other columns are
    not carried; an empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col), (common.fold(id_col, folds) == held).alias("held_out"), scorer(model)(F.col(text_col)).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    common.small_batches(docs.sparkSession)
    return docs.where(scorer(model)(F.col(text_col)) < 0.5)
