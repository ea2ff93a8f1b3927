"""Document quality from a linear-chain conditional random field over lines.

Each line gets features of its own and of its two neighbours.  The field has
two labels, good and bad, with weights for the features and for each pair of
labels in a row; forward and backward sums give each line's chance of being
good.  Chances weighted by the lines' lengths make the document's quality.

Labels are of documents, not of lines.  Lines of a good document are good.  A
bad document's lines start as bad; after each fit those that the field finds
good are relabelled, but for the worst line of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from curvelake.llm import common
from curvelake.llm.toxicity import labelled_sample

#: Labelled rows that a fit reads at most, by class.
SAMPLE_ROWS = 1000
RELABELS = 3
STEPS = 150
L2 = 2e-3
#: Score from which a document counts as good.
BAR = 0.7
SYMBOLS = frozenset("#*$%&|<>!~^=+_\\{}[]@/")
ENDS = frozenset(".!?:;\"')")
N_OWN = 15


def lines_of(text: str | None) -> list[str]:
    """Lines with a word; a text without any has one empty line."""
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


def own_features(lines: list[str]) -> np.ndarray:
    """One row of ``N_OWN`` features for each line."""
    out = np.zeros((len(lines), N_OWN))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, chars = len(words), max(1, len(line))
        letters = sum(map(str.isalpha, line))
        upper = sum(map(str.isupper, line))
        digits = sum(map(str.isdigit, line))
        marks = sum(map(SYMBOLS.__contains__, line))
        kinds = len(set(words))
        ends = sum(w[-1] in ENDS for w in words)
        dressed = sum(w[-1] in SYMBOLS for w in words)
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[i] = (
            min(n, 60) / 30, n <= 3, letters / chars, upper / max(1, letters), digits / chars, marks / chars, marks > 0.05 * chars,
            kinds / max(1, n), repeats / max(1, n), ends / max(1, n), dressed / max(1, n), bool(words) and words[-1][-1] in ".!?",
            min(20, chars / max(1, n)) / 10, line in seen, bool(words) and line.strip()[0].isupper(),
        )
        seen.add(line)
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with its neighbours' beside them, and the lines' lengths."""
    lines = lines_of(text)
    own = own_features(lines)
    pad = np.zeros((1, N_OWN))
    before, after = np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad])
    ends = np.zeros((len(lines), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.column_stack([own, before, after, ends, np.ones(len(lines))]), np.array([max(1, len(x)) for x in lines], float)


class Field:
    """Weights of the two labels (0 bad, 1 good) and of label pairs; scale of features; link to the score."""

    def __init__(self, width: int):
        self.w = np.zeros(width)  # good against bad
        self.pair = np.zeros((2, 2))
        self.mean, self.dev = np.zeros(width), np.ones(width)
        self.link = np.array([4.0, 0.0])

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.dev) @ self.w


def _pack(unaries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(u) for u in unaries])
    m = np.zeros((int(lens.max()), len(unaries)))
    for j, u in enumerate(unaries):
        m[: len(u), j] = u
    return m, lens


def marginals(pair: np.ndarray, unaries: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Chances of good for each line, expected label pairs, and the summed log normaliser."""
    out: list[np.ndarray] = [np.zeros(0)] * len(unaries)
    pairs, logz = np.zeros((2, 2)), 0.0
    e_pair = np.exp(pair)
    order = sorted(range(len(unaries)), key=lambda i: -len(unaries[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(unaries[order[at]]))
        take = order[at : at + max(1, min(1024, 200_000 // longest))]
        at += len(take)
        u, lens = _pack([unaries[i] for i in take])
        steps, width = u.shape
        u = np.clip(u, -30, 30)
        pot = np.stack([np.exp(-u / 2), np.exp(u / 2)], 2)
        live = np.searchsorted(-lens, -np.arange(steps), side="left")
        alpha, scale = np.zeros((steps, width, 2)), np.ones((steps, width))
        for t in range(steps):
            n = live[t]
            a = pot[t, :n] if t == 0 else (alpha[t - 1, :n] @ e_pair) * pot[t, :n]
            s = a.sum(1)
            scale[t, :n], alpha[t, :n] = s, a / s[:, None]
        logz += float(np.log(scale).sum())
        beta = np.ones((width, 2))
        for t in range(steps - 1, -1, -1):
            if t + 1 < steps and live[t + 1]:
                q = live[t + 1]
                w = beta[:q] * pot[t + 1, :q] / scale[t + 1, :q, None]
                pairs += e_pair * (alpha[t, :q].T @ w)
                beta[:q] = w @ e_pair.T
            alpha[t, : live[t]] *= beta[: live[t]]
        for j, i in enumerate(take):
            out[i] = alpha[: lens[j], j, 1]
    return out, pairs, logz


def _fit_weights(field: Field, xs: list[np.ndarray], ys: list[np.ndarray]) -> None:
    """Full-batch gradient steps (Adam) on the likelihood of whole label sequences."""
    all_x = np.concatenate(xs)
    all_y = np.concatenate(ys)
    cuts = np.cumsum([len(x) for x in xs])[:-1]
    scaled = (all_x - field.mean) / field.dev
    # Rare labels weigh as much as frequent ones in the bias only; sequences stay as they are.
    n = len(all_y)
    seen_pairs = np.zeros((2, 2))
    for y in ys:
        np.add.at(seen_pairs, (y[:-1].astype(int), y[1:].astype(int)), 1)
    theta = np.concatenate([field.w, field.pair.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, _ = marginals(pair, np.split(scaled @ w, cuts))
        g = np.concatenate([scaled.T @ (all_y - np.concatenate(p)), (seen_pairs - pairs).ravel()]) / n - L2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field.w, field.pair = theta[:-4], theta[-4:].reshape(2, 2)


def qualities(field: Field, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Length-weighted chances of good of each document, and the lines' chances."""
    p, _, _ = marginals(field.pair, [field.unary(x) for x, _ in docs])
    return np.array([float(q @ n / n.sum()) for q, (_, n) in zip(p, docs, strict=True)]), p


def _link(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit(rows: list[tuple[str, int]]) -> Field:
    """From (text, label) rows.  With one class only, every document gets the same side."""
    docs = [features(t) for t, _ in rows]
    y = np.array([k for _, k in rows], float)
    field = Field(3 * N_OWN + 3)
    if not len(y) or y.min() == y.max():
        field.link = np.array([0.0, 3.0 if len(y) == 0 or y[0] == 1 else -3.0])
        return field
    xs = [x for x, _ in docs]
    flat = np.concatenate(xs)
    field.mean, field.dev = flat.mean(0), np.maximum(flat.std(0), 0.05)
    field.mean[-1], field.dev[-1] = 0.0, 1.0
    labels = [np.full(len(x), k) for x, k in zip(xs, y, strict=True)]
    for k in range(RELABELS):
        _fit_weights(field, xs, labels)
        if k + 1 < RELABELS:
            _, p = qualities(field, docs)
            for i in np.flatnonzero(y == 0):
                labels[i] = (p[i] > 0.5).astype(float)
                labels[i][p[i].argmin()] = 0.0
    q, _ = qualities(field, docs)
    x = _link(q)
    reps = max(1, round((y == 1).sum() / max(1, (y == 0).sum())))
    bad = y == 0
    w = common.logistic(np.concatenate([x] + [x[bad]] * (reps - 1))[:, None], np.concatenate([y] + [y[bad]] * (reps - 1)), l2=0.1)
    # The sides meet at one half there; the score has them meet at the bar.
    field.link = np.array([w[0], w[1] + np.log(BAR / (1 - BAR))])
    return field


def scores(field: Field, texts: list[str | None]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    q, _ = qualities(field, [features(t) for t in texts])
    return common.sigmoid(field.link[0] * _link(q) + field.link[1])


def scorer(field: Field):
    """A Pandas UDF from text to score."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scores(field, [t if isinstance(t, str) else None for t in s]), dtype="float64")

    return score


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit on a bounded sample: at most ``sample_rows`` labelled rows of either class."""
    return fit(labelled_sample(docs, labels, label, id_col, text_col, folds, held, sample_rows))


def classify(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2) -> DataFrame:
    """Score every whole text.

    One row for each row of ``docs``: id, ``held_out``, ``score`` in 0..1 and
    ``predicted`` (score >= 0.7).  An absent text is scored as an empty one,
    which has one empty line; repeated rows are each scored; an empty table
    gives an empty result; other columns are not carried.
    """
    common.small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col), (common.fold(id_col, folds) == held).alias("held_out"), scorer(field)(F.col(text_col)).alias("score")
    ).withColumn("predicted", (F.col("score") >= BAR).cast("int"))
